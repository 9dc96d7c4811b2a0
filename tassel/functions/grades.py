"""Grade codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

# Points per letter grade.
GRADE_POINTS = {
    "A+": 4.0, "A": 4.0, "A-": 3.7,
    "B+": 3.3, "B": 3.0, "B-": 2.7,
    "C+": 2.3, "C": 2.0, "C-": 1.7,
    "D+": 1.3, "D": 1.0, "D-": 0.7,
    "F": 0.0, "P": 3.0, "S": 3.0,
}
# Grades that count as failing in the student features.
FAILING = ["F", "W", "WF", "WN", "FN", "U", "I", "E"]
# Grades that count as D/F/W/I in the course reports.
DFWI = ["D", "F", "W", "I"]


def grade_points(grade: Column | str = "grade") -> Column:
    table = F.create_map(*[F.lit(v) for pair in GRADE_POINTS.items() for v in pair])
    return F.try_element_at(table, as_col(grade))


def is_failing(grade: Column | str = "grade") -> Column:
    return F.coalesce(as_col(grade).isin(FAILING), F.lit(False))


def is_passing(grade: Column | str = "grade") -> Column:
    """Any grade that is present and not failing."""
    g = as_col(grade)
    return g.isNotNull() & ~g.isin(FAILING)


def is_dfwi(grade: Column | str = "grade") -> Column:
    return F.coalesce(as_col(grade).isin(DFWI), F.lit(False))


def is_course_pass(grade: Column | str = "grade") -> Column:
    """Present, not blank and not D/F/W/I."""
    g = as_col(grade)
    return F.coalesce((g != "") & ~g.isin(DFWI), F.lit(False))
