"""Readiness records and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import readiness as r
from ..functions.numeric import ordinal, percent

# Identity of the rule set written with every record.
SOURCE = "rule_engine"
MODEL_VERSION = "rules_v1"


def with_readiness(scored: DataFrame) -> DataFrame:
    """Sub-scores, score and level beside the student columns."""
    raw = scored.withColumns(
        {
            "academic_score": r.academic_score(),
            "engagement_score": r.engagement_score(),
            "model_score": r.model_score(),
            "readiness_raw": r.readiness_raw(),
        }
    )
    return raw.withColumns({"readiness_score": r.stored_score(), "readiness_level": r.readiness_level()})


def readiness_records(
    scored: DataFrame, run_id: str | None = None, model_name: str = "Readiness Rule Engine v1"
) -> DataFrame:
    """One record per student ready to be stored; lists and the input profile are JSON text."""
    rows = with_readiness(scored)
    blank = F.lit("")
    return rows.select(
        "student_guid",
        F.coalesce("institution_id", blank).alias("institution_id"),
        F.coalesce("cohort", blank).alias("cohort"),
        F.coalesce("cohort_term", blank).alias("cohort_term"),
        F.col("readiness_score").cast("decimal(5,4)").alias("readiness_score"),
        "readiness_level",
        r.rationale().alias("rationale"),
        F.to_json(r.risk_factors()).alias("risk_factors"),
        F.to_json(r.suggested_actions()).alias("suggested_actions"),
        F.lit(model_name).alias("model_name"),
        F.current_timestamp().alias("generated_at"),
        F.lit(SOURCE).alias("source"),
        F.lit(MODEL_VERSION).alias("model_version"),
        F.to_json(r.safe_profile(), {"ignoreNullFields": "false"}).alias("input_features"),
        F.lit(run_id).cast("string").alias("run_id"),
    )


# Inputs the score reads as numbers.
NUMERIC_INPUTS = [
    "gpa_group_year_1",
    "number_of_credits_earned_year_1",
    "course_completion_rate",
    "passing_rate",
    "total_courses_enrolled",
    "failing_grades_count",
    "retention_probability",
]


# Why a row cannot be scored. Texts name whole credits and courses, so these must be finite
# wherever they are written out: credits when below the milestone, courses always.
NOT_FINITE = "cannot convert float infinity to integer"


def split_scorable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to score with typed inputs, rows that cannot be scored with the ``error``).

    Blank, unparsable and NaN inputs are missing values and are scored as such.
    """
    present = [c for c in NUMERIC_INPUTS if c in rows.columns]
    number = {c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in present}
    typed = rows.withColumns(number)
    endless = F.lit(float("inf"))
    failing = [
        test
        for column, test in (
            ("number_of_credits_earned_year_1", F.col("number_of_credits_earned_year_1") == -endless),
            ("total_courses_enrolled", F.abs("total_courses_enrolled") == endless),
        )
        if column in present
    ]
    error = F.coalesce(*[F.when(t, F.lit(NOT_FINITE)) for t in failing]) if failing else F.lit(None).cast("string")
    checked = typed.withColumn("error", error)
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())


def _select(readiness: DataFrame, students: DataFrame | None, filters: dict) -> DataFrame:
    """Filters on the records; the join to students is planned only when a student filter is given."""
    out = readiness
    for column, name in (("institution_id", "institution"), ("cohort", "cohort"), ("readiness_level", "level")):
        if filters.get(name):
            out = out.filter(F.col(column) == filters[name])
    wanted = {
        "enrollment_intensity_first_term": filters.get("enrollment_type"),
        "predicted_credential_label": filters.get("credential_type"),
    }
    wanted = {c: v for c, v in wanted.items() if v}
    if wanted:
        keys = students
        for column, value in wanted.items():
            keys = keys.filter(F.col(column) == value)
        out = out.join(keys.select("student_guid"), "student_guid")
    return out


def select_readiness(readiness: DataFrame, students: DataFrame | None = None, **filters: str | None) -> DataFrame:
    return _select(readiness, students, filters)


def _levels() -> list:
    return [F.count_if(F.col("readiness_level") == name).alias(f"{name}_count") for name in r.LEVEL_ORDER]


def _score() -> Column:
    return F.col("readiness_score").cast("double")


def readiness_summary(readiness: DataFrame) -> DataFrame:
    return readiness.agg(
        F.count("*").alias("total_students"),
        F.round(F.coalesce(F.avg(_score()), F.lit(0.0)), 4).alias("avg_score"),
        F.coalesce(F.min(_score()), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.max(_score()), F.lit(0.0)).alias("max_score"),
        *_levels(),
    )


def readiness_by_level(readiness: DataFrame) -> DataFrame:
    return (
        readiness.groupBy("readiness_level")
        .agg(
            F.count("*").alias("count"),
            F.round(F.avg(_score()), 6).alias("avg_score"),
            F.min(_score()).alias("min_score"),
            F.max(_score()).alias("max_score"),
        )
        .orderBy(ordinal("readiness_level", r.LEVEL_ORDER))
    )


def score_range() -> Column:
    s = _score()
    return (
        F.when(s >= 0.8, "0.8-1.0")
        .when(s >= 0.6, "0.6-0.8")
        .when(s >= 0.4, "0.4-0.6")
        .when(s >= 0.2, "0.2-0.4")
        .otherwise("0.0-0.2")
    )


def readiness_histogram(readiness: DataFrame) -> DataFrame:
    return (
        readiness.groupBy(score_range().alias("score_range"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("score_range"))
    )


def readiness_by_cohort(readiness: DataFrame) -> DataFrame:
    return (
        readiness.groupBy("cohort")
        .agg(F.count("*").alias("total"), F.round(F.avg(_score()), 6).alias("avg_score"), *_levels())
        .orderBy(F.desc_nulls_first("cohort"))
    )


def readiness_by_major(readiness: DataFrame, students: DataFrame) -> DataFrame:
    programs = students.select("student_guid", "program_of_study_year_1")
    return (
        readiness.select("student_guid", "readiness_score")
        .join(programs, "student_guid")
        .groupBy("program_of_study_year_1")
        .agg(F.count("*").alias("students"), F.round(F.avg(_score()), 6).alias("avg_score"))
    )


def top_risk_factors(readiness: DataFrame, k: int | None = None) -> DataFrame:
    """Most common factors (the first ``k`` if given); text that is no JSON list is skipped."""
    lists = F.from_json("risk_factors", "array<string>", {"mode": "PERMISSIVE"})
    counted = (
        readiness.select(F.explode(lists).alias("factor"))
        .filter(F.col("factor").isNotNull())
        .groupBy("factor")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "factor")
    )
    return counted if k is None else counted.limit(k)


def recent_assessments(readiness: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest records first (the first ``limit`` if given), lists parsed."""
    empty = F.array().cast("array<string>")
    newest = readiness.orderBy(F.desc_nulls_first("generated_at"), "student_guid")
    newest = newest if limit is None else newest.limit(limit)
    return newest.withColumns(
        {
            c: F.coalesce(F.from_json(c, "array<string>"), empty)
            for c in ("risk_factors", "suggested_actions")
        }
    )


def readiness_extract(readiness: DataFrame) -> DataFrame:
    """Level and score-range tables with percent of all records, from one pass over the records.

    Records are counted by level and range; the few counts are then added up both ways in a single row.
    """
    cells = (
        readiness.groupBy("readiness_level", score_range().alias("score_range"))
        .agg(F.count("*").alias("n"))
        .agg(F.collect_list(F.struct("readiness_level", "score_range", "n")).alias("cells"), F.sum("n").alias("total"))
    )
    each = cells.select("total", F.explode("cells").alias("c"))
    rows = each.select(
        "total",
        F.explode(
            F.array(
                F.struct(F.lit("level").alias("section"), F.col("c.readiness_level").alias("label"), F.col("c.n").alias("n")),
                F.struct(F.lit("score_range").alias("section"), F.col("c.score_range").alias("label"), F.col("c.n").alias("n")),
            )
        ).alias("x"),
    )
    return (
        rows.groupBy("x.section", "x.label", "total")
        .agg(F.sum("x.n").alias("count"))
        .select("section", "label", "count", percent("count", "total").alias("percentage"))
    )
