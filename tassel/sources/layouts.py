"""Upload layouts: which columns a file may have, which are required, and the upsert key."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENT, TENTATIVE = 0.6, 0.3


@dataclass(frozen=True)
class Layout:
    id: str
    label: str
    target: str
    key: tuple[str, ...]
    required: tuple[str, ...]
    columns: tuple[str, ...]
    numeric: tuple[str, ...] = ()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    recodes: dict[str, dict[str, str]] = field(default_factory=dict)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def names_of(self, column: str) -> list[str]:
        return [column, *self.aliases.get(column, ())]

    @property
    def optional(self) -> list[str]:
        return [c for c in self.columns if c not in self.required]


# Code to label tables of the submission layouts.
ENROLLMENT_TYPE = {"F": "First-Time", "R": "Re-admit", "T": "Transfer-In"}
RACE = {
    "W": "White",
    "B": "Black or African American",
    "A": "Asian",
    "AN": "American Indian or Alaska Native",
    "IA": "American Indian or Alaska Native",
    "HP": "Native Hawaiian or Other Pacific Islander",
    "TM": "Two or More Races",
    "UK": "Unknown",
}
ETHNICITY = {"H": "Hispanic", "N": "Not Hispanic", "UK": "Unknown"}
GENDER = {"M": "Male", "F": "Female", "P": "Non-binary", "X": "Other", "UK": "Unknown"}

# The five layouts. Column names are normalized headers.
_STUDENT_TABLE, _COURSE_TABLE = "student_level_with_predictions", "course_enrollments"
_COURSE_KEY = ("student_guid", "course_prefix", "course_number", "academic_term", "academic_year")
LAYOUTS = [
    Layout(
        id="pdp_cohort_ar",
        label="PDP Cohort AR File",
        target=_STUDENT_TABLE,
        key=("student_guid",),
        required=("student_guid", "cohort", "cohort_term", "enrollment_type"),
        columns=(
            "student_guid",
            "institution_id",
            "cohort",
            "cohort_term",
            "student_age",
            "enrollment_type",
            "enrollment_intensity_first_term",
            "race",
            "ethnicity",
            "gender",
            "first_gen",
            "pell_status_first_year",
            "math_placement",
            "english_placement",
            "reading_placement",
            "gateway_math_status",
            "gateway_english_status",
            "credential_type_sought_year_1",
            "gpa_group_term_1",
            "gpa_group_year_1",
            "number_of_credits_attempted_year_1",
            "number_of_credits_earned_year_1",
            "number_of_credits_attempted_year_2",
            "number_of_credits_earned_year_2",
            "retention",
            "persistence",
            "time_to_credential",
            "years_to_bachelors_at_cohort_inst_",
            "years_to_associates_or_certificate_at_cohort_inst_",
            "school",
            "dataset_type",
        ),
        numeric=(
            "number_of_credits_attempted_year_1", "number_of_credits_earned_year_1",
            "number_of_credits_attempted_year_2", "number_of_credits_earned_year_2",
            "retention", "persistence",
        ),
        aliases={"student_guid": ("student_id",)},
        allowed={"cohort_term": ("Fall", "Winter", "Spring", "Summer")},
    ),
    Layout(
        id="pdp_cohort_submission",
        label="PDP Cohort Submission File",
        target=_STUDENT_TABLE,
        key=("student_guid",),
        required=("student_guid", "cohort", "cohort_term", "enrollment_type"),
        columns=(
            "student_guid",
            "cohort",
            "cohort_term",
            "first_name",
            "last_name",
            "date_of_birth",
            "enrollment_type",
            "race",
            "ethnicity",
            "gender",
            "math_placement",
            "english_placement",
            "gateway_math_status",
            "gateway_english_status",
            "first_gen",
            "dual_and_summer_enrollment",
        ),
        aliases={"student_guid": ("student_id",)},
        recodes={"enrollment_type": ENROLLMENT_TYPE, "race": RACE, "ethnicity": ETHNICITY, "gender": GENDER},
    ),
    Layout(
        id="course_ar",
        label="Course Enrollment AR File",
        target=_COURSE_TABLE,
        key=_COURSE_KEY,
        required=("student_guid", "academic_year", "academic_term", "course_prefix", "course_number", "grade"),
        columns=(
            "student_guid",
            "cohort",
            "cohort_term",
            "academic_year",
            "academic_term",
            "course_prefix",
            "course_number",
            "section_id",
            "course_name",
            "course_cip",
            "course_type",
            "math_or_english_gateway",
            "grade",
            "number_of_credits_attempted",
            "number_of_credits_earned",
            "delivery_method",
            "course_begin_date",
            "course_end_date",
            "student_age",
            "race",
            "ethnicity",
            "gender",
            "institution_id",
            "school",
        ),
        numeric=("number_of_credits_attempted", "number_of_credits_earned"),
        aliases={"student_guid": ("student_id",)},
    ),
    Layout(
        id="course_submission",
        label="Course Enrollment Submission File",
        target=_COURSE_TABLE,
        key=_COURSE_KEY,
        required=("student_guid", "academic_year", "academic_term", "course_prefix", "course_number", "grade"),
        columns=(
            "student_guid",
            "cohort",
            "cohort_term",
            "academic_year",
            "academic_term",
            "course_prefix",
            "course_number",
            "section_id",
            "course_name",
            "course_cip",
            "course_type",
            "grade",
            "number_of_credits_attempted",
            "number_of_credits_earned",
            "first_name",
            "last_name",
            "date_of_birth",
            "semester_session_gpa",
            "overall_gpa",
        ),
        numeric=("number_of_credits_attempted", "number_of_credits_earned", "semester_session_gpa", "overall_gpa"),
        aliases={"student_guid": ("student_id",), "academic_term": ("term",)},
    ),
    Layout(
        id="ml_predictions",
        label="ML Predictions",
        target=_STUDENT_TABLE,
        key=("student_guid",),
        required=("student_guid", "prediction_type", "prediction_value"),
        columns=("student_guid", "prediction_type", "prediction_value", "model_version", "confidence_score"),
        numeric=("confidence_score",),
        aliases={"student_guid": ("student_id",), "confidence_score": ("confidence",)},
    ),
]
BY_ID = {layout.id: layout for layout in LAYOUTS}

# Personal columns of the submission layouts that never reach a student table.
PERSONAL_COLUMNS = ["first_name", "last_name", "date_of_birth"]

# Course columns named differently by uploads and by the enrollment table.
COURSE_RENAMES = {
    "math_or_english_gateway": "gateway_type",
    "number_of_credits_attempted": "credits_attempted",
    "number_of_credits_earned": "credits_earned",
    "co_requisite_course": "is_co_requisite",
    "core_course": "is_core_course",
    "course_instructor_employment_status": "instructor_status",
}


def normalize_header(header: str) -> str:
    return re.sub(r"[\s\-]+", "_", header.strip().lower().replace("/", "_"))


def normalized(header: Column) -> Column:
    """normalize_header for a column of header texts."""
    return F.regexp_replace(F.replace(F.lower(F.trim(header)), F.lit("/"), F.lit("_")), r"[\s\-]+", "_")


def alias_rows() -> list[tuple[str, str, str, int]]:
    """(layout id, accepted header, column, 1 if required) for every layout."""
    return [
        (layout.id, name, column, int(column in layout.required))
        for layout in LAYOUTS
        for column in layout.columns
        for name in layout.names_of(column)
    ]
