"""Rule-based readiness: sub-scores, score, level, risk factors, actions, rationale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import fixed_text, half_even, missing_to_null

# Weights, level thresholds and alert components.
WEIGHTS = {"academic": 0.40, "engagement": 0.30, "model": 0.30}
LEVEL_HIGH, LEVEL_MEDIUM = 0.65, 0.40
ALERT_COMPONENT = {"URGENT": 0.1, "HIGH": 0.3, "MODERATE": 0.6, "LOW": 0.9}
LEVEL_ORDER = ["high", "medium", "low"]

# Codes as they arrive in the data.
DONE_CODES = ["1", "Y", "YES", "TRUE", "C"]
FULL_TIME_CODES = ["FT", "FULL-TIME", "FULL TIME", "FULL_TIME"]
PART_TIME_CODES = ["PT", "PART-TIME", "PART TIME", "PART_TIME", "LE", "LESS THAN HALF TIME"]

# Wording of factors and actions.
FACTOR_TEXT = {
    "gpa": "Low first-year GPA (%s / 4.0)",
    "failing": "High course failure rate (%s%% of courses failed)",
    "part_time": "Part-time enrollment reduces success probability",
    "math": "Gateway math not completed in Year 1",
    "english": "Gateway English not completed in Year 1",
    "credits": "Below 12-credit Year 1 milestone (%s credits earned)",
    "alert": "Retention model flags as %s risk",
    "completion": "Below average course completion rate (%s%%)",
}
ACTION_TEXT = {
    "gpa": "Connect with academic advisor for tutoring resources",
    "failing": "Review course load and consider academic support services",
    "part_time": "Explore full-time enrollment options and financial aid",
    "math": "Prioritize gateway math enrollment next term",
    "english": "Prioritize gateway English enrollment next term",
    "alert": "Immediate outreach recommended — high dropout risk",
    "completion": "Review course withdrawal patterns with advisor",
    "credits": "Increase credit load to reach 12-credit first-year milestone",
}


def _code(name: str) -> Column:
    return F.upper(F.trim(F.col(name)))


def _code_in(name: str, codes: list[str]) -> Column:
    return F.coalesce(_code(name).isin(codes), F.lit(False))


def _or_half(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.5))


def _mean(*parts: Column) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total / F.lit(float(len(parts)))


def academic_score() -> Column:
    gpa = missing_to_null("gpa_group_year_1")
    credits = missing_to_null("number_of_credits_earned_year_1")
    gateways = (
        F.lit(0.5)
        + F.when(_code_in("completedgatewaymathyear1", DONE_CODES), 0.25).otherwise(0.0)
        + F.when(_code_in("completedgatewayenglishyear1", DONE_CODES), 0.25).otherwise(0.0)
    )
    momentum = F.when(credits >= 12, 1.0).when(credits >= 6, 0.6).when(credits.isNotNull(), 0.3).otherwise(0.5)
    return _mean(
        _or_half(F.when(gpa.isNotNull(), F.least(gpa / 4.0, F.lit(1.0)))),
        _or_half(missing_to_null("course_completion_rate")),
        _or_half(missing_to_null("passing_rate")),
        gateways,
        momentum,
    )


def engagement_score() -> Column:
    intensity = (
        F.when(_code_in("enrollment_intensity_first_term", FULL_TIME_CODES), 1.0)
        .when(_code_in("enrollment_intensity_first_term", PART_TIME_CODES), 0.5)
        .otherwise(0.3)
    )
    courses = missing_to_null("total_courses_enrolled")
    placement = _code("math_placement")
    return _mean(
        intensity,
        _or_half(F.when(courses.isNotNull(), F.least(courses / 10.0, F.lit(1.0)))),
        F.when(placement == "C", 1.0).when(placement == "R", 0.2).otherwise(0.5),
    )


def model_score() -> Column:
    alert = _code("at_risk_alert")
    component = F.lit(0.5)
    for name, value in ALERT_COMPONENT.items():
        component = F.when(alert == name, value).otherwise(component)
    return _mean(_or_half(missing_to_null("retention_probability")), component)


def readiness_raw() -> Column:
    raw = (
        academic_score() * WEIGHTS["academic"]
        + engagement_score() * WEIGHTS["engagement"]
        + model_score() * WEIGHTS["model"]
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def readiness_level(raw: str = "readiness_raw") -> Column:
    r = F.col(raw)
    return F.when(r >= LEVEL_HIGH, "high").when(r >= LEVEL_MEDIUM, "medium").otherwise("low")


def stored_score(raw: str = "readiness_raw") -> Column:
    return half_even(raw, 4)


def _fired() -> dict[str, Column]:
    """One true/false test per rule; null counts as not fired."""
    courses = F.coalesce(missing_to_null("total_courses_enrolled"), F.lit(0.0))
    failing = F.coalesce(missing_to_null("failing_grades_count"), F.lit(0.0))
    tests = {
        "gpa": missing_to_null("gpa_group_year_1") < 2.0,
        "failing": (courses > 0) & (F.try_divide(failing, courses) > 0.2),
        "part_time": _code_in("enrollment_intensity_first_term", PART_TIME_CODES),
        "math": ~_code_in("completedgatewaymathyear1", DONE_CODES),
        "english": ~_code_in("completedgatewayenglishyear1", DONE_CODES),
        "credits": missing_to_null("number_of_credits_earned_year_1") < 12,
        "alert": _code_in("at_risk_alert", ["URGENT", "HIGH"]),
        "completion": missing_to_null("course_completion_rate") < 0.75,
    }
    return {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}


def risk_factors() -> Column:
    """Texts of the rules that fired, in rule order."""
    share = F.try_divide(missing_to_null("failing_grades_count"), missing_to_null("total_courses_enrolled"))
    detail = {
        "gpa": fixed_text("gpa_group_year_1", 1),
        "failing": fixed_text(share * 100, 0),
        "credits": F.col("number_of_credits_earned_year_1").cast("bigint").cast("string"),
        "alert": F.initcap(F.lower(F.trim(F.col("at_risk_alert")))),
        "completion": fixed_text(F.col("course_completion_rate") * 100, 0),
    }
    texts = []
    for name, test in _fired().items():
        text = F.format_string(FACTOR_TEXT[name], detail[name]) if name in detail else F.lit(FACTOR_TEXT[name])
        texts.append(F.when(test, text))
    return F.array_compact(F.array(*texts))


def suggested_actions() -> Column:
    """One action per rule that fired, in action order."""
    fired = _fired()
    return F.array_compact(F.array(*[F.when(fired[name], text) for name, text in ACTION_TEXT.items()]))


# The wording of the rationale below.
def rationale(raw: str = "readiness_raw", level: str = "readiness_level") -> Column:
    def shown(value: Column, text: Column) -> Column:
        return F.when(value.isNotNull(), text).otherwise("N/A")

    gpa = missing_to_null("gpa_group_year_1")
    completion = missing_to_null("course_completion_rate")
    courses = missing_to_null("total_courses_enrolled")
    probability = missing_to_null("retention_probability")
    return F.format_string(
        "Readiness score of %s (%s) based on: academic performance (GPA %s/4.0, %s%% course completion), "
        "engagement (%s enrollment, %s courses), and ML risk assessment (%s alert, %s%% predicted retention).",
        fixed_text(raw, 2),
        F.col(level),
        shown(gpa, fixed_text(gpa, 1)),
        shown(completion, fixed_text(completion * 100, 0)),
        F.coalesce(F.trim(F.col("enrollment_intensity_first_term")), F.lit("unknown")),
        shown(courses, courses.cast("bigint").cast("string")),
        F.coalesce(F.trim(F.col("at_risk_alert")), F.lit("unknown")),
        shown(probability, fixed_text(probability * 100, 0)),
    )


def safe_profile() -> Column:
    """The 18 input fields that identify nobody, as one struct."""
    # Field name in the stored profile -> source column, and whether it is numeric.
    fields = [
        ("enrollment_type", "enrollment_type", False),
        ("enrollment_intensity", "enrollment_intensity_first_term", False),
        ("pell_status", "pell_status_first_year", False),
        ("math_placement", "math_placement", False),
        ("english_placement", "english_placement", False),
        ("gpa_year1", "gpa_group_year_1", True),
        ("credits_attempted_y1", "number_of_credits_attempted_year_1", True),
        ("credits_earned_y1", "number_of_credits_earned_year_1", True),
        ("course_completion_rate", "course_completion_rate", True),
        ("passing_rate", "passing_rate", True),
        ("average_grade", "average_grade", True),
        ("failing_grades_count", "failing_grades_count", True),
        ("gateway_math_completed", "completedgatewaymathyear1", False),
        ("gateway_english_completed", "completedgatewayenglishyear1", False),
        ("total_courses_enrolled", "total_courses_enrolled", True),
        ("retention_probability", "retention_probability", True),
        ("at_risk_alert", "at_risk_alert", False),
        ("retention_risk_category", "retention_risk_category", False),
    ]
    return F.struct(
        *[(missing_to_null(src) if numeric else F.col(src)).alias(name) for name, src, numeric in fields]
    )
