"""Outcome targets, risk score, alert levels and probability bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, band, missing_to_null

# Label orders used by reports.
ALERT_ORDER = ["URGENT", "HIGH", "MODERATE", "LOW"]
RETENTION_ORDER = ["Critical Risk", "High Risk", "Moderate Risk", "Low Risk"]
GATEWAY_ORDER = ["High Risk", "Moderate Risk", "Likely Pass", "Very Likely Pass"]
ACADEMIC_ORDER = ["Low Risk", "Moderate Risk", "High Risk", "Critical Risk"]
CREDENTIAL_LABELS = {0: "No Credential", 1: "Certificate", 2: "Associate", 3: "Bachelor"}
PERFORMANCE_ORDER = ["Above Expected", "As Expected", "Below Expected"]

# Credential-sought codes by track.
CERTIFICATE_CODES = ["01", "02", "03", "C1", "C2"]
ASSOCIATE_CODES = ["A", "04", "05"]
BACHELOR_CODES = ["B", "06", "07", "08"]

# Outcome columns holding years to each credential, 0 meaning not applicable.
BACHELOR_YEARS = ["years_to_bachelors_at_cohort_inst_", "years_to_bachelor_at_other_inst_"]
ASSOCIATE_YEARS = ["years_to_latest_associates_at_cohort_inst", "years_to_latest_associates_at_other_inst"]
CERTIFICATE_YEARS = ["years_to_latest_certificate_at_cohort_inst", "years_to_latest_certificate_at_other_inst"]
EITHER_YEARS = [
    "years_to_associates_or_certificate_at_cohort_inst_",
    "years_to_associates_or_certificate_at_other_inst_",
]


def _false_if_null(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _any_positive(columns: list[str]) -> Column:
    test = F.lit(False)
    for name in columns:
        test = test | _false_if_null(missing_to_null(name) > 0)
    return test


def target_retention(retention: Column | str = "retention") -> Column:
    return F.coalesce(missing_to_null(retention).cast("int"), F.lit(0))


def target_at_risk() -> Column:
    tests = [
        missing_to_null("retention") == 0,
        missing_to_null("persistence") == 0,
        missing_to_null("average_grade") < 2.0,
        missing_to_null("course_completion_rate") < 0.6,
    ]
    any_test = F.lit(False)
    for test in tests:
        any_test = any_test | _false_if_null(test)
    return any_test.cast("int")


def target_time_to_credential() -> Column:
    """Shortest positive time over the four completion columns, 99 when there is none."""
    positive = [
        F.when(missing_to_null(name) > 0, missing_to_null(name)) for name in BACHELOR_YEARS + EITHER_YEARS
    ]
    return F.coalesce(F.least(*positive), F.lit(99.0))


def target_credential_type(infer_from_sought: bool = True) -> Column:
    """0 none, 1 certificate, 2 associate, 3 bachelor; completions first, then the code sought."""
    sought = F.col("credential_type_sought_year_1")
    certificate_track = _false_if_null(sought.isin(CERTIFICATE_CODES))
    kind = (
        F.when(_any_positive(BACHELOR_YEARS), 3)
        .when(_any_positive(ASSOCIATE_YEARS), 2)
        .when(_any_positive(CERTIFICATE_YEARS), 1)
        .when(_any_positive(EITHER_YEARS), F.when(certificate_track, 1).otherwise(2))
    )
    if infer_from_sought:
        kind = (
            kind.when(certificate_track, 1)
            .when(_false_if_null(sought.isin(ASSOCIATE_CODES)), 2)
            .when(_false_if_null(sought.isin(BACHELOR_CODES)), 3)
        )
    return kind.otherwise(0)


def target_gateway(completed: Column | str, success_codes: tuple[str, ...] = ("Y", "C")) -> Column:
    """1/0 for students with a recorded outcome, null for the others."""
    c = as_col(completed)
    return F.when(c.isNotNull(), c.isin(list(success_codes)).cast("int"))


def target_low_gpa(gpa: Column | str = "gpa_group_year_1") -> Column:
    return _false_if_null(missing_to_null(gpa) < 2.0).cast("int")


def risk_score(
    probability: Column | str = "retention_probability",
    grade: Column | str = "average_grade",
    completion: Column | str = "course_completion_rate",
    credits: Column | str = "total_credits_earned",
) -> Column:
    """0-100; half from the retention probability, the rest in steps. Null without a probability."""
    p, g = missing_to_null(probability), missing_to_null(grade)
    c, k = missing_to_null(completion), missing_to_null(credits)
    from_grade = F.when(g < 2.0, 20.0).when(g < 2.5, 10.0).when(g < 3.0, 3.0).otherwise(0.0)
    from_completion = F.when(c < 0.5, 20.0).when(c < 0.7, 10.0).when(c < 0.85, 5.0).otherwise(0.0)
    from_credits = F.when(k < 6, 10.0).when(k < 12, 5.0).otherwise(0.0)
    total = (F.lit(1.0) - p) * 100 * 0.5 + from_grade + from_completion + from_credits
    return F.when(p.isNotNull(), F.least(F.lit(100.0), total))


def alert_level(score: Column | str = "risk_score") -> Column:
    s = as_col(score)
    return (
        F.when(s >= 75, "URGENT").when(s >= 50, "HIGH").when(s >= 25, "MODERATE").when(s.isNotNull(), "LOW")
    )


def retention_band(p: Column | str = "retention_probability") -> Column:
    return band(p, list(zip([0.25, 0.50, 0.75, 1.0], RETENTION_ORDER)))


def gateway_band(p: Column | str) -> Column:
    return band(p, list(zip([0.4, 0.6, 0.8, 1.0], GATEWAY_ORDER)))


def academic_band(p: Column | str = "low_gpa_probability") -> Column:
    return band(p, list(zip([0.2, 0.4, 0.6, 1.0], ACADEMIC_ORDER)))


def cohort_start_year(cohort: Column | str = "cohort") -> Column:
    return F.expr("try_cast(left({0}, 4) as double)".format(cohort)) if isinstance(cohort, str) else F.left(
        cohort, F.lit(4)
    ).try_cast("double")


def graduation_year(
    cohort: str = "cohort", time: Column | str = "predicted_time_to_credential"
) -> Column:
    return cohort_start_year(cohort) + as_col(time)


def credential_label(kind: Column | str = "predicted_credential_type") -> Column:
    table = F.create_map(*[F.lit(v) for pair in CREDENTIAL_LABELS.items() for v in pair])
    return F.try_element_at(table, as_col(kind).cast("int"))


def gpa_performance(
    actual: Column | str = "average_grade", predicted: Column | str = "predicted_gpa"
) -> Column:
    a, p = missing_to_null(actual), missing_to_null(predicted)
    return (
        F.when(a > p + 0.2, "Above Expected").when(a < p - 0.2, "Below Expected").otherwise("As Expected")
    )


def age_segment(age: Column | str = "student_age") -> Column:
    """The data holds age bands; the two younger bands are under 25."""
    a = as_col(age)
    return F.when(a.isin("20 and younger", ">20 - 24"), "Under 25").when(a.isNotNull(), "25 and over")
