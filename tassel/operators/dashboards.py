"""Dashboard aggregates over the scored student table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ordinal, percent
from ..functions.scoring import ALERT_ORDER, RETENTION_ORDER, age_segment


def dashboard_filter(
    students: DataFrame,
    cohort: str | None = None,
    enrollment_type: str | None = None,
    credential_type: str | None = None,
) -> DataFrame:
    """Equality filters; blank means no filter."""
    wanted = {
        "cohort": cohort,
        "enrollment_intensity_first_term": enrollment_type,
        "predicted_credential_label": credential_type,
    }
    out = students
    for column, value in wanted.items():
        if value:
            out = out.filter(F.col(column) == value)
    return out


def at_risk() -> Column:
    return F.coalesce(F.col("at_risk_alert").isin("HIGH", "URGENT"), F.lit(False))


def kpis(students: DataFrame, **filters: str | None) -> DataFrame:
    def rate(name: str) -> Column:
        return F.round(F.coalesce(F.avg(name) * 100, F.lit(0.0)), 1)

    return dashboard_filter(students, **filters).agg(
        rate("retention").alias("overall_retention_rate"),
        rate("retention_probability").alias("avg_predicted_retention"),
        F.count_if(at_risk()).alias("high_critical_risk_count"),
        rate("course_completion_rate").alias("avg_course_completion_rate"),
        F.count("*").alias("total_students"),
    )


def _with_total(students: DataFrame, column: str, name: str) -> DataFrame:
    """Counts per label and their share of all rows, from one pass: the few counts are totalled in one row."""
    counts = students.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    gathered = counts.agg(F.collect_list(F.struct("label", "n")).alias("cells"), F.sum("n").alias("total"))
    return gathered.select("total", F.explode("cells").alias("c")).select(
        F.col("c.label").alias(name), F.col("c.n").alias("count"), percent("c.n", "total").alias("percentage")
    )


def label_distribution(students: DataFrame, column: str, order: list[str], **filters: str | None) -> DataFrame:
    """Count and percent per label, fixed label order; null labels only count in the denominator."""
    shares = _with_total(dashboard_filter(students, **filters), column, "category")
    return shares.filter(F.col("category").isNotNull()).orderBy(ordinal("category", order), "category")


def risk_alert_distribution(students: DataFrame, **filters: str | None) -> DataFrame:
    return label_distribution(students, "at_risk_alert", ALERT_ORDER, **filters)


def retention_risk_distribution(students: DataFrame, **filters: str | None) -> DataFrame:
    return label_distribution(students, "retention_risk_category", RETENTION_ORDER, **filters)


def band_distribution(students: DataFrame, column: str, order: list[str], keep_empty: bool = True) -> DataFrame:
    """Every label of a fixed list with its count and percent of all rows."""
    totals = students.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(column) == name).alias(f"n{i}") for i, name in enumerate(order)],
    )
    rows = totals.select(
        "total",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"), F.lit(name).alias("label"), F.col(f"n{i}").alias("count")
                    )
                    for i, name in enumerate(order)
                ]
            )
        ).alias("x"),
    ).select("x.position", "x.label", "x.count", percent("x.count", "total").alias("percentage"))
    return rows if keep_empty else rows.filter(F.col("count") > 0)


def prediction_summary(scored: DataFrame) -> DataFrame:
    def mean(name: str) -> Column:
        return F.round(F.avg(name), 6)

    return scored.agg(
        mean("predicted_time_to_credential").alias("mean_time_to_credential"),
        F.round(F.median("predicted_time_to_credential"), 6).alias("median_time_to_credential"),
        mean("gateway_math_probability").alias("mean_gateway_math_probability"),
        F.count("gateway_math_probability").alias("gateway_math_scored"),
        mean("gateway_english_probability").alias("mean_gateway_english_probability"),
        F.count("gateway_english_probability").alias("gateway_english_scored"),
        mean("low_gpa_probability").alias("mean_low_gpa_probability"),
        F.count_if(F.col("low_gpa_probability") >= 0.5).alias("low_gpa_predicted"),
    )


# Question vocabulary of the ad-hoc metric query.
METRICS = {
    "retention": "retention",
    "completion": "persistence",
    "gpa": "gpa_group_year_1",
    "credits": "number_of_credits_earned_year_1",
}
GROUPS = {
    "cohort": "cohort",
    "term": "cohort_term",
    "program": "program_of_study_year_1",
    "course": "course_prefix",
    "enrollment": "enrollment_intensity_first_term",
}


def metric_query(
    rows: DataFrame, metric: str | None = None, group_by: str | None = None, filters: dict | None = None
) -> DataFrame:
    """Average of a metric (or a count) overall or per group, ordered by group; without either, the rows.

    Filters are equalities by column; a ``cohort`` given as a number matches the start year.
    """
    out = rows
    for column, value in (filters or {}).items():
        if column == "cohort" and isinstance(value, int):
            out = out.filter(F.col("cohort").startswith(f"{value}-"))
        else:
            out = out.filter(F.col(column) == value)
    value = F.round(F.avg(METRICS[metric]), 2).alias(metric) if metric else F.count("*").alias("count")
    if group_by is None:
        return out.agg(value) if metric else out
    return (
        out.groupBy(F.coalesce(F.col(GROUPS[group_by]).cast("string"), F.lit("Unknown")).alias(group_by))
        .agg(value)
        .orderBy(group_by)
    )


def age_segments(students: DataFrame) -> DataFrame:
    return students.groupBy(age_segment().alias("segment")).agg(F.count("*").alias("students"))


def target_distribution(with_targets: DataFrame, target: str) -> DataFrame:
    return with_targets.groupBy(F.col(target).alias("value")).agg(F.count("*").alias("students"))


def dashboard_extract(students: DataFrame, **filters: str | None) -> DataFrame:
    """KPIs and both distributions as one long table."""
    k = kpis(students, **filters)
    kpi_rows = k.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value"))
                    for c in k.columns
                ]
            )
        ).alias("x")
    ).select(
        F.lit("kpi").alias("section"),
        "x.label",
        F.col("x.value").alias("value"),
        F.lit(None).cast("double").alias("percentage"),
    )

    def part(section: str, dist: DataFrame) -> DataFrame:
        return dist.select(
            F.lit(section).alias("section"),
            F.col("category").alias("label"),
            F.col("count").cast("double").alias("value"),
            "percentage",
        )

    return kpi_rows.unionByName(part("risk_alert", risk_alert_distribution(students, **filters))).unionByName(
        part("retention_risk", retention_risk_distribution(students, **filters))
    )
