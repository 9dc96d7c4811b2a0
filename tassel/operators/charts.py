"""Chart tables: one aggregate over the scored student table each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import missing_to_null, percent
from .dashboards import at_risk

PROGRAM = "program_of_study_year_1"


def _mean(name: str) -> Column:
    return F.round(F.avg(name), 6)


def risk_score_histogram(scored: DataFrame) -> DataFrame:
    """Four bins of 25 points; 100 falls in the last one."""
    lower = F.least(F.floor(F.col("risk_score") / 25) * 25, F.lit(75)).cast("int")
    return (
        scored.filter(F.col("risk_score").isNotNull())
        .groupBy(lower.alias("bin_start"))
        .agg(F.count("*").alias("students"))
    )


def at_risk_counts(scored: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Students on HIGH or URGENT alert per group, most first."""
    out = scored.filter(at_risk()).groupBy(by).agg(F.count("*").alias("at_risk_students"))
    return out.orderBy(F.desc("at_risk_students"), by).limit(k) if k else out


def at_risk_by_program(scored: DataFrame, k: int = 10) -> DataFrame:
    return at_risk_counts(scored, PROGRAM, k)


def at_risk_by_institution(scored: DataFrame) -> DataFrame:
    return at_risk_counts(scored, "institution_id")


def retention_by_cohort(scored: DataFrame) -> DataFrame:
    return scored.groupBy("cohort").agg(
        _mean("retention").alias("actual_retention"),
        _mean("retention_probability").alias("predicted_retention"),
    )


def gpa_by_performance(scored: DataFrame) -> DataFrame:
    """Five-number summary of the average grade per performance group."""
    points = F.percentile("average_grade", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    grouped = scored.filter(F.col("average_grade").isNotNull()).groupBy("gpa_performance").agg(points.alias("q"))
    names = ["min_grade", "q1", "median", "q3", "max_grade"]
    return grouped.select(
        "gpa_performance", *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(names)]
    )


def completion_vs_retention(scored: DataFrame) -> DataFrame:
    """Least-squares line of retention probability on completion rate, and their correlation, by alert."""
    y, x = "retention_probability", "course_completion_rate"
    return (
        scored.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
        .groupBy("at_risk_alert")
        .agg(
            F.count("*").alias("students"),
            F.round(F.regr_slope(y, x), 4).alias("slope"),
            F.round(F.regr_intercept(y, x), 4).alias("intercept"),
            F.round(F.corr(y, x), 4).alias("correlation"),
        )
    )


def credits_by_year(scored: DataFrame, by: str = "cohort") -> DataFrame:
    """Credits earned in years 1-4 per group, in long form."""
    columns = [f"number_of_credits_earned_year_{i}" for i in range(1, 5)]
    sums = scored.groupBy(by).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])
    return sums.unpivot([by], columns, "year_column", "credits").select(
        by, F.right("year_column", F.lit(1)).cast("int").alias("year"), "credits"
    )


def gateway_impact(scored: DataFrame) -> DataFrame:
    return scored.groupBy("completedgatewaymathyear1", "completedgatewayenglishyear1").agg(
        F.count("*").alias("students"), _mean("retention_probability").alias("avg_probability")
    )


# Demographic columns reported on.
DEMOGRAPHICS = ["race", "gender", "first_gen", "pell_status_first_year", "student_age"]


def retention_by_demographic(scored: DataFrame) -> DataFrame:
    """Actual and predicted retention for every value of five demographics, one pass over the table."""
    columns = [F.col(c) for c in DEMOGRAPHICS]
    sets = scored.groupingSets([[c] for c in columns], *columns).agg(
        *[F.grouping(c).alias(f"no_{c}") for c in DEMOGRAPHICS],
        F.count("*").alias("n"),
        _mean("retention").alias("actual_retention"),
        _mean("retention_probability").alias("predicted_retention"),
    )
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in DEMOGRAPHICS:
        dimension = F.when(F.col(f"no_{c}") == 0, c).otherwise(dimension)
        value = F.when(F.col(f"no_{c}") == 0, F.col(c)).otherwise(value)
    return sets.select(
        dimension.alias("dimension"), value.alias("value"), "n", "actual_retention", "predicted_retention"
    )


def firstgen_risk_profile(scored: DataFrame) -> DataFrame:
    """First-generation status by alert level, counts side by side."""
    return scored.groupBy("first_gen").agg(
        *[
            F.count_if(F.col("at_risk_alert") == level).alias(level.lower())
            for level in ("URGENT", "HIGH", "MODERATE", "LOW")
        ]
    )


def placement_vs_retention(scored: DataFrame) -> DataFrame:
    return scored.groupBy("math_placement").agg(
        F.count("*").alias("students"), _mean("retention_probability").alias("avg_probability")
    )


def retention_confusion(scored: DataFrame) -> DataFrame:
    """Actual by predicted retention; all four cells, also empty ones."""
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    one_row = scored.agg(
        *[
            F.count_if((F.col("retention") == a) & (F.col("retention_prediction") == p)).alias(f"n{a}{p}")
            for a, p in cells
        ]
    )
    return one_row.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("students")
                    )
                    for a, p in cells
                ]
            )
        ).alias("x")
    ).select("x.actual", "x.predicted", "x.students")


def time_to_credential_hist(scored: DataFrame) -> DataFrame:
    """Predicted and actual years to a credential in bins 1, 2, 3, 4 and 5 (five or more)."""

    def year_bin(name: str) -> Column:
        v = missing_to_null(name)
        return F.when(v > 0, F.least(F.lit(5), F.greatest(F.lit(1), F.floor(v)))).cast("int")

    both = scored.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("p"), F.lit(0).alias("a"), year_bin("predicted_time_to_credential").alias("y")),
                F.struct(F.lit(0).alias("p"), F.lit(1).alias("a"), year_bin("time_to_credential").alias("y")),
            )
        ).alias("x")
    )
    return (
        both.filter("x.y is not null")
        .groupBy(F.col("x.y").alias("years"))
        .agg(F.sum("x.p").alias("predicted"), F.sum("x.a").alias("actual"))
    )


def graduation_year_counts(scored: DataFrame) -> DataFrame:
    return (
        scored.filter(F.col("predicted_graduation_year").isNotNull())
        .groupBy(F.floor("predicted_graduation_year").cast("int").alias("graduation_year"))
        .agg(F.count("*").alias("students"))
    )


def credential_mix(scored: DataFrame, by: str = "cohort") -> DataFrame:
    """Mean class probability per group and credential, in long form."""
    columns = ["prob_no_credential", "prob_certificate", "prob_associate", "prob_bachelor"]
    means = scored.groupBy(by).agg(*[_mean(c).alias(c) for c in columns])
    return means.unpivot([by], columns, "credential", "mean_probability")


def retention_by_zip(scored: DataFrame) -> DataFrame:
    return scored.groupBy("zip_code").agg(
        F.count("*").alias("n"), _mean("retention_probability").alias("avg_probability")
    )


def intensity_impact(scored: DataFrame) -> DataFrame:
    return scored.groupBy("enrollment_intensity_first_term").agg(
        F.count("*").alias("students"),
        _mean("retention").alias("avg_retention"),
        _mean("course_completion_rate").alias("avg_completion"),
        _mean("average_grade").alias("avg_grade"),
    )


def online_share_impact(scored: DataFrame) -> DataFrame:
    """Average probability by quarter of the online share; upper bounds belong to the next quarter."""
    p = F.col("pct_online")
    bucket = (
        F.when(p < 0.25, "0-25%").when(p < 0.5, "25-50%").when(p < 0.75, "50-75%").when(p.isNotNull(), "75-100%")
    )
    return (
        scored.filter(p.isNotNull())
        .groupBy(bucket.alias("online_share"))
        .agg(F.count("*").alias("students"), _mean("retention_probability").alias("avg_probability"))
    )


def dual_enrollment_impact(scored: DataFrame) -> DataFrame:
    """Four outcome averages for students with and without dual or summer enrollment."""
    dual = F.col("dual_and_summer_enrollment").isin("DS", "SE", "DE")
    return scored.groupBy(F.when(dual, "Yes").otherwise("No").alias("dual_enrollment")).agg(
        _mean("retention").alias("retention_rate"),
        _mean("course_completion_rate").alias("completion_rate"),
        _mean("average_grade").alias("avg_grade"),
        _mean("retention_probability").alias("avg_probability"),
    )


def program_performance(scored: DataFrame, k: int = 20, bottom: bool = False) -> DataFrame:
    grouped = scored.groupBy(PROGRAM).agg(
        _mean("retention_probability").alias("avg_probability"), F.count("*").alias("students")
    )
    lead = F.asc("avg_probability") if bottom else F.desc("avg_probability")
    return grouped.orderBy(lead, PROGRAM).limit(k)


def program_risk_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy(PROGRAM).agg(_mean("risk_score").alias("avg_risk_score"))


def gateway_completion_rate(scored: DataFrame) -> DataFrame:
    """Completed over attempted for gateway math and English, in percent."""
    def done(subject: str) -> Column:
        return F.count_if(
            (F.col(f"completedgateway{subject}year1") == "Y") & (F.col(f"attemptedgateway{subject}year1") == "Y")
        )

    def tried(subject: str) -> Column:
        return F.count_if(F.col(f"attemptedgateway{subject}year1") == "Y")

    return scored.agg(
        done("math").alias("md"), tried("math").alias("mt"), done("english").alias("ed"), tried("english").alias("et")
    ).select(percent("md", "mt").alias("math_rate"), percent("ed", "et").alias("english_rate"))


def intervention_success_rate(changes: DataFrame, order: list[str]) -> DataFrame:
    """Percent of treated students whose alert became less severe.

    ``changes`` has student_guid, previous_alert, current_alert, treated for every treated student, changed or not.
    """
    from ..functions.numeric import ordinal

    better = ordinal("current_alert", order) > ordinal("previous_alert", order)
    counted = changes.filter("treated").agg(
        F.count("*").alias("treated_students"), F.count_if(better).alias("improved_students")
    )
    return counted.withColumn("success_rate", percent("improved_students", "treated_students"))


def roi_estimate(scored: DataFrame, success_rate: float, value_per_student: float) -> DataFrame:
    """Students on alert, those expected to be kept at the given rate, and what that is worth."""
    flagged = scored.agg(F.count_if(at_risk()).alias("flagged"))
    kept = F.col("flagged") * success_rate
    return flagged.select("flagged", kept.alias("expected_kept"), (kept * value_per_student).alias("estimated_value"))


def baseline_at_risk(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Points from failed courses, open gateways and credits, with the reasons; highest first.

    Three points for three or more failed courses (one for one or two), two for each gateway not
    completed, two for fewer than 12 credits in the first year (one for fewer than 24).
    """
    failed = F.coalesce("failing_grades_count", F.lit(0))
    credits = F.coalesce("number_of_credits_earned_year_1", F.lit(0.0))
    math_open = ~F.coalesce(F.col("completedgatewaymathyear1").isin("Y", "C"), F.lit(False))
    english_open = ~F.coalesce(F.col("completedgatewayenglishyear1").isin("Y", "C"), F.lit(False))
    points = (
        F.when(failed >= 3, 3).when(failed >= 1, 1).otherwise(0)
        + F.when(math_open, 2).otherwise(0)
        + F.when(english_open, 2).otherwise(0)
        + F.when(credits < 12, 2).when(credits < 24, 1).otherwise(0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(failed >= 1, F.lit("failed courses")),
            F.when(math_open, F.lit("gateway math open")),
            F.when(english_open, F.lit("gateway English open")),
            F.when(credits < 24, F.lit("low first-year credits")),
        )
    )
    out = scored.select("student_guid", points.alias("points"), reasons.alias("reasons"))
    return out.orderBy(F.desc("points"), "student_guid").limit(k) if k else out
