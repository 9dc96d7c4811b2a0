"""Derived columns of the scored student table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as s


def with_targets(students: DataFrame, infer_from_sought: bool = True) -> DataFrame:
    """Outcome targets the models are trained on."""
    return students.withColumns(
        {
            "target_retention": s.target_retention(),
            "target_at_risk": s.target_at_risk(),
            "target_time_to_credential": s.target_time_to_credential(),
            "target_credential_type": s.target_credential_type(infer_from_sought),
            "target_gateway_math": s.target_gateway("completedgatewaymathyear1"),
            "target_gateway_english": s.target_gateway("completedgatewayenglishyear1"),
            "target_low_gpa": s.target_low_gpa(),
        }
    )


def with_scores(students: DataFrame) -> DataFrame:
    """Risk score, alert, bands and labels from the model probabilities; projection only."""
    scored = students.withColumn("risk_score", s.risk_score())
    return scored.withColumns(
        {
            "at_risk_alert": s.alert_level(),
            "at_risk_probability": F.col("risk_score") / 100,
            "at_risk_prediction": (F.col("risk_score") >= 50).cast("int"),
            "retention_risk_category": s.retention_band(),
            "gateway_math_risk": s.gateway_band("gateway_math_probability"),
            "gateway_english_risk": s.gateway_band("gateway_english_probability"),
            "academic_risk_level": s.academic_band(),
            "predicted_graduation_year": s.graduation_year(),
            "predicted_credential_label": s.credential_label(),
            "gpa_performance": s.gpa_performance(),
        }
    )


# Prediction columns of the published table.
PREDICTION_COLUMNS = [
    "student_guid",
    "retention_probability", "retention_prediction", "retention_risk_category",
    "at_risk_probability", "at_risk_prediction", "at_risk_alert", "risk_score",
    "predicted_time_to_credential", "predicted_graduation_year",
    "predicted_credential_type", "predicted_credential_label",
    "prob_no_credential", "prob_certificate", "prob_associate", "prob_bachelor",
    "gateway_math_probability", "gateway_math_prediction", "gateway_math_risk",
    "gateway_english_probability", "gateway_english_prediction", "gateway_english_risk",
    "low_gpa_probability", "low_gpa_prediction", "academic_risk_level",
    "predicted_gpa", "gpa_performance",
]


def predictions(scored: DataFrame) -> DataFrame:
    """The prediction columns present in the table, in published order."""
    return scored.select(*[c for c in PREDICTION_COLUMNS if c in scored.columns])


def scenario(scored: DataFrame, completion_shift: float = 0.0, grade_shift: float = 0.0) -> DataFrame:
    """Risk score and alert if completion and grades moved; the retention term stays as it is."""
    completion = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("course_completion_rate") + completion_shift))
    grade = F.least(F.lit(4.0), F.greatest(F.lit(0.0), F.col("average_grade") + grade_shift))
    moved = scored.withColumn(
        "scenario_risk_score",
        s.risk_score(
            grade=F.when(F.col("average_grade").isNotNull(), grade),
            completion=F.when(F.col("course_completion_rate").isNotNull(), completion),
        ),
    )
    return moved.withColumn("scenario_alert", s.alert_level("scenario_risk_score"))


def scenario_counts(scored: DataFrame, completion_shift: float, grade_shift: float) -> DataFrame:
    """Students per alert level before and after, in one pass over the table."""
    rows = scenario(scored, completion_shift, grade_shift)
    both = rows.select(
        F.explode(
            F.array(
                F.struct(F.lit("before").alias("stage"), F.col("at_risk_alert").alias("alert")),
                F.struct(F.lit("after").alias("stage"), F.col("scenario_alert").alias("alert")),
            )
        ).alias("x")
    )
    return both.groupBy("x.stage", "x.alert").agg(F.count("*").alias("students"))


def snapshot_changes(previous: DataFrame, current: DataFrame, drop_by: float = 0.2) -> DataFrame:
    """Per student: alert before and now, and what changed between two scored snapshots."""
    p = previous.select(
        "student_guid",
        F.col("at_risk_alert").alias("previous_alert"),
        F.col("retention_probability").alias("previous_probability"),
    )
    c = current.select(
        "student_guid",
        F.col("at_risk_alert").alias("current_alert"),
        F.col("retention_probability").alias("current_probability"),
    )
    joined = p.join(c, "student_guid")
    changed = ~F.col("previous_alert").eqNullSafe(F.col("current_alert"))
    return joined.select(
        "student_guid",
        "previous_alert",
        "current_alert",
        F.coalesce(changed & (F.col("current_alert") == "URGENT"), F.lit(False)).alias("new_urgent"),
        F.coalesce(
            (F.col("previous_alert") == "HIGH") & (F.col("current_alert") == "LOW"), F.lit(False)
        ).alias("high_to_low"),
        F.coalesce(
            F.col("previous_probability") - F.col("current_probability") >= drop_by, F.lit(False)
        ).alias("probability_drop"),
    ).filter(changed | F.col("probability_drop"))


def snapshot_pairs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Every student of both snapshots with the alert before and now, changed or not."""
    p = previous.select("student_guid", F.col("at_risk_alert").alias("previous_alert"))
    c = current.select("student_guid", F.col("at_risk_alert").alias("current_alert"))
    return p.join(c, "student_guid")


def change_matrix(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Students per (alert before, alert now)."""
    pairs = snapshot_pairs(previous, current)
    return pairs.groupBy("previous_alert", "current_alert").agg(F.count("*").alias("students"))


def contradictions(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count_if((F.col("retention_probability") > 0.8) & (F.col("at_risk_alert") == "URGENT")).alias(
            "likely_retained_but_urgent"
        ),
        F.count_if((F.col("retention_probability") < 0.3) & (F.col("at_risk_alert") == "LOW")).alias(
            "unlikely_retained_but_low"
        ),
    )


def derived_flags(students: DataFrame) -> DataFrame:
    """On-track share of a 30-credit year, early progress flag and prefix diversity per student."""
    credits = F.col("number_of_credits_earned_year_1")
    return students.select(
        "student_guid",
        F.round(credits / 30.0, 4).alias("on_track_share"),
        F.coalesce((credits >= 24) & (F.col("gpa_group_year_1") >= 2.5), F.lit(False)).alias("on_track"),
        F.round(F.try_divide(F.col("unique_course_prefixes"), F.col("total_courses_enrolled")), 4).alias(
            "prefix_diversity"
        ),
    )
