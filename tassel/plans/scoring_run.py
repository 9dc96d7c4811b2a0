"""The nightly job: student table, models, predictions, readiness, course table, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dashboards, readiness, students
from ..operators.scored import predictions
from ..sources import sinks
from .models import ModelSet, score_all, train_all


@dataclass
class RunResult:
    run_id: str
    students: int
    readiness_records: int
    enrollments: int


def run(
    cohort: DataFrame,
    records: DataFrame | None,
    enrollments: DataFrame,
    out: str,
    models: ModelSet | None = None,
    compare: bool = True,
    error_sample: int = 5,
) -> RunResult:
    """Write scored students, enrollments with predictions, readiness records and summary tables under ``out``.

    Every stage reads the table the one before it wrote, so a lost executor repeats one stage at most. Students
    whose readiness cannot be scored are left out of the records and written to ``readiness_errors``; the ledger
    gets their number and the ids of the first ``error_sample``.
    """
    spark = cohort.sparkSession
    run_id = sinks.start_run(spark, f"{out}/run_events", readiness.SOURCE, readiness.MODEL_VERSION)
    table = students.student_table(students.normalize_institution_id(cohort), records, enrollments)
    n_students = sinks.save_table(table, f"{out}/student_level")
    base = sinks.read_table(spark, f"{out}/student_level").drop("upload_timestamp")
    models = models or train_all(base, compare)
    for trained in models.all():
        if trained.model is not None:
            kind = "regression" if "rmse" in trained.metrics else "classification"
            sinks.log_model_performance(spark, f"{out}/model_performance", trained.name, kind, trained.metrics)
    if models.retention.comparison:
        sinks.write_csv(spark.createDataFrame(models.retention.comparison), f"{out}/model_comparison")

    sinks.save_table(score_all(base, models), f"{out}/student_predictions", expected=n_students)
    scored = sinks.read_table(spark, f"{out}/student_predictions").drop("upload_timestamp")
    joined = students.enrollments_with_predictions(enrollments, predictions(scored))
    n_rows = sinks.save_table(joined, f"{out}/course_predictions", partition_by=["academic_year"])
    good, bad = readiness.split_scorable(scored)
    n_ready = sinks.save_table(readiness.readiness_records(good, run_id), f"{out}/readiness")
    n_bad = sinks.save_table(bad.select("student_guid", "error"), f"{out}/readiness_errors")
    failed = sinks.read_table(spark, f"{out}/readiness_errors").orderBy("student_guid").limit(error_sample)
    sample = [f"{r['student_guid']}: {r['error']}" for r in failed.collect()]
    sinks.write_csv(dashboards.dashboard_extract(scored), f"{out}/dashboard_extract")
    sinks.finish_run(spark, f"{out}/run_events", run_id, n_students, n_ready, n_bad, sample)
    return RunResult(run_id, n_students, n_ready, n_rows)


def summary_report(scored: DataFrame) -> DataFrame:
    """Label distributions of all predictions as one table (report, position, label, count, percentage)."""
    from ..functions import scoring as s

    parts = [
        ("retention", "retention_risk_category", s.RETENTION_ORDER, True),
        ("alert", "at_risk_alert", s.ALERT_ORDER, True),
        ("credential", "predicted_credential_label", list(s.CREDENTIAL_LABELS.values()), False),
        ("gateway_math", "gateway_math_risk", s.GATEWAY_ORDER, False),
        ("gateway_english", "gateway_english_risk", s.GATEWAY_ORDER, False),
        ("academic", "academic_risk_level", s.ACADEMIC_ORDER, False),
        ("gpa", "gpa_performance", s.PERFORMANCE_ORDER, False),
    ]
    # one pass: every count in one aggregate row, then turned into rows
    counts = [F.count("*").alias("total")]
    cells = []
    for report, column, order, keep in parts:
        for i, label in enumerate(order):
            name = f"n_{report}_{i}"
            counts.append(F.count_if(F.col(column) == label).alias(name))
            cells.append(
                F.struct(
                    F.lit(report).alias("report"), F.lit(i).alias("position"), F.lit(label).alias("label"),
                    F.col(name).alias("count"), F.lit(keep).alias("keep"),
                )
            )
    from ..functions.numeric import percent

    rows = scored.agg(*counts).select("total", F.explode(F.array(*cells)).alias("x"))
    return rows.filter("x.keep or x.count > 0").select(
        "x.report", "x.position", "x.label", "x.count", percent("x.count", "total").alias("percentage")
    )
