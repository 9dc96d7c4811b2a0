"""Writers: tables, CSV exports, the model-performance log, the run ledger, raw batches."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import bronze_rows
from .snapshots import SnapshotTable


def save_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
    expected: int | None = None,
    keep: int = 2,
) -> int:
    """Write with an upload timestamp; ``mode`` is overwrite, append or error. Returns the rows added.

    The table is one of versions (``snapshots``) and shows the new rows at once, when all are written and counted; a job
    that fails, or a count other than ``expected``, leaves it as it was. The count comes from the files' footers, so
    the input is computed once. Files that only versions before the newest ``keep`` have are deleted.
    """
    table = SnapshotTable(df.sparkSession, path)
    if mode not in ("overwrite", "append", "error"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "error" and table.versions():
        raise FileExistsError(path)
    stamped = df.withColumn("upload_timestamp", F.current_timestamp())
    write = table.append if mode == "append" else table.overwrite
    added = write(stamped, partition_by=partition_by or [], expected=expected).rows
    table.expire(keep)
    return added


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table of ``save_table``."""
    return SnapshotTable(spark, path).read()


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Full export with a header, one file per task."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    # by default the writer trims text
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)


MODEL_LOG = (
    "model_name string, model_type string, accuracy double, precision_score double, recall_score double, "
    "f1_score double, auc_roc double, rmse double, mae double, r2_score double, training_date timestamp, notes string"
)


def log_model_performance(
    spark: SparkSession, path: str, model_name: str, model_type: str, metrics: dict[str, float], notes: str = ""
) -> None:
    """Append one row; F1 is taken under either of its two usual names."""
    m = metrics
    row = (
        model_name, model_type, m.get("accuracy"), m.get("precision"), m.get("recall"),
        m.get("f1", m.get("f1_score")), m.get("auc_roc"), m.get("rmse"), m.get("mae"), m.get("r2", m.get("r2_score")),
        datetime.now(timezone.utc), notes,
    )
    spark.createDataFrame([row], MODEL_LOG).write.mode("append").parquet(path)


RUN_EVENT = (
    "run_id string, at timestamp, event string, source string, model_version string, students_input long, "
    "students_scored long, errors long, error_sample string, triggered_by string"
)


def start_run(spark: SparkSession, path: str, source: str, model_version: str, triggered_by: str = "manual") -> str:
    run_id = str(uuid.uuid4())
    row = (run_id, datetime.now(timezone.utc), "started", source, model_version, None, None, 0, None, triggered_by)
    spark.createDataFrame([row], RUN_EVENT).write.mode("append").parquet(path)
    return run_id


def finish_run(
    spark: SparkSession, path: str, run_id: str, students_input: int, students_scored: int, errors: int, sample: list[str]
) -> None:
    row = (
        run_id, datetime.now(timezone.utc), "finished", None, None, students_input, students_scored, errors,
        json.dumps(sample), None,
    )
    spark.createDataFrame([row], RUN_EVENT).write.mode("append").parquet(path)


def run_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Current state of every run from its events."""
    e = spark.read.schema(RUN_EVENT).parquet(path)
    started, finished = F.col("event") == "started", F.col("event") == "finished"
    return e.groupBy("run_id").agg(
        F.min(F.when(started, F.col("at"))).alias("started_at"),
        F.max(F.when(finished, F.col("at"))).alias("completed_at"),
        *[F.max(F.when(started, F.col(c))).alias(c) for c in ("source", "model_version", "triggered_by")],
        *[
            F.max_by(c, F.when(finished, F.col("at"))).alias(c)
            for c in ("students_input", "students_scored", "errors", "error_sample")
        ],
    )


def bronze_load(df: DataFrame, path: str, endpoint: str, batch_id: str) -> None:
    """Raw rows of one batch; loading the batch again replaces it and nothing else."""
    (
        bronze_rows(df, endpoint, batch_id)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("etl_batch_id")
        .parquet(path)
    )
