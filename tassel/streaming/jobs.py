"""Streaming versions of the reports that follow arriving files.

The aggregations are ordinary DataFrame functions and run on batch tables as well; ``run_to_table``
drives a streaming query over everything available and leaves its result in a parquet table. Every job keeps
its tables and its progress in the folder the caller names, so it goes on where it stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.grades import is_course_pass, is_dfwi
from ..functions.numeric import percent
from ..operators.ingest import last_per_key, recode_values
from ..operators.ingest import map_columns as map_headers_of
from ..operators.ingest import upsert as upsert_rows
from ..sources.files import audit_entries, dense_positions, with_chunks
from ..sources.layouts import Layout
from ..sources.snapshots import SnapshotTable
from .changelog import FANOUT, ChangeLog


def daily_counts(events: DataFrame, delay: str = "1 day", day: str = "1 day") -> DataFrame:
    """Queries per day, institution and chart type; rows later than ``delay`` are dropped."""
    windowed = events.withWatermark("ts", delay).groupBy(F.window("ts", day), "institution", "viz_type")
    return windowed.agg(F.count("*").alias("queries")).select(
        F.col("window.start").alias("day_start"), F.col("window.end").alias("day_end"), "institution", "viz_type", "queries"
    )


def sliding_activity(events: DataFrame, length: str = "6 hours", slide: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Queries per institution in overlapping windows."""
    windowed = events.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), "institution")
    return windowed.agg(F.count("*").alias("queries")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "institution", "queries"
    )


def activity_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of queries by one user with no pause longer than ``gap``."""
    windowed = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id")
    return windowed.agg(F.count("*").alias("queries")).select(
        "user_id",
        F.col("session_window.start").alias("session_start"),
        F.col("session_window.end").alias("session_end"),
        "queries",
    )


def running_course_counts(enrollments: DataFrame) -> DataFrame:
    """Enrollments, D/F/W/I and passes per course so far (no windows, so use complete or update mode)."""
    return enrollments.groupBy("course_prefix", "course_number").agg(
        F.count("*").alias("enrollments"),
        F.count_if(is_dfwi()).alias("dfwi_count"),
        F.count_if(is_course_pass()).alias("pass_count"),
    )


def course_rates_so_far(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {"dfwi_rate": percent("dfwi_count", "enrollments"), "pass_rate": percent("pass_count", "enrollments")}
    )


def without_repeats(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop rows seen before with the same keys within the delay; state stays bounded."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything that has arrived since the last call and return the resulting table.

    Append mode uses the exactly-once file sink and holds closed windows only. Complete and update mode write each
    micro-batch to its own folder, named by the batch id, so a repeated batch replaces itself; ``last_batch`` (update)
    or ``newest_batch`` (complete) turn them into the current answer, open windows included.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    out = f"{path}/rows"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else _with_batch(stream)).parquet(out)


def run_to_log(stream: DataFrame, path: str, keys: list[str], fanout: int = FANOUT) -> ChangeLog:
    """Process everything that has arrived since the last call in update mode and return the log of changes, whose
    ``current`` rows are the answer so far, open windows included."""
    log = ChangeLog(stream.sparkSession, f"{path}/changes", keys, fanout)
    query = (
        stream.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .outputMode("update")
        .foreachBatch(lambda batch, batch_id: log.add(batch, batch_id))
        .start()
    )
    query.awaitTermination()
    return log


def session_table(events: DataFrame, path: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions over everything that has arrived since the first call: closed ones from the table that append mode
    writes, open ones from the stream's state, which holds no others."""
    sessions = activity_sessions(events, gap, delay)
    closed = run_to_table(sessions, path, "append")
    return closed.unionByName(open_sessions(sessions, path))


def open_sessions(sessions: DataFrame, path: str) -> DataFrame:
    """The sessions that the stream's last batch left open, as the state data source reads them."""
    spark = sessions.sparkSession
    try:
        state = spark.read.format("statestore").load(f"{path}/checkpoint")
    except PySparkException as err:
        if err.getCondition() != "STDS_COMMITTED_BATCH_UNAVAILABLE":
            raise
        return spark.createDataFrame([], sessions.schema)
    return state.select(
        F.col("key.user_id").alias("user_id"),
        F.col("value.session_window.start").alias("session_start"),
        F.col("value.session_window.end").alias("session_end"),
        F.col("value.count").alias("queries"),
    )


def _with_batch(stream: DataFrame) -> StructType:
    return StructType([*stream.schema.fields, StructField("batch_id", LongType())])


def last_batch(table: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row of every key from an update-mode table."""
    return last_per_key(table, keys, "batch_id").drop("batch_id")


def newest_batch(table: DataFrame) -> DataFrame:
    """The rows of the last micro-batch of a complete-mode table; the batch ids are folder names."""
    newest = table.agg(F.max("batch_id").alias("_newest"))
    return table.join(F.broadcast(newest), F.col("batch_id") == F.col("_newest")).drop("batch_id", "_newest")  # one row


# ---------------------------------------------------------------- file drop


def ingest_batch(batch: DataFrame, batch_id: int, layout: Layout, out: str, compact_every: int = 0) -> None:
    """Map, recode and validate one micro-batch of raw text rows; rows and their errors are one table by batch id.

    Every folder is overwritten as a whole, so running a batch twice gives the same tables. Blank fields are null.
    With ``compact_every`` the current rows are written out after every so many batches.
    """
    held = batch.persist()
    try:
        checked_rows(held, layout).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
    finally:
        held.unpersist()
    if compact_every and (batch_id + 1) % compact_every == 0:
        compact(batch.sparkSession, layout, out, batch_id)


def checked_rows(batch: DataFrame, layout: Layout) -> DataFrame:
    """Raw text rows with file and chunk as the layout's columns, recoded, with file, row_no and the first error."""
    mapped = [(h, c) for h, c in map_headers_of([c for c in batch.columns if c not in ("file", "chunk")], layout) if c]
    values = [F.nullif(F.col(f"`{h}`"), F.lit("")).alias(c) for h, c in mapped]
    return with_errors(recode_values(dense_positions(batch).select("file", "row_no", *values), layout), layout)


def with_errors(rows: DataFrame, layout: Layout) -> DataFrame:
    """All rows with the column and the message of their first error, or nulls (the rules of validate_required)."""
    ordered = [c for c in layout.columns if c in layout.required and c in rows.columns]
    absent = [F.lit(c) for c in layout.required if c not in rows.columns]
    empty = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in ordered]
    column = F.coalesce(*absent, *empty)
    text = "Required column not mapped: " if absent else "Empty required field: "
    return rows.withColumns({"error_column": column, "error": F.concat(F.lit(text), column)})


def file_drop_ingest(stream: DataFrame, layout: Layout, out: str, compact_every: int = 0) -> None:
    """Ingest all files that have arrived (from ``stream_text_files``) and stop."""
    query = (
        stream.writeStream.option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, layout, out, compact_every))
        .start()
    )
    query.awaitTermination()


def upsert_batch(batch: DataFrame, batch_id: int, layout: Layout, table: SnapshotTable, out: str) -> None:
    """Write one micro-batch of raw text rows into a table with keys; rejected rows go to a folder of the batch.

    The last row of a key by file and position wins. The table remembers the last batch of this inbox, so a batch
    that is repeated after a failure changes nothing.
    """
    held = batch.persist()
    try:
        marked = checked_rows(held, layout).persist()
        bad = marked.filter(F.col("error").isNotNull())
        bad.select("file", "row_no", "error_column", "error").write.mode("overwrite").parquet(f"{out}/errors/batch_id={batch_id}")
        good = marked.filter(F.col("error").isNull()).withColumn("_order", F.struct("file", "row_no"))
        table.upsert(good, order="_order", applied={out: batch_id})
        marked.unpersist()
    finally:
        held.unpersist()


def file_drop_upserts(stream: DataFrame, layout: Layout, table: SnapshotTable, out: str) -> None:
    """Upsert all files that have arrived (from ``stream_text_files``) into ``table``, micro-batch by micro-batch, and stop.

    Each batch rewrites the files that own its keys and shows as one version of the table.
    """
    query = (
        stream.writeStream.option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: upsert_batch(batch, batch_id, layout, table, out))
        .start()
    )
    query.awaitTermination()


def ingest_errors(spark: SparkSession, out: str) -> DataFrame:
    """file, row, column and message of every rejected row so far."""
    bad = spark.read.parquet(f"{out}/rows").filter(F.col("error").isNotNull())
    return bad.select("file", F.col("row_no").cast("bigint").alias("row"), F.col("error_column").alias("column"), F.col("error").alias("message"))


def _since(spark: SparkSession, out: str) -> tuple[DataFrame | None, int]:
    """(the last compacted table, the batch it covers)."""
    try:
        listed = spark.read.parquet(f"{out}/compacted")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, -1
    upto = listed.agg(F.max("upto")).first()[0]
    return (None, -1) if upto is None else (listed.filter(F.col("upto") == upto).drop("upto"), upto)


def current_rows(spark: SparkSession, layout: Layout, out: str) -> DataFrame:
    """The target as of now: the last valid row of every key over all ingested batches, by batch, file and row.

    Reads the last compacted table and the batches after it only.
    """
    base, upto = _since(spark, out)
    rows = spark.read.schema(_rows_schema(spark, out)).parquet(f"{out}/rows")
    rows = rows.filter((F.col("batch_id") > upto) & F.col("error").isNull())
    order = F.struct(F.col("batch_id").cast("bigint").alias("b"), F.col("file").alias("f"), F.col("row_no").alias("r"))
    rows = rows.withColumn("_order", order).drop("batch_id", "file", "row_no", "error", "error_column")
    if base is not None:
        first = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit("").alias("f"), F.lit(0).cast("bigint").alias("r"))
        rows = rows.unionByName(base.withColumn("_order", first))
    return last_per_key(rows, list(layout.key), "_order").drop("_order")


def _rows_schema(spark: SparkSession, out: str) -> StructType:
    known = spark.read.parquet(f"{out}/rows").schema
    return StructType([f if f.name != "batch_id" else StructField("batch_id", IntegerType()) for f in known.fields])


def compact(spark: SparkSession, layout: Layout, out: str, upto: int) -> None:
    """Write the current rows as of batch ``upto``; later reads start from there."""
    current_rows(spark, layout, out).write.mode("overwrite").parquet(f"{out}/compacted/upto={upto}")


def upserted(target: DataFrame, layout: Layout, out: str) -> DataFrame:
    """``target`` after all ingested rows: known keys get the new values of the columns the files carry, new keys
    are added."""
    rows = current_rows(target.sparkSession, layout, out)
    kept = [c for c in rows.columns if c in target.columns]
    return upsert_rows(target, rows.select(*kept).withColumn("row_no", F.lit(0)), list(layout.key))


def stream_parquet(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    """Stream of the parquet files in a folder whose name matches."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def stream_audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the query audit log, JSON lines: ts, institution, viz_type; malformed lines are skipped."""
    entries = audit_entries(spark.readStream.schema("value string").text(folder))
    return entries.select(
        F.col("timestamp").try_cast("timestamp").alias("ts"), "institution", F.col("vizType").alias("viz_type")
    )


def stream_text_files(spark: SparkSession, folder: str, columns: list[str], files_a_batch: int | None = None) -> DataFrame:
    """Stream of headed CSV files as text columns, with the file and chunk each row came from.

    Files come by their time; ``files_a_batch`` limits how many make a micro-batch.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.readStream.schema(schema).option("header", True).option("escape", '"')
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return with_chunks(reader.csv(folder))
