"""Readers: headed text files, numbered rows, the audit log, database tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the conformed tables that are not text.
STUDENT_TYPES = {
    "retention": "int",
    "persistence": "int",
    "gpa_group_term_1": "double",
    "gpa_group_year_1": "double",
    **{f"number_of_credits_{kind}_year_{i}": "double" for kind in ("attempted", "earned") for i in range(1, 5)},
    "gatewaymathgradey1": "double",
    "gatewayenglishgradey1": "double",
    "time_to_credential": "double",
}


def read_text_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Headed CSV with every column as text; no inference pass over the data.

    With ``columns`` the schema is given up front and not even the header is read ahead.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
    reader = reader.option("enforceSchema", columns is None).option("multiLine", False)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def _trimmed_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_students(spark: SparkSession, path: str) -> DataFrame:
    """Cohort file with lower-case names; numeric columns typed, text that does not parse is null."""
    df = _trimmed_header(read_text_table(spark, path))
    years = [c for c in df.columns if c.startswith(("years_to_", "first_year_to_", "years_of_last_"))]
    types = {**STUDENT_TYPES, **{c: "double" for c in years}}
    return df.select(
        *[F.col(c).try_cast("double").cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
    )


def read_academic_records(spark: SparkSession, path: str) -> DataFrame:
    df = _trimmed_header(read_text_table(spark, path))
    numeric = {c for c in df.columns if c.startswith(("years_to_", "first_year_"))}
    return df.select(
        *[
            F.col(c).try_cast("double").alias(c) if c in numeric
            else F.col(c).try_cast("bigint").alias(c) if c == "id"
            else F.col(c)
            for c in df.columns
        ]
    )


def read_courses(spark: SparkSession, path: str) -> DataFrame:
    """Course file as conformed enrollments."""
    from ..operators.ingest import conform_enrollments

    return conform_enrollments(read_text_table(spark, path))


def with_chunks(files: DataFrame) -> DataFrame:
    """Adds the file and the chunk (its byte offset) each row was read from; also for streams of files."""
    return files.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk")
    )


def dense_positions(rows: DataFrame) -> DataFrame:
    """Replaces ``chunk`` by ``row_no``, the 1-based position in the file.

    Rows of one chunk are consecutive in one task, so counts per chunk (a small table) turn the
    non-dense row ids into dense positions; no row is sorted.
    """
    ids = rows.withColumn("_id", F.monotonically_increasing_id())
    chunks = ids.groupBy("file", "chunk").agg(F.min("_id").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("file", "chunk", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ids.join(offsets, ["file", "chunk"])
        .withColumn("row_no", F.col("_id") - F.col("_start") + F.col("_before") + 1)
        .drop("chunk", "_id", "_start", "_before")
    )


def number_rows(files: DataFrame) -> DataFrame:
    """Adds ``file`` and ``row_no``; ``files`` must come straight from a file reader."""
    return dense_positions(with_chunks(files))


AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("institution", T.StringType()),
        T.StructField("vizType", T.StringType()),
        T.StructField("rowCount", T.LongType()),
        T.StructField("timestamp", T.StringType()),
    ]
)


def audit_entries(lines: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parsed audit log from raw lines (``value``); malformed lines are skipped, the time range is inclusive."""
    entry = F.from_json("value", T.StructType([*AUDIT_SCHEMA, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    good = lines.filter(F.col("value") != "").select(entry.alias("e")).filter("e._bad is null").select("e.*")
    at: Column = F.col("timestamp").try_cast("timestamp")
    if start:
        good = good.filter(at >= F.to_timestamp(F.lit(start)))
    if end:
        good = good.filter(at <= F.to_timestamp(F.lit(end)))
    return good.select("timestamp", "institution", "prompt", "vizType", "rowCount")


def read_audit_log(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return audit_entries(spark.read.text(path), start, end)


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """Table scan over JDBC, split on a numeric or date column when one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
    return reader.load()


def write_database(df: DataFrame, url: str, table: str, mode: str = "overwrite", batch: int = 1000, **options: str) -> None:
    """Table write over JDBC in batches of rows."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=batch, truncate=True, **options).save()
