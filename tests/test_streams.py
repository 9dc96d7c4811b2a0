"""Streaming jobs: late data, repeats, restarts."""

import os

from pyspark.sql import functions as F

from tassel.sources.layouts import BY_ID
from tassel.sources.snapshots import SnapshotTable
from tassel.streaming import jobs

LAYOUT = BY_ID["ml_predictions"]
HEADER = ["Student ID", "Prediction Type", "Prediction Value", "Confidence"]


def drop_file(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([",".join(HEADER), *[",".join(r) for r in rows]]) + "\n")


def current(spark, out):
    rows = jobs.current_rows(spark, LAYOUT, out)
    names = ["student_guid", "prediction_type", "prediction_value", "confidence_score"]
    return sorted(tuple(r) for r in rows.select(*names).collect())


def test_files_arrive_in_turns(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")

    def ingest():
        jobs.file_drop_ingest(jobs.stream_text_files(spark, str(inbox), HEADER), LAYOUT, out)

    drop_file(inbox, "1.csv", [("a", "risk", "0.1", "0.5"), ("b", "risk", "0.2", ""), ("", "risk", "0.3", "1"), ("a", "risk", "0.4", "0.6")])
    ingest()
    assert current(spark, out) == [("a", "risk", "0.4", "0.6"), ("b", "risk", "0.2", None)]
    errors = jobs.ingest_errors(spark, out).collect()
    assert [(e.row, e.column, e.message) for e in errors] == [(3, "student_guid", "Empty required field: student_guid")]
    # nothing new: nothing changes
    ingest()
    assert len(current(spark, out)) == 2
    drop_file(inbox, "2.csv", [("b", "gpa", "3.0", "0.9"), ("c", "gpa", "2.0", "0.8")])
    ingest()
    assert current(spark, out) == [("a", "risk", "0.4", "0.6"), ("b", "gpa", "3.0", "0.9"), ("c", "gpa", "2.0", "0.8")]


def test_compaction_and_upsert(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    for i, value in enumerate(("0.1", "0.2", "0.3")):
        drop_file(inbox, f"{i}.csv", [("a", "risk", value, ""), (f"s{i}", "gpa", value, "1")])
        jobs.file_drop_ingest(jobs.stream_text_files(spark, str(inbox), HEADER), LAYOUT, out, compact_every=2)
    assert [p.name for p in (tmp_path / "out" / "compacted").iterdir()] == ["upto=1"]
    assert current(spark, out) == [("a", "risk", "0.3", None), ("s0", "gpa", "0.1", "1"), ("s1", "gpa", "0.2", "1"), ("s2", "gpa", "0.3", "1")]
    target = spark.createDataFrame([("a", "old", "x"), ("z", "old", "y")], "student_guid string, prediction_type string, note string")
    got = sorted(tuple(r) for r in jobs.upserted(target, LAYOUT, out).collect())
    assert [g[:2] for g in got] == [("a", "risk"), ("s0", "gpa"), ("s1", "gpa"), ("s2", "gpa"), ("z", "old")]
    assert got[0][2] == "x" and got[1][2] is None


def test_files_upserted_one_a_batch(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    table = SnapshotTable(spark, str(tmp_path / "table"))
    known = [(f"k{i:03d}", "old", "0", None, f"note {i}") for i in range(100)]
    columns = "student_guid string, prediction_type string, prediction_value string, confidence_score string, note string"
    table.overwrite(spark.createDataFrame(known, columns), keys=["student_guid"], file_rows=10)
    files = len(table.files())

    def ingest():
        jobs.file_drop_upserts(jobs.stream_text_files(spark, str(inbox), HEADER, files_a_batch=1), LAYOUT, table, out)

    drop_file(inbox, "1.csv", [("k001", "risk", "0.1", "1"), ("k001", "risk", "0.2", "1"), ("", "risk", "0.3", "1")])
    drop_file(inbox, "2.csv", [("k050", "risk", "0.4", ""), ("new", "risk", "0.5", "1")])
    os.utime(inbox / "1.csv", (1, 1))
    drop_file(inbox, "3.csv", [("k001", "risk", "0.6", "1")])
    os.utime(inbox / "2.csv", (2, 2))
    ingest()
    assert table.versions() == [1, 2, 3, 4]  # a version for each file
    got = {r.student_guid: r for r in table.read().collect()}
    assert len(got) == 101 and got["k001"].prediction_value == "0.6" and got["k001"].note == "note 1"
    assert got["k050"].confidence_score is None and got["new"].note is None and got["k002"].prediction_type == "old"
    kept = {f.path for f in table.files(1)} & {f.path for f in table.files()}
    assert len(kept) >= files - 3
    bad = spark.read.parquet(f"{out}/errors").collect()
    assert [(r.row_no, r.error) for r in bad] == [(3, "Empty required field: student_guid")]
    ingest()  # nothing new
    assert table.versions() == [1, 2, 3, 4]


def test_open_windows_are_in_the_update_table(spark, tmp_path):
    source, base = str(tmp_path / "events"), str(tmp_path / "job")
    for i in range(3):
        events(spark, [(i, f"2024-01-0{i + 1} 10:00:00", "i", "bar", 1)] * 2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events(spark, []).schema).parquet(source)
        table = jobs.run_to_table(jobs.daily_counts(stream, "1 hour"), base, "update")
    found = jobs.last_batch(table, ["day_start", "institution", "viz_type"]).collect()
    assert sorted((str(r.day_start)[:10], r.queries) for r in found) == [("2024-01-01", 2), ("2024-01-02", 2), ("2024-01-03", 2)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    drop_file(inbox, "1.csv", [("a", "risk", "0.1", "0.5")])
    batch = spark.read.option("header", True).csv(str(inbox)).select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"))
    for _ in range(2):
        jobs.ingest_batch(batch, 0, LAYOUT, out)
    assert spark.read.parquet(f"{out}/rows").count() == 1


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, at string, institution string, viz_type string, user_id long").select(
        "event_id", F.to_timestamp("at").alias("ts"), "institution", "viz_type", "user_id")


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    source = str(tmp_path / "events")
    base = str(tmp_path / "job")

    def run():
        stream = spark.readStream.schema(events(spark, []).schema).parquet(source)
        return jobs.run_to_table(jobs.daily_counts(stream, "1 hour"), base)

    events(spark, [(1, "2024-01-01 10:00:00", "i", "bar", 1), (2, "2024-01-03 10:00:00", "i", "bar", 1)]).coalesce(1).write.parquet(source)
    assert [(str(r.day_start)[:10], r.queries) for r in run().collect()] == [("2024-01-01", 1)]
    # a row of the closed first day comes too late; the third day closes
    events(spark, [(3, "2024-01-01 11:00:00", "i", "bar", 1), (4, "2024-01-04 12:00:00", "i", "bar", 1)]).coalesce(1).write.mode("append").parquet(source)
    assert sorted((str(r.day_start)[:10], r.queries) for r in run().collect()) == [("2024-01-01", 1), ("2024-01-03", 1)]


def test_same_functions_on_a_batch(spark):
    df = events(spark, [(1, "2024-01-01 10:00:00", "i", "bar", 1), (2, "2024-01-01 10:20:00", "i", "bar", 1), (3, "2024-01-01 12:00:00", "i", "bar", 1)])
    assert sorted(r.queries for r in jobs.activity_sessions(df).collect()) == [1, 2]
    assert sorted(r.queries for r in jobs.sliding_activity(df).collect()) == [1, 2, 3, 3]
