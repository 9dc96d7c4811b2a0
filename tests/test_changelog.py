"""The merged log of an update-mode stream, sessions in bounded state, repeats that come late."""

import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tassel.streaming import jobs
from tassel.streaming.changelog import ChangeLog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 3])
def test_levels_stay_few_and_the_newest_row_wins(spark, tmp_path, fanout):
    rng, log, want = random.Random(1), ChangeLog(spark, str(tmp_path / "log"), ["k", "part"], fanout), {}
    for batch in range(9):
        new = {(rng.choice([None, *"abcdef"]), rng.randrange(2)): batch for _ in range(rng.randrange(0, 6))}
        want |= new
        log.add(spark.createDataFrame([(*k, v) for k, v in new.items()], "k string, part int, value int"), batch)
        by_level = {}
        for level in log.segments().values():
            by_level[level] = by_level.get(level, 0) + 1
        assert max(by_level.values()) < fanout
        # as many levels as the number of batches has digits
        assert max(by_level) <= len(_digits(batch + 1, fanout)) - 1
    assert rows(log.current()) == sorted(((*k, v) for k, v in want.items()), key=str)
    # what was merged is gone from disk, but for the version before
    held = {name.partition("=")[2] for name in os.listdir(tmp_path / "log" / "data") if "=" in name}
    assert len(held) <= 2 * len(log.segments()) + fanout
    # a repeated or older batch changes nothing
    before = log.versions()
    log.add(spark.createDataFrame([("a", 0, -1)], "k string, part int, value int"), 8)
    assert log.versions() == before


def _digits(n, base):
    out = []
    while n:
        out.append(n % base)
        n //= base
    return out


def events(spark, made):
    return spark.createDataFrame(made, "event_id long, at string, user_id long").select(
        "event_id", F.to_timestamp("at").alias("ts"), "user_id", F.lit("i").alias("institution"), F.lit("bar").alias("viz_type")
    )


def test_a_failed_batch_is_run_again(spark, tmp_path, monkeypatch):
    source, base = str(tmp_path / "in"), str(tmp_path / "job")
    events(spark, [(1, "2024-01-01 10:00:00", 1), (2, "2024-01-02 10:00:00", 1)]).write.parquet(source)
    job = lambda: jobs.run_to_log(
        jobs.daily_counts(spark.readStream.schema(events(spark, []).schema).parquet(source)), base, ["day_start"], fanout=2
    )
    real, calls = ChangeLog._merge, []

    def breaks(log):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return real(log)

    monkeypatch.setattr(ChangeLog, "_merge", breaks)
    with pytest.raises(StreamingQueryException):
        job()
    assert sorted(r.queries for r in job().current().collect()) == [1, 1]


def test_sessions_leave_the_state_when_they_close(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "job")
    schema = events(spark, []).schema
    os.makedirs(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    assert jobs.session_table(stream(), base).count() == 0
    rng, made, open_now = random.Random(2), [], []
    for day in range(1, 6):
        new = [(len(made) + i, f"2024-01-{day:02d} {rng.randrange(8, 18):02d}:{rng.randrange(60):02d}:00", rng.randrange(6)) for i in range(80)]
        made += new
        events(spark, new).write.mode("append").parquet(source)
        got = jobs.session_table(stream(), base)
        assert rows(got) == rows(jobs.activity_sessions(events(spark, made)))
        open_now.append(jobs.open_sessions(jobs.activity_sessions(stream()), base).count())
    assert max(open_now) < 30 < got.count()  # state holds the last hours of one day, not all sessions


def test_a_session_goes_on_over_rounds(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "job")
    schema = events(spark, []).schema
    for i, at in enumerate(("10:00", "10:20", "10:45")):
        events(spark, [(i, f"2024-01-01 {at}:00", 1)]).write.mode("append").parquet(source)
        got = jobs.session_table(spark.readStream.schema(schema).parquet(source), base).collect()
        assert [r.queries for r in got] == [i + 1]


def test_repeats_that_come_late(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "job")
    schema = events(spark, []).schema

    def run(made):
        events(spark, made).write.mode("append").parquet(source)
        return jobs.run_to_table(jobs.without_repeats(spark.readStream.schema(schema).parquet(source), ["event_id"], "ts", "2 hours"), base)

    one, two = (1, "2024-01-01 10:00:00", 1), (2, "2024-01-01 11:00:00", 1)
    run([one, two, two])
    run([(3, "2024-01-02 10:00:00", 1), (4, "2024-01-02 11:30:00", 1)])
    # event 1 is older than the watermark, event 3 still in state
    got = run([one, (3, "2024-01-02 10:00:00", 1), (5, "2024-01-02 12:00:00", 1)])
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4, 5]
    kept = spark.read.format("statestore").load(f"{base}/checkpoint")
    assert sorted(r.event_id for r in kept.select("key.event_id").collect()) == [3, 4, 5]
