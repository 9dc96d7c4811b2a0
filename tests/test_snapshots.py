"""Tables that change at once: upserts by file, writes that fail, writers that meet, clean-up."""

import pytest
from pyspark.sql import functions as F

from tassel.operators import ingest
from tassel.operators.ranks import last_at_most
from tassel.sources import snapshots
from tassel.sources.snapshots import SnapshotTable, TableChanged


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "a table"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def people(spark, ids, name="n", extra=0):
    return spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("id")).select(
        F.col("id").cast("long"), F.concat(F.lit(name), "id").alias("name"), F.lit(extra).alias("extra"))


def test_upsert_rewrites_the_files_of_its_keys_only(spark, table):
    base = people(spark, range(0, 2000, 2))
    table.overwrite(base, keys=["id"], file_rows=100)
    before = table.files()
    assert len(before) >= 10 and sum(f.rows for f in before) == 1000
    assert all(a.last.id < b.first.id for a, b in zip(before, before[1:]))
    touched = before[4]
    batch = people(spark, [touched.first.id, touched.first.id + 1, touched.last.id], "new").drop("extra").withColumn("row_no", F.lit(1))
    change = table.upsert(batch)
    assert (change.replaced, change.left) == (1, len(before) - 1)
    after = table.files()
    assert {f.path for f in before} - {f.path for f in after} == {touched.path}
    assert rows(table.read()) == rows(ingest.upsert(base, batch, ["id"]))
    # the version before is still whole
    assert rows(table.read(1)) == rows(base)


@pytest.mark.parametrize("keys", [["id"], ["name", "id"], ["half", "name"]])
def test_many_upserts_equal_the_plain_ones(spark, table, keys):
    import random

    rng = random.Random(len(keys))
    schema = "id long, name string, half decimal(9,1), note string"
    wanted = spark.createDataFrame([(None, None, None, "lost")] * 3, schema)
    from decimal import Decimal

    pick = lambda n, note: [
        (i, rng.choice("äbcß") + str(i % 7), Decimal(i) / 2, note) for i in sorted(rng.sample(range(-300, 300), n))
    ]
    known = spark.createDataFrame(pick(200, "old"), schema).union(wanted).cache()
    table.overwrite(known, keys=keys, file_rows=20)
    expected = known
    for turn in range(4):
        new = pick(25, f"new {turn}") + [(None, "x", None, "no key")]
        batch = spark.createDataFrame([(*r, i) for i, r in enumerate(new + new[:5])], schema + ", row_no long")
        table.upsert(batch)
        expected = spark.createDataFrame(ingest.upsert(expected, batch, keys).collect(), schema)
        files = table.files()
        assert rows(table.read()) == rows(expected)
        assert sum(f.rows for f in files) == expected.count()
        held = [f for f in files if None not in f.first]
        assert all(a.last < b.first for a, b in zip(held, held[1:]))
        assert all(f.low is None or f.low <= f.first for f in held)


def test_blocks_of_files(spark, table, monkeypatch):
    monkeypatch.setattr(snapshots, "BLOCK", 4)
    base = people(spark, range(0, 600, 3))
    table.overwrite(base, keys=["id"], file_rows=10)
    batch = people(spark, [-5, 0, 1, 299, 300, 598, 10_000], "new").withColumn("row_no", F.lit(1))
    table.upsert(batch)
    assert rows(table.read()) == rows(ingest.upsert(base, batch, ["id"]))


def test_into_an_empty_table_and_a_batch_without_keys(spark, table):
    table.overwrite(people(spark, [1]).filter("id > 5"), keys=["id"])
    assert table.read().count() == 0
    batch = people(spark, range(50)).withColumn("row_no", F.lit(1))
    assert table.upsert(batch).added >= 1
    assert table.read().count() == 50
    version = table.versions()
    assert table.upsert(batch.withColumn("id", F.lit(None).cast("long"))).added == 0
    assert table.versions() == version


def test_an_owner_that_gets_most_rows_is_split(spark, table):
    table.overwrite(people(spark, range(100)), keys=["id"], file_rows=50)
    batch = spark.range(1000, 3000).select("id", F.lit("late").alias("name"), F.lit(0).alias("row_no"))
    table.upsert(batch)
    assert max(f.rows for f in table.files()) <= 50 and table.read().count() == 2100


def test_a_repeated_key_is_an_error(spark, table):
    with pytest.raises(ValueError, match="occurs twice"):
        table.overwrite(people(spark, [1, 1, 1]), keys=["id"], file_rows=2)
    assert table.versions() == []


def test_a_batch_is_applied_once(spark, table):
    table.overwrite(people(spark, range(10)), keys=["id"])
    one = people(spark, [1], "one").withColumn("row_no", F.lit(1))
    two = people(spark, [1], "two").withColumn("row_no", F.lit(1))
    table.upsert(one, applied={"inbox": 0})
    table.upsert(two, applied={"inbox": 1})
    table.upsert(one, applied={"inbox": 0})  # repeated after a restart
    assert [r.name for r in table.read().filter("id = 1").collect()] == ["two1"]
    assert table.state()["applied"] == {"inbox": 1} and table.versions() == [1, 2, 3]


def failing(df):
    return df.withColumn("name", F.when(F.col("id") >= 0, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))


@pytest.mark.parametrize("keys", [[], ["id"]])
def test_a_write_that_fails_leaves_the_table(spark, table, keys):
    base = people(spark, range(20))
    table.overwrite(base, keys=keys)
    with pytest.raises(Exception, match="broken"):
        table.overwrite(failing(people(spark, range(5))), keys=keys)
    with pytest.raises(RuntimeError, match="expected 6"):
        table.overwrite(people(spark, range(5)), keys=keys, expected=6)
    if keys:
        with pytest.raises(Exception, match="broken"):
            table.upsert(failing(people(spark, range(5))).withColumn("row_no", F.lit(1)))
    else:
        with pytest.raises(Exception, match="broken"):
            table.append(failing(people(spark, range(5))))
    assert table.versions() == [1] and rows(table.read()) == rows(base)


def test_of_two_writers_one_loses(spark, table):
    table.overwrite(people(spark, range(5)), keys=["id"])
    state = table.state()
    files = [(f.path, f.rows, f.low, f.first, f.last) for f in table.files()]
    table.upsert(people(spark, [9]).withColumn("row_no", F.lit(1)))
    with pytest.raises(TableChanged):
        table._commit(state, files, 0, 1, [])
    assert table.read().count() == 6


def test_appends_meet(spark, table, monkeypatch):
    table.append(people(spark, [1]))
    real, calls = table._commit, []

    def late(*a):
        calls.append(1)
        if len(calls) == 1:  # another writer comes first
            SnapshotTable(spark, table.path).append(people(spark, [2]))
        return real(*a)

    monkeypatch.setattr(table, "_commit", late)
    table.append(people(spark, [3]))
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="keys"):
        table.upsert(people(spark, [1]).withColumn("row_no", F.lit(1)))


def test_partitioned_text_stays_text(spark, table):
    df = spark.createDataFrame([("007", 1), ("08", 2), (None, 3)], "zip string, n int")
    table.overwrite(df, partition_by=["zip"])
    table.append(df)
    assert rows(table.read()) == sorted(rows(df) * 2, key=str)
    assert table.read().schema == df.schema


def test_clean_up(spark, table, tmp_path):
    base = people(spark, range(100))
    table.overwrite(base, keys=["id"], file_rows=10)
    batch = people(spark, [5], "new").withColumn("row_no", F.lit(1))
    table.upsert(batch)
    assert table.expire(2) == 0
    assert table.expire(1) == 1
    assert table.versions() == [2] and rows(table.read()) == rows(ingest.upsert(base, batch, ["id"]))


def test_own_names_are_refused(spark, table):
    with pytest.raises(ValueError, match="snapshot_range"):
        table.overwrite(people(spark, [1]).withColumn("snapshot_range", F.lit(1)), keys=["id"])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9])
def test_last_at_most(spark, n):
    bounds = [None, *range(0, 10 * (n - 1), 10)]
    df = spark.createDataFrame([(bounds, v) for v in range(-15, 10 * n)], "b array<int>, v int")
    for r in df.withColumn("at", last_at_most(F.col("b"), F.col("v"), n)).collect():
        assert r.at == max(i for i, b in enumerate(bounds) if b is None or b <= r.v)
