"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitioning."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 32
ROUNDS = 4
FINE = 16


def _draw(rows: DataFrame, rate: float) -> list[tuple[tuple[str, int, int], int]]:
    """Keys drawn with a chance of size x rate, sorted, with how often each counts."""
    u = F.pmod(F.xxhash64("_key", "_tie", "_nth"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.filter(u < F.col("size") * rate).select("_key", "_tie", "_nth", "size").collect()
    return sorted(((r[0], r[1], r[2]), max(1, round(r[3] * rate))) for r in drawn)


def _quantiles(sample: list, parts: int) -> list[tuple]:
    total, seen, out = sum(w for _, w in sample), 0, []
    for key, weight in sample:
        if seen * parts // total != (seen + weight) * parts // total and (not out or out[-1] != key):
            out.append(key)
        seen += weight
    return out[:-1] if out and out[-1] == sample[-1][0] else out


def _range_of(bounds: list[tuple[str, int, int]]) -> Column:
    """Number of boundaries at or below the key, in two short steps rather than one long one."""
    if not bounds:
        return F.coalesce(F.length("_key") * 0, F.lit(0))
    quoted = [f"struct('{k}' as _key, {t}L as _tie, {n}L as _nth)" for k, t, n in bounds]
    key = F.struct("_key", "_tie", "_nth")
    groups = [quoted[i : i + FINE] for i in range(0, len(quoted), FINE)]
    heads = F.expr("array(" + ", ".join(g[0] for g in groups) + ")")
    table = F.expr("array(" + ", ".join("array(" + ", ".join(g) + ")" for g in groups) + ")")
    block = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.get(table, block - 1), lambda b: b <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * FINE + inside)


def range_shards(rows: DataFrame, n_shards: int, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows with ``_key`` (text), ``_tie`` (long, no null), ``_nth`` (long, one of its own
    for each row, the same at each reading) and ``size`` (long, from 1).

    Draws about ``SAMPLES_PER_RANGE`` keys for each of ``n_shards * ranges_per_shard`` ranges, each key with a
    chance in proportion to its size, takes weighted quantiles as boundaries and totals the ranges. A range over
    twice its due is sampled again and cut (``ROUNDS`` times at most). Byte
    positions are then exact: ranges are totalled before, and a window runs inside each range only, so a shard
    ends at the row whose middle crosses its share. Sizes differ from equal shares by at most one row's size.
    Rows with equal (_key, _tie) take adjacent slots in the order of _nth and may be cut between any two. An empty table gives no rows.
    """
    spark = rows.sparkSession
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 1
    parts = n_shards * ranges_per_shard
    sample = _draw(rows, parts * SAMPLES_PER_RANGE / total) if n else []
    bounds = _quantiles(sample, parts) if sample else []
    for turn in range(ROUNDS + 1):
        # the last turn only totals, so that the totals are those of the last boundaries
        sums = rows.groupBy(_range_of(bounds).alias("_range")).agg(F.sum("size"), F.count("*")).collect()
        over = [r for r in sums if r[1] > 2 * total / parts and r[2] > 1]
        if not over or turn == ROUNDS:
            break
        again = _draw(
            rows.filter(_range_of(bounds).isin([r[0] for r in over])), parts * SAMPLES_PER_RANGE * 2 / total
        )
        edges = [("", 0, 0)] + bounds
        more: list[tuple[str, int, int]] = []
        for r in over:
            inside = [(k, w) for k, w in again if bisect_right(bounds, k) == r[0]]
            if inside:
                more += [k for k in _quantiles(inside, max(2, round(2 * r[1] * parts / total))) if k != edges[r[0]]]
        if not more:
            break
        bounds = sorted({*bounds, *more})
    table, bytes_before, rows_before = [], 0, 0
    for r in sorted(sums, key=lambda r: r[0]):
        table.append((r[0], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r[1], rows_before + r[2]
    if n and (bytes_before, rows_before) != (total, n):
        raise RuntimeError(f"ranges hold {rows_before} rows of {bytes_before} bytes, the table {n} of {total}")
    offsets = spark.createDataFrame(table, "_r int, _bytes long, _rows long")
    # one row for each range
    placed = rows.withColumn("_range", _range_of(bounds)).join(
        F.broadcast(offsets), F.col("_range") == F.col("_r")
    )
    inside = Window.partitionBy("_range").orderBy("_key", "_tie", "_nth")
    end = F.col("_bytes") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumns({"_end": end, "_row": F.col("_rows") + F.row_number().over(inside) - 1})
    middle = F.expr(f"(2 * _end - size) * {n_shards} div (2 * {total}L)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))
    placed = Scratch(spark, "shards").table(placed.drop("_range", "_r", "_bytes", "_rows", "_end"))
    firsts = placed.groupBy(F.col("shard").alias("_s")).agg(F.min("_row").alias("_first"))
    # one row for each shard
    joined = placed.join(F.broadcast(firsts), F.col("shard") == F.col("_s"))
    return joined.withColumn("slot", F.col("_row") - F.col("_first")).drop("_row", "_s", "_first")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document, with shards of nearly equal bytes.

    The key is (md5 of the text, doc_id, a number of the row): equal texts are neighbours, so they share a shard unless a boundary
    falls between them, and a text that many documents share is cut by doc_id. A null text has no bytes (size 1,
    CRC 0); a null doc_id sorts first; repeated rows each get a slot. Other columns are not carried.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("_tie"),
        F.monotonically_increasing_id().alias("_nth"),
    )
    slim = Scratch(docs.sparkSession, "shard-keys").table(slim)
    return range_shards(slim, n_shards).drop("_key", "_tie", "_nth")
