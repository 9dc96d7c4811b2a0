"""Distinct texts (units) of a table, connected classes, and pairs inside groups in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

NO_ID = -(2**63)


def with_id(docs: DataFrame) -> DataFrame:
    """doc_id as a long without nulls (``_id``) and the text's MD5 (``_key``; null for a null text)."""
    return docs.withColumns(
        {
            "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
            "_key": F.md5(F.col("text").cast("binary")),
        }
    )


def units_of(members: DataFrame, scratch: Scratch, carried: list[str]) -> DataFrame:
    """One row for each ``_key`` of members (_id, _key, carried): unit (long), _key, rep (smallest _id), copies.

    Copies are combined before the shuffle, so a text that a third of all rows share costs a row a task.
    """
    firsts = [F.first(c).alias(c) for c in carried]
    units = members.filter(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.min("_id").alias("rep"), F.count("*").alias("copies"), *firsts
    )
    return scratch.table(units.withColumn("unit", F.monotonically_increasing_id()), "units")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (_key, rep, ...) with the text, read from the row of the representative only."""
    rows = with_id(docs).select(F.col("_key").alias("_k"), "_id", "text")
    joined = wanted.join(rows, (F.col("_key") == F.col("_k")) & (F.col("rep") == F.col("_id")))
    return joined.drop("_k", "_id").dropDuplicates(["_key", "rep"])  # repeated rows; needs no shuffle of its own


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node that each node of edges (a, b) is linked with, directly or not.

    Each round gives all neighbours and the node itself the smallest label among them and lets every node jump
    to its label's label; rounds end when nothing changes. Tables are written between rounds.
    """
    both = scratch.table(
        edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    least = both.groupBy("a").agg(F.min("b").alias("_m"))
    labels = scratch.table(least.select(F.col("a").alias("node"), F.least("a", "_m").alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_n"))
        near = labels.join(seen, F.col("node") == F.col("a")).select("node", F.least("label", "_n").alias("near"), F.col("label").alias("_old"))
        up = labels.select(F.col("node").alias("_p"), F.col("label").alias("_up"))
        jumped = near.join(up, F.col("near") == F.col("_p"), "left").select(
            "node", F.least("near", F.coalesce("_up", "near")).alias("label"), "_old"
        )
        new = scratch.table(jumped, "labels")
        if new.filter("label <> _old").isEmpty():
            return new.drop("_old")
        labels = new.drop("_old")


def in_blocks(members: DataFrame, blocks: str) -> DataFrame:
    """Members (a long ``unit``, and ``blocks``, how many their group has) once for each pair of blocks that holds theirs:
    ``_i <= _j`` are the pair's blocks and ``_side`` is the member's. Two members of a group meet in exactly
    one pair of blocks, so a large group is compared in parts of bounded size."""
    own = F.pmod(F.xxhash64("unit"), F.col(blocks))
    others = F.when(F.col(blocks) == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    dealt = members.withColumn("_own", own).withColumn("_other", F.explode(others))
    return dealt.withColumns(
        {
            "_i": F.least("_own", "_other"),
            "_j": F.greatest("_own", "_other"),
            "_side": (F.col("_own") > F.col("_other")).cast("int"),
        }
    ).drop("_own", "_other")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int, work: Callable) -> Iterator[pa.RecordBatch]:
    """Cuts a stream sorted by ``keys`` (longs) between groups and gives ``work`` tables of whole groups with the
    first row of each, about ``most`` rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        if last:
            return [(table, starts)], None
        if len(starts) == 1:
            return [], table
        return [(table.slice(0, int(starts[-1])), starts[:-1])], table.slice(int(starts[-1]))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            ready, rest = cut(pa.Table.from_batches(held), False)
            for table, starts in ready:
                yield from work(table, starts)
            held = rest.to_batches() if rest is not None else []
            rows = sum(b.num_rows for b in held)
            most = max(most, 2 * rows)
    if held:
        for table, starts in cut(pa.Table.from_batches(held), True)[0]:
            yield from work(table, starts)


def pairs_in_groups(starts: np.ndarray, n: int, side: np.ndarray, same_block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (a < b) of each group; where a group holds two blocks, pairs across them only."""
    ends = np.append(starts[1:], n)
    sizes = ends - starts
    group = np.repeat(np.arange(len(starts)), sizes)
    left = ends[group] - np.arange(n) - 1
    a = np.repeat(np.arange(n), left)
    total = np.cumsum(left)
    b = np.arange(total[-1] if n else 0) - np.repeat(total - left, left) + a + 1
    keep = same_block[a] | (side[a] != side[b])
    return a[keep], b[keep]


def stars(a: np.ndarray, b: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (name, smallest name linked with it) that join the same rows as the pairs (a, b) do."""
    if not len(a):
        return names[:0], names[:0]
    label = names.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != names)
    return names[moved], label[moved]
