"""Repeated passages by sparse suffix arrays: suffixes at minimiser positions, sorted, compared and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import Scratch, gram_hashes, in_arrow, text_slices, word_hashes
from .units import texts_of, units_of, whole_groups, with_id

#: A passage is at least this many words.
PASSAGE = 50
#: A suffix is kept where its first words are the smallest of all in some passage-long window.
GRAM = 10
STREAM_ROWS = 16384
#: Suffixes that begin alike and are compared in one task; larger groups are compared window by window in Spark.
GROUP_ROWS = 200_000
_LOW = 21  # bits for a place in a slice


def minimisers(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, owner, text, hash of the owner's first words) of every PASSAGE-long window.

    The owner is the place in the window whose GRAM words have the smallest hash, the leftmost of equals; equal
    windows have it at the same distance, wherever they stand.
    """
    none = np.zeros(0, np.int64)
    n = len(words) - GRAM + 1
    width = PASSAGE - GRAM + 1
    starts = np.concatenate([np.arange(a, b - PASSAGE + 1) for a, b in zip(bounds[:-1], bounds[1:])]) if len(bounds) > 1 else none
    if n < width or not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    grams = gram_hashes(words, GRAM)
    low = np.uint64((1 << max(_LOW, int(n).bit_length())) - 1)
    least = (grams & ~low) | np.arange(n, dtype=np.uint64)
    done = 1
    while done < width:  # smallest over a window by doubling
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    owner = (least[starts] & low).astype(np.int64)
    text = np.searchsorted(bounds, starts, side="right") - 1
    return starts.astype(np.int64), owner, text, grams[owner]


def _runs(owner: np.ndarray) -> np.ndarray:
    """First window of each owner; an owner's windows are consecutive."""
    if not len(owner):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Rows of ``values``, sorted by ``owner``, as lists of 0..n-1."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _key, doc_id, text) -> words and the different hashes of the suffixes kept."""
    for batch in batches:
        for first, end, raw, offsets in text_slices(batch.column(3)):
            words, bounds = word_hashes(raw, offsets)
            _, owner, text, grams = minimisers(words, bounds)
            at = _runs(owner)
            order = np.lexsort((grams[at], text[at]))
            t, g = text[at][order], grams[at][order]
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (g[1:] != g[:-1]))) if len(t) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).slice(first, end - first) for i in range(3)],
                    pa.array(np.diff(bounds), pa.int64()),
                    _lists(g[new].view(np.int64), t[new], end - first),
                ],
                names=["_id", "_key", "doc_id", "n_words", "kept"],
            )


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, shared, text) -> kept suffixes whose beginning another text shares: (gram, unit, first window,
    hashes of the windows it owns)."""
    for batch in batches:
        for first, end, raw, offsets in text_slices(batch.column(2)):
            words, bounds = word_hashes(raw, offsets)
            starts, owner, text, grams = minimisers(words, bounds)
            units = batch.column(0).slice(first, end - first).to_numpy()
            shared = batch.column(1).slice(first, end - first)
            listed = np.repeat(np.arange(end - first), pa.compute.list_value_length(shared).to_numpy(zero_copy_only=False).astype(np.int64))
            hashes = shared.flatten().to_numpy().view(np.uint64)
            # (text, hash) pairs as one number each; sorted, so that windows can be looked up
            tag = np.uint64(0x9E3779B97F4A7C15)
            with np.errstate(over="ignore"):
                wanted = np.unique(hashes ^ (listed.astype(np.uint64) * tag))
                mine = grams ^ (text.astype(np.uint64) * tag)
            if not len(wanted) or not len(mine):
                continue
            at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
            keep = wanted[at] == mine
            starts, owner, text, grams = starts[keep], owner[keep], text[keep], grams[keep]
            if not len(starts):
                continue
            windows = gram_hashes(words, PASSAGE)[starts]
            begin = _runs(owner)
            ends = np.append(begin[1:], len(starts))
            data = windows.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[begin].view(np.int64)),
                    pa.array(units[text[begin]]),
                    pa.array(starts[begin] - bounds[text[begin]]),
                    pa.array([data[8 * a : 8 * b] for a, b in zip(begin, ends)], pa.binary()),
                ],
                names=["gram", "unit", "first", "windows"],
            )


def _spans(unit: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Window starts -> merged spans (unit, start, end)."""
    order = np.lexsort((start, unit))
    unit, start = unit[order], start[order]
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (start[1:] > start[:-1] + PASSAGE)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(unit)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(unit[at]), pa.array(start[at]), pa.array(start[last] + PASSAGE)], names=["unit", "start", "end"]
    )


def _compare(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole groups of suffixes that begin alike -> spans of windows that another unit has too.

    Equal windows have equal owners at equal distances, so sorting the windows of a group brings each next to
    its equals: to the left and right of the shared beginning, as far as passages reach.
    """
    data = table.column("windows").to_pylist()
    counts = np.array([len(x) // 8 for x in data])
    windows = np.frombuffer(b"".join(data), np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    unit = table.column("unit").to_numpy()[row]
    start = table.column("first").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.lexsort((unit, windows))
    w, u = windows[order], unit[order]
    group = np.cumsum(np.concatenate(([True], w[1:] != w[:-1]))) - 1
    # sorted by unit inside a group: another unit is there if the first and the last differ
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    several = u[edge] != u[np.append(edge[1:], len(u)) - 1]
    shared = order[several[group]]
    if len(shared):
        yield _spans(unit[shared], start[shared])


def _compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from whole_groups(batches, ["gram"], STREAM_ROWS, _compare)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column(3).to_pylist()
        counts = np.array([len(x) // 8 for x in data])
        row = np.repeat(np.arange(len(counts)), counts)
        start = batch.column(2).to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.frombuffer(b"".join(data), np.int64)), pa.array(batch.column(1).to_numpy()[row]), pa.array(start)],
            names=["window", "unit", "start"],
        )


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def merged(spans: Column) -> Column:
    """Spans in order, overlapping and touching ones joined."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joins = (F.size(done) > 0) & (last["end"] >= s["start"])
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(kept, F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS.simpleString()), step)


def repeated_passages(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each document: doc_id, n_words, copies, spans (word positions, end exclusive, merged).

    A word is in a span if it stands in 50 consecutive words that another document has as well (an equal text,
    too); words are runs of bytes 0-9, a-z (A-Z lowered) and from 128, compared as 64-bit hashes.

    Equal texts become units first. Of each unit the suffixes at minimiser positions are kept: any 50 words
    hold one, at the same place wherever they stand. Their first ten words are counted over all units; texts
    with a suffix whose beginning no other unit has are done. The others' suffixes with a shared beginning are
    sorted, and neighbours are compared window by window to the left and right. Suffixes are spread by their
    beginning; a beginning with more than ``group_rows`` suffixes is spread by whole windows instead, summed
    before the shuffle. So neither a hot text nor a hot passage meets in one task.

    Null texts have no words; repeated rows and rows without doc_id are documents, too; no documents give no
    rows; other columns are not used.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    rows = in_arrow(
        with_id(docs).select("_id", "_key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")),
        _sample,
        "_id long, _key string, doc_id long, n_words long, kept array<long>",
    )
    rows = scratch.table(rows, "sampled")
    units = units_of(rows, scratch, ["kept", "n_words"])
    kept = units.select("unit", F.explode("kept").alias("gram"))
    shared = kept.groupBy("gram").agg(F.count("*").alias("_n")).filter("_n > 1")
    met = kept.join(shared, "gram").groupBy("unit").agg(F.collect_list("gram").alias("shared"))
    wanted = units.select("unit", "_key", "rep").join(met, "unit")
    texts = texts_of(docs, wanted).select("unit", "shared", "text")
    suffixes = scratch.table(
        in_arrow(texts, _suffixes, "gram long, unit long, first long, windows binary"), "suffixes"
    )
    crowded = suffixes.groupBy("gram").agg(F.count("*").alias("_n")).filter(F.col("_n") > group_rows).select("gram")
    crowded = scratch.table(crowded, "crowded")
    spans = "unit long, start long, end long"
    some = crowded.isEmpty()
    near = suffixes if some else suffixes.join(crowded, "gram", "left_anti")
    found = in_arrow(near.repartition("gram").sortWithinPartitions("gram"), _compare_all, spans)
    if not some:
        far = in_arrow(suffixes.join(crowded, "gram", "left_semi"), _unpacked, "window long, unit long, start long")
        several = far.groupBy("window").agg(F.min("unit").alias("_a"), F.max("unit").alias("_b")).filter("_a <> _b")
        hits = far.join(several, "window", "left_semi")
        found = found.unionAll(hits.select("unit", "start", (F.col("start") + PASSAGE).alias("end")))
    by_unit = found.groupBy("unit").agg(merged(F.collect_list(F.struct("start", "end"))).alias("spans"))
    known = units.select(F.col("_key").alias("_k"), "unit", "copies").join(by_unit, "unit", "left")
    joined = rows.drop("kept").join(known, F.col("_key") == F.col("_k"), "left")
    none = F.array().cast(SPANS.simpleString())
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    spans_of = F.when((F.col("copies") > 1) & (F.col("n_words") >= PASSAGE), whole).otherwise(F.coalesce("spans", none))
    return joined.select("doc_id", "n_words", F.coalesce("copies", F.lit(1)).alias("copies"), spans_of.alias("spans"))


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Words outside the spans, joined by spaces: (doc_id, text), for documents with unique doc_ids.

    Cuts what :func:`repeated_passages` found, everywhere it stands.
    """
    from .op5_licenses import words_of

    words = docs.select("doc_id", words_of(F.col("text")).alias("_w")).join(spans.select("doc_id", "spans"), "doc_id")
    inside = lambda i: F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"]))
    return words.select("doc_id", F.array_join(F.filter("_w", lambda w, i: ~inside(i)), " ").alias("text"))
