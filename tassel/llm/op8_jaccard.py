"""N-gram Jaccard join with Bayesian pruning: MinHash values compared a few at a time, survivors verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gram_hashes, gram_places, in_arrow, mix64, text_slices, word_hashes
from .units import NO_ID, components, in_blocks, pairs_in_groups, stars, texts_of, units_of, whole_groups, with_id

SHINGLE = 5
THRESHOLD = (4, 5)  # similarity of at least 4/5, in whole numbers
BANDS, ROWS = 25, 4
STEP = 20
TOLERANCE = 1e-6
#: Units compared at once in one block, and shingles verified at once in one block.
BLOCK_UNITS = 512
BLOCK_GRAMS = 1 << 20
STREAM_ROWS = 8192
#: Members of sets laid out as bits at once, and pairs compared at once.
BITS = 1 << 14
PAIRS = 500_000


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, shingles before each text, words of each text): every k words, or all words of a shorter text."""
    words, bounds = word_hashes(raw, offsets)
    n = np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < k))
    places, _ = gram_places(bounds, k)
    grams = gram_hashes(words, k)[places] if len(places) else np.zeros(0, np.uint64)
    counts = np.maximum(n - k + 1, 0)
    if len(short):
        whole = np.array([gram_hashes(words[bounds[i] : bounds[i + 1]], n[i])[0] for i in short], np.uint64)
        before = np.concatenate(([0], np.cumsum(counts)))
        grams = np.insert(grams, before[short], mix64(whole + n[short].astype(np.uint64)))
        counts[short] = 1
    return grams, np.concatenate(([0], np.cumsum(counts))), n


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def min_hashes(grams: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
    """MinHash values [text, n]; a text without shingles keeps the largest value."""
    out = np.full((len(before) - 1, n), np.iinfo(np.uint32).max, np.uint32)
    some = np.flatnonzero(np.diff(before))
    if len(some):
        low = (grams >> np.uint64(32)).astype(np.uint32)
        multiply, add = hash_family(n)
        buffer = np.empty_like(low)
        with np.errstate(over="ignore"):
            for j in range(n):
                np.multiply(low, multiply[j], out=buffer)
                buffer += add[j]
                out[some, j] = np.minimum.reduceat(buffer, before[some])
    return out


def posterior(matches: int, compared: int, threshold: float) -> float:
    """Chance that the similarity reaches ``threshold``, after so many matches from a uniform prior.

    The similarity is then Beta(matches + 1, misses + 1); its upper tail is a binomial sum.
    """
    n = compared + 1
    return sum(comb(n, i) * threshold**i * (1 - threshold) ** (n - i) for i in range(matches + 1))


def fewest_matches(compared: int, threshold: float, tolerance: float) -> int:
    return next(m for m in range(compared + 1) if posterior(m, compared, threshold) >= tolerance)


def surviving(a: np.ndarray, b: np.ndarray, values: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no step of the comparison rules out."""
    same = np.zeros(len(a), np.int16)
    for end in sorted(least):
        for s in range(0, len(a), 1 << 17):
            part = slice(s, s + (1 << 17))
            same[part] += (values[a[part], end - STEP : end] == values[b[part], end - STEP : end]).sum(axis=1, dtype=np.int16)
        keep = same >= least[end]
        a, b, same = a[keep], b[keep], same[keep]
    return a, b


def _values(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _key, doc_id, text) -> words, shingles and MinHash values of each text."""
    for batch in batches:
        for first, end, raw, offsets in text_slices(batch.column(3)):
            grams, before, n = shingles(raw, offsets, SHINGLE)
            values = min_hashes(grams, before, BANDS * ROWS)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).slice(first, end - first) for i in range(3)],
                    pa.array(n, pa.int64()),
                    pa.array(np.diff(before), pa.int64()),
                    pa.array([v.tobytes() for v in values], pa.binary()),
                ],
                names=["_id", "_key", "doc_id", "n_words", "grams", "values"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, values) -> (unit, band key), one row a band."""
    for batch in batches:
        for s in range(0, batch.num_rows, 4096):
            part = batch.slice(s, 4096)
            values = _values(part.column(1), "<u4", BANDS * ROWS).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column(0).to_numpy(), BANDS)), pa.array(key.ravel().view(np.int64))],
                names=["unit", "bucket"],
            )


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MinHash values as 16 bits each, enough to compare."""
    for batch in batches:
        values = _values(batch.column(1), "<u4", BANDS * ROWS).astype("<u2")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([v.tobytes() for v in values], pa.binary())], names=["unit", "short"]
        )


def _same_block(table: pa.Table) -> np.ndarray:
    return table.column("_i").to_numpy() == table.column("_j").to_numpy()


def _near(least: dict[int, int]):
    """Blocks of a bucket -> edges that join all pairs the evidence does not rule out."""

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit, side, same = table.column("unit").to_numpy(), table.column("_side").to_numpy(), _same_block(table)
        values = _values(table.column("short").combine_chunks(), "<u2", BANDS * ROWS)
        ends = np.append(starts[1:], len(unit))
        first = 0
        while first < len(starts):  # as many groups as make about PAIRS pairs
            last = first + 1
            pairs = (ends[first] - starts[first]) ** 2
            while last < len(starts) and pairs + (ends[last] - starts[last]) ** 2 < 2 * PAIRS:
                pairs += (ends[last] - starts[last]) ** 2
                last += 1
            s = slice(int(starts[first]), int(ends[last - 1]))
            a, b = pairs_in_groups(starts[first:last] - starts[first], s.stop - s.start, side[s], same[s])
            a, b = surviving(a, b, values[s], least)
            x, y = stars(a, b, unit[s])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from whole_groups(batches, ["bucket", "_i", "_j"], STREAM_ROWS, work)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, group, blocks, copies, text) -> the text's different shingles in order, and its MinHash values."""
    for batch in batches:
        for first, end, raw, offsets in text_slices(batch.column(4)):
            grams, before, _ = shingles(raw, offsets, SHINGLE)
            values = min_hashes(grams, before, BANDS * ROWS).astype("<u2")
            sets = [np.unique(grams[before[i] : before[i + 1]]).tobytes() for i in range(end - first)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).slice(first, end - first) for i in range(4)],
                    pa.array(sets, pa.binary()),
                    pa.array([v.tobytes() for v in values], pa.binary()),
                ],
                names=["unit", "group", "blocks", "copies", "set", "short"],
            )


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared members of the pairs: sets as rows of bits over all members, ``BITS`` members at a time."""
    members, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros(len(a), np.int64)
    for low in range(0, len(members), BITS):
        inside = slice(*np.searchsorted(at, (low, low + BITS)))
        width = min(BITS, (len(members) - low + 63) // 64 * 64)
        rows = np.zeros((len(sets), width), np.uint8)
        rows[owner[inside], at[inside] - low] = 1
        words = np.packbits(rows, axis=1).view(np.uint64)
        step = max(1, (1 << 19) // (width // 64))
        for s in range(0, len(a), step):
            both = words[a[s : s + step]] & words[b[s : s + step]]
            out[s : s + step] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return out


def _verify(least: dict[int, int]):
    """Blocks of a group -> (unit, other, texts, copies): each unit's links in this block pair, and edges that join them."""

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit, side, same = table.column("unit").to_numpy(), table.column("_side").to_numpy(), _same_block(table)
        copies = table.column("copies").to_numpy()
        values = _values(table.column("short").combine_chunks(), "<u2", BANDS * ROWS)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        for s, e in zip(starts, np.append(starts[1:], len(unit))):
            a, b = pairs_in_groups(np.zeros(1, np.int64), e - s, side[s:e], same[s:e])
            a, b = surviving(a, b, values[s:e], least)
            own = sets[s:e]
            sizes = np.array([len(x) for x in own], np.int64)
            both = common_counts(own, a, b) if len(a) else np.zeros(0, np.int64)
            linked = (both > 0) & (both * THRESHOLD[1] >= (sizes[a] + sizes[b] - both) * THRESHOLD[0])
            a, b = a[linked], b[linked]
            n = e - s
            texts = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            documents = np.zeros(n, np.int64)
            np.add.at(documents, a, copies[s:e][b])
            np.add.at(documents, b, copies[s:e][a])
            x, y = stars(a, b, unit[s:e])
            some = np.flatnonzero(texts)
            lowest = dict(zip(x.tolist(), y.tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(unit[s:e][some]),
                    pa.array([lowest.get(u, u) for u in unit[s:e][some].tolist()], pa.int64()),
                    pa.array(texts[some]),
                    pa.array(documents[some]),
                ],
                names=["unit", "other", "texts", "documents"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from whole_groups(batches, ["group", "_i", "_j"], 512, work)

    return run


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with _id and _key, units with the representative of their class and their links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    limit = THRESHOLD[0] / THRESHOLD[1]
    least = {n: fewest_matches(n, limit, TOLERANCE) for n in range(STEP, BANDS * ROWS + 1, STEP)}
    signed = in_arrow(
        with_id(docs).select("_id", "_key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")),
        _sign,
        "_id long, _key string, doc_id long, n_words long, grams long, values binary",
    )
    rows = scratch.table(signed, "signed")
    units = units_of(rows, scratch, ["grams", "values"])
    some = units.filter("grams > 0").select("unit", "values")
    bands = scratch.table(in_arrow(some, _bands, "unit long, bucket long"), "bands")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1")
    crowded = bands.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("_n") / BLOCK_UNITS))
    dealt = in_blocks(crowded.drop("_n"), "blocks").drop("blocks")
    short = in_arrow(some, _short, "unit long, short binary")
    met = dealt.join(short, "unit").repartition("bucket", "_i", "_j").sortWithinPartitions("bucket", "_i", "_j")
    near = scratch.table(in_arrow(met, _near(least), "a long, b long"), "near")
    groups = components(near, scratch)
    sized = units.join(groups, units["unit"] == groups["node"]).select("unit", "_key", "rep", "copies", "grams", F.col("label").alias("group"))
    sums = sized.groupBy(F.col("group").alias("_g")).agg(F.count("*").alias("_n"), F.sum("grams").alias("_sum"))
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK_UNITS), F.ceil(F.col("_sum") / BLOCK_GRAMS))
    wanted = sized.join(sums, F.col("group") == F.col("_g")).select("unit", "_key", "rep", "copies", "group", blocks.alias("blocks"))
    texts = texts_of(docs, wanted).select("unit", "group", "blocks", "copies", "text")
    sets = in_arrow(texts, _sets, "unit long, group long, blocks long, copies long, set binary, short binary")
    compared = in_blocks(sets, "blocks").drop("blocks").repartition("group", "_i", "_j").sortWithinPartitions("group", "_i", "_j")
    found = scratch.table(in_arrow(compared, _verify(least), "unit long, other long, texts long, documents long"), "links")
    classes = components(found.filter("unit <> other").select(F.col("unit").alias("a"), F.col("other").alias("b")), scratch)
    links = found.groupBy("unit").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    known = (
        units.select("unit", "_key", "rep", "copies")
        .join(classes.withColumnRenamed("node", "unit"), "unit", "left")
        .join(links, "unit", "left")
        .withColumn("_class", F.coalesce("label", "unit"))
    )
    firsts = known.groupBy("_class").agg(F.min(F.struct("rep", "_key")).alias("first"))
    known = known.join(firsts, "_class").select(
        "_key",
        "rep",
        "first",
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
    )
    return rows, known


def similar_texts(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, n_text_links, n_words.

    Two documents are linked if their sets of five-word shingles (all words of a shorter text) have a Jaccard
    similarity of 0.8 or more, or their texts are equal. ``class_id`` is the smallest doc_id of all documents
    linked directly or through others; ``n_links`` counts the documents linked directly, ``n_text_links`` the
    different texts among them.

    Steps: equal texts become units; units that agree in one of 25 bands of 4 MinHash values are candidates (a
    pair at 0.8 is missed with a chance of 2e-6); their 100 values are compared 20 at a time and a pair is
    dropped once the posterior chance of reaching 0.8 is below 1e-6; what survives is joined to groups and
    verified on the shingle sets (as 64-bit hashes). Buckets and groups of any size are compared in pairs of
    blocks of bounded size, and tasks give sums and edges, never pairs, so nothing grows with a group's square
    but the comparisons that counting its links takes.

    Null texts are linked with nothing; texts without words only with equal ones; null doc_ids count as the
    smallest and give a null class_id; repeated rows are copies; no documents give no rows; other columns are
    not used.
    """
    rows, known = _classes(docs)
    links = known.select(F.col("_key").alias("_k"), F.col("first.rep").alias("_c"), "n_links", "n_text_links")
    joined = rows.join(links, F.col("_key") == F.col("_k"), "left").withColumn("_c", F.coalesce("_c", "_id"))
    return joined.select(
        "doc_id",
        F.when(F.col("_c") != NO_ID, F.col("_c")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
        "n_words",
    )


def drop_similar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class of :func:`similar_texts` the row with the
    smallest doc_id stays (then the smallest MD5 of the text; of repeated rows, one). Rows with a null text stay.
    All columns stay as they are."""
    _, known = _classes(docs)
    first = known.filter((F.col("first.rep") == F.col("rep")) & (F.col("first._key") == F.col("_key")))
    first = first.select(F.col("_key").alias("_k"), F.col("rep").alias("_r"))
    packed = with_id(docs.select("doc_id", "text", F.struct("*").alias("row"))).select("_id", "_key", "row")
    kept = packed.join(first, (F.col("_key") == F.col("_k")) & (F.col("_id") == F.col("_r"))).dropDuplicates(["_key", "_id"])
    return kept.select("row.*").unionAll(packed.filter(F.col("_key").isNull()).select("row.*"))
