"""Benchmark decontamination: an FM-index per training shard, searched backwards for the test phrases."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import Scratch, in_arrow, text_beside, text_in, text_slices, word_hashes

WINDOW = 13
#: Bytes of text in a shard; each gets an index of its own.
SHARD_BYTES = 1 << 23
#: One suffix position in so many is kept.
SAMPLE = 8
#: Items searched at once; beyond it the documents are passed over again.
ITEM_BLOCK = 20_000


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order. ``text`` ends with 0; every 0 differs from all others, so a
    comparison never runs past one. Prefix doubling, sorting again only what is still tied."""
    n = len(text)
    zero = text == 0
    first = np.where(zero, np.cumsum(zero) - 1, text + zero.sum())
    order = np.argsort(first, kind="stable")
    sorted_first = first[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.searchsorted(sorted_first, sorted_first)
    tied = order[_tied(rank[order])]
    k = 1
    while len(tied):
        key = rank[tied] * (n + 1) + rank[tied + k]
        by = np.argsort(key, kind="stable")
        place, key = tied[by], key[by]
        old = rank[place]
        at = np.arange(len(by))
        slot = old + at - np.searchsorted(old, old)
        order[slot] = place
        new = slot[np.searchsorted(key, key)]
        rank[place] = new
        tied = place[_tied(new)]
        k *= 2
    return order


def _tied(sorted_rank: np.ndarray) -> np.ndarray:
    same = np.zeros(len(sorted_rank) + 1, bool)
    same[1:-1] = sorted_rank[1:] == sorted_rank[:-1]
    return same[1:] | same[:-1]


class WaveletRanks:
    """How often a symbol stands before a place: one bit of the symbol a level, each level sorted by that bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(bit) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(place), place
        for b, ones, zeros in self.levels:
            up = ((symbol >> b) & 1).astype(bool)
            low = np.where(up, zeros + ones[low], low - ones[low])
            high = np.where(up, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_order(text)
        self.last = text[order - 1]  # the symbol before each suffix; before the first stands the final 0
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))
        self.ranks = WaveletRanks(self.last, max(1, int(n_symbols - 1).bit_length()))
        # kept positions: every SAMPLE-th and those after a 0, which no step can pass
        self.kept = (order % SAMPLE == 0) | (self.last == 0)
        self.kept_before = np.cumsum(self.kept) - 1
        self.positions = order[self.kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of phrases (rows, right-aligned): each step puts one more word in front."""
        n = len(phrases)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.last), np.int64)
        alive = np.arange(n)
        for step in range(phrases.shape[1]):
            alive = alive[(lengths[alive] > step) & (high[alive] > low[alive])]
            if not len(alive):
                break
            c = phrases[alive, phrases.shape[1] - 1 - step]
            low[alive] = self.before[c] + self.ranks.rank(c, low[alive])
            high[alive] = self.before[c] + self.ranks.rank(c, high[alive])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a kept position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        moving = np.flatnonzero(~self.kept[rows])
        while len(moving):
            c = self.last[rows[moving]]
            rows[moving] = self.before[c] + self.ranks.rank(c, rows[moving])
            steps[moving] += 1
            moving = moving[~self.kept[rows[moving]]]
        return self.positions[self.kept_before[rows]] + steps


class Phrases:
    """Windows of the items as rows of symbols 1.. over the items' own words, right-aligned."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        hashed = []
        for label, text in items:
            for _, _, raw, offsets in text_slices(pa.array([text], pa.string())):
                words, _ = word_hashes(raw, offsets)
                if len(words):
                    hashed.append((label, words))
        self.vocabulary = np.unique(np.concatenate([w for _, w in hashed])) if hashed else np.zeros(0, np.uint64)
        self.labels = sorted({label for label, _ in hashed})
        number = {x: i for i, x in enumerate(self.labels)}
        pairs: set[tuple[bytes, int]] = set()
        for label, words in hashed:
            ids = np.searchsorted(self.vocabulary, words) + 1
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1):
                pairs.add((ids[i : i + k].astype("<i8").tobytes(), number[label]))
        ordered = sorted(pairs)
        distinct = sorted({p for p, _ in ordered})
        at = {p: i for i, p in enumerate(distinct)}
        self.lengths = np.array([len(p) // 8 for p in distinct], np.int64)
        self.rows = np.zeros((len(distinct), window), np.int64)
        for i, p in enumerate(distinct):
            self.rows[i, window - self.lengths[i] :] = np.frombuffer(p, "<i8")
        # the items of phrase i: owner[first[i] : first[i + 1]]
        self.owner = np.array([o for _, o in ordered], np.int64)
        self.first = np.searchsorted(np.array([at[p] for p, _ in ordered], np.int64), np.arange(len(distinct) + 1))
        self.shortest = int(self.lengths.min()) if distinct else 0


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 ... counts[i] of them, one after another."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)


def shard_hits(raw: np.ndarray, offsets: np.ndarray, phrases: Phrases):
    """(words per text, (text, first word, end word) of merged hit spans, (text, item) pairs) of one shard."""
    words, bounds = word_hashes(raw, offsets)
    n_words, none = np.diff(bounds), np.zeros(0, np.int64)
    if not len(words) or not len(phrases.lengths):
        return n_words, (none, none, none), (none, none)
    at = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == words
    # runs of words that occur in items, within one text, at least as long as the shortest phrase; any phrase
    # lies inside such a run, so the words between runs are all the same separator
    edge = known.copy()
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(words))]
    edge[1:] &= ~known[:-1]
    edge[inner] = known[inner]
    starts = np.flatnonzero(edge)
    if not len(starts):
        return n_words, (none, none, none), (none, none)
    # a run ends before the next unknown word or the next text
    stop = np.zeros(len(words) + 1, bool)
    stop[:-1] = ~known
    stop[inner] = True
    stop[-1] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    long = ends - starts >= phrases.shortest
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts):
        return n_words, (none, none, none), (none, none)
    source = _spread(starts, sizes)
    target = np.arange(len(source)) + np.repeat(np.arange(len(starts)), sizes)
    text = np.zeros(len(source) + len(starts), np.int64)
    text[target] = at[source] + 1
    word_at = np.zeros(len(text), np.int64)
    word_at[target] = source
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.rows, phrases.lengths)
    phrase = np.repeat(np.arange(len(low)), high - low)
    if not len(phrase):
        return n_words, (none, none, none), (none, none)
    begin = word_at[index.locate(_spread(low, high - low))]
    end = begin + phrases.lengths[phrase]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    hit = np.cumsum(change[:-1]) > 0
    first = hit.copy()
    first[1:] &= ~hit[:-1]
    first[inner] = hit[inner]
    after = np.concatenate([~hit, [True]])
    after[inner] = True
    a, b = np.flatnonzero(first), np.flatnonzero(after)
    b = b[np.searchsorted(b, a, side="right")]
    owner = np.searchsorted(bounds, a, side="right") - 1
    spans = (owner, a - bounds[owner], b - bounds[owner])
    in_text = np.searchsorted(bounds, begin, side="right") - 1
    counts = phrases.first[phrase + 1] - phrases.first[phrase]
    item = phrases.owner[_spread(phrases.first[phrase], counts)]
    pairs = np.unique(np.stack([np.repeat(in_text, counts), item], axis=1), axis=0)
    return n_words, spans, (pairs[:, 0], pairs[:, 1])


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def _lists(owner: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))


def _search_block(
    docs: DataFrame, keep: list[str], text: str, items: list[tuple[str, str]], window: int, shard_bytes: int
) -> DataFrame:
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))  # one block of items
    schema = StructType(
        [docs.schema[c] for c in keep]
        + [StructField("n_words", LongType()), StructField("spans", SPANS), StructField("items", ArrayType(StringType()))]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = phrases.value
        labels = np.array(own.labels, object)
        for batch in batches:
            for first, end, raw, offsets in text_slices(text_in(batch, text), shard_bytes):
                n = end - first
                n_words, (of, a, b), (owner, item) = shard_hits(raw, offsets, own)
                span = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(first, n) for c in keep],
                        pa.array(n_words, pa.int64()),
                        pa.ListArray.from_arrays(_lists(of, n), span),
                        pa.ListArray.from_arrays(_lists(owner, n), pa.array(labels[item] if len(item) else [], pa.string())),
                    ],
                    names=[*keep, "n_words", "spans", "items"],
                )

    return in_arrow(text_beside(docs, keep, text), search, schema)


def merged(spans: Column) -> Column:
    """Spans in order, touching and overlapping ones joined."""
    kind = SPANS.simpleString()
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    item_block: int = ITEM_BLOCK,
    text: str = "text",
) -> DataFrame:
    """``keep`` with n_words, spans (word positions, end exclusive, merged) and items (sorted ids as text).

    A phrase is ``window`` consecutive words of an item, or a whole shorter item; words are runs of bytes 0-9,
    a-z (A-Z lowered) and from 128. Each run of texts of about ``shard_bytes`` (a longer text makes a larger
    one) is a shard with its own index. The words of the items make its alphabet; all other words are
    separators, and runs too short for any phrase are left out, as no phrase can occur there. Items come in
    blocks of ``item_block``, each block a pass over the documents; the driver holds two blocks at most.

    Null texts and items have no words; a null item_id counts as the text ``null``; item rows of one id are one
    item; repeated documents are searched each; without documents there are no rows, without items no spans.
    """
    wanted = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator()
    blocks = iter(lambda: [(r[0], r[1] or "") for r in islice(wanted, item_block)], [])
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return _search_block(docs, keep, text, first, window, shard_bytes)
    # more than one block: rows are numbered once in a written table, and each block's finds are written before the block
    # after the next is read, so that the driver holds two at most and a worker one
    scratch = Scratch(docs.sparkSession, "passages")
    own = text_beside(docs, keep, text).select(F.struct(*keep).alias("_keep_"), F.col(text).alias("_text_"))
    rows = scratch.table(own.withColumn("_row_", F.monotonically_increasing_id()), "rows")
    parts = []
    for items_of_block in chain([first, second], blocks):
        found = _search_block(rows, ["_row_"], "_text_", items_of_block, window, shard_bytes)
        parts.append(scratch.table(found if not parts else found.filter(F.size("spans") > 0), "finds"))
    union = reduce(DataFrame.unionAll, parts)
    joined = union.groupBy("_row_").agg(
        F.max("n_words").alias("n_words"),
        merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return rows.drop("_text_").join(joined, "_row_").select("_keep_.*", "n_words", "spans", "items")


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """Hit words make up a twentieth of the text at least."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)
