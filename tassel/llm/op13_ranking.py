"""Ranked lexical search for many items at once: sums that items share are built once and combined along a graph."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_arrow, text_slices, word_hashes

TOP = 50
#: Items searched together: so many, or fewer if they have more distinct terms than that among them. Each such
#: block passes over the documents twice, once for its terms' document counts and once for the scores.
BLOCK_ITEMS, BLOCK_TERMS = 1000, 100_000
#: Shared pairs are looked for among so many neighbouring terms of an item (by how many items have them).
MINED_TOGETHER = 64
#: Partial sums held at once.
CELLS = 1 << 22
#: Parts in which the tasks' best rows of one item are ranked before they meet.
PARTS = 32
N_DOCS, N_TERMS = -1, -2


class SharedSums:
    """A graph of sums over terms, such that the items' sums share as much as a greedy search finds.

    A leaf is a set of terms that the same items have. An inner node adds two nodes that at least two items have
    together; it takes their place there. What an item has left in the end is added up for it alone. A term reaches an
    item by exactly one way, so the sums are exact, whatever was found to be shared.
    """

    def __init__(self, items: list[np.ndarray], n_terms: int):
        owners: list[list[int]] = [[] for _ in range(n_terms)]
        for i, terms in enumerate(items):
            for t in terms.tolist():
                owners[t].append(i)
        leaves: dict[tuple, int] = {}
        self.leaf_of_term = np.array([leaves.setdefault(tuple(o), len(leaves)) for o in owners], np.int64)
        self.n_leaves = len(leaves)
        runs: list[set[int]] = []  # neighbouring nodes of one item
        self.runs_of_item: list[list[int]] = [[] for _ in items]
        whole: list[list[int]] = [[] for _ in items]
        for owner, node in sorted(leaves.items(), key=lambda x: (-len(x[0]), x[1])):
            for i in owner:
                whole[i].append(node)
        for i, nodes in enumerate(whole):
            for a in range(0, len(nodes), MINED_TOGETHER):
                self.runs_of_item[i].append(len(runs))
                runs.append(set(nodes[a : a + MINED_TOGETHER]))
        self.steps = self._share(runs)
        level = {}
        for z, a, b in self.steps:
            level[z] = 1 + max(level.get(a, 0), level.get(b, 0))
        self.levels = [
            np.array([s for s in self.steps if level[s[0]] == n], np.int64).T for n in range(1, 1 + max(level.values(), default=0))
        ]
        self.n_nodes = self.n_leaves + len(self.steps)
        left = [[node for r in own for node in sorted(runs[r])] for own in self.runs_of_item]
        self.parts = np.array([node for nodes in left for node in nodes], np.int64)
        self.first_part = np.concatenate(([0], np.cumsum([len(nodes) for nodes in left])[:-1])).astype(np.int64)

    def _share(self, runs: list[set[int]]) -> list[tuple[int, int, int]]:
        """(node, its two parts) in the order in which they are found; ``runs`` then hold what is left."""
        fresh = self.n_leaves
        code = [np.array(sorted(r), np.int64) for r in runs]
        pairs = [(c[:, None] * fresh + c[None, :])[np.triu_indices(len(c), 1)] for c in code]
        found, counts = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
        shared = found[counts > 1]
        holders: dict[tuple[int, int], set[int]] = {}
        for r, own in enumerate(pairs):
            for p in own[np.isin(own, shared)].tolist():
                holders.setdefault(divmod(p, fresh), set()).add(r)
        heap = [(-len(r), *pair) for pair, r in holders.items()]
        heapq.heapify(heap)
        steps = []
        while heap:
            size, a, b = heapq.heappop(heap)
            own = holders.get((a, b), ())
            if len(own) < 2:
                continue
            if len(own) != -size:
                heapq.heappush(heap, (-len(own), a, b))
                continue
            own = holders.pop((a, b))
            near: dict[int, set[int]] = {}
            for r in own:
                runs[r] -= {a, b}
                for c in runs[r]:
                    near.setdefault(c, set()).add(r)
                    for old in (a, b):
                        holders.get((min(old, c), max(old, c)), set()).discard(r)
                runs[r].add(fresh)
            steps.append((fresh, a, b))
            for c, r in near.items():
                if len(r) > 1:
                    holders[c, fresh] = r
                    heapq.heappush(heap, (-len(r), c, fresh))
            fresh += 1
        return steps

    def sums(self, term: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """One row an item, one column a document: the sum of ``value`` over the item's terms."""
        held = np.zeros((self.n_nodes, n), np.int64)
        np.add.at(held, (self.leaf_of_term[term], column), value)
        for node, a, b in self.levels:
            held[node] = held[a] + held[b]
        return np.add.reduceat(held[self.parts], self.first_part, axis=0)


class Block:
    """Items searched together: their terms as hashes in order, and what each item sums."""

    def __init__(self, items: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate(items))
        self.items = len(items)
        self.shared = SharedSums([np.searchsorted(self.vocabulary, own) for own in items], len(self.vocabulary))
        self.at_once = max(1, CELLS // max(self.shared.n_nodes, len(self.shared.parts), self.items))
        self.weights = np.zeros(0, np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, counts: dict[int, int]) -> None:
        self.n_docs, self.n_terms = counts.get(N_DOCS, 0), counts.get(N_TERMS, 0)
        rarity = lambda df: math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))
        self.weights = np.array([rarity(counts.get(t, 0)) for t in range(len(self.vocabulary))], np.int64)

    def terms(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text, and for each text and term of the items in it: text, term, occurrences), by text."""
        words, bounds = word_hashes(raw, offsets)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == words)
        text = np.searchsorted(bounds, known, side="right") - 1
        code, times = np.unique(text * len(self.vocabulary) + at[known], return_counts=True)
        return np.diff(bounds), *np.divmod(code, len(self.vocabulary)), times

    def impacts(self, n: np.ndarray, text: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        most = 50 * int(n.max(initial=0)) * self.n_docs
        length = n if most < 2**63 else n.astype(object)
        m = 50 + (50 * length * self.n_docs // self.n_terms).astype(np.int64)
        return self.weights[term] * (1_000_000_000 * times // (1000 * times + 20 * m[text]))


class Best:
    """The ``k`` best documents of each item so far: by score, then with an id before without, then by id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)
        self.held = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        least = self.least
        n = scores.shape[1]
        if n > self.k:
            least = np.maximum(least, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        item, at = np.nonzero(scores >= least[:, None])
        if not len(item):
            return
        new = (item, unnamed[at], ids[at], scores[item, at])
        item, none, doc, score = (np.concatenate(p) for p in zip(self.held, new))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        top = place < self.k
        self.held = [c[top] for c in (item, none[order], doc[order], score[order])]
        full = np.flatnonzero(place == self.k - 1)
        self.least[item[full]] = score[order][full]


def blocks_of(items: DataFrame, most_items: int, most_terms: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(item ids, their distinct terms as hashes) of runs of items; rows of one id are one item. The driver reads one
    block at a time."""
    ids: list = []
    terms: list[np.ndarray] = []
    for item, text in items.orderBy("item_id").toLocalIterator():
        parts = [word_hashes(raw, offsets)[0] for _, _, raw, offsets in text_slices(pa.array([text], pa.string()))]
        own = np.unique(np.concatenate(parts))
        if not len(own):
            continue
        if ids and ids[-1] == item:
            terms[-1] = np.union1d(terms[-1], own)
            continue
        if ids and (len(ids) >= most_items or sum(map(len, terms)) + len(own) > most_terms):
            yield ids, terms
            ids, terms = [], []
        ids.append(item)
        terms.append(own)
    if ids:
        yield ids, terms


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    block_items: int = BLOCK_ITEMS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest score above 0 for each item.

    ``docs`` has doc_id and text, ``items`` item_id and text. Terms are runs of bytes 0-9, a-z (A-Z lowered) and
    from 128, as 64-bit hashes, of whole texts. With N documents that have terms, L terms in all, n terms of a document,
    a term's df documents and its tf occurrences: w = floor(1000 * ln((2N + 2) / (2df + 1))),
    m = 50 + 50nN div L, and the score is the sum of w * (10^9 tf div (1000 tf + 20m)) over the item's distinct terms.

    Equal scores go by ascending doc_id, a null one last. Each row is a document, so repeated rows each get a rank; item
    rows of one id are one item with the terms of all. Null and empty texts, and items without terms, give nothing;
    without documents or items there are no rows. Other columns are not used.

    Items come in blocks. For each the terms that items share are mined on the driver (``SharedSums``), a first
    pass counts documents and terms, and a second one sums what each term adds to each document in the leaves of the
    graph, once, and combines them up to the items. A task keeps ``k`` rows an item; they are ranked in parts, then
    together. Each block's rows are written before the next block is read.
    """
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "ranking"), []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).filter(F.col("text").isNotNull())
    id_type = items.schema["item_id"].dataType.simpleString()
    for ids, terms in blocks_of(items.select("item_id", "text"), block_items, block_terms):
        block = Block(terms)

        def count(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            found = np.zeros(len(block.vocabulary), np.int64)
            n_docs = n_terms = 0
            for batch in batches:
                for _, _, raw, offsets in text_slices(batch.column(1)):
                    n, _, term, _ = block.terms(raw, offsets)
                    n_docs += int((n > 0).sum())
                    n_terms += int(n.sum())
                    found += np.bincount(term, minlength=len(found))
            seen = np.flatnonzero(found)
            columns = [np.append(seen, [N_DOCS, N_TERMS]), np.append(found[seen], [n_docs, n_terms])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "n"])

        totals = in_arrow(own, count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        block.weigh({r.term: r.n for r in totals.collect()})  # a row for each of the block's terms
        sent = spark.sparkContext.broadcast(block)

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            best = Best(block.items, k)
            for batch in batches:
                unnamed = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                names = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                for first, end, raw, offsets in text_slices(batch.column(1)):
                    n, text, term, times = block.terms(raw, offsets)
                    value = block.impacts(n, text, term, times) if len(text) else times
                    some, text = np.unique(text, return_inverse=True)  # texts with a term of any item
                    for a in range(0, len(some), block.at_once):
                        b = min(a + block.at_once, len(some))
                        s = slice(*np.searchsorted(text, [a, b]))
                        scores = block.shared.sums(term[s], text[s] - a, value[s], b - a)
                        at = first + some[a:b]
                        best.add(scores, names[at], unnamed[at])
            item, none, doc, found = best.held
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=none), pa.array(found, pa.int64())],
                names=["_item", "doc_id", "score"],
            )

        found = in_arrow(own, score, "_item long, doc_id long, score long")
        by = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = Window.partitionBy("_item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))).orderBy(*by)
        few = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("rank")
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*by))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"_n long, item_id {id_type}")
        joined = ranked.join(F.broadcast(names), F.col("_item") == F.col("_n"))  # a row for each item of the block
        parts.append(scratch.table(joined.select("item_id", "rank", "doc_id", "score"), "ranked"))
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
