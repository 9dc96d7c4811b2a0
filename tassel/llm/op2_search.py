"""Exact top-k by inner product, with bounds from segment means and deviations, coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_arrow

#: Segments per level, coarse to fine.
LEVELS = (1, 4, 16)
#: Queries scored together; the driver holds one block at a time.
QUERY_BLOCK = 2048
ROWS_AT_ONCE = 2048
EXACT = 2.0**53
OUT = "_q long, vec_id long, score long"


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(length) x mean and sqrt(length) x deviation.

    With n values a segment, d(x, y)^2 >= sum n * ((mean - mean)^2 + (dev - dev)^2) by Cauchy's inequality, and
    |x|^2 = sum n * (mean^2 + dev^2); so the dot product of two feature rows is the largest inner product
    that this lower bound of the distance leaves possible.
    """
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = []
    for a, b in zip(edges[:-1], edges[1:]):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        parts += [mean * np.sqrt(b - a), np.sqrt(np.square(part - mean[:, None]).sum(axis=1))]
    return np.stack(parts, axis=1)


def pair_scores(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the pairs, held within a long."""
    most = (np.abs(q).max(initial=0)) * (np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        out = np.empty(len(qi), np.int64)
        for a in range(0, len(qi), 1 << 16):
            s = slice(a, a + (1 << 16))
            out[s] = np.einsum("ij,ij->i", q[qi[s]], x[xi[s]])
        return out
    low, high = -(2**63), 2**63 - 1
    as_ints = lambda row: [int(v) for v in row]
    return np.array(
        [min(high, max(low, sum(a * b for a, b in zip(as_ints(q[i]), as_ints(x[j]))))) for i, j in zip(qi, xi)],
        np.int64,
    )


class QueryGroup:
    """Queries of one length, with their best ``k`` so far."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, least=None):
        self.numbers, self.ids, self.vectors, self.k = numbers, ids, vectors, k
        self.features = [segment_features(vectors, s) for s in LEVELS if s < vectors.shape[1]]
        self.least = np.full(len(ids), -np.inf) if least is None else least
        self.best = [np.zeros(0, np.int64) for _ in range(3)]  # query, id, score

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        alive = self.ids[:, None] != ids[None, :]
        qi = xi = None
        for level, mine in enumerate(self.features):
            theirs = segment_features(x, LEVELS[level])
            if qi is None:
                bound = mine @ theirs.T
                alive &= bound + np.abs(bound) * 1e-9 + 1e-6 >= self.least[:, None]
                if alive.sum() * 4 <= alive.size:
                    qi, xi = np.nonzero(alive)
            else:
                bound = np.einsum("ij,ij->i", mine[qi], theirs[xi])
                keep = bound + np.abs(bound) * 1e-9 + 1e-6 >= self.least[qi]
                qi, xi = qi[keep], xi[keep]
        if qi is None:
            qi, xi = np.nonzero(alive)
        if len(qi) == 0:
            return
        score = pair_scores(self.vectors, x, qi, xi)
        keep = score >= self.least[qi]
        q, v, s = (np.concatenate(p) for p in zip(self.best, (qi[keep], ids[xi[keep]], score[keep])))
        order = np.lexsort((v, -s.astype(object) if s.min(initial=0) == -(2**63) else -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, q)
        top = np.arange(len(q)) - first < self.k
        self.best = [q[top], v[top], s[top]]
        full = np.flatnonzero(np.arange(len(q)) - first == self.k - 1)
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


def _matrix(column: pa.Array, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows of each length."""
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield ids[rows], values[starts[rows][:, None] + np.arange(d)[None, :]]


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and the vector as doubles, of rows with an id whose components are all there and finite."""
    x = F.transform(vector_column, lambda v: v.cast("double"))
    fine: Column = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & fine)
    return kept.select(
        F.col(id_column).cast("long").alias("vec_id"),
        x.alias("v"),
    )


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest inner product for each query row.

    Components count as floor(1024 * x). A row is no candidate for a query of its own id or of another
    length; ties go to the smaller id; a query with fewer candidates gets them all. Rows without an id or a
    whole finite vector take no part. Equal rows each count. Scores beyond a long are held at its ends.
    Other columns are not used.

    Queries come in blocks of ``block``; each block passes over all rows once. A task starts from what the
    other queries of the block already guarantee as the k-th score and raises it as it goes.
    """
    spark = rows.sparkSession
    data, asked = usable(rows, id_column, vector_column), usable(queries, id_column, vector_column)
    scratch, parts = Scratch(spark, "top-k"), []
    wanted = asked.toLocalIterator()
    first = 0
    while chunk := list(islice(wanted, block)):
        groups: dict[int, list] = {}
        for n, r in enumerate(chunk, first):
            groups.setdefault(len(r[1]), []).append((n, r[0], r[1]))
        first += len(chunk)
        packed = []
        for d, g in groups.items():
            numbers = np.array([x[0] for x in g], np.int64)
            ids = np.array([x[1] for x in g], np.int64)
            vectors = np.floor(1024 * np.array([x[2] for x in g], np.float64).reshape(len(g), d))
            own = QueryGroup(numbers, ids, vectors, k)
            for a in range(0, len(g), 256):  # one row of each id: a repeated query row is not a second candidate
                own.add(ids[a : a + 256], vectors[a : a + 256])
            least = own.least if len(set(ids.tolist())) == len(ids) else None
            packed.append((d, numbers, ids, vectors, least))
        names = spark.createDataFrame([(x[0], x[1]) for g in groups.values() for x in g], "_n long, query_id long")

        def scan(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            own = {d: QueryGroup(n, i, v, k, None if least is None else least.copy()) for d, n, i, v, least in packed}
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for some, x in _matrix(batch.column(1), ids):
                    if x.shape[1] not in own:
                        continue
                    for a in range(0, len(some), ROWS_AT_ONCE):
                        part = np.floor(1024 * x[a : a + ROWS_AT_ONCE])
                        own[x.shape[1]].add(some[a : a + ROWS_AT_ONCE], part)
            for g in own.values():
                q, v, s = g.best
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.numbers[q]), pa.array(v), pa.array(s)], names=["_q", "vec_id", "score"]
                )

        found = in_arrow(data, scan, OUT)
        by = Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        # one row for each query of the block
        parts.append(
            scratch.table(
                ranked.join(F.broadcast(names), F.col("_q") == F.col("_n")).select("query_id", "rank", "vec_id", "score")
            )
        )
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
