"""Embedding whitening: shifted CholeskyQR in distributed Gram passes, then the SVD of the small triangular factor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import in_arrow

#: A vector's integers are floor(SCALE * component) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components beyond this size are held there, so that they stay whole numbers as doubles.
HELD = 2.0**52
#: One shifted pass and two more: the rows are orthogonal to rounding then, whatever their condition.
ROUNDS = 3
COMPONENTS = 8
UNIT = np.finfo(float).eps / 2


@dataclass
class Whitening:
    """What was learned from the vectors of one length. ``whole`` and ``part`` are S div n and S mod n."""

    n: int
    whole: np.ndarray
    part: np.ndarray
    factors: list[np.ndarray] = field(default_factory=list)
    components: np.ndarray | None = None  # a row each, unit length, by falling variance
    variances: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once: the whole part of the mean is taken off in integers."""
        return (x - self.whole) - self.part / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n * x - S)^2 for each row, exact; held at the largest long."""
        away = x - self.whole
        most = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 2**63:
            return np.square(self.n * away - self.part).sum(axis=1)
        exact = [sum((self.n * int(a) - int(p)) ** 2 for a, p in zip(row, self.part)) for row in away]
        return np.array([min(v, 2**63 - 1) for v in exact], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column a component; a component without variance gives NaN."""
        with np.errstate(divide="ignore"):
            scale = np.where(self.variances > 0, 1 / np.sqrt(self.variances), np.nan)
        return (self.centred(x) @ self.components.T) * scale


def vectors_of(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return rows.filter(F.col(vector_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))


def matrices(batch: pa.RecordBatch, scale: float, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors) of the rows of each length but 0 whose components are all there and finite."""
    vectors = batch.column(1)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
    ends = np.cumsum(lengths)
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        own = values[(ends[at] - d)[:, None] + np.arange(d)]
        fine = np.isfinite(own).all(axis=1)
        if not fine.any():
            continue
        with np.errstate(over="ignore"):
            scaled = np.floor(scale * own[fine])
        yield at[fine], np.clip(scaled, -HELD, HELD).astype(np.int64) + offset


def sums(data: DataFrame, scale: float, offset: int) -> dict[int, Whitening]:
    """n and S for each length of vectors. S is summed in two parts, as it may be more than a long holds."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for at, x in matrices(batch, scale, offset):
                own = held.setdefault(x.shape[1], [0, 0, 0])
                own[0] += len(at)
                own[1] = own[1] + (x >> 32).sum(axis=0)
                own[2] = own[2] + (x & 0xFFFFFFFF).sum(axis=0)
        for d, (n, high, low) in held.items():
            whole = [np.full(d, d), np.arange(d), np.full(d, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in whole], names=["d", "j", "n", "high", "low"])

    totals = in_arrow(data, parts, "d long, j long, n long, high long, low long").groupBy("d", "j")
    found: dict[int, list] = {}
    for r in totals.agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        found.setdefault(r.d, []).append((r.j, r.n, r.high * 2**32 + r.low))
    out = {}
    for d, columns in found.items():
        n = columns[0][1]
        split = [divmod(s, n) for _, _, s in sorted(columns)]
        out[d] = Whitening(n, np.array([q for q, _ in split], np.int64), np.array([r for _, r in split], np.int64))
    return out


def gram(
    data: DataFrame, of: dict[int, Callable[[np.ndarray], np.ndarray]], scale: float, offset: int
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(Gram matrix, column sums) of the rows that ``of`` makes of the integer vectors of each length.

    A task adds up one matrix a length over all its rows; Spark adds the matrices up entry by entry, and the driver gets
    one entry of each.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in matrices(batch, scale, offset):
                d = x.shape[1]
                z = of[d](x)
                own = held.setdefault(d, [0, 0])
                own[0] = own[0] + z.T @ z
                own[1] = own[1] + z.sum(axis=0)
        for d, (products, total) in held.items():
            k = len(total)
            i, j = np.triu_indices(k)
            # row k holds the column sums
            columns = [np.full(len(i) + k, d), np.append(i, np.full(k, k)), np.append(j, np.arange(k))]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns], pa.array(np.append(products[i, j], total))],
                names=["d", "i", "j", "value"],
            )

    found: dict[int, list] = {}
    for r in in_arrow(data, parts, "d long, i long, j long, value double").groupBy("d", "i", "j").agg(F.sum("value")).collect():
        found.setdefault(r[0], []).append(tuple(r)[1:])
    out = {}
    for d, entries in found.items():
        k = max(j for _, j, _ in entries) + 1
        whole = np.zeros((k + 1, k))
        for i, j, value in entries:
            whole[i, j] = value
            if i < k:
                whole[j, i] = value
        out[d] = whole[:k], whole[k]
    return out


def solved(z: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """z times the inverse of an upper triangular factor, by substitution a column at a time."""
    out = np.array(z, order="F")
    for j in range(out.shape[1]):
        if j:
            out[:, j] -= out[:, :j] @ factor[:j, j]
        out[:, j] /= factor[j, j]
    return out


def orthogonal(x: np.ndarray, fit: Whitening) -> np.ndarray:
    z = fit.centred(x)
    for factor in fit.factors:
        z = solved(z, factor)
    return z


def shifted_factor(products: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; with a multiple of the identity added if asked for, or if it takes one to succeed."""
    d = len(products)
    step = 11 * d * (d + 1) * UNIT * max(np.trace(products), np.finfo(float).tiny)
    shift = step if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(products + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, step)


def fit_whitening(
    rows: DataFrame,
    components: int = COMPONENTS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: float = SCALE,
    offset: int = OFFSET,
    rounds: int = ROUNDS,
) -> dict[int, Whitening]:
    """The whitening of the vectors of each length, fitted on all of them.

    A first pass adds up n and S in integers. Then each of ``rounds`` passes centres all rows, divides them by the
    triangular factors found so far, one after another, and adds up their Gram matrix, of which the driver takes the
    next Cholesky factor; in the first round a small multiple of the identity is added, so that nearly dependent
    dimensions do not end it. The product of the factors is the R of the centred rows' QR decomposition; its right
    singular vectors are the eigenvectors of the covariance, and the squares of its singular values over n are the
    variances. The covariance itself is never decomposed: that would square the condition. A last pass measures how far
    the whitened rows' covariance is from the identity. The driver and each task hold d x d numbers a length.

    A component's largest entry is positive. Without variance (none, or beyond rounding) it has variance 0.
    """
    data = vectors_of(rows, id_column, vector_column)
    fits = sums(data, scale, offset)
    for turn in range(rounds if fits else 0):
        of = {d: (lambda x, fit=fit: orthogonal(x, fit)) for d, fit in fits.items()}
        found = gram(data, of, scale, offset)
        for d, fit in fits.items():
            fit.factors.append(shifted_factor(found[d][0], turn == 0))
    for d, fit in fits.items():
        whole = np.eye(d)
        for factor in fit.factors:
            whole = factor @ whole
        _, size, directions = np.linalg.svd(whole)
        size = np.where(size > 1000 * d * UNIT * size[0], size, 0.0) if size[0] > HELD * UNIT**3 else size * 0.0
        directions = directions[: min(components, d)]
        turned = np.sign(directions[np.arange(len(directions)), np.abs(directions).argmax(axis=1)])
        fit.components = directions * turned[:, None]
        variances = np.square(size) / fit.n
        fit.variances = variances[: len(directions)]
        total = variances.sum()
        fit.explained = fit.variances / total if total > 0 else fit.variances
    if fits:
        known = {d: fit.variances > 0 for d, fit in fits.items()}
        of = {d: (lambda x, fit=fit, use=known[d]: fit.whitened(x)[:, use]) for d, fit in fits.items() if known[d].any()}
        none = {d: (lambda x: np.zeros((len(x), 1))) for d in fits if d not in of}
        for d, (products, total) in gram(data, of | none, scale, offset).items():
            if d in of:
                n = fits[d].n
                covariance = products / n - np.outer(total / n, total / n)
                fits[d].identity_error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return fits


def whiten(
    rows: DataFrame,
    fits: dict[int, Whitening],
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: float = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or infinite components or NaN go, and vectors of a length without a fit.
    Vectors of each length are whitened by themselves, and empty vectors have no component. A null vec_id stays null;
    repeated rows each count and each come back. ``deviation`` is the sum of (n * x - S)^2, held at the largest long;
    components of x beyond 2^52 are held there. ``whitened`` is null where a component has no variance: one
    vector alone, equal vectors, dimensions that depend on others. Other columns are not used.
    """
    schema = StructType(
        [
            StructField("vec_id", LongType()),
            StructField("component", IntegerType()),
            StructField("n", LongType()),
            StructField("deviation", LongType()),
            StructField("whitened", DoubleType()),
            StructField("explained", DoubleType()),
            StructField("identity_error", DoubleType()),
        ]
    )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch, scale, offset):
                fit = fits.get(x.shape[1])
                if fit is None:
                    continue
                k, rows_here = len(fit.variances), len(at)
                white = fit.whitened(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1), rows_here), pa.int32()),
                        pa.array(np.full(k * rows_here, fit.n), pa.int64()),
                        pa.array(np.repeat(fit.deviation(x), k), pa.int64()),
                        pa.array(white, pa.float64(), mask=np.isnan(white)),
                        pa.array(np.tile(fit.explained, rows_here)),
                        pa.array(np.full(k * rows_here, fit.identity_error)),
                    ],
                    names=schema.fieldNames(),
                )

    return in_arrow(vectors_of(rows, id_column, vector_column), project, schema)
