import math

import numpy as np
import pytest

from tassel.llm import op12_whitening as op
from tassel.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=8):
    """{(id, length, component): [(n, deviation, whitened up to sign, explained)]} by a plain SVD of the centred rows."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for d in {len(v) for _, v in good}:
        own = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in good if len(v) == d]
        n, total = len(own), [sum(x[j] for _, x in own) for j in range(d)]
        centred = np.array([[(n * x[j] - total[j]) / n for j in range(d)] for _, x in own])
        _, size, vectors = np.linalg.svd(centred if n >= d else np.vstack([centred, np.zeros((d - n, d))]), full_matrices=False)
        e = np.where(size > 1e-11 * max(size[0], 1e-9), size, 0.0) ** 2 / n
        for at in range(min(k, d)):
            for (i, x), row in zip(own, centred):
                deviation = min(2**63 - 1, sum((n * a - s) ** 2 for a, s in zip(x, total)))
                white = row @ vectors[at] / math.sqrt(e[at]) if e[at] else None
                out.setdefault((i, d, at + 1), []).append((n, deviation, white, e[at] / e.sum() if e.sum() else 0.0))
    return out


def run(spark, rows, schema=SCHEMA, **more):
    df = spark.createDataFrame(rows, schema).repartition(4)
    return op.whiten(df, op.fit_whitening(df, **more)).collect()


def same(got, want, d):
    """Exact columns equal, whitened ones equal but for one sign a component."""
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    want = {(i, c): v for (i, size, c), v in want.items() if size == d}
    assert {k: len(v) for k, v in by.items()} == {k: len(v) for k, v in want.items()}
    for component in {c for _, c in want}:
        a, b = [], []
        for (i, c), values in want.items():
            if c == component:
                mine = sorted(by[i, c], key=lambda r: r.deviation)  # repeated ids
                values = sorted(values, key=lambda v: v[1])
                assert [(r.n, r.deviation) for r in mine] == [v[:2] for v in values]
                assert [r.explained for r in mine] == pytest.approx([v[3] for v in values], rel=1e-9, abs=1e-12)
                a += [r.whitened for r in mine]
                b += [v[2] for v in values]
        if None in b:
            assert set(a) == {None}
        else:
            sign = np.sign(np.dot(a, b))
            assert np.allclose(a, sign * np.array(b), rtol=1e-8, atol=1e-8)


def vectors(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d)) * np.linspace(1, 0.1, d)
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


def test_equals_brute_force(spark):
    rows = vectors(700, 12, 1)
    got = run(spark, rows)
    same(got, brute(rows), 12)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-12
    white = np.zeros((700, 8))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
    white -= white.mean(axis=0)
    assert np.abs(white.T @ white / 700 - np.eye(8)).max() < 1e-10


def test_rows_that_take_no_part_and_rows_that_do(spark):
    rows = vectors(50, 3, 2)
    rows += [(60, None), (61, [1.0, None, 0.0]), (62, [float("nan")] * 3), (63, [0.0, float("inf"), 0.0]), (64, []), (65, [float("nan"), 1.0])]
    rows += [(None, [0.5, 0.25, 0.125]), (7, [0.1, 0.2, 0.3]), (7, [0.1, 0.2, 0.3])]
    got = run(spark, rows)
    assert {r.vec_id for r in got} == {None, *range(50)} and {r.component for r in got} == {1, 2, 3}
    same(got, brute(rows), 3)


def test_each_length_by_itself(spark):
    rows = vectors(40, 5, 3) + [(100 + i, v) for i, v in vectors(30, 2, 4)]
    got = run(spark, rows)
    same([r for r in got if r.vec_id < 100], brute(rows), 5)
    same([r for r in got if r.vec_id >= 100], brute(rows), 2)


def test_nearly_dependent_dimensions(spark):
    """One row alone parts two dimensions: the shift of the first round must leave no trace."""
    rows = [(i, [v[0], v[0] + (1 / 512 if i == 5 else 0), 1000 * v[1]]) for i, v in vectors(3000, 2, 5)]
    rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    got = run(spark, rows)
    same(got, brute(rows), 3)
    assert got[0].identity_error < 1e-6


@pytest.mark.parametrize(
    "rows",
    [
        [(1, [0.5, 0.25])],
        [(i, [0.5, 0.25, 3.0]) for i in range(30)],
        [(i, [i / 64, i / 32, 5.0]) for i in range(30)],  # one direction only
        [(i, [float(i % 2), 0.0, 0.0, 1.0]) for i in range(9)],
    ],
)
def test_components_without_variance_are_null(spark, rows):
    same(run(spark, rows), brute(rows), len(rows[0][1]))


def test_large_components_are_exact(spark):
    rows = [(i, [1e12 * i, 3.0 + i * i, -1e11 * (i % 3)]) for i in range(6)]
    got = run(spark, rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    assert {(r.vec_id, r.deviation) for r in got} == {(i, v[0][1]) for (i, _, _), v in want.items()}
    got = run(spark, [(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert {round(abs(r.whitened), 9) for r in got} == {1.0}


def test_more_rounds_for_a_bad_condition(spark):
    rows = [(i, [v[0], v[0] + v[1] / 1024, 1e6 * v[1]]) for i, v in vectors(500, 2, 6)]
    rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    error = {r: run(spark, rows, rounds=r)[0].identity_error for r in (1, 3)}
    assert error[3] < 1e-6 and error[3] <= error[1]
    same(run(spark, rows), brute(rows), 3)


def test_no_rows_and_other_columns(spark):
    assert run(spark, []) == []
    rows = vectors(20, 3, 8)
    df = spark.createDataFrame([(*r, "a", 1, 2.0) for r in rows], SCHEMA + ", id string, n int, whitened double")
    same(op.whiten(df, op.fit_whitening(df)).collect(), brute(rows), 3)


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op12_cholesky_whitening"](spark, d).collect()
    same(got, brute(rows), len(rows[0][1]))
    assert len(got) == 8 * len(rows) and got[0].identity_error < 1e-10
