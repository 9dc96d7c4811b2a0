import math
import random

import numpy as np
import pytest

from tassel.llm import op2_search as op

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=10):
    usable = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for qi, q in usable:
        if qi % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in usable if i != qi and len(v) == len(q))
            out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(tuple(r) for r in op.top_k(df, df.filter("vec_id % 100 = 0"), **more).collect())


def vectors(n, d, seed):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(d)]) for i in range(n)]


def test_equals_brute_force_in_blocks_of_queries(spark):
    rows = vectors(901, 20, 1)
    assert run(spark, rows, block=4) == brute(rows)


def test_awkward_vectors(spark):
    rows = vectors(60, 5, 2)
    rows += [(100, [0.0] * 5), (101, [0.0] * 5), (200, None), (300, [1.0, None, 0.0, 0.0, 0.0]), (400, [float("nan")] * 5)]
    rows += [(None, [1.0] * 5), (500, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (600, [1.0, 2.0]), (700, []), (800, [])]
    rows += [(62, [3.0] * 5), (61, [3.0] * 5), (63, [-3.0] * 5)]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_each_count(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [5.0, 5.0])]
    assert run(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, 1e6 + 1]), (1, [2e6 + 1, -1e6]), (2, [2e6, -1e6 + 1]), (3, [0.5, 0.25])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_bound_holds_at_every_level():
    x = np.random.default_rng(1).normal(size=(40, 24))
    for s in op.LEVELS:
        f = op.segment_features(x, s)
        assert (f @ f.T >= x @ x.T - 1e-9).all()


@pytest.mark.parametrize("k", [1, 3])
def test_k(spark, k):
    rows = vectors(150, 8, 3)
    assert run(spark, rows, k=k) == brute(rows, k)
