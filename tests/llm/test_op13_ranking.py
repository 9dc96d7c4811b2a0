import math
import random
from collections import Counter

import numpy as np
import pytest

from conftest import SCHEMA
from conftest_words import prose, words
from tassel.llm import op13_ranking as op

ITEMS = "item_id long, text string"


def brute(rows, items, k=50):
    docs = [(r[0], Counter(words(r[1]))) for r in rows if words(r[1])]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(words(text))
    out = []
    for i, terms in wanted.items():
        scores = []
        for doc, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in terms
                if c[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(i, n, None if none else doc, -s) for n, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, items, **more):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, *_ in rows], SCHEMA).repartition(4)
    found = op.rank_documents(docs, spark.createDataFrame(items, ITEMS), **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


AWKWARD = [
    (1, "the W1 w2 w3, w4!"),
    (2, "the w1 w2 w9"),
    (3, None),
    (4, ""),
    (5, "... ---"),
    (6, "nowhere to be found"),
    (7, "élan 日本語 one TWO"),
    (None, "the of and w1"),
    (8, "w5 w5 w5 w6"),
    (8, "w7"),
]


def test_awkward_rows(spark, awkward_rows):
    assert run(spark, awkward_rows, AWKWARD) == brute(awkward_rows, AWKWARD)


@pytest.mark.parametrize("more", [{"block_items": 1}, {"block_items": 3}, {"block_terms": 5}, {"k": 1}, {"k": 7}])
def test_blocks_and_sizes(spark, awkward_rows, more):
    got = run(spark, awkward_rows, AWKWARD, **more)
    assert got == brute(awkward_rows, AWKWARD, more.get("k", 50))


def test_ties_go_by_id(spark):
    rows = [(i, "alpha beta") for i in range(300, 0, -1)] + [(None, "alpha beta")] * 5 + [(4, "alpha beta")] * 3 + [(1000, "gamma")] * 900
    got = run(spark, rows, [(1, "ALPHA alpha"), (2, "beta gamma")])
    assert got == brute(rows, [(1, "ALPHA alpha"), (2, "beta gamma")])
    assert [r[2] for r in sorted(got) if r[0] == 1][:6] == [1, 2, 3, 4, 4, 4]


def test_rows_without_an_id_come_last(spark):
    rows = [(i, "alpha beta") for i in range(20)] + [(None, "alpha beta")] * 9 + [(99, "other")] * 60
    got = run(spark, rows, [(1, "alpha")])
    assert got == brute(rows, [(1, "alpha")])
    assert [r[2] for r in sorted(got, key=lambda r: r[1])][-9:] == [None] * 9


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(500), prose(rng.randrange(10**6), rng.randrange(1, 120), 80)) for _ in range(400)]
    items = [(i, prose(rng.randrange(40), rng.randrange(1, 30), 80)) for i in range(40)]
    assert run(spark, rows, items) == brute(rows, items)


def test_very_long_texts(spark):
    rows = [(1, prose(1, 400_000, 900)), (2, "w1 w2"), (3, "x" * 2_000_000)]
    items = [(1, prose(2, 30_000, 5000)), (2, "w1 unknown")]
    assert run(spark, rows, items) == brute(rows, items)


def test_clashing_columns_and_item_names(spark, clashing, awkward_rows):
    items = spark.createDataFrame([(f"i{i}", t, 1, 2) for i, t in AWKWARD[:3]], "item_id string, text string, score int, doc_id int")
    got = op.rank_documents(clashing, items).collect()
    want = brute(awkward_rows, [(f"i{i}", t) for i, t in AWKWARD[:3]])
    assert sorted((tuple(r) for r in got), key=str) == want


def test_no_documents_no_items(spark, awkward_rows):
    assert run(spark, [], AWKWARD) == []
    assert run(spark, awkward_rows, []) == []
    assert run(spark, [(1, None), (2, "--")], AWKWARD) == []


@pytest.mark.parametrize("together, share", [(4, 0.8), (64, 0.6)])
def test_shared_sums_are_the_items_sums(together, share, monkeypatch):
    monkeypatch.setattr(op, "MINED_TOGETHER", together)
    rng = np.random.default_rng(together)
    items = [np.unique(rng.zipf(1.3, 40) % 60) for _ in range(50)] + [np.array([3]), np.arange(60)]
    shared = op.SharedSums(items, 60)
    term, column = np.nonzero(rng.random((60, 17)) < 0.5)
    value = rng.integers(1, 1000, len(term))
    dense = np.zeros((60, 17), np.int64)
    dense[term, column] = value
    assert np.array_equal(shared.sums(term, column, value, 17), np.array([dense[i].sum(axis=0) for i in items]))
    # what is shared is added once: fewer additions than without
    assert len(shared.steps) > 20
    assert len(shared.steps) + len(shared.parts) < share * sum(map(len, items))
