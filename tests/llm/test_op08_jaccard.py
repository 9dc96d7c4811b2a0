import itertools
import random

import numpy as np
import pytest
from conftest_words import prose, words

from tassel.llm import op8_jaccard as op
from tassel.llm import units as un
from tassel.llm.common import Scratch


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, class_id, n_links, n_text_links, n_words) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    links = [[] for _ in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][1] is None or rows[b][1] is None:
            continue
        both = len(sets[a] & sets[b])
        if rows[a][1] == rows[b][1] or both and both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a].append(b)
            links[b].append(a)
            parent[top(a)] = top(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        ids = least.setdefault(top(i), [])
        ids.append(float("-inf") if doc is None else doc)
    out = []
    for i, (doc, text) in enumerate(rows):
        first = min(least[top(i)])
        others = {rows[j][1] for j in links[i]} - {text}
        out.append((doc, None if first == float("-inf") else first, len(links[i]), len(others), len(words(text))))
    return sorted(out, key=str)


def run(docs):
    return sorted((tuple(r) for r in op.similar_texts(docs).collect()), key=str)


def variants(n, changes, seed):
    """Copies of one text with some words changed: a group whose members are alike by 0.8 or nearly so."""
    base, rng = prose(99, 260, 5000).split(), random.Random(seed)
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), changes):
            w[at] = f"x{i}y{at}"
        out.append(" ".join(w))
    return out


def test_awkward_rows(awkward, clashing, empty, awkward_rows):
    want = brute([r[:2] for r in awkward_rows])
    assert run(awkward) == want
    assert run(clashing) == want
    assert run(empty) == []


def test_near_copies_in_blocks(spark, monkeypatch):
    rows = list(enumerate(variants(60, 5, 1) + variants(20, 12, 2) + [prose(i, 200, 50000) for i in range(30)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert run(df) == want
    monkeypatch.setattr(op, "BLOCK_UNITS", 7)  # many pairs of blocks
    assert run(df) == want


def test_one_of_each_class_stays(clashing, awkward_rows):
    from collections import defaultdict

    kept = op.drop_similar(clashing)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    classes = defaultdict(list)
    for doc, first, *_ in brute([r[:2] for r in awkward_rows]):
        classes[first].append(doc)
    # nulls share a class_id of null here, so look at texts instead
    texts = [r.text for r in rows]
    sets = [shingle_set(t) for t in texts]
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        assert not (texts[a] is not None and (texts[a] == texts[b] or both and both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both)))
    assert {7, 8, 11, 13, 19} <= {r.doc_id for r in rows} and not {2, 3, 14, 12} & {r.doc_id for r in rows}
    assert all(r["_key"] == "own _key" for r in rows)


@pytest.mark.parametrize("matches,compared", [(0, 20), (10, 20), (20, 20), (60, 100), (80, 100)])
def test_posterior(matches, compared):
    x = (np.arange(200_000) + 0.5) / 200_000
    weight = x**matches * (1 - x) ** (compared - matches)
    assert abs(op.posterior(matches, compared, 0.8) - weight[x >= 0.8].sum() / weight.sum()) < 1e-4


def test_min_hashes_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64)
    from tassel.llm.common import mix64

    grams = np.concatenate([mix64(a[:800]), mix64(a[100:])])
    values = op.min_hashes(grams, np.array([0, 800, 1700]), 2000)
    assert abs((values[0] == values[1]).mean() - 700 / 1000) < 0.05


def test_components(spark, tmp_path):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    found = un.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {tuple(r) for r in found.collect()} == {(x, top(x)) for x in parent}


def test_block_pairs_meet_once(spark):
    n = 50
    df = spark.range(n).selectExpr("id AS unit", "4L AS blocks")
    rows = un.in_blocks(df, "blocks").collect()
    met = {}
    for r in rows:
        met.setdefault((r._i, r._j), []).append((r.unit, r._side))
    pairs = [
        tuple(sorted((a, b)))
        for (i, j), members in met.items()
        for (a, x), (b, y) in itertools.combinations(members, 2)
        if i == j or x != y
    ]
    assert len(pairs) == len(set(pairs)) == n * (n - 1) // 2
