import random

import numpy as np
import pytest
from conftest_words import prose, words
from pyspark.sql import functions as F

from tassel.llm import op6_decontaminate as op


def brute(docs, items, window=13):
    wanted = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if k else ():
            wanted.setdefault(tuple(w[i : i + k]), set()).add("null" if item is None else str(item))
    sizes = sorted({len(k) for k in wanted})
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if names := wanted.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= names
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def run(docs, items, **more):
    rows = op.find_passages(docs, items, ["doc_id"], **more).collect()
    out = []
    for r in rows:
        spans = [(s.start, s.end) for s in r.spans]
        assert spans == sorted(spans) and all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        out.append((r.doc_id, r.n_words, [i for a, b in spans for i in range(a, b)], r.items))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items_rows():
    return [
        (1, prose(3, 70)),
        (2, "one two three"),
        (2, "the mit license"),
        (None, "日本語"),
        (4, None),
        (5, "... !"),
        (6, " ".join(prose(1, 300).split()[100:120])),
        (7, "the " * 30),
        (8, "absent words only here"),
    ]


def test_awkward_rows(spark, awkward, clashing, awkward_rows, empty, items_rows):
    items = spark.createDataFrame(items_rows, "item_id long, text string")
    want = brute([r[:2] for r in awkward_rows], items_rows)
    assert sum(bool(r[2]) for r in want) > 8
    assert run(awkward, items) == want
    assert run(clashing, items) == want
    assert run(awkward, items, item_block=2) == want
    assert run(awkward, items, shard_bytes=500) == want
    assert run(empty, items) == []
    none = run(awkward, items.filter("item_id > 99"))
    assert [r[1] for r in none] == [r[1] for r in want] and not any(r[2] or r[3] for r in none)


def test_rule_for_contaminated(spark):
    rows = [(0, 10), (1, 20), (1, 21), (13, 260), (13, 261), (0, 0)]
    df = spark.createDataFrame(rows, "h long, n long")
    out = [r[0] for r in df.select(op.is_contaminated(F.col("h"), F.col("n"))).collect()]
    assert out == [False, True, False, True, False, False]


@pytest.mark.parametrize("seed", range(6))
def test_index_against_plain_search(seed):
    rng = random.Random(seed)
    text = np.array([rng.randrange(rng.choice((2, 3, 5))) for _ in range(rng.randrange(1, 300))] + [0], np.int64)
    index = op.FMIndex(text, 6)
    order = op.suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    zeros = {p: n for n, p in enumerate(np.flatnonzero(text == 0).tolist())}
    key = lambda p: [(0, zeros[i]) if text[i] == 0 else (1, text[i]) for i in range(p, len(text))]
    assert [key(p) for p in order] == sorted(key(p) for p in range(len(text)))
    phrases = np.array([[rng.randrange(1, 6) for _ in range(4)] for _ in range(50)])
    lengths = np.array([rng.randrange(1, 5) for _ in range(50)])
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high):
        own = p[4 - n :].tolist()
        want = [i for i in range(len(text) - n + 1) if text[i : i + n].tolist() == own]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
