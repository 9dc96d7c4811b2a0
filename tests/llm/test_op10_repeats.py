from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_words import prose, words

from tassel.llm import op10_repeats as op
from tassel.llm.common import documents, word_hashes


def brute(rows):
    owners, out = defaultdict(set), []
    for n, (_, text) in enumerate(rows):
        w = words(text)
        for i in range(len(w) - op.PASSAGE + 1):
            owners[tuple(w[i : i + op.PASSAGE])].add(n)
    copies = Counter(t for _, t in rows if t is not None)
    for doc, text in rows:
        w, inside = words(text), set()
        for i in range(len(w) - op.PASSAGE + 1):
            if len(owners[tuple(w[i : i + op.PASSAGE])]) > 1:
                inside.update(range(i, i + op.PASSAGE))
        out.append((doc, len(w), 1 if text is None else copies[text], sorted(inside)))
    return sorted(out, key=str)


def run(docs, **more):
    out = []
    for r in op.repeated_passages(docs, **more).collect():
        assert all(x.end < y.start for x, y in zip(r.spans, r.spans[1:]))
        out.append((r.doc_id, r.n_words, r.copies, [i for s in r.spans for i in range(s.start, s.end)]))
    return sorted(out, key=str)


def test_awkward_rows(awkward, clashing, empty, awkward_rows):
    want = brute([r[:2] for r in awkward_rows])
    assert sum(bool(r[3]) for r in want) >= 8
    assert run(awkward) == want
    assert run(clashing) == want
    assert run(awkward, group_rows=1) == want
    assert run(empty) == []


@pytest.mark.parametrize("length", [49, 50, 51, 90])
def test_passage_length(spark, length):
    shared = prose(50, length, 10**6)
    around = lambda i, n, side: " ".join(f"{side}{i}x{j}" for j in range(n))
    rows = [(i, f"{around(i, 40 + 7 * i, 'a')} {shared} {around(i, 30, 'b')}") for i in range(6)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and all(len(r[3]) == (length if length >= 50 else 0) for r in got)


def test_repeats_inside_one_document_are_its_own(spark):
    rows = [(1, prose(1, 60, 10**6) + " " + prose(1, 60, 10**6)), (2, prose(2, 300, 10**6))]
    assert all(not r[3] for r in run(spark.createDataFrame(rows, "doc_id long, text string")))


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_every_window_owns_a_minimiser():
    text = prose(5, 500).encode()
    hashes, bounds = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    starts, owner, _, grams = op.minimisers(hashes, bounds)
    assert starts.tolist() == list(range(len(hashes) - op.PASSAGE + 1))
    assert ((owner >= starts) & (owner + op.GRAM <= starts + op.PASSAGE)).all()
    assert len(set(owner.tolist())) < len(starts) / 8


def test_spans_are_cut_out(spark):
    shared = prose(50, 60, 10**6)
    df = spark.createDataFrame([(1, f"a b {shared} c"), (2, f"{shared} d"), (3, "e")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in op.without_repeats(df, op.repeated_passages(df)).collect()}
    assert out == {1: "a b c", 2: "d", 3: "e"}
