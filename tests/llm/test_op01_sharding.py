import zlib
from collections import defaultdict

import pytest

from tassel.llm import op1_sharding as op
from tassel.llm.common import documents

SF = "/root/testdata/sf0.001"


def check(rows, n_shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(n_shards):
        assert abs(sum(r.size for r in by[s]) - total / n_shards) <= most


def test_documents(spark):
    docs = documents(spark, SF)
    out = op.shard_documents(docs, 16).collect()
    check(out, 16)
    want = sorted((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == want


def test_shard_is_the_place_of_the_middle_byte(spark):
    import hashlib

    docs = documents(spark, SF).collect()
    out = {r.doc_id: r.shard for r in op.shard_documents(documents(spark, SF), 16).collect()}
    order = sorted((hashlib.md5(r.text.encode()).hexdigest(), r.doc_id, len(r.text.encode()) + 1) for r in docs)
    total, at = sum(x[2] for x in order), 0
    for _, doc_id, size in order:
        at += size
        assert out[doc_id] == min(15, (2 * at - size) * 16 // (2 * total))


def test_awkward_rows(awkward, clashing, awkward_rows):
    for docs in (awkward, clashing):
        out = op.shard_documents(docs, 4).collect()
        check(out, 4)
        assert len(out) == len(awkward_rows)
        assert [(r.size, r.text_crc32) for r in out if r.doc_id == 7] == [(1, 0)]


def test_no_rows(empty):
    assert op.shard_documents(empty, 4).count() == 0


def test_hot_text_is_cut(spark):
    rows = [(i, "the same text " * 5 if i % 3 else f"text {i}") for i in range(3000)]
    out = op.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    check(out, 16)
    assert len({r.shard for r in out if r.doc_id % 3}) > 8


def test_ranges_still_cut_in_the_last_round(spark, monkeypatch):
    draw = op._draw
    monkeypatch.setattr(op, "_draw", lambda rows, rate: draw(rows, rate)[1:3])
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(500)]
    out = op.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(out, 4)
    assert sorted(r.doc_id for r in out) == list(range(500))


def test_repeated_rows_are_drawn_and_cut(spark, monkeypatch):
    draw, range_of, drawn, bounds = op._draw, op._range_of, [], []
    monkeypatch.setattr(op, "_draw", lambda rows, rate: drawn.append(draw(rows, rate)) or drawn[-1])
    monkeypatch.setattr(op, "_range_of", lambda b: bounds.append(len(b)) or range_of(b))
    rows = [(None, "the same text")] * 3000
    out = op.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    check(out, 2)
    assert len(out) == 3000 and 0 < len(drawn[0]) < 2000 and bounds[-1] >= 16


@pytest.mark.parametrize("parts", [2, 7])
def test_quantiles(parts):
    sample = [((f"{i:03d}", i), 1 + i % 3) for i in range(100)]
    bounds = op._quantiles(sample, parts)
    assert bounds == sorted(set(bounds)) and len(bounds) <= parts
