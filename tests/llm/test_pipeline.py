import itertools

import public_tokenizers
from conftest_words import words
from test_op08_jaccard import shingle_set
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tassel.llm import op4_pii
from tassel.llm.common import Scratch, documents

SF = "/root/testdata/sf0.001"


def contaminated(text, windows):
    w = words(text)
    hit = {j for i in range(len(w)) for k in windows if tuple(w[i : i + k]) in windows[k] for j in range(i, i + k)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_against_brute_force(spark):
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in __spark_entry__.queries()
    scratch = Scratch(spark, "test-pipeline")
    source = documents(spark, SF)
    tables = [source]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(scratch.table(stage(spark, tables[-1], SF)))
    assert all(t.columns == source.columns for t in tables[:5])
    start, language, single, clean, private, packed = ({} if i == 5 else {r.doc_id: r for r in t.collect()} for i, t in enumerate(tables))
    assert set(start) - set(language) == {i for i, r in start.items() if not any(c.isalpha() for c in r.text or "")}
    # one document of each class of similar ones
    sets = {i: shingle_set(r.text) for i, r in language.items()}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    assert set(single) == {top(i) for i in sets}
    assert all(tuple(single[i]) == tuple(start[i]) for i in single)
    windows: dict = {}
    for r in documents(spark, SF, "benchmark").collect():
        w = words(r.text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows.setdefault(k, set()).add(tuple(w[i : i + k]))
    assert set(clean) == {i for i, r in single.items() if not contaminated(r.text, windows)}
    # texts change in their personal values only
    assert set(private) == set(clean)
    values = {r.doc_id: r.pii for r in op4_pii.pseudonymise(tables[3], corpus_pipeline.KEY).collect()}
    for i, r in private.items():
        assert (r.text == clean[i].text) == (not values[i]) and r.n_chars == len(r.text)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in private.items()}
    pieces = tables[5].collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == lengths
    assert sum(r.length for r in pieces) == sum(lengths.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(
        (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces
    )


def test_awkward_rows(spark, clashing, empty):
    for docs in (clashing, empty):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = Scratch(spark, "test-pipeline").table(out)
        assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() >= docs.count()
