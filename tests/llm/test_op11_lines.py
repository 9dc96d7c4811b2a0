import random

import pytest

from tassel.llm import op11_lines as op
from conftest import CLASHES, SCHEMA

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line):
    return line.strip(BLANKS).translate(str.maketrans(UPPER, LOWER))


def brute(rows, min_chars=20, min_docs=3):
    ids, holders = [-(2**63) if r[0] is None else r[0] for r in rows], {}
    for i, r in zip(ids, rows):
        for line in (r[1] or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, r in zip(ids, rows):
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((r[0], len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def run(df, **more):
    return sorted((tuple(r) for r in op.drop_common_lines(df, ["doc_id"], **more).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(5)


NOTICE = "All rights reserved by the owners"


def test_awkward_documents(spark, awkward, awkward_rows):
    assert run(awkward) == brute(awkward_rows)


def test_lines_at_every_edge(spark):
    rows = [
        (1, f"{NOTICE}\nbody one\n{NOTICE}"),
        (2, f" \t{NOTICE.upper()}\r\n\nbody two"),
        (3, f"{NOTICE}\x0b\x0c"),
        (4, " " + NOTICE),  # a no-break space is no blank
        (5, f"{NOTICE}\n{NOTICE.lower()}\nlast"),
        (6, "\n"),
        (7, "\n\n\n"),
        (8, None),
        (9, ""),
        (10, "É" * 19 + "\n" + "É" * 20 + "\n" + "é" * 20),
        (11, "É" * 19 + "\n" + "É" * 20),
        (12, "É" * 19 + "\n" + "É" * 20),
        (13, "x" * 20 + "\x85" + "y"),  # cut at line feeds only
        (14, "x" * 20),
        (15, "X" * 20 + " " + "y"),
        (16, " " * 40),
        (17, " " * 40),
        (18, " " * 40),
    ]
    got = run(frame(spark, rows))
    assert got == brute(rows)
    assert (3, 1, 1, "") in got and (5, 3, 0, rows[4][1]) in got


def test_null_and_repeated_ids(spark):
    rows = [(None, f"{NOTICE}\na")] * 40 + [(None, f"b\n{NOTICE}")] + [(5, NOTICE)] * 3
    assert run(frame(spark, rows)) == brute(rows)  # two documents: nothing goes
    rows += [(9, f"{NOTICE}\nx"), (9, f"y\n{NOTICE}"), (9, f"{NOTICE}\nx")]
    got = run(frame(spark, rows))
    assert got == brute(rows)
    assert sum(r[2] for r in got) == 44


def test_only_null_ids_keep_their_lines(spark):
    rows = [(None, NOTICE)] * 5
    assert run(frame(spark, rows), min_docs=1) == brute(rows, min_docs=1)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [rng.choice(["", " ", "\t"]) + rng.choice("ab") * rng.randrange(15, 26) for _ in range(60)]
    rows = [
        (rng.choice([None, *range(80)]), rng.choice([None, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))]))
        for _ in range(300)
    ]
    for docs, chars in ((3, 20), (1, 0), (2, 18), (500, 20)):
        assert run(frame(spark, rows), min_docs=docs, min_chars=chars) == brute(rows, chars, docs)


def test_a_very_long_text(spark):
    lines = [f"line number {i} of a very long document" for i in range(60_000)]
    rows = [(i, "\n".join(lines + [f"end of {i}"])) for i in range(3)] + [(7, "x" * 3_000_000)]
    assert run(frame(spark, rows)) == brute(rows)


def test_own_columns_of_the_same_names(spark, clashing, awkward_rows):
    keep = ["doc_id", *CLASHES]
    out = op.drop_common_lines(clashing, keep)
    assert out.columns == [*keep, "n_lines", "n_dropped", "kept"]
    got = out.collect()
    assert all(r[c] == f"own {c}" for r in got for c in CLASHES)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=str) == brute(awkward_rows)


def test_no_rows(spark, empty):
    assert run(empty) == []
