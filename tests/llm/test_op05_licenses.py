from conftest_words import words

from tassel.llm import op5_licenses as op
from tassel.llm.common import documents


def brute(text):
    """Places of the base phrases, and labels of wordings by their best run of neighbouring diagonals."""
    w = [x.decode() for x in words(text)]
    places, labels, best = [], set(), 0.0
    for phrase, label in op.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append((i, label))
                best = 1.0
    for label, phrase in op.WORDINGS:
        grams = [tuple(phrase.split()[i : i + op.K]) for i in range(len(phrase.split()) - op.K + 1)]
        diagonals = {}
        for i in range(len(w) - op.K + 1):
            for j, g in enumerate(grams):
                if tuple(w[i : i + op.K]) == g:
                    diagonals.setdefault(i - j, set()).add(j)
        span, last = set(), None
        for d in sorted(diagonals):
            span = diagonals[d] | (span if last is not None and d - last <= op.GAP else set())
            last = d
            best = max(best, len(span) / len(grams))
            if len(span) / len(grams) >= op.SHARE:
                labels.add(label)
    starts = [i for i, _ in places]
    base = {label for _, label in places}
    return (
        len(w),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | labels)),
        best,
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_brute_force(spark):
    notice = dict((label, text) for label, text in op.WORDINGS)
    broken = notice["mit-notice"].split()
    del broken[8]
    broken.insert(20, "extra")
    texts = [
        *notice.values(),
        " ".join(broken),
        "x " * 50 + notice["bsd"] + " y" * 50,
        "MIT license, mit License; Apache license general public license General Public LICENSE",
        "general public general public license mit mit license license",
        "licensed under the law",
        "the GNU general public license version 3 is licensed under the rules",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = rows_of(op.scan_licenses(df, ["doc_id"]))
    assert out == sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=str)
    labels = {r[0]: r[6].split(",") for r in out}
    assert all(label in labels[i] for i, label in enumerate(notice)) and "mit-notice" in labels[len(notice)]


def test_awkward_rows(awkward, clashing, empty, awkward_rows):
    want = sorted(((i, *brute(t)) for i, t, *_ in awkward_rows), key=str)
    assert rows_of(op.scan_licenses(awkward, ["doc_id"])) == want
    assert rows_of(op.scan_licenses(clashing, ["doc_id"])) == want
    assert op.scan_licenses(empty, ["doc_id"]).count() == 0


def test_no_python_in_the_plan(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    plan = op.scan_licenses(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
