"""Hidden cells and totals against a solver that tries every table that agrees with what is shown."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tassel.operators import privacy


def solutions(shown, present, wanted):
    """A table of counts of at least 1 in the present cells that agrees with all shown numbers and for which ``wanted``
    holds, or None. ``shown`` has the visible numbers by key; a key holds a value or None (total) for each dimension."""
    free = [c for c in present if c not in shown]
    table = {c: shown[c] for c in present if c in shown}
    totals = [(t, [c for c in present if all(v in (None, w) for v, w in zip(t, c))]) for t in shown if None in t]
    most = max([n for n in shown.values()], default=0) + 3

    def possible():
        for t, members in totals:
            known = [table[c] for c in members if c in table]
            rest = len(members) - len(known)
            if sum(known) + rest > shown[t] or (not rest and sum(known) != shown[t]):
                return False
        return True

    def search(i):
        if i == len(free):
            return dict(table) if wanted(table) else None
        for n in range(1, most):
            table[free[i]] = n
            if possible() and (found := search(i + 1)):
                return found
            del table[free[i]]
        return None

    return search(0)


def run(spark, counts, dims, minimum, **more):
    rows = [(*(None if v == "null" else v for v in key),) for key, n in counts.items() for _ in range(n)]
    names = [f"d{i}" for i in range(dims)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names)).repartition(3)
    out = {}
    for r in privacy.protected_cells(df, names, minimum, {"half": F.count("*") / 2}, **more).collect():
        key = tuple(None if r[f"all_{c}"] else ("null" if r[c] is None else r[c]) for c in names)
        assert key not in out and (r.n is None) == (r.half is None) == r.suppressed
        out[key] = r.n
    return out


def check(counts, got, minimum):
    dims = len(next(iter(counts)))
    want = {}
    for key, n in counts.items():
        for mask in itertools.product([0, 1], repeat=dims):
            total = tuple(None if m else v for m, v in zip(mask, key))
            want[total] = want.get(total, 0) + n
    assert got.keys() == want.keys()
    assert all(n in (None, want[key]) for key, n in got.items())
    assert all(got[key] is None for key, n in want.items() if n < minimum)
    shown = {key: n for key, n in got.items() if n is not None}
    for key in (k for k, n in got.items() if n is None):
        members = [c for c in counts if all(v in (None, w) for v, w in zip(key, c))]
        other = solutions(shown, list(counts), lambda t: sum(t[c] for c in members) != want[key])
        assert other, f"{key} follows from the rest"
    return sum(n is None for n in got.values())


@pytest.mark.parametrize("seed", range(6))
def test_no_hidden_number_follows(spark, seed):
    rng = random.Random(seed)
    counts = {(a, b): n for a in "pqrs" for b in "xyz" if (n := rng.choice([0, 1, 2, 3, 5, 7, 9]))}
    counts |= {("null", "x"): 4, ("p", "null"): 2}
    got = run(spark, counts, 2, 3, nearest=rng.choice([1, 2, 8]))
    assert check(counts, got, 3) > 0


def test_one_dimension(spark):
    counts = {("a",): 1, ("b",): 7, ("c",): 9, ("d",): 20}
    got = run(spark, counts, 1, 3)
    check(counts, got, 3)
    assert {k[0] for k, n in got.items() if n is None} == {"a", "b"}  # the next smallest, not the total


def test_three_dimensions(spark):
    rng = random.Random(9)
    counts = {(a, b, c): n for a in "pq" for b in "xy" for c in "12" if (n := rng.choice([0, 1, 2, 4, 6]))}
    check(counts, run(spark, counts, 3, 2), 2)


def test_totals_are_hidden_if_nothing_else_helps(spark):
    counts = {("a", "x"): 1, ("b", "y"): 9}
    got = run(spark, counts, 2, 3)
    check(counts, got, 3)
    assert got["b", "y"] == 9 and got[None, None] is None


def test_bridges_between_hidden_cells(spark):
    """Two hidden cells in every line are not enough: one that joins two circles would follow."""
    counts = {(r, c): 5 for r in "abcde" for c in "vwxyz"}
    counts |= {k: 1 for k in [("a", "v"), ("a", "w"), ("b", "v"), ("b", "w"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", "x"), ("d", "y")]}
    got = run(spark, counts, 2, 2)
    assert check(counts, got, 2) > 9


def test_nothing_small_and_nothing_at_all(spark):
    counts = {("a", "x"): 5, ("a", "y"): 6}
    assert None not in run(spark, counts, 2, 3).values()
    df = spark.createDataFrame([], "d0 string, d1 string")
    assert [tuple(r) for r in privacy.protected_cells(df, ["d0", "d1"]).collect()] == []
