"""Combinations of courses against plain counting, and pairs whose courses cannot reach the count."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tassel.operators import courses

SCHEMA = (
    "student_guid string, academic_year string, academic_term string, course_prefix string, course_number string, "
    "course_name string, grade string, delivery_method string, instructor_status string"
)
BAD, GOOD = {"D", "F", "W", "I"}, {"A", "B", "C", "P"}


def made(seed, n, students=40, catalog=9):
    rng = random.Random(seed)
    pick = lambda: (
        rng.choice([None, "hot", *[f"s{i}" for i in range(students)]]), rng.choice(["2020", "2021", None]), rng.choice(["FALL", "SPRING"]),
        rng.choice(["A", "A 1", "B"]), str(rng.choice([9, 10, 95, 101][: max(1, catalog // 2)])), rng.choice(["x", "y", None]),
        rng.choice(["A", "B", "D", "F", "W", None, "P"]), rng.choice(["F", "O", None]), rng.choice(["FT", None]),
    )
    return [pick() for _ in range(n)]


def brute(rows, size, min_count):
    sittings = {}
    for s, y, t, p, c, _, g, *_ in rows:
        if None not in (s, y, t, p, c):
            sittings.setdefault((s, y, t), {}).setdefault((p, c), []).append(g)
    found = {}
    for taken in sittings.values():
        for n in range(2, size + 1):
            for combo in itertools.combinations(sorted(taken), n):
                grades = [g for c in combo for g in taken[c]]
                counts = found.setdefault(combo, [0, 0, 0])
                counts[0] += 1
                counts[1] += any(g in BAD for g in grades)
                counts[2] += all(g in GOOD for g in grades)
    return {" + ".join(map(" ".join, k)): (len(k), *v) for k, v in found.items() if v[0] >= min_count}


@pytest.mark.parametrize("size, min_count", [(2, 1), (3, 4), (4, 2), (5, 9), (3, 10_000)])
def test_sets_equal_plain_counting(spark, size, min_count):
    rows = made(size, 700)
    got = courses.course_sets(spark.createDataFrame(rows, SCHEMA), size, min_count).collect()
    want = brute(rows, size, min_count)
    assert len({r.courses for r in got}) == len(got)
    assert {r.courses: (r.n_courses, r.sittings) for r in got} == {k: v[:2] for k, v in want.items()}
    for r in got:
        n, total, bad, good = want[r.courses]
        assert r.dfwi_rate == pytest.approx(100 * bad / total, abs=0.051)
        assert r.all_pass_rate == pytest.approx(100 * good / total, abs=0.051)


def test_one_course_is_no_combination(spark):
    with pytest.raises(ValueError):
        courses.course_sets(spark.createDataFrame([], SCHEMA), 1)
    assert courses.course_sets(spark.createDataFrame([], SCHEMA), 3).count() == 0


@pytest.mark.parametrize("min_count", [2, 9, 40])
def test_pruned_pairs_are_the_plain_ones(spark, min_count):
    """Rare courses that a student repeats in one term may still reach the count, and stay."""
    rows = made(1, 500) + [("rep", "2020", "FALL", "Z", "1", "z", "A", "F", "FT")] * 5 + [("rep", "2020", "FALL", "Z", "2", "z", "F", "O", "FT")] * 8
    df = spark.createDataFrame(rows, SCHEMA)
    plain = courses.course_pairs(df).filter(F.col("co_enrollment_count") >= min_count)
    key = lambda t: sorted(map(str, t.collect()))
    assert key(courses.course_pairs(df, min_count=min_count)) == key(plain)
    assert key(courses.all_pair_breakdowns(df, min_count)) == key(courses.all_pair_breakdowns(df, 1).filter(F.col("co_count") >= min_count))


def test_rare_courses_do_not_reach_the_join(spark):
    rows = made(2, 400) + [(f"s{i}", "2020", "FALL", "R", str(i), "r", "A", "F", "FT") for i in range(5)]
    sat = courses._sittings(spark.createDataFrame(rows, SCHEMA), "course_name")
    assert sat.filter("course_prefix = 'R'").count() == 5
    assert courses._supported(sat, 20, "t").filter("course_prefix = 'R'").count() == 0


@pytest.mark.parametrize("min_count", [1, 3])
def test_pair_names_are_the_greatest_that_met(spark, min_count):
    """F10 to F13: names were grouped with every pair; a name that never met the other course must still not show."""
    row = lambda s, c, name, grade: (s, "2020", "FALL", *c, name, grade, "F", "FT")
    a, b, c = ("A", "1"), ("B", "1"), ("C", "1")
    rows = [row(f"s{i}", a, "m" if i else "k", "A") for i in range(3)] + [row(f"s{i}", b, None, "F") for i in range(3)]
    rows += [row("s1", a, "l", "F"), row("alone", a, "z", "A"), row("s0", c, "q", "A"), row("s0", (None, "1"), "n", "A")]
    got = courses.course_pairs(spark.createDataFrame(rows, SCHEMA), min_count=min_count)
    assert got.columns == [*courses.PAIR, "name_a", "name_b", "co_enrollment_count", "hit_count"]
    want = {("A", "1", "B", "1", "m", None, 4, 0)}
    if min_count == 1:
        want |= {("A", "1", "C", "1", "k", "q", 1, 1), ("B", "1", "C", "1", None, "q", 1, 0)}
    assert {tuple(r) for r in got.collect()} == want


def _grouped_by(df):
    """Columns of all grouped aggregates in the plan, physical names without ids."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Aggregate [" in line]


def test_pairs_are_not_grouped_by_name(spark):
    """F10 to F13: a task held a row for every pair of names, with both names in it."""
    lines = _grouped_by(courses.course_pairs(spark.createDataFrame(made(3, 100), SCHEMA), min_count=2))
    assert lines and not any("course_name_a" in line.split("], [")[0] for line in lines)


def test_levels_write_counts_only(spark, tmp_path, monkeypatch):
    """each level wrote and joined a row for every set of every sitting; a sitting is one row now, and no level writes it."""
    rows = [(f"s{s}", "2020", "FALL", "A", str(c), "x", "A", "F", "FT") for s in range(60) for c in range(8)]
    monkeypatch.setattr(courses, "checkpoint_dir", lambda _: str(tmp_path))
    got = courses.course_sets(spark.createDataFrame(rows, SCHEMA), 4, 3)
    assert got.count() == 28 + 56 + 70
    (folder,) = tmp_path.iterdir()
    written = {p.name: spark.read.parquet(str(p)).count() for p in folder.iterdir()}
    assert written == {"sittings": 480, "courses": 8, "taken": 60, "frequent-2": 28, "frequent-3": 56, "frequent-4": 70}
