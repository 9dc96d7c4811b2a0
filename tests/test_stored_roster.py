"""Pages of a stored roster are those of the sorted one, and read their ranges only."""

import glob
import random

import pytest

from tassel.operators import roster

STUDENTS = (
    "student_guid string, cohort string, enrollment_intensity_first_term string, at_risk_alert string, retention_probability double, "
    "gateway_math_probability double, gateway_english_probability double, low_gpa_probability double, predicted_time_to_credential double, "
    "predicted_credential_label string"
)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    rows = [
        (f"s{i:04d}", rng.choice(["2020-21", "2021-22", None]), "FT", rng.choice(["URGENT", "HIGH", "LOW", None]),
         rng.choice([None, 0.5, round(rng.random(), 2)]), rng.random(), 0.1, 0.2, 3.0, "Associate")
        for i in range(500)
    ]
    records = [(f"s{i:04d}", round(rng.random(), 4), "high") for i in range(0, 500, 3)]
    return (
        spark.createDataFrame(rows, STUDENTS).repartition(4),
        spark.createDataFrame(records, "student_guid string, readiness_score double, readiness_level string"),
    )


@pytest.mark.parametrize("sort", [{}, {"worst_first": True}, {"sort_by": "readiness_score", "descending": False}, {"sort_by": "cohort"}])
def test_pages_are_those_of_the_sorted_roster(spark, tables, tmp_path, sort):
    stored = roster.StoredRoster(spark, str(tmp_path / "r"), **sort).write(*tables, range_rows=60)
    assert len(glob.glob(str(tmp_path / "r" / "rows" / "_range=*"))) > 4
    for page, size in ((1, 50), (2, 50), (10, 50), (11, 50), (3, 7), (2, 200), (1, 1000), (72, 7)):
        got = [tuple(r) for r in stored.page(page, size).collect()]
        assert got == [tuple(r) for r in roster.roster(*tables, page=page, page_size=size, **sort).collect()]


def test_a_page_reads_its_ranges_only(spark, tables, tmp_path):
    stored = roster.StoredRoster(spark, str(tmp_path / "r")).write(*tables, range_rows=60)
    again = roster.StoredRoster(spark, str(tmp_path / "r"))
    plan = again.page(9, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan or "PartitionFilters: [_range" in plan
    assert [tuple(r) for r in again.page(9, 50).collect()] == [tuple(r) for r in stored.page(9, 50).collect()]
    assert again.page(1000, 50).count() == 0


def test_an_empty_roster(spark, tables, tmp_path):
    stored = roster.StoredRoster(spark, str(tmp_path / "r")).write(*tables, search="nobody")
    assert stored.page().count() == 0
