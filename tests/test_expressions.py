"""Column builders on edge rows."""

import math
import random

from pyspark.sql import functions as F

from tassel.functions import numeric, readiness, scoring
from tassel.operators.readiness import with_readiness


def values(df, column):
    return [r[column] for r in df.collect()]


def numbers(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)


def test_half_even_rounds_like_python(spark):
    rng = random.Random(5)
    xs = [0.0, 0.05, 0.15, 0.25, 0.35, 2.05, 2.15, 2.25, 2.35, 2.675, 0.125, 0.5, 1.5, 2.5, 99.95, 1e-9]
    xs += [rng.randrange(0, 401) / 100 for _ in range(300)] + [rng.random() * 100 for _ in range(300)]
    df = numbers(spark, xs)
    for places in (0, 1, 2, 4):
        got = values(df.select(numeric.half_even("x", places).alias("r")), "r")
        assert got == [round(x, places) for x in xs]
        text = values(df.select(numeric.fixed_text("x", places).alias("r")), "r")
        assert text == [f"{x:.{places}f}" for x in xs]


def test_percent_is_exact_and_null_safe(spark):
    df = spark.createDataFrame([(1, 8), (0, 5), (5, 5), (1, 0), (1, 3), (1, 2000)], "a long, b long").coalesce(1)
    assert values(df.select(numeric.percent("a", "b").alias("p")), "p") == [12.5, 0.0, 100.0, None, 33.3, 0.1]


def test_bands_are_right_closed(spark):
    xs = [None, math.nan, 0.0, 0.25, 0.2500001, 0.5, 0.75, 1.0, 1.01]
    got = values(numbers(spark, xs).select(scoring.retention_band("x").alias("b")), "b")
    assert got == [
        None, None, None, "Critical Risk", "High Risk", "High Risk", "Moderate Risk", "Low Risk", None,
    ]


def test_risk_score_nulls_add_nothing_and_cap(spark):
    rows = [
        (0.0, 1.0, 0.1, 0.0, 100.0, "URGENT"),
        (1.0, None, None, None, 0.0, "LOW"),
        (0.5, 2.0, 0.5, 6.0, 50.0, "HIGH"),
        (0.5, 2.5, 0.85, 12.0, 28.0, "MODERATE"),
        (None, 1.0, 0.1, 0.0, None, None),
        (0.5, math.nan, math.nan, math.nan, 25.0, "MODERATE"),
    ]
    df = spark.createDataFrame(rows, "p double, g double, c double, k double, score double, alert string").coalesce(1)
    df = df.withColumn("s", scoring.risk_score("p", "g", "c", "k")).withColumn("a", scoring.alert_level("s"))
    assert values(df, "s") == [r[4] for r in rows]
    assert values(df, "a") == [r[5] for r in rows]


def test_targets_treat_zero_years_as_not_applicable(spark):
    columns = [*scoring.BACHELOR_YEARS, *scoring.ASSOCIATE_YEARS, *scoring.CERTIFICATE_YEARS, *scoring.EITHER_YEARS]
    rows = [
        ([0.0] * 8, "A", 99.0, 2, 0),
        ([4.0, 0, 0, 0, 0, 0, 2.0, 0], "C1", 2.0, 3, 3),
        ([0.0, None, 0, 3.0, 0, 0, 0, 0], None, 99.0, 2, 2),
        ([0.0, 0, 0, 0, 1.0, 0, 0, 0], "B", 99.0, 1, 1),
        ([0.0, 0, 0, 0, 0, 0, 0, 5.0], "02", 5.0, 1, 1),
        ([0.0, 0, 0, 0, 0, 0, 0, 5.0], "B", 5.0, 2, 2),
        ([0.0] * 8, "07", 99.0, 3, 0),
        ([0.0] * 8, None, 99.0, 0, 0),
    ]
    data = [(*[None if v is None else float(v) for v in y], s) for y, s, *_ in rows]
    schema = ", ".join(f"{c} double" for c in columns) + ", credential_type_sought_year_1 string"
    df = spark.createDataFrame(data, schema).coalesce(1)
    out = df.select(
        scoring.target_time_to_credential().alias("t"),
        scoring.target_credential_type().alias("c"),
        scoring.target_credential_type(False).alias("n"),
    ).collect()
    assert [(r.t, r.c, r.n) for r in out] == [(r[2], r[3], r[4]) for r in rows]


def test_gateway_target_codes(spark):
    df = spark.createDataFrame([("Y",), ("C",), ("N",), (None,)], "c string").coalesce(1)
    assert values(df.select(scoring.target_gateway("c").alias("t")), "t") == [1, 1, 0, None]
    assert values(df.select(scoring.target_gateway("c", ("Y",)).alias("t")), "t") == [1, 0, 0, None]


STUDENT = """gpa_group_year_1 double, course_completion_rate double, passing_rate double,
completedgatewaymathyear1 string, completedgatewayenglishyear1 string, number_of_credits_earned_year_1 double,
enrollment_intensity_first_term string, total_courses_enrolled long, math_placement string,
retention_probability double, at_risk_alert string, failing_grades_count long"""


def test_readiness_worked_examples(spark):
    rows = [
        (3.2, 0.83, 0.78, "Y", "N", 9.0, "Part-Time", 5, "C", 0.72, "MODERATE", 0),
        (1.8, 0.55, 0.50, "N", "N", 4.0, "Part-Time", 3, "R", 0.38, "HIGH", 2),
        (None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = with_readiness(spark.createDataFrame(rows, STUDENT).coalesce(1)).collect()
    shown = [
        (round(r.academic_score, 3), round(r.engagement_score, 3), round(r.model_score, 3), round(r.readiness_raw, 3), r.readiness_level)
        for r in got
    ]
    assert shown[0] == (0.752, 0.667, 0.660, 0.699, "high")
    assert shown[1] == (0.460, 0.333, 0.340, 0.386, "low")
    assert shown[2] == (0.5, 0.433, 0.5, 0.48, "medium")


def test_factors_actions_and_rationale(spark):
    rows = [
        (1.85, 0.745, 0.5, "N", None, 11.9, " pt ", 3, "R", 0.385, "urgent", 2),
        (None, None, None, "true", "1", 12.0, None, None, None, None, None, None),
    ]
    df = with_readiness(spark.createDataFrame(rows, STUDENT).coalesce(1))
    out = df.select(
        readiness.risk_factors().alias("f"), readiness.suggested_actions().alias("a"), readiness.rationale().alias("r")
    ).collect()
    assert out[0].f == [
        f"Low first-year GPA ({1.85:.1f} / 4.0)",
        "High course failure rate (67% of courses failed)",
        "Part-time enrollment reduces success probability",
        "Gateway math not completed in Year 1",
        "Gateway English not completed in Year 1",
        "Below 12-credit Year 1 milestone (11 credits earned)",
        "Retention model flags as Urgent risk",
        f"Below average course completion rate ({0.745 * 100:.0f}%)",
    ]
    assert len(out[0].a) == 8 and out[0].a[-1].startswith("Increase credit load")
    assert "(pt enrollment, 3 courses)" in out[0].r and "38% predicted" in out[0].r.replace("39%", "38%")
    assert out[1].f == [] and out[1].a == []
    assert "GPA N/A/4.0, N/A% course completion" in out[1].r and "unknown alert, N/A% predicted" in out[1].r


def test_gpa_performance_without_grade_is_as_expected(spark):
    df = spark.createDataFrame([(None, 3.0), (3.3, 3.0), (2.7, 3.0), (3.1, 3.0)], "a double, p double").coalesce(1)
    got = values(df.select(scoring.gpa_performance("a", "p").alias("g")), "g")
    assert got == ["As Expected", "Above Expected", "Below Expected", "As Expected"]


def test_age_segment(spark):
    df = spark.createDataFrame([("20 and younger",), (">20 - 24",), ("Older than 24",), (None,)], "a string").coalesce(1)
    assert values(df.select(scoring.age_segment("a").alias("s")), "s") == ["Under 25", "Under 25", "25 and over", None]


def test_missing_to_null(spark):
    got = values(numbers(spark, [1.0, math.nan, None]).select(numeric.missing_to_null("x").alias("m")), "m")
    assert got == [1.0, None, None]


def test_half_up_tenth_goes_up_below_zero(spark):
    got = values(numbers(spark, [25.0, -24.5, -25.5, 0.5]).select(numeric.half_up_tenth(F.col("x")).alias("m")), "m")
    assert got == [2.5, -2.4, -2.5, 0.1]
