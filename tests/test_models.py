"""Training on a small table with a signal that can be learned."""

import threading

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tassel.functions import scoring
from tassel.operators.scored import with_targets
from tassel.plans import models

N = 400


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    text = {c: F.concat(F.lit("v"), (i % (k + 2)).cast("string")) for k, c in enumerate(models.BACKGROUND)}
    good = (i * 37 % 100) / 100.0
    columns = {
        **text,
        "student_guid": F.format_string("S%05d", i),
        "cohort": F.lit("2020-21"),
        "retention": (good > 0.4).cast("int"),
        "persistence": F.lit(1),
        "average_grade": F.when(i % 9 == 0, F.lit(None)).otherwise(good * 4),
        "course_completion_rate": good,
        "total_credits_attempted": F.lit(30.0),
        "total_credits_earned": good * 30,
        "gateway_math_courses": (i % 2).cast("long"),
        "gateway_english_courses": (i % 3).cast("long"),
        "gpa_group_year_1": F.when(i % 11 == 0, F.lit(None)).otherwise(good * 4),
        "number_of_credits_earned_year_1": good * 24,
        "completedgatewaymathyear1": F.when(i % 7 == 0, F.lit(None)).otherwise(F.when(good > 0.5, "Y").otherwise("N")),
        "completedgatewayenglishyear1": F.when(good > 0.3, "Y").otherwise("N"),
        **{c: F.lit(0.0) for c in scoring.BACHELOR_YEARS + scoring.ASSOCIATE_YEARS + scoring.CERTIFICATE_YEARS + scoring.EITHER_YEARS},
    }
    rows = spark.range(N).select(*[e.alias(c) for c, e in columns.items()])
    rows = rows.withColumn("credential_type_sought_year_1", F.when(F.col("gpa_group_year_1") > 2, "A").otherwise("01"))
    out = with_targets(rows).persist()
    out.count()
    return out


def test_preprocessor_fills_with_medians_and_alphabetical_codes(spark):
    df = spark.createDataFrame([("a", 1.0, "z"), ("b", None, None), ("c", 4.0, "y")], "student_guid string, n double, t string")
    pre = models.Preprocessor.fit(df, ["n", "t"])
    assert pre.medians == {"n": 2.5}
    got = {r.student_guid: list(r.features) for r in pre.transform(df, ["student_guid"], ["n", "t"]).collect()}
    # Unknown < y < z
    assert got == {"a": [1.0, 2.0], "b": [2.5, 0.0], "c": [4.0, 1.0]}


def test_regularization_matches_the_summed_loss():
    assert models.logistic(1000).getRegParam() == pytest.approx(0.01)


def test_comparison_keeps_the_best(table):
    got = models.compare_models(table, folds=2, candidates=["Logistic Regression", "Random Forest (Simple)"])
    assert [c["model"] for c in got.comparison] == ["Logistic Regression", "Random Forest (Simple)"]
    assert got.metrics["auc_roc"] > 0.8
    assert got.name == max(got.comparison, key=lambda c: c["cv_auc"])["model"]


def test_no_time_model_without_enough_completers(table):
    assert models.train_time_to_credential(table).model is None


def test_every_student_is_scored(table, monkeypatch):
    forest = RandomForestClassifier(numTrees=5, maxDepth=3, seed=1)
    monkeypatch.setattr(models, "boosted_trees", lambda: forest)
    trained = models.train_all(table.drop(*[c for c in table.columns if c.startswith("target_")]), compare=False)
    scored = models.score_all(table, trained).persist()
    assert scored.count() == N
    for c in ("retention_probability", "gateway_math_probability", "gateway_english_probability", "low_gpa_probability"):
        assert scored.filter(~F.col(c).between(0, 1) | F.col(c).isNull()).count() == 0
    # no bachelor ever occurred
    assert scored.filter("prob_bachelor <> 0 or predicted_time_to_credential is not null").count() == 0
    assert scored.filter("at_risk_alert is null").count() == 0
    # inputs come through unfilled
    assert scored.filter("gpa_group_year_1 is null").count() == table.filter("gpa_group_year_1 is null").count()
    scored.unpersist()


class Watched:
    """An estimator that notes in how many parts its rows come."""

    def __init__(self, inner):
        self.inner, self.parts = inner, []

    def fit(self, rows):
        self.parts.append(rows.rdd.getNumPartitions())
        return self.inner.fit(rows)


def test_passes_cost_a_task_for_thousands_of_rows(table):
    """320 rows came in as many parts as the last shuffle had, each a task in each of hundreds of passes."""
    watched = Watched(RandomForestClassifier(numTrees=2, maxDepth=2, seed=1))
    got = models.train_classifier(table, "Retention", "target_retention", models.RETENTION_FEATURES, watched)
    assert watched.parts == [1] and got.metrics["n"] == 80


def test_tasks_follow_the_rows():
    assert [models._tasks(n, 12) for n in (0, 400, 15_000, 90_000, 900_000, 5_400_000)] == [1, 1, 2, 9, 12, 22]


def test_rows_for_passes_are_the_same_rows(spark):
    rows = spark.createDataFrame([(i % 50, None if i % 7 else float(i)) for i in range(30_000)], "a int, b double").repartition(30)
    with models._for_passes(rows) as dealt:
        assert dealt.rdd.getNumPartitions() == 3
        assert dealt.exceptAll(rows).isEmpty() and rows.exceptAll(dealt).isEmpty()


def test_rows_for_passes_leave_their_steps_behind(spark):
    """every job of a trainer walked through all shuffles and joins that its rows came from."""
    rows = spark.range(500).selectExpr("id", "id % 7 as k").repartition(6)
    rows = rows.join(rows.groupBy("k").count(), "k").repartition(5)
    with models._for_passes(rows) as dealt:
        assert "Shuffled" not in dealt.rdd.toDebugString().decode()
        assert dealt.exceptAll(rows).isEmpty() and rows.exceptAll(dealt).isEmpty()


def test_fits_run_side_by_side_on_few_rows_only(spark):
    """fits of hundreds of short jobs each ran one after the other on idle cores."""
    assert [models._fits_at_once(n, 12) for n in (0, 400, 15_000, 40_000, 90_000, 900_000, 5_400_000)] == [4, 4, 4, 3, 1, 1, 1]
    both = threading.Barrier(2, timeout=60)
    got = models._side_by_side([lambda: (both.wait(), "a")[1], lambda: (both.wait(), "b")[1]], spark.range(10))
    assert got == ["a", "b"]
