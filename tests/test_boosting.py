"""Boosted trees grown side by side against MLlib's, and what they cost in jobs."""

import threading
import uuid

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tassel.plans import boosting, models

N = 600


@pytest.fixture(scope="module")
def rows(spark):
    """Two numbers of few values and a text; the outcome follows from them but for every seventh row."""
    h = lambda k, n: F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(n))
    df = spark.range(N).select("id", (h(1, 19) / 2).alias("a"), h(2, 11).cast("double").alias("b"), F.concat(F.lit("v"), h(3, 6)).alias("t"))
    right = (F.col("a") + F.col("b") > 9) | F.col("t").isin("v1", "v4")
    df = df.withColumns({"label": F.when(h(4, 7) == 0, ~right).otherwise(right).cast("double"), "fold": (F.col("id") % 3).cast("int")})
    df = StringIndexer(inputCol="t", outputCol="c", stringOrderType="alphabetAsc").fit(df).transform(df)
    out = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).repartition(3).persist()
    out.count()
    return out


def chances(model, rows):
    p = model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).collect()
    return {r.id: r.p for r in p}


@pytest.mark.parametrize("one_task", [boosting.ONE_TASK_ROWS, 0])
def test_equal_to_mllib_where_nothing_is_drawn(rows, monkeypatch, one_task):
    monkeypatch.setattr(boosting, "ONE_TASK_ROWS", one_task)
    estimator = GBTClassifier(maxIter=13, maxDepth=3, stepSize=0.3, seed=1)
    got, want = boosting.fit_boosted(estimator, rows).model, estimator.fit(rows)
    assert chances(got, rows) == pytest.approx(chances(want, rows), abs=1e-9)
    assert got.featureImportances.toArray().tolist() == pytest.approx(want.featureImportances.toArray().tolist())
    assert [t.depth for t in got.trees] == [t.depth for t in want.trees] and got.treeWeights == want.treeWeights


@pytest.mark.parametrize("one_task", [boosting.ONE_TASK_ROWS, 0])
def test_a_fold_is_scored_by_the_fit_without_it(rows, monkeypatch, one_task):
    monkeypatch.setattr(boosting, "ONE_TASK_ROWS", one_task)
    estimator = GBTClassifier(maxIter=12, maxDepth=2, stepSize=0.3, seed=1)
    got = boosting.fit_boosted(estimator, rows, 3).held_out
    assert got.groupBy("fold").count().orderBy("fold").collect() == [(i, N // 3) for i in range(3)]
    for fold in range(3):
        alone = estimator.fit(rows.filter(F.col("fold") != fold)).transform(rows.filter(F.col("fold") == fold))
        want = alone.select("label", vector_to_array("rawPrediction")[1].alias("score")).orderBy("score", "label").collect()
        have = got.filter(F.col("fold") == fold).select("label", "score").orderBy("score", "label").collect()
        assert sorted(r.score for r in have) == pytest.approx(sorted(r.score for r in want), abs=1e-9)
        assert sum(r.label for r in have) == sum(r.label for r in want)


@pytest.mark.parametrize("one_task", [boosting.ONE_TASK_ROWS, 0])
def test_shares_of_rows_and_features(rows, monkeypatch, one_task):
    monkeypatch.setattr(boosting, "ONE_TASK_ROWS", one_task)
    model = boosting.fit_boosted(models.boosted_trees().setMaxIter(25), rows).model
    assert model.getNumTrees == 25 and model.featureImportances.toArray().sum() == pytest.approx(1.0)
    assert model.treeWeights == [1.0] + [0.05] * 24
    right = model.transform(rows).filter("prediction = label").count()
    assert right > 0.75 * N


def test_numbers_of_many_values_and_of_one(spark):
    df = spark.range(500).select(F.col("id").alias("a"), F.lit(3.0).alias("b"), (F.col("id") > 200).cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = boosting.fit_boosted(GBTClassifier(maxIter=3, maxDepth=2, seed=1), rows).model
    assert model.transform(rows).filter("prediction <> label").count() <= 500 / 32
    only = VectorAssembler(inputCols=["b"], outputCol="features").transform(df)
    assert [t.numNodes for t in boosting.fit_boosted(GBTClassifier(maxIter=2, seed=1), only).model.trees] == [1, 1]


def test_what_cannot_be_learned_from(spark, rows):
    with pytest.raises(ValueError, match="empty"):
        boosting.fit_boosted(GBTClassifier(maxIter=1), rows.filter("false"))
    with pytest.raises(ValueError, match="empty without fold 0"):
        boosting.fit_boosted(GBTClassifier(maxIter=1), rows.withColumn("fold", F.lit(0)), 2)
    with pytest.raises(Exception, match="0 or 1"):
        boosting.fit_boosted(GBTClassifier(maxIter=1), rows.withColumn("label", F.lit(2.0)))


def test_trees_that_draw_no_row(spark, rows):
    few = rows.limit(2).withColumn("label", F.lit(1.0))
    model = boosting.fit_boosted(GBTClassifier(maxIter=20, subsamplingRate=0.2, seed=1), few).model
    assert model.getNumTrees == 20 and model.transform(few).filter("prediction <> 1").isEmpty()


def test_fits_share_their_jobs(spark, rows):
    """each level of each tree of each fit was a job of its own, 2,700 for a scoring run."""
    group = f"boosted-{uuid.uuid4().hex}"
    got = []

    def fit():
        spark.sparkContext.setJobGroup(group, "boosted")
        got.append(boosting.fit_boosted(models.boosted_trees(), rows, 3))

    thread = threading.Thread(target=fit)
    thread.start()
    thread.join()
    assert got[0].model.getNumTrees == 100
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 60
