"""Ensembles scored from their table of nodes, beside MLlib's own answers."""

import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tassel.plans.trees import export_trees, read_trees, score_trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(i, rng.gauss(0, 1), float(rng.randrange(5)), rng.random()) for i in range(400)]
    df = spark.createDataFrame(made, "id long, a double, b double, c double")
    df = df.withColumn("y", F.when(F.col("a") + F.col("b") > 2.5, 1.0).otherwise(0.0)).withColumn("k", F.col("b") % 3)
    df = df.withColumn("v", F.col("a") * F.col("b") + F.col("c"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).persist()


@pytest.mark.parametrize(
    "estimator",
    [
        lambda: RandomForestClassifier(labelCol="y", numTrees=7, maxDepth=4, seed=1),
        lambda: RandomForestClassifier(labelCol="k", numTrees=5, maxDepth=3, seed=2),
        lambda: RandomForestClassifier(labelCol="y", numTrees=1, maxDepth=0, seed=1),
        lambda: GBTClassifier(labelCol="y", maxIter=6, maxDepth=2, stepSize=0.3, seed=1),
        lambda: RandomForestRegressor(labelCol="v", numTrees=6, maxDepth=5, seed=1),
        lambda: GBTRegressor(labelCol="v", maxIter=5, maxDepth=3, seed=1),
    ],
)
def test_every_value_is_the_same(spark, rows, tmp_path, estimator):
    model = estimator().fit(rows)
    export_trees(model, str(tmp_path / "t"), spark)
    mine = score_trees(read_trees(spark, str(tmp_path / "t")), rows, "id")
    theirs = model.transform(rows)
    both = theirs.drop("prediction").join(mine, "id").count()
    assert both == rows.count()
    if "shares" in mine.columns:
        found = theirs.select("id", vector_to_array("probability").alias("p"), F.col("prediction").cast("int").alias("label")).join(mine, "id")
        for r in found.collect():
            assert r.shares == pytest.approx(r.p, abs=1e-12) and r.score == pytest.approx(r.p[1], abs=1e-12)
            assert r.prediction == r.label or max(r.p) - sorted(r.p)[-2] < 1e-12
    else:
        for r in theirs.select("id", F.col("prediction").alias("p")).join(mine, "id").collect():
            assert r.score == pytest.approx(r.p, abs=1e-9)


def test_splits_by_codes(spark, rows, tmp_path):
    text = rows.withColumn("t", F.concat(F.lit("v"), (F.abs(F.hash("id")) % 9).cast("string"))).drop("features")
    text = text.withColumn("y", F.when(F.col("t").isin("v1", "v4", "v5", "v8", "v0"), 1.0).otherwise(F.col("y")))
    coded = StringIndexer(inputCol="t", outputCol="code", stringOrderType="alphabetAsc").fit(text).transform(text)
    ready = VectorAssembler(inputCols=["a", "code"], outputCol="features").transform(coded)
    model = RandomForestClassifier(labelCol="y", numTrees=6, maxDepth=4, seed=1).fit(ready)
    nodes = export_trees(model, str(tmp_path / "t"), spark)
    assert nodes.filter("codes is not null").count() > 5 and nodes.filter("threshold is not null").count() > 5
    found = model.transform(ready).select("id", vector_to_array("probability")[1].alias("p")).join(score_trees(nodes, ready, "id"), "id")
    assert found.filter(F.abs(F.col("p") - F.col("score")) > 1e-12).count() == 0 and found.count() == rows.count()


def test_no_rows_and_other_models(spark, rows, tmp_path):
    model = RandomForestRegressor(labelCol="v", numTrees=2, maxDepth=2, seed=1).fit(rows)
    nodes = export_trees(model, str(tmp_path / "t"), spark)
    assert score_trees(nodes, rows.filter("id < 0"), "id").count() == 0
    with pytest.raises(TypeError):
        export_trees(DecisionTreeClassifier(labelCol="y").fit(rows), str(tmp_path / "u"), spark)
