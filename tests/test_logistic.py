"""The trainer with own arithmetic against MLlib and against its own optimum."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tassel.plans.logistic import apply_logistic, fit_logistic

SCHEMA = "a double, b double, c double, y int"


def made(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = rng.gauss(3, 2), rng.gauss(-1, 0.5)
        y = int(rng.random() < 1 / (1 + np.exp(-(0.8 * a - 2 - b))))
        rows.append((a if rng.random() > 0.1 else None, b if rng.random() > 0.1 else float("nan"), 7.0, y if rng.random() > 0.05 else None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_equals_mllib(spark):
    df = made(spark).filter("y is not null and a is not null and not isnan(b)").persist()
    n = df.count()
    mine = fit_logistic(df, ["a", "b"], "y", penalty=5.0)
    assert mine.steps[-1] < 1e-12
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    theirs = LogisticRegression(labelCol="y", regParam=5.0 / n, tol=1e-12, maxIter=500).fit(rows)
    # MLlib divides by the sample deviation, which the penalty feels, hence the tolerance
    assert np.allclose(np.array(mine.coefficients[1:]) / mine.scales, theirs.coefficients.toArray(), rtol=1e-3)
    got = np.array([r.probability for r in apply_logistic(mine, df).collect()])
    want = np.array([r.probability[1] for r in theirs.transform(rows).collect()])
    assert np.abs(np.sort(got) - np.sort(want)).max() < 1e-3


def test_it_is_the_optimum(spark):
    df = made(spark)
    model = fit_logistic(df, ["a", "b", "c"], "y")
    known = df.filter("y is not null").collect()
    medians = [np.median([r[c] for r in known if r[c] is not None and not np.isnan(r[c])]) for c in "abc"]
    x = np.array([[m if r[c] is None or np.isnan(r[c]) else r[c] for c, m in zip("abc", medians)] for r in known])
    assert np.allclose(model.fill, medians)
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    y, b = np.array([r.y for r in known]), np.array(model.coefficients)
    p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    gradient = np.append((y - p).sum(), x.T @ (y - p) - 10.0 * b[1:])
    assert np.abs(gradient).max() < 1e-8 and b[3] == pytest.approx(0, abs=1e-12)
    # rows without a label are scored, too
    assert apply_logistic(model, df).filter("probability between 0 and 1").count() == df.count()


def test_separable_rows_and_no_rows(spark):
    df = spark.createDataFrame([(float(i), 1.0, None, int(i > 4)) for i in range(10)], SCHEMA)
    model = fit_logistic(df, ["a", "b", "c"], "y")
    assert np.isfinite(model.coefficients).all() and model.coefficients[1] > 0
    empty = fit_logistic(df.filter("y > 5"), ["a"], "y")
    assert empty.coefficients == [0.0, 0.0] and apply_logistic(empty, df).filter("probability = 0.5").count() == 10
    one = fit_logistic(df.filter("y = 1").withColumn("a", F.lit(2.0)), ["a"], "y", rounds=3)
    assert np.isfinite(one.coefficients).all()
