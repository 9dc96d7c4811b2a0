"""Boosted trees by MLlib's steps, with several fits on the same rows grown level by level in the same jobs.

MLlib runs a job for each level of each tree of each fit, and on few rows a job's own cost is nearly all of it. Here the
folds of a cross-validation share their jobs. A worker adds up histograms of its rows, the driver chooses the
splits; rows that one task can pass over as fast as a job starts are learned from within one task, by the same steps. What comes
out is MLlib's own model.
"""

from __future__ import annotations

import functools
import json
import math
import operator
import pickle
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, let_workers_import
from . import boosting_kernel as kernel

#: Trees after which the margins of all rows are brought up to date; younger trees are applied again in each job.
TREES_A_STATE = 10
#: Rows, times fits, that a pass takes about as long over as a job takes to start.
ONE_TASK_ROWS = 250_000
#: Parts whose histograms the driver adds up itself; those of more parts are added up on the way.
MOST_TO_DRIVER = 16

_NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint,"
    " gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def _codes(rows: DataFrame) -> list[int]:
    """For each place of the feature vectors the number of its codes, 0 for a number."""
    about = rows.schema["features"].metadata["ml_attr"]
    codes = [0] * about["num_attrs"]
    for attribute in about.get("attrs", {}).get("nominal", []):
        codes[attribute["idx"]] = len(attribute["vals"]) if "vals" in attribute else attribute.get("num_vals", 0)
    for attribute in about.get("attrs", {}).get("binary", []):
        codes[attribute["idx"]] = 2
    return codes


def _edges(rows: DataFrame, codes: list[int], most_bins: int) -> list[np.ndarray | None]:
    """Thresholds of each number: between all its values if they are few, else at quantiles of all rows."""
    x, numbers = vector_to_array("features"), [i for i, n in enumerate(codes) if not n]
    edges: list[np.ndarray | None] = [None] * len(codes)
    if not numbers:
        return edges
    counted = rows.agg(*[F.approx_count_distinct(x[i], 0.02).alias(f"c{i}") for i in numbers]).first()
    few = [i for i in numbers if counted[f"c{i}"] <= 2 * most_bins]
    shares = F.array(*[F.lit(k / most_bins) for k in range(1, most_bins)])
    found = rows.agg(
        *[F.collect_set(x[i]).alias(f"v{i}") for i in few],
        *[F.percentile_approx(x[i], shares, F.lit(10_000)).alias(f"q{i}") for i in numbers],
    ).first()
    for i in numbers:
        values = np.array(sorted(found[f"v{i}"])) if i in few else None
        if values is not None and len(values) <= most_bins:
            edges[i] = (values[1:] + values[:-1]) / 2
        else:
            edges[i] = np.unique(found[f"q{i}"] or [])
    return edges


def _chosen(strategy: str, n_features: int) -> int:
    """Features that a node may choose from."""
    if strategy in ("all", "auto"):
        return n_features
    if strategy.isdigit() and int(strategy) > 0:
        return min(int(strategy), n_features)
    return math.ceil(float(strategy) * n_features)


def _split(node: kernel.Node, spec: kernel.Spec, codes: list[int]) -> tuple:
    if node.left is None:
        return (-1, [], -1)
    if spec.edges[node.feature] is None:
        lefts = np.flatnonzero(node.left[: codes[node.feature]]).astype(float).tolist()
        return (node.feature, lefts, codes[node.feature])
    return (node.feature, [float(spec.edges[node.feature][node.left.sum() - 1])], -1)


def _as_model(spark: SparkSession, estimator: GBTClassifier, spec: kernel.Spec, codes: list[int], trees: list[dict[int, kernel.Node]]):
    """MLlib's model with these trees, read from the files that MLlib would have written for it."""

    def about(kind: str, params: set[str], **more) -> str:
        known = {p.name: v for p, v in estimator._paramMap.items() if p.name in params}
        usual = {p.name: v for p, v in estimator._defaultParamMap.items() if p.name in params}
        head = {"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        return json.dumps({**head, "uid": f"{kind.split('.')[-1]}_{uuid.uuid4().hex[:12]}", "paramMap": known, "defaultParamMap": usual, **more})

    def inner(tree: dict[int, kernel.Node]) -> list[tuple]:
        out: list[tuple] = []

        def add(at: int) -> int:
            node, number = tree[at], len(out)
            out.append(())
            below = (add(2 * at + 1), add(2 * at + 2)) if node.left is not None else (-1, -1)
            out[number] = (
                number, node.prediction, node.impurity, list(node.stats), int(node.stats[0]), node.gain, *below, _split(node, spec, codes)
            )
            return number

        add(0)
        return out

    of_tree = {
        "cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
        "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed",
    }
    of_model = of_tree | {
        "featureSubsetStrategy", "lossType", "maxIter", "probabilityCol", "rawPredictionCol", "stepSize", "subsamplingRate", "validationTol",
    }
    path = f"{checkpoint_dir(spark)}/boosted-{uuid.uuid4().hex}"
    head = about("classification.GBTClassificationModel", of_model, numFeatures=len(codes), numTrees=len(trees))
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    weights = [estimator.getStepSize() if i else 1.0 for i in range(len(trees))]
    heads = [(i, about("regression.DecisionTreeRegressionModel", of_tree), w) for i, w in enumerate(weights)]
    spark.createDataFrame(heads, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    rows = [(i, node) for i, tree in enumerate(trees) for node in inner(tree)]
    spark.createDataFrame(rows, _NODES).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


@dataclass
class Boosted:
    """The model of all rows and, of the fits that left a fold out, (fold, label, score) of its rows."""

    model: GBTClassificationModel
    held_out: DataFrame | None


def _in_one_task(spec: kernel.Spec, blocks: RDD) -> Iterator:
    """The nodes of all trees, then the rows left out as an RDD."""
    trees, *scores = blocks.coalesce(1).mapPartitions(functools.partial(kernel.all_grown, spec)).collect()
    yield trees
    yield blocks.context.parallelize(scores, 1)


def _in_many(spec: kernel.Spec, blocks: RDD) -> Iterator:
    """The same with a job for each level of each tree."""
    states, recent, trees = [blocks], [], []

    def add_up(grown: kernel.Trees, level: int):
        parts = states[-1].mapPartitionsWithIndex(functools.partial(kernel.histograms, spec, recent, grown, len(trees), level))
        if parts.getNumPartitions() > MOST_TO_DRIVER:
            return parts.treeReduce(operator.add)
        return functools.reduce(operator.add, parts.collect(), 0)

    try:
        for turn in range(spec.trees):
            if len(recent) == TREES_A_STATE:
                states.append(states[-1].map(functools.partial(kernel.moved_on, recent)).persist(StorageLevel.MEMORY_AND_DISK))
                recent = []
            grown, nodes = kernel.grown(spec, turn, add_up)
            recent = [*recent, grown]
            trees.append(nodes)
            while len(states) > 1:  # the first job has made the new margins from the old
                states.pop(0).unpersist()
        yield trees
        yield states[-1].flatMap(functools.partial(kernel.held_out_rows, spec, recent))
    finally:
        for state in states:
            state.unpersist()


def fit_boosted(estimator: GBTClassifier, rows: DataFrame, folds: int = 0) -> Boosted:
    """Fit on all ``rows`` (label, features) and, with ``folds``, also without each value of the column ``fold``.

    The steps are those of MLlib for the logistic loss: the first tree learns the outcome as -1 and 1, each further one the
    residuals of a share of the rows; a node chooses by variance from a share of the features, codes in the order of their mean. All
    fits draw the same rows for a tree.
    """
    spark = rows.sparkSession
    fold = F.col("fold").cast("int") if folds else F.lit(0)
    in_fold = {r["fold"]: r["count"] for r in rows.groupBy(fold.alias("fold")).count().collect()}
    for out in [*range(folds), -1]:
        if not sum(n for k, n in in_fold.items() if k != out):
            raise ValueError("the rows to learn from are empty" + f" without fold {out}" * (out >= 0))
    codes = _codes(rows)
    edges = [None if n else e for n, e in zip(codes, _edges(rows, codes, estimator.getMaxBins()))]
    sizes = [n or len(e) + 1 for n, e in zip(codes, edges)]
    spec = kernel.Spec(
        edges, sizes, [*range(folds), -1], estimator.getMaxIter(), estimator.getMaxDepth(), estimator.getStepSize(), estimator.getSubsamplingRate(),
        _chosen(estimator.getFeatureSubsetStrategy(), len(codes)), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain(), estimator.getSeed() % 2**63,
    )
    let_workers_import(spark)
    plain = rows.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"), fold.alias("fold"))
    made = plain.mapInArrow(functools.partial(kernel.to_blocks, spec), "block binary")
    blocks = made.rdd.map(lambda r: pickle.loads(r["block"])).persist(StorageLevel.MEMORY_AND_DISK)
    few = sum(in_fold.values()) * len(spec.held_out) <= ONE_TASK_ROWS
    learned = _in_one_task(spec, blocks) if few else _in_many(spec, blocks)
    scores = None
    try:
        trees = next(learned)
        if folds:
            schema, path = "fold int, label double, score double", f"{checkpoint_dir(spark)}/held-out-{uuid.uuid4().hex}"
            spark.createDataFrame(next(learned), schema).write.parquet(path)
            scores = spark.read.schema(schema).parquet(path)
    finally:
        learned.close()
        blocks.unpersist()
    return Boosted(_as_model(spark, estimator, spec, codes, [nodes[-1] for nodes in trees]), scores)
