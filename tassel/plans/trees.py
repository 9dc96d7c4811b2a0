"""Tree ensembles as tables: one row a node, and scoring by joining the levels."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of an ensemble and how its trees' answers become one.
KINDS = {
    RandomForestClassificationModel: "shares",  # class shares of the leaves, averaged
    RandomForestRegressionModel: "mean",  # leaf values, averaged
    GBTClassificationModel: "odds",  # weighted leaf values as half the log odds
    GBTRegressionModel: "sum",  # weighted leaf values, added
}
INNER_COLUMNS = ["tree", "node", "feature", "threshold", "codes", "n_codes", "left", "right"]


def export_trees(model: Model, folder: str, spark: SparkSession) -> DataFrame:
    """Writes the nodes of an ensemble and reads them back: tree, node; feature, the threshold up to which a number goes
    left or the codes (of n_codes) of a category that do, and the two children (all null for a leaf); value, shares (of
    classes), weight of the tree, kind, trees, levels.

    The nodes come from MLlib's own saved form, which stays beside the table.
    """
    kind = KINDS.get(type(model))
    if kind is None:
        raise TypeError(f"{type(model).__name__} is no ensemble of trees")
    model.save(f"{folder}/model")
    weights = spark.read.parquet(f"{folder}/model/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    data = spark.read.parquet(f"{folder}/model/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    leaf, coded = F.col("leftChild") < 0, F.col("split.numCategories") >= 0
    inner = lambda c: F.when(~leaf, c)
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    nodes = data.join(weights, "tree").select(
        "tree",
        F.col("id").alias("node"),
        inner(F.col("split.featureIndex")).alias("feature"),
        inner(F.when(~coded, F.get("split.leftCategoriesOrThreshold", F.lit(0)))).alias("threshold"),
        inner(F.when(coded, F.col("split.leftCategoriesOrThreshold"))).alias("codes"),
        inner(F.when(coded, F.col("split.numCategories"))).alias("n_codes"),
        inner(F.col("leftChild")).alias("left"),
        inner(F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"),
        F.when(F.lit(kind == "shares"), F.transform("impurityStats", lambda x: x / total)).alias("shares"),
        "weight",
        F.lit(kind).alias("kind"),
        F.lit(len(model.trees)).alias("trees"),
        F.lit(max(t.depth for t in model.trees)).alias("levels"),
    )
    nodes.write.parquet(f"{folder}/nodes")
    return read_trees(spark, folder)


def read_trees(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/nodes")


def score_trees(nodes: DataFrame, rows: DataFrame, key: str, features: Column | str = "features") -> DataFrame:
    """``key``, score and, for a classifier, shares of all classes and prediction, from the table of nodes.

    ``rows`` has one row a key and its features as a vector. Each row starts at the root of every tree; each level is an
    equi-join on tree and node that moves to a child or, at a leaf, stays. The leaves' answers are added up by key, first
    within tasks. The nodes are a table of known size (two for each leaf at most), so Spark chooses how to join it.
    """
    first = nodes.select("kind", "trees", "levels", F.size("shares").alias("classes")).first()
    at = rows.select(F.col(key).alias("_key"), vector_to_array(features).alias("_x"))
    at = at.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(first["trees"] - 1)))).withColumn("_node", F.lit(0))
    moves = nodes.select(*INNER_COLUMNS)
    here = (F.col("_tree") == F.col("tree")) & (F.col("_node") == F.col("node"))
    for _ in range(first["levels"]):
        value = F.get("_x", F.col("feature"))
        # of the codes MLlib keeps the smaller side, so one beyond all codes goes with the larger
        among = F.array_contains("codes", value) | ((value >= F.col("n_codes")) & (F.size("codes") * 2 > F.col("n_codes")))
        goes_left = F.when(F.col("codes").isNotNull(), among).otherwise(value <= F.col("threshold"))
        step = F.coalesce(F.when(goes_left, F.col("left")).otherwise(F.col("right")), F.col("_node"))
        at = at.join(moves, here).withColumn("_node", step).drop(*INNER_COLUMNS)
    leaves = at.join(nodes.select("tree", "node", "value", "shares", "weight"), here)
    classes = range(first["classes"] if first["kind"] == "shares" else 0)
    summed = leaves.groupBy("_key").agg(
        F.sum("value").alias("_sum"),
        F.sum(F.col("weight") * F.col("value")).alias("_weighted"),
        *[F.sum(F.get("shares", F.lit(c))).alias(f"_s{c}") for c in classes],
    )
    named = summed.withColumnRenamed("_key", key)
    if first["kind"] == "shares":
        shares = F.array(*[F.col(f"_s{c}") / first["trees"] for c in classes])
        out = named.withColumn("shares", shares).withColumn("score", F.get("shares", F.lit(1)))
        best = F.array_position("shares", F.array_max("shares")) - 1
        return out.select(key, "score", "shares", best.cast("int").alias("prediction"))
    if first["kind"] == "odds":
        score = 1 / (1 + F.exp(-2 * F.col("_weighted")))
        out = named.withColumn("score", score).withColumn("shares", F.array(1 - F.col("score"), F.col("score")))
        return out.select(key, "score", "shares", (F.col("_weighted") > 0).cast("int").alias("prediction"))
    return named.select(key, (F.col("_sum") / first["trees"] if first["kind"] == "mean" else F.col("_weighted")).alias("score"))
