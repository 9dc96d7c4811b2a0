"""Splits, class weights and model metrics as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import exact_quantiles, hash_row_numbers, running_totals


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: str = "") -> DataFrame:
    """Adds ``is_test``: the first share of every class in hash order."""
    numbered = hash_row_numbers(df, key, [label], seed)
    return numbered.withColumn("is_test", F.col("row_no") <= F.bround(F.col("row_total") * test_share)).drop(
        "row_no", "row_total"
    )


def random_split(df: DataFrame, key: str, test_share: float = 0.2, seed: str = "") -> DataFrame:
    numbered = hash_row_numbers(df, key, None, seed)
    return numbered.withColumn("is_test", F.col("row_no") <= F.bround(F.col("row_total") * test_share)).drop(
        "row_no", "row_total"
    )


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: str = "") -> DataFrame:
    """Adds ``fold`` 0..folds-1, dealt round-robin within each class in hash order."""
    numbered = hash_row_numbers(df, key, [label], seed)
    return numbered.withColumn("fold", ((F.col("row_no") - 1) % folds).cast("int")).drop("row_no", "row_total")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes x rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"), F.lit(1).alias("one"))
    return (
        counts.withColumn("one", F.lit(1))
        .join(F.broadcast(total), "one")
        .select(label, "n", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))
    )


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """2x2 counts with empty cells kept."""
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    one = pred.agg(*[F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"n{a}{p}") for a, p in cells])
    grid = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("count"))
            for a, p in cells
        ]
    )
    return one.select(F.explode(grid).alias("x")).select("x.*")


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve with tied scores averaged; null when a class is missing."""
    counts = (
        pred.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("s"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    # every column that running_totals adds is read below, so all its uses of ``counts`` are the same and share
    # one scan and one shuffle
    placed = running_totals(counts, "s", ["neg", "pos"])
    # pairs won by a positive: negatives strictly below, plus half of those tied
    won = F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)
    def total(c: str) -> Column:
        return F.max(F.greatest(f"all_{c}", f"cum_{c}")).cast("double")

    pairs = total("pos") * total("neg")
    return placed.agg(F.try_divide(F.sum(won), pairs).alias("auc_roc"))


def binary_metrics(
    pred: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score"
) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when undefined) and ROC AUC in one row."""
    y, p = F.col(label), F.col(prediction)
    counts = pred.filter(y.isNotNull()).agg(
        F.count("*").alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if(y == p).alias("right"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp = F.col("tp")
    rates = counts.select(
        "n",
        share(F.col("right"), F.col("n")).alias("accuracy"),
        share(tp, tp + F.col("fp")).alias("precision"),
        share(tp, tp + F.col("fn")).alias("recall"),
        share(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"),
    )
    return rates.crossJoin(F.broadcast(roc_auc(pred, label, score)))  # one row beside one row


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and R squared.

    The squared deviations come from the variance aggregate, which is stable for large means.
    """
    y, error = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    return pred.filter(y.isNotNull() & F.col(prediction).isNotNull()).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count("*"))).alias("r2"),
    )


def class_accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows and share predicted right, per actual class."""
    return pred.groupBy(F.col(label).alias("class")).agg(
        F.count("*").alias("n"), F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy")
    )


def multiclass_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and the unweighted mean F1 over all classes that are actual or predicted."""
    cells = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    per_class = (
        cells.select(
            F.explode(
                F.array(
                    F.struct(F.col("y").alias("c"), F.lit(1).alias("is_actual")),
                    F.struct(F.col("p").alias("c"), F.lit(0).alias("is_actual")),
                )
            ).alias("x"),
            "n",
            (F.col("y") == F.col("p")).alias("hit"),
        )
        .groupBy("x.c")
        .agg(
            F.sum(F.when(F.col("x.is_actual") == 1, F.col("n")).otherwise(0)).alias("actual"),
            F.sum(F.when(F.col("x.is_actual") == 0, F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(F.col("hit") & (F.col("x.is_actual") == 1), F.col("n")).otherwise(0)).alias("hits"),
        )
    )
    return per_class.agg(
        F.sum("actual").alias("n"),
        (F.sum("hits") / F.sum("actual")).alias("accuracy"),
        F.avg(2 * F.col("hits") / (F.col("actual") + F.col("predicted"))).alias("macro_f1"),
    )


def fill_missing(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Numeric nulls take the column's exact median, text nulls the word Unknown."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in text})
    if not numeric:
        return filled
    # one row: the medians side by side
    medians = (
        exact_quantiles(df, numeric, [0.5])
        .groupBy(F.lit(1).alias("_one"))
        .agg(*[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(f"_median_{c}") for c in numeric])
    )
    joined = filled.withColumn("_one", F.lit(1)).join(F.broadcast(medians), "_one", "left")
    clean = {
        c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.col(f"_median_{c}"))
        for c in numeric
    }
    return joined.withColumns(clean).drop("_one", *[f"_median_{c}" for c in numeric])


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Alphabetical code 0.. for every value of a text column, however many.

    Values are numbered among those with the same first two characters; the sizes of these ranges, a small table,
    say how many values come before.
    """
    from pyspark.sql import Window

    values = df.select(F.col(column).alias("value")).distinct().withColumn("_range", F.substring("value", 1, 2))
    sizes = values.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = values.join(offsets, F.col("_range").eqNullSafe(F.col("_r")))
    inside = Window.partitionBy("_range").orderBy("value")
    return joined.select("value", (F.row_number().over(inside) - 1 + F.col("_before")).cast("int").alias("code"))
