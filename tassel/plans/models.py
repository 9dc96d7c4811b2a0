"""Training and applying the prediction models with MLlib."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import (
    binary_metrics,
    class_weights,
    exact_quantiles,
    multiclass_metrics,
    random_split,
    regression_metrics,
    roc_auc,
    stratified_folds,
    stratified_split,
)
from ..operators.scored import with_scores, with_targets
from ..session import checkpoint_dir
from .boosting import fit_boosted

# Features of each model. Columns that give the target away are left out.
DEMOGRAPHIC = ["student_age", "race", "ethnicity", "gender", "first_gen", "pell_status_first_year"]
PREPARATION = ["math_placement", "english_placement", "reading_placement", "credential_type_sought_year_1"]
ENROLLMENT = ["enrollment_type", "enrollment_intensity_first_term", "cohort_term"]
BACKGROUND = DEMOGRAPHIC + PREPARATION + ENROLLMENT
RETENTION_FEATURES = [
    *BACKGROUND,
    "total_credits_attempted", "total_credits_earned", "course_completion_rate", "average_grade",
    "gateway_math_courses", "gateway_english_courses",
    "gpa_group_year_1", "number_of_credits_earned_year_1", "completedgatewaymathyear1",
    "completedgatewayenglishyear1",
]
GATEWAY_MATH_FEATURES = [
    *BACKGROUND, "total_credits_attempted", "gateway_english_courses", "number_of_credits_earned_year_1",
]
GATEWAY_ENGLISH_FEATURES = [
    *BACKGROUND, "total_credits_attempted", "gateway_math_courses", "number_of_credits_earned_year_1",
]
LOW_GPA_FEATURES = [
    *BACKGROUND,
    "total_credits_attempted", "gateway_math_courses", "gateway_english_courses",
    "number_of_credits_earned_year_1", "completedgatewaymathyear1", "completedgatewayenglishyear1",
]

KEY = "student_guid"


def _kinds(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return [c for c in features if c not in text], [c for c in features if c in text]


@dataclass
class Preprocessor:
    """Medians and label codes learned once on one table, for all models and any other table."""

    numeric: list[str]
    text: list[str]
    medians: dict[str, float]
    codes: StringIndexerModel | None

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Preprocessor:
        """Learn the given columns; several models share one fit on the columns of them all."""
        names = list(dict.fromkeys(columns))
        numeric, text = _kinds(df, names)
        # one number per column reaches the driver
        medians = {r["column"]: r["q0"] for r in exact_quantiles(df, numeric, [0.5]).collect()} if numeric else {}
        medians = {c: medians.get(c, 0.0) for c in numeric}
        codes = None
        if text:
            # one indexer for all text columns: their values are counted in a single job
            indexer = StringIndexer(
                inputCols=[f"{c}__text" for c in text],
                outputCols=[f"{c}__code" for c in text],
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
            codes = indexer.fit(cls._filled(df, [], text, {}))
        return cls(numeric, text, medians, codes)

    @staticmethod
    def _filled(df: DataFrame, numeric: list[str], text: list[str], medians: dict[str, float]) -> DataFrame:
        known = {
            f"{c}__number": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(medians[c])) for c in numeric
        }
        return df.withColumns({**known, **{f"{c}__text": F.coalesce(c, F.lit("Unknown")) for c in text}})

    def encode(self, df: DataFrame) -> DataFrame:
        """Adds a number for every learned column, beside the columns themselves."""
        filled = self._filled(df, self.numeric, self.text, self.medians)
        return self.codes.transform(filled).drop(*[f"{c}__text" for c in self.text]) if self.codes else filled

    def assemble(self, encoded: DataFrame, features: list[str], output: str = "features") -> DataFrame:
        columns = [f"{c}__code" if c in self.text else f"{c}__number" for c in features]
        return VectorAssembler(inputCols=columns, outputCol=output).transform(encoded)

    def transform(self, df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
        needed = dict.fromkeys([*keep, *self.numeric, *self.text])
        return self.assemble(self.encode(df.select(*needed)), features).select(*keep, "features")


# Estimator settings.
def logistic(n_rows: int) -> LogisticRegression:
    """L2 with C = 0.1: the summed-loss penalty becomes 1 / (C x rows) on MLlib's mean loss."""
    return LogisticRegression(maxIter=1000, regParam=1.0 / (0.1 * max(1, n_rows)), elasticNetParam=0.0)


def simple_forest(seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=50, maxDepth=4, minInstancesPerNode=20, seed=seed)


def boosted_trees(seed: int = 42) -> GBTClassifier:
    return GBTClassifier(
        maxIter=100, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
        checkpointInterval=20,
    )


def _fit(estimator: Estimator, rows: DataFrame) -> Model:
    return fit_boosted(estimator, rows).model if isinstance(estimator, GBTClassifier) else estimator.fit(rows)


def _scored(model: Model, rows: DataFrame) -> DataFrame:
    """Adds ``score`` (probability of class 1) and integer ``prediction``."""
    out = model.transform(rows)
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn(
        "prediction", F.col("prediction").cast("int")
    )


@dataclass
class Trained:
    name: str
    pre: Preprocessor | None
    model: Model | None
    features: list[str] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)
    comparison: list[dict] = field(default_factory=list)
    importances: list[tuple[str, float]] = field(default_factory=list)


def _first(df: DataFrame) -> dict[str, float]:
    return df.first().asDict()


def _importances(features: list[str], model: Model) -> list[tuple[str, float]]:
    if not hasattr(model, "featureImportances"):
        return []
    return sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda x: -x[1])


#: Rows that are worth a task of their own in one pass of a trainer, and rows that a task gets at most.
TASK_ROWS, MOST_TASK_ROWS = 10_000, 250_000


def _tasks(n_rows: int, cores: int) -> int:
    """One task a core if there are rows enough for it, more only where a task would get too many rows."""
    return max(1, min(cores, math.ceil(n_rows / TASK_ROWS)), math.ceil(n_rows / MOST_TASK_ROWS))


@contextmanager
def _for_passes(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` kept in as few parts as they need.

    A trainer passes over its rows hundreds of times, and a pass costs a task a part: in the parts of the last shuffle
    (hundreds, mostly empty on a small table) the tasks' own cost would be nearly all there is. Which rows come is not
    changed. They are written and read back: each job of a trainer walks through all that its rows come from, and the
    steps behind a persisted table stay in that walk.
    """
    shuffled = rows.persist()
    try:
        path = f"{checkpoint_dir(rows.sparkSession)}/passes-{uuid.uuid4().hex}"
        n_tasks = _tasks(shuffled.count(), rows.sparkSession.sparkContext.defaultParallelism)
        shuffled.repartition(n_tasks).write.parquet(path)
    finally:
        shuffled.unpersist()
    dealt = rows.sparkSession.read.schema(rows.schema).parquet(path).persist()
    try:
        yield dealt
    finally:
        dealt.unpersist()


#: Fits that are run side by side at most.
MOST_FITS = 4


def _fits_at_once(n_rows: int, cores: int) -> int:
    """As many fits as the cores hold tasks of one pass for; one after the other where a pass fills them."""
    return max(1, min(MOST_FITS, cores // _tasks(n_rows, cores)))


def _side_by_side(fits: list[Callable], rows: DataFrame) -> list:
    """What each of the fits on ``rows`` gives, in their order.

    On few rows a fit waits for its hundreds of short jobs and leaves most cores idle.
    """
    at_once = _fits_at_once(rows.count(), rows.sparkSession.sparkContext.defaultParallelism)
    with ThreadPoolExecutor(at_once) as pool:
        waiting = [pool.submit(inheritable_thread_target(rows.sparkSession)(fit)) for fit in fits]
        return [w.result() for w in waiting]


def _with_checkpoints(df: DataFrame) -> DataFrame:
    """Boosting cuts its lineage now and then, in the folder the cluster names."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df


def feature_importance_top(trained: Trained, k: int = 10) -> list[tuple[str, float]]:
    return trained.importances[:k]


def train_classifier(
    students: DataFrame,
    name: str,
    target: str,
    features: list[str],
    estimator: Estimator | None = None,
    pre: Preprocessor | None = None,
) -> Trained:
    """Preprocess, split 80/20 within classes, fit, measure on the held-out rows."""
    pre = pre or Preprocessor.fit(students, features)
    known = _with_checkpoints(students).filter(F.col(target).isNotNull()).withColumn("label", F.col(target))
    with _for_passes(stratified_split(pre.transform(known, [KEY, "label"], features), KEY, "label")) as split:
        model = _fit(estimator or boosted_trees(), split.filter("not is_test"))
        metrics = _first(binary_metrics(_scored(model, split.filter("is_test"))))
    return Trained(name, pre, model, features, metrics, importances=_importances(features, model))


def compare_models(
    students: DataFrame,
    target: str = "target_retention",
    features: list[str] | None = None,
    folds: int = 5,
    parallelism: int = 5,
    candidates: list[str] | None = None,
    pre: Preprocessor | None = None,
) -> Trained:
    """Three candidates (or those named) by cross-validated ROC AUC; the best is kept, with the comparison.

    Each row of the comparison has cv_auc, cv_std, train_auc, test_auc, gap and a verdict.
    """
    names = features or RETENTION_FEATURES
    pre = pre or Preprocessor.fit(students, names)
    known = _with_checkpoints(students).filter(F.col(target).isNotNull()).withColumn("label", F.col(target))
    with ExitStack() as kept:
        split = kept.enter_context(_for_passes(stratified_split(pre.transform(known, [KEY, "label"], names), KEY, "label")))
        train, test = split.filter("not is_test"), split.filter("is_test")
        dealt = kept.enter_context(_for_passes(stratified_folds(train, KEY, "label", folds)))
        estimators = {
            "Logistic Regression": logistic(train.count()),
            "Random Forest (Simple)": simple_forest(),
            "Boosted Trees (Regularized)": boosted_trees(),
        }
        chosen = [name for name in estimators if not candidates or name in candidates]

        def validated(estimator: Estimator) -> tuple[Model, float, float]:
            """The fit on all rows, with the mean and deviation of the ROC AUC of the folds."""
            if isinstance(estimator, GBTClassifier):
                boosted = fit_boosted(estimator, dealt, folds)
                evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC", rawPredictionCol="score")
                held_out = [boosted.held_out.filter(F.col("fold") == i) for i in range(folds)]
                for i, rows in enumerate(held_out):
                    if rows.isEmpty():
                        raise ValueError(f"The validation data at fold {i} is empty.")
                aucs = [evaluator.evaluate(rows) for rows in held_out]
                return boosted.model, float(np.mean(aucs)), float(np.std(aucs))
            cv = CrossValidator(
                estimator=estimator,
                estimatorParamMaps=ParamGridBuilder().build(),
                evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"),
                numFolds=folds,
                foldCol="fold",
                parallelism=parallelism,
            ).fit(dealt)
            return cv.bestModel, float(cv.avgMetrics[0]), float(cv.stdMetrics[0])

        def measured(name: str) -> tuple[dict, Model]:
            model, cv_auc, cv_std = validated(estimators[name])
            train_auc = roc_auc(_scored(model, train)).first()["auc_roc"]
            test_auc = roc_auc(_scored(model, test)).first()["auc_roc"]
            gap = train_auc - test_auc
            verdict = "no overfitting" if gap < 0.05 else "minimal overfitting" if gap < 0.10 else "overfitting"
            return {
                "model": name, "cv_auc": cv_auc, "cv_std": cv_std, "train_auc": train_auc,
                "test_auc": test_auc, "gap": gap, "verdict": verdict,
            }, model

        table, best = [], None
        fits = [lambda name=name: measured(name) for name in chosen]
        for name, (row, model) in zip(chosen, _side_by_side(fits, dealt)):
            table.append(row)
            if best is None or row["cv_auc"] > best[0]:
                best = (row["cv_auc"], name, model)
        metrics = _first(binary_metrics(_scored(best[2], test)))
    return Trained(best[1], pre, best[2], names, metrics, table, _importances(names, best[2]))


def train_regressor(
    students: DataFrame,
    name: str,
    target: str,
    features: list[str],
    estimator: RandomForestRegressor,
    minimum: int = 0,
    pre: Preprocessor | None = None,
) -> Trained:
    """Fit on rows with a target; without more than ``minimum`` rows there is no model, and its name says so."""
    # the target of one model may be a feature of another, so it is copied first
    usable = students.filter(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double"))
    if usable.count() <= minimum:
        return Trained(f"{name} (no model: {minimum} rows or fewer)", None, None, features)
    pre = pre or Preprocessor.fit(students, features)
    with _for_passes(random_split(pre.transform(usable, [KEY, "label"], features), KEY)) as split:
        model = estimator.fit(split.filter("not is_test"))
        metrics = _first(regression_metrics(model.transform(split.filter("is_test"))))
    return Trained(name, pre, model, features, metrics, importances=_importances(features, model))


def train_time_to_credential(students: DataFrame, minimum: int = 100, pre: Preprocessor | None = None) -> Trained:
    """Only completers (0 < years < 99), and only with more than ``minimum`` of them."""
    done = (F.col("target_time_to_credential") > 0) & (F.col("target_time_to_credential") < 99)
    rows = students.withColumn("_time", F.when(done, F.col("target_time_to_credential")))
    forest = RandomForestRegressor(numTrees=50, maxDepth=4, seed=42)
    return train_regressor(rows, "Time-to-Credential", "_time", RETENTION_FEATURES, forest, minimum, pre)


def train_gpa(students: DataFrame, pre: Preprocessor | None = None) -> Trained:
    forest = RandomForestRegressor(numTrees=100, maxDepth=8, minInstancesPerNode=5, seed=42)
    return train_regressor(students, "GPA", "average_grade", RETENTION_FEATURES, forest, pre=pre)


def train_credential_type(students: DataFrame, balanced: bool = True, pre: Preprocessor | None = None) -> Trained:
    """Four classes; balanced class weights unless told otherwise."""
    target = "target_credential_type"
    pre = pre or Preprocessor.fit(students, RETENTION_FEATURES)
    known = students.filter(F.col(target).isNotNull()).withColumn("label", F.col(target))
    split = stratified_split(pre.transform(known, [KEY, "label"], RETENTION_FEATURES), KEY, "label")
    forest = RandomForestClassifier(numTrees=50, maxDepth=5, seed=42)
    if balanced:
        weights = class_weights(split.filter("not is_test"), "label").select(F.col("label").alias("_l"), "weight")
        # one row per class
        split = split.join(F.broadcast(weights), F.col("label") == F.col("_l"), "left").drop("_l")
        forest = forest.setWeightCol("weight")
        split = split.fillna({"weight": 1.0})
    with _for_passes(split) as rows:
        model = forest.fit(rows.filter("not is_test"))
        held = model.transform(rows.filter("is_test")).withColumn("prediction", F.col("prediction").cast("int"))
        metrics = _first(multiclass_metrics(held))
    return Trained("Credential Type", pre, model, RETENTION_FEATURES, metrics, importances=_importances(RETENTION_FEATURES, model))


@dataclass
class ModelSet:
    retention: Trained
    time_to_credential: Trained
    credential: Trained
    gateway_math: Trained
    gateway_english: Trained
    low_gpa: Trained
    gpa: Trained

    def all(self) -> list[Trained]:
        return list(vars(self).values())


def train_all(student_table: DataFrame, compare: bool = True) -> ModelSet:
    """Every model from one student table with course features; medians and codes are learned once for all.

    Without ``compare`` the retention model is the simple forest instead of the best of three.
    """
    rows = _with_checkpoints(with_targets(student_table)).persist()
    every = [*RETENTION_FEATURES, *GATEWAY_MATH_FEATURES, *GATEWAY_ENGLISH_FEATURES, *LOW_GPA_FEATURES]
    try:
        pre = Preprocessor.fit(rows, every)

        def retention() -> Trained:
            if compare:
                return compare_models(rows, pre=pre)
            return train_classifier(rows, "Retention", "target_retention", RETENTION_FEATURES, simple_forest(), pre)

        fits = {
            "retention": retention,
            "gateway_math": lambda: train_gateway_math(rows, pre),
            "gateway_english": lambda: train_gateway_english(rows, pre),
            "low_gpa": lambda: train_low_gpa(rows, pre),
            "time_to_credential": lambda: train_time_to_credential(rows, pre=pre),
            "credential": lambda: train_credential_type(rows, pre=pre),
            "gpa": lambda: train_gpa(rows, pre=pre),
        }
        return ModelSet(**dict(zip(fits, _side_by_side(list(fits.values()), rows))))
    finally:
        rows.unpersist()


def train_gateway_math(students: DataFrame, pre: Preprocessor | None = None) -> Trained:
    return train_classifier(students, "Gateway Math", "target_gateway_math", GATEWAY_MATH_FEATURES, pre=pre)


def train_gateway_english(students: DataFrame, pre: Preprocessor | None = None) -> Trained:
    return train_classifier(students, "Gateway English", "target_gateway_english", GATEWAY_ENGLISH_FEATURES, pre=pre)


def train_low_gpa(students: DataFrame, pre: Preprocessor | None = None) -> Trained:
    return train_classifier(students, "Low GPA", "target_low_gpa", LOW_GPA_FEATURES, pre=pre)


def apply_model(trained: Trained, rows: DataFrame) -> DataFrame:
    """``rows`` with what the model predicts: ``prediction`` and, from classifiers, ``probability``."""
    if trained.model is None:
        return rows.withColumn("prediction", F.lit(None).cast("double"))
    extra = [f"{c}__number" for c in trained.pre.numeric] + [f"{c}__code" for c in trained.pre.text]
    assembled = trained.pre.assemble(trained.pre.encode(rows), trained.features).drop(*extra)
    return trained.model.transform(assembled).drop("features", "rawPrediction")


CLASS_COLUMNS = ["prob_no_credential", "prob_certificate", "prob_associate", "prob_bachelor"]


def score_all(student_table: DataFrame, models: ModelSet) -> DataFrame:
    """The student table with every prediction column.

    The features are filled and encoded once; models run one after the other on the same rows, each adding
    columns. There is no join and no shuffle beyond the input's own.
    """
    made = set(CLASS_COLUMNS) | {
        "retention_probability", "retention_prediction", "gateway_math_probability", "gateway_math_prediction",
        "gateway_english_probability", "gateway_english_prediction", "low_gpa_probability", "low_gpa_prediction",
        "predicted_time_to_credential", "predicted_credential_type", "predicted_gpa",
    }
    original = [c for c in student_table.columns if c not in made]
    out, encoders = student_table.select(*original), []

    def run(trained: Trained, columns: dict) -> None:
        nonlocal out
        if trained.model is None:
            out = out.withColumns({name: F.lit(None).cast("double") for name in columns})
            return
        if trained.pre not in encoders:  # models that share a preprocessor share its columns
            kept = [c for c in out.columns if not c.endswith(("__number", "__code"))]
            encoders[:] = [trained.pre]
            out = trained.pre.encode(out.select(*kept))
        applied = trained.model.transform(trained.pre.assemble(out, trained.features))
        out = applied.select(*out.columns, *[e.alias(n) for n, e in columns.items()])

    def binary(prefix: str) -> dict:
        return {
            f"{prefix}_probability": vector_to_array("probability")[1],
            f"{prefix}_prediction": F.col("prediction").cast("int"),
        }

    run(models.retention, binary("retention"))
    run(models.gateway_math, binary("gateway_math"))
    run(models.gateway_english, binary("gateway_english"))
    run(models.low_gpa, binary("low_gpa"))
    run(models.time_to_credential, {"predicted_time_to_credential": F.col("prediction")})
    run(models.gpa, {"predicted_gpa": F.col("prediction")})
    classes = models.credential.model.numClasses
    chances = vector_to_array("probability")
    run(
        models.credential,
        {
            "predicted_credential_type": F.col("prediction").cast("int"),
            # a class that never occurred gets probability 0
            **{c: (chances[i] if i < classes else F.lit(0.0)) for i, c in enumerate(CLASS_COLUMNS)},
        },
    )
    return with_scores(out.drop(*[c for c in out.columns if c.endswith(("__number", "__code"))]))
