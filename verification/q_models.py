"""Splits, preprocessing, metrics and model training."""

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tassel.operators import evaluate, ranks, scored, students
from tassel.plans import logistic, models, scoring_run, trees
from tassel.session import checkpoint_dir
from tassel.sources import sinks, star

from .base_sql import pct, with_ctes
from .registry import register
from .tables import enrollments, scored_rows, student_rows


def targets(s, d):
    return scored.with_targets(student_rows(s, d)).select("student_guid", "target_retention")


_T = "t AS (SELECT student_guid, coalesce(retention,0) AS target_retention FROM cohort_rows)"


def _with_t(body):
    return with_ctes(["cohort_rows"], "@@").replace("\n@@", f",\n{_T}\n{body}")


register(
    "stratified_split",
    lambda s, d: evaluate.stratified_split(targets(s, d), "student_guid", "target_retention"),
    _with_t(
        """SELECT student_guid, target_retention, row_number() OVER (PARTITION BY target_retention ORDER BY md5(student_guid), student_guid)
 <= round_even(count(*) OVER (PARTITION BY target_retention)*0.2::DOUBLE, 0) AS is_test FROM t"""
    ),
)
register(
    "random_split",
    lambda s, d: evaluate.random_split(targets(s, d), "student_guid", seed="7"),
    _with_t(
        """SELECT student_guid, target_retention, row_number() OVER (ORDER BY md5('7' || student_guid), student_guid)
 <= round_even(count(*) OVER ()*0.2::DOUBLE, 0) AS is_test FROM t"""
    ),
)
register(
    "stratified_folds",
    lambda s, d: evaluate.stratified_folds(targets(s, d), "student_guid", "target_retention"),
    _with_t(
        """SELECT student_guid, target_retention, CAST((row_number() OVER (PARTITION BY target_retention ORDER BY md5(student_guid), student_guid)-1)%5 AS INT) AS fold FROM t"""
    ),
)
register(
    "split_line_items",
    lambda s, d: evaluate.stratified_split(
        star.table(s, d, "events").select("event_id", "event_type"), "event_id", "event_type", 0.3
    )
    .groupBy("event_type", "is_test")
    .agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")),
    """SELECT event_type, is_test, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, event_type,
 row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= round_even(count(*) OVER (PARTITION BY event_type)*0.3::DOUBLE,0) AS is_test FROM events)
GROUP BY 1,2""",
)
register(
    "class_weights",
    lambda s, d: evaluate.class_weights(scored.with_targets(student_rows(s, d)), "target_credential_type").withColumn(
        "weight", F.round("weight", 6)
    ),
    with_ctes(
        ["cohort_rows"],
        """SELECT target_credential_type, n, round(sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE), 6) AS weight FROM (
 SELECT CASE WHEN y_bach>0 OR y_other>0 THEN 3 WHEN y_assoc>0 THEN 2 WHEN y_cert>0 THEN 1
  WHEN y_either>0 THEN CASE WHEN credential_type_sought_year_1 IN ('01','02','03','C1','C2') THEN 1 ELSE 2 END
  WHEN credential_type_sought_year_1 IN ('01','02','03','C1','C2') THEN 1
  WHEN credential_type_sought_year_1='A' THEN 2 WHEN credential_type_sought_year_1='B' THEN 3 ELSE 0 END AS target_credential_type, count(*) AS n FROM cohort_rows GROUP BY 1)""",
    ),
)
_NUMERIC = ["gpa_group_year_1", "number_of_credits_earned_year_1", "average_grade", "number_of_credits_earned_year_4"]
_TEXT = ["enrollment_intensity_first_term", "completedgatewaymathyear1", "race"]
register(
    "fill_missing",
    lambda s, d: evaluate.fill_missing(student_rows(s, d).select("student_guid", *_NUMERIC, *_TEXT), _NUMERIC, _TEXT).withColumns(
        {c: F.round(c, 6) for c in _NUMERIC}
    ),
    with_ctes(
        ["stu"],
        "SELECT student_guid, "
        + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM stu)),6) AS {c}" for c in _NUMERIC)
        + ", "
        + ", ".join(f"coalesce({c},'Unknown') AS {c}" for c in _TEXT)
        + " FROM stu",
    ),
)
register(
    "label_codes",
    lambda s, d: evaluate.label_codes(star.students(s, d), "first_gen"),
    with_ctes(
        ["cohort_rows"],
        "SELECT value, CAST(row_number() OVER (ORDER BY value)-1 AS INT) AS code FROM (SELECT DISTINCT first_gen AS value FROM cohort_rows)",
    ),
)
register(
    "exact_quantiles",
    lambda s, d: ranks.exact_quantiles(
        star.table(s, d, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"], [0.0, 0.1, 0.5, 0.99, 1.0]
    ).select("column", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(5)]),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + ", ".join(f"round(quantile_cont({c},{q}),6) AS q{i}" for i, q in enumerate((0, 0.1, 0.5, 0.99, 1))) + " FROM lineitem"
        for c in ("l_extendedprice", "l_quantity", "l_discount")
    ),
)


def judged(s, d):
    """Retention outcome against the stand-in probability."""
    return scored_rows(s, d).selectExpr(
        "student_guid", "coalesce(retention, 0) as label", "retention_prediction as prediction", "retention_probability as score"
    )


_J = "j AS (SELECT coalesce(retention,0) AS y, retention_prediction AS p, retention_probability AS s FROM cohort_rows)"
_AUC = """(SELECT sum(CASE WHEN y=1 THEN r END - 0.5 - 0) FROM j2)"""
register(
    "binary_metrics",
    lambda s, d: evaluate.binary_metrics(judged(s, d)).select(
        "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc_roc")]
    ),
    with_ctes(["cohort_rows"], "@@").replace(
        "\n@@",
        f""",
{_J}, j2 AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1)/2.0::DOUBLE AS r FROM j),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE y=1 AND p=1) AS tp, count(*) FILTER (WHERE y=0 AND p=1) AS fp,
  count(*) FILTER (WHERE y=1 AND p=0) AS fn, count(*) FILTER (WHERE y=p) AS ok, count(*) FILTER (WHERE y=1) AS np, count(*) FILTER (WHERE y=0) AS nn,
  sum(r) FILTER (WHERE y=1) AS rs FROM j2)
SELECT n, round(ok/CAST(n AS DOUBLE),6) AS accuracy, round(tp/CAST(tp+fp AS DOUBLE),6) AS precision, round(tp/CAST(tp+fn AS DOUBLE),6) AS recall,
 round(2*tp/CAST(2*tp+fp+fn AS DOUBLE),6) AS f1, round((rs - np*(np+1)/2.0::DOUBLE)/(CAST(np AS DOUBLE)*nn),6) AS auc_roc FROM c""",
    ),
)
register(
    "roc_auc_line_items",
    lambda s, d: evaluate.roc_auc(
        star.table(s, d, "lineitem").selectExpr("if(l_returnflag = 'R', 1, 0) as label", "l_extendedprice as score")
    ).select(F.round("auc_roc", 6).alias("auc_roc")),
    """SELECT round((sum(r) FILTER (WHERE y=1) - np*(np+1)/2.0::DOUBLE)/(CAST(np AS DOUBLE)*nn),6) AS auc_roc FROM (
 SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s)-1)/2.0::DOUBLE AS r, count(*) FILTER (WHERE y=1) OVER () AS np, count(*) FILTER (WHERE y=0) OVER () AS nn
 FROM (SELECT CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS y, l_extendedprice AS s FROM lineitem)) GROUP BY np, nn""",
)
register(
    "confusion",
    lambda s, d: evaluate.confusion(judged(s, d)),
    with_ctes(["cohort_rows"], "@@").replace(
        "\n@@",
        f""",
{_J} SELECT a AS actual, b AS predicted, (SELECT count(*) FROM j WHERE y=a AND p=b) AS count FROM (VALUES (0),(1)) x(a), (VALUES (0),(1)) z(b)""",
    ),
)
register(
    "regression_metrics",
    lambda s, d: evaluate.regression_metrics(
        scored_rows(s, d).selectExpr("average_grade as label", "predicted_gpa as prediction")
    ).select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")]),
    with_ctes(
        ["scored"],
        """SELECT count(*) AS n, round(sqrt(avg((average_grade-predicted_gpa)**2)),6) AS rmse, round(avg(abs(average_grade-predicted_gpa)),6) AS mae,
 round(1 - sum((average_grade-predicted_gpa)**2)/(var_pop(average_grade)*count(*)),6) AS r2 FROM scored WHERE average_grade IS NOT NULL""",
    ),
)


def classes(s, d):
    return scored.with_targets(student_rows(s, d)).selectExpr(
        "target_credential_type as label", "predicted_credential_type as prediction"
    )


_CLS = """y AS (SELECT CASE WHEN y_bach>0 OR y_other>0 THEN 3 WHEN y_assoc>0 THEN 2 WHEN y_cert>0 THEN 1
  WHEN y_either>0 THEN CASE WHEN credential_type_sought_year_1 IN ('01','02','03','C1','C2') THEN 1 ELSE 2 END
  WHEN credential_type_sought_year_1 IN ('01','02','03','C1','C2') THEN 1
  WHEN credential_type_sought_year_1='A' THEN 2 WHEN credential_type_sought_year_1='B' THEN 3 ELSE 0 END AS y, predicted_credential_type AS p FROM cohort_rows)"""
register(
    "class_accuracy",
    lambda s, d: evaluate.class_accuracy(classes(s, d)).withColumn("accuracy", F.round("accuracy", 6)),
    with_ctes(["cohort_rows"], "@@").replace(
        "\n@@",
        f",\n{_CLS} SELECT y AS class, count(*) AS n, round(avg(CASE WHEN y=p THEN 1.0 ELSE 0.0 END),6) AS accuracy FROM y GROUP BY 1",
    ),
)
register(
    "multiclass_metrics",
    lambda s, d: evaluate.multiclass_metrics(classes(s, d)).select(
        "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1")
    ),
    with_ctes(["cohort_rows"], "@@").replace(
        "\n@@",
        f""",
{_CLS}, k AS (SELECT y AS c FROM y UNION SELECT p FROM y),
f AS (SELECT c, 2*(SELECT count(*) FROM y WHERE y=c AND p=c)/CAST((SELECT count(*) FROM y WHERE y=c)+(SELECT count(*) FROM y WHERE p=c) AS DOUBLE) AS f1 FROM k)
SELECT (SELECT count(*) FROM y) AS n, round((SELECT avg(CASE WHEN y=p THEN 1.0 ELSE 0.0 END) FROM y),6) AS accuracy, round(avg(f1),6) AS macro_f1 FROM f""",
    ),
)
register(
    "summary_report",
    lambda s, d: scoring_run.summary_report(scored_rows(s, d)),
    with_ctes(["scored"], "@@").replace(
        "\n@@",
        "\n"
        + " UNION ALL ".join(
            f"""SELECT * FROM (SELECT '{r}' AS report, position, label, (SELECT count(*) FROM scored WHERE {c}=label) AS count,
 {pct(f'(SELECT count(*) FROM scored WHERE {c}=label)', '(SELECT count(*) FROM scored)')} AS percentage
 FROM (VALUES {', '.join(f"({i},'{x}')" for i, x in enumerate(o))}) v(position,label)) {'' if k else 'WHERE count>0'}"""
            for r, c, o, k in (
                ("retention", "retention_risk_category", ["Critical Risk", "High Risk", "Moderate Risk", "Low Risk"], True),
                ("alert", "at_risk_alert", ["URGENT", "HIGH", "MODERATE", "LOW"], True),
                ("credential", "predicted_credential_label", ["No Credential", "Certificate", "Associate", "Bachelor"], False),
                ("gateway_math", "gateway_math_risk", ["High Risk", "Moderate Risk", "Likely Pass", "Very Likely Pass"], False),
                ("gateway_english", "gateway_english_risk", ["High Risk", "Moderate Risk", "Likely Pass", "Very Likely Pass"], False),
                ("academic", "academic_risk_level", ["Low Risk", "Moderate Risk", "High Risk", "Critical Risk"], False),
                ("gpa", "gpa_performance", ["Above Expected", "As Expected", "Below Expected"], False),
            )
        ),
    ),
)

# ------------------------------------------------------------------ training
# What a model must satisfy whatever it learned: every student is scored, values are in range, labels follow from
# them, importances sum to 1 and measures are shares.


def training_table(s, d):
    """The students with targets, written once: training passes over them many times."""
    path = f"{checkpoint_dir(s)}/training-{uuid.uuid4().hex}"
    rows = scored.with_targets(student_rows(s, d))
    rows.write.parquet(path)
    return s.read.schema(rows.schema).parquet(path)


def _measures_hold(trained) -> bool:
    shares = [v for k, v in trained.metrics.items() if k not in ("n", "rmse", "mae", "r2") and v is not None]
    errors = [trained.metrics[k] for k in ("rmse", "mae") if k in trained.metrics]
    return bool(trained.metrics) and all(0 <= v <= 1 for v in shares) and all(v >= 0 for v in errors)


def _classified(s, d, train):
    """Each student's probability of class 1 is in range and the prediction follows from it."""
    rows = training_table(s, d)
    trained = train(rows)
    p = F.get(vector_to_array("probability"), 1)
    top = F.array_max(vector_to_array("probability"))
    chosen = F.get(vector_to_array("probability"), F.col("prediction").cast("int"))
    return models.apply_model(trained, rows.drop("probability", "prediction")).select(
        "student_guid",
        p.between(0, 1).alias("in_range"),
        (chosen == top).alias("follows"),
        F.lit(round(sum(v for _, v in trained.importances), 6)).alias("importances"),
        F.lit(_measures_hold(trained)).alias("measured"),
    )


def _regressed(s, d, train, target, low, high):
    """Each student's prediction lies between the least and the greatest value learned from."""
    rows = training_table(s, d)
    trained = train(rows)
    known = rows.filter(F.col(target).between(low, high)).agg(F.min(target).alias("_low"), F.max(target).alias("_high"))
    out = models.apply_model(trained, rows.drop("probability", "prediction")).crossJoin(F.broadcast(known))  # one row
    return out.select(
        "student_guid",
        F.col("prediction").between(F.col("_low") - 1e-9, F.col("_high") + 1e-9).alias("in_range"),
        F.lit(round(sum(v for _, v in trained.importances), 6)).alias("importances"),
        F.lit(_measures_hold(trained)).alias("measured"),
    )


_CLASSIFIED = with_ctes(
    ["cohort_rows"],
    "SELECT student_guid, true AS in_range, true AS follows, 1.0::DOUBLE AS importances, true AS measured FROM cohort_rows",
)
for _name, _train in (
    (
        "train_retention_forest",
        lambda rows: models.train_classifier(
            rows, "Retention", "target_retention", models.RETENTION_FEATURES, models.simple_forest()
        ),
    ),
    ("train_gateway_math", models.train_gateway_math),
    ("train_gateway_english", models.train_gateway_english),
    ("train_low_gpa", models.train_low_gpa),
    ("train_credential_type", models.train_credential_type),
):
    register(_name, lambda s, d, t=_train: _classified(s, d, t), _CLASSIFIED)
_REGRESSED = with_ctes(
    ["cohort_rows"],
    "SELECT student_guid, true AS in_range, 1.0::DOUBLE AS importances, true AS measured FROM cohort_rows",
)
register(
    "train_time_to_credential",
    lambda s, d: _regressed(
        s, d, lambda rows: models.train_time_to_credential(rows, minimum=0), "target_time_to_credential", 1e-9, 98.999
    ),
    _REGRESSED,
)
register("train_gpa", lambda s, d: _regressed(s, d, models.train_gpa, "average_grade", 0.0, 4.0), _REGRESSED)


def _compared(s, d, candidates=None):
    """Every candidate is measured, the measures are shares, and the verdict follows from the gap."""
    rows = s.createDataFrame(models.compare_models(training_table(s, d), candidates=candidates).comparison)
    gap = F.col("train_auc") - F.col("test_auc")
    verdict = F.when(gap < 0.05, "no overfitting").when(gap < 0.10, "minimal overfitting").otherwise("overfitting")
    shares = [F.col(c).between(0, 1) for c in ("cv_auc", "cv_std", "train_auc", "test_auc")]
    return rows.select(
        "model", (shares[0] & shares[1] & shares[2] & shares[3]).alias("in_range"), (F.col("verdict") == verdict).alias("follows")
    )


_TWO = ["Logistic Regression", "Random Forest (Simple)"]
_NAMED = "SELECT model, true AS in_range, true AS follows FROM (VALUES {0}) v(model) WHERE EXISTS (SELECT 1 FROM customer)"
register(
    "compare_logistic_and_forest",
    lambda s, d: _compared(s, d, _TWO),
    _NAMED.format(", ".join(f"('{x}')" for x in _TWO)),
)
register(
    "compare_models",
    _compared,
    _NAMED.format(", ".join(f"('{x}')" for x in [*_TWO, "Boosted Trees (Regularized)"])),
)


SCORED_LABELS = ["risk_score", "at_risk_alert", "retention_risk_category", "gateway_math_risk", "gateway_english_risk", "academic_risk_level"]


def _scoring_run(s, d):
    """Train every model with the comparison of all candidates, score every student, write all tables, read the
    predictions back: each probability is in range and each label follows from it."""
    out = f"{checkpoint_dir(s)}/run-{uuid.uuid4().hex}"
    cohort = star.students(s, d)
    cohort = cohort.drop(*[c for c in cohort.columns if "probability" in c or "predict" in c or c.startswith("prob_")])
    result = scoring_run.run(cohort, star.academic_records(s, d), enrollments(s, d), out)
    rows = sinks.read_table(s, f"{out}/student_predictions")
    chances = ["retention_probability", "gateway_math_probability", "gateway_english_probability", "low_gpa_probability"]
    in_range = F.lit(True)
    for c in [*chances, *models.CLASS_COLUMNS]:
        in_range = in_range & F.col(f"a.{c}").between(0, 1)
    again = scored.with_scores(rows.select(*[c for c in rows.columns if c not in SCORED_LABELS]))
    labels = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in SCORED_LABELS if c in rows.columns]
    follows = F.lit(True)
    for test in labels:
        follows = follows & test
    both = rows.alias("a").join(again.alias("b"), "student_guid")
    return both.select(
        "student_guid",
        in_range.alias("in_range"),
        follows.alias("labels_follow"),
        F.lit(result.students == result.readiness_records).alias("all_ready"),
    )


register(
    "scoring_run",
    _scoring_run,
    with_ctes(
        ["cohort_rows"],
        "SELECT student_guid, true AS in_range, true AS labels_follow, true AS all_ready FROM cohort_rows",
    ),
)


LOGISTIC_FEATURES = [
    "average_grade", "course_completion_rate", "total_credits_earned", "gpa_group_year_1", "number_of_credits_earned_year_1",
]


def _newton_sql(features: list[str], penalty: float, rounds: int) -> str:
    """The same steps written out: a round adds up the system and eliminates one unknown after the other."""
    k = len(features) + 1
    at = range(k)
    parts = [
        f"raw AS MATERIALIZED (SELECT student_guid, CAST(coalesce(retention,0) AS DOUBLE) AS y, {', '.join(f'CAST({c} AS DOUBLE) AS f{i}' for i, c in enumerate(features, 1))} FROM stu)",
        "med AS MATERIALIZED (SELECT " + ", ".join(f"median(f{i}) AS m{i}" for i in at[1:]) + " FROM raw)",
        "fil AS MATERIALIZED (SELECT student_guid, y, " + ", ".join(f"coalesce(f{i}, m{i}) AS f{i}" for i in at[1:]) + " FROM raw, med)",
        "mom AS MATERIALIZED (SELECT " + ", ".join(f"avg(f{i}) AS a{i}, stddev_pop(f{i}) AS d{i}" for i in at[1:]) + " FROM fil)",
        "z AS MATERIALIZED (SELECT student_guid, y, 1.0::DOUBLE AS x0, " + ", ".join(f"(f{i}-a{i})/d{i} AS x{i}" for i in at[1:]) + " FROM fil, mom)",
        "b0 AS MATERIALIZED (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in at) + ")",
    ]
    for r in range(rounds):
        score = "+".join(f"b{i}*x{i}" for i in at)
        parts.append(f"q{r} AS MATERIALIZED (SELECT z.*, 1/(1+exp(-({score}))) AS p FROM z, b{r})")
        sums = [f"sum(p*(1-p)*x{i}*x{j}) + {penalty if i == j and i else 0.0}::DOUBLE AS a{i}_{j}" for i in at for j in at]
        sums += [f"sum((y-p)*x{i}) - {penalty if i else 0.0}::DOUBLE*any_value(b{i}) AS g{i}" for i in at]
        parts.append(f"e{r}_0 AS MATERIALIZED (SELECT {', '.join(sums)} FROM q{r}, b{r})")
        for c in at:
            cell = lambda i, x: f"{x.format(c)}/a{c}_{c}" if i == c else f"{x.format(i)}-a{i}_{c}*{x.format(c)}/a{c}_{c}"
            columns = [cell(i, f"a{{0}}_{j}") + f" AS a{i}_{j}" for i in at for j in at] + [cell(i, "g{0}") + f" AS g{i}" for i in at]
            parts.append(f"e{r}_{c + 1} AS MATERIALIZED (SELECT {', '.join(columns)} FROM e{r}_{c})")
        parts.append(f"b{r + 1} AS MATERIALIZED (SELECT {', '.join(f'b{i}+g{i} AS b{i}' for i in at)} FROM b{r}, e{r}_{k})")
    return ",\n".join(parts)


_NEWTON = with_ctes(["stu"], "@@").replace(
    "\n@@", ",\n" + _newton_sql(LOGISTIC_FEATURES, logistic.PENALTY, logistic.ROUNDS) + "\n@@"
)


def _fitted(s, d):
    # written once, these columns only: the fit passes over the rows several times, and each would join the enrollments again
    rows = scored.with_targets(student_rows(s, d)).select("student_guid", *LOGISTIC_FEATURES, "target_retention")
    path = f"{checkpoint_dir(s)}/logistic-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = s.read.schema(rows.schema).parquet(path)
    return logistic.fit_logistic(rows, LOGISTIC_FEATURES, "target_retention"), rows


def _coefficients(s, d):
    model, _ = _fitted(s, d)
    rows = s.createDataFrame(model.rows(), "term string, coefficient double")  # one row a feature
    return rows.withColumn("coefficient", F.round("coefficient", 6))


def _logistic_scores(s, d):
    model, rows = _fitted(s, d)
    return logistic.apply_logistic(model, rows).select(
        "student_guid", F.round("probability", 6).alias("probability"), "prediction"
    )


register(
    "logistic_coefficients",
    _coefficients,
    _NEWTON.replace(
        "@@",
        " UNION ALL ".join(
            f"SELECT '{c}' AS term, round(b{i},6) AS coefficient FROM b{logistic.ROUNDS}" for i, c in enumerate(["intercept", *LOGISTIC_FEATURES])
        ),
    ),
)
_LAST = "1/(1+exp(-(" + "+".join(f"b{i}*x{i}" for i in range(len(LOGISTIC_FEATURES) + 1)) + ")))"
register(
    "logistic_scores",
    _logistic_scores,
    _NEWTON.replace(
        "@@",
        f"SELECT student_guid, round({_LAST},6) AS probability, CASE WHEN {_LAST}>=0.5 THEN 1 ELSE 0 END AS prediction FROM z, b{logistic.ROUNDS}",
    ),
)


def _forest_by_joins(s, d):
    """The retention forest scored from its table of nodes, read back from disk, beside what MLlib makes of each student."""
    rows = training_table(s, d)
    trained = models.train_classifier(rows, "Retention", "target_retention", models.RETENTION_FEATURES, models.simple_forest())
    folder = f"{checkpoint_dir(s)}/trees-{uuid.uuid4().hex}"
    trees.export_trees(trained.model, folder, s)
    inputs = trained.pre.transform(rows, ["student_guid"], trained.features)
    mine = trees.score_trees(trees.read_trees(s, folder), inputs, "student_guid")
    theirs = trained.model.transform(inputs).select(
        "student_guid", vector_to_array("probability")[1].alias("_p"), F.col("prediction").cast("int").alias("_label")
    )
    return theirs.join(mine, "student_guid", "left").select(
        "student_guid",
        F.coalesce(F.abs(F.col("score") - F.col("_p")) < 1e-12, F.lit(False)).alias("same_probability"),
        F.coalesce((F.col("prediction") == F.col("_label")) | (F.abs(F.col("_p") - 0.5) < 1e-12), F.lit(False)).alias("same_label"),
    )


register(
    "forest_by_joins",
    _forest_by_joins,
    with_ctes(["cohort_rows"], "SELECT student_guid, true AS same_probability, true AS same_label FROM cohort_rows"),
)
