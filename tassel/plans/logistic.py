"""Logistic regression by iteratively reweighted least squares, its sums taken by Spark in one aggregate a round."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import exact_quantiles

#: Penalty on the squared coefficients of the summed loss: 1 / C with C = 0.1 (fixed value).
PENALTY = 10.0
#: Newton steps; with a penalty the last ones no longer move a coefficient in double precision.
ROUNDS = 10


@dataclass
class Logistic:
    """Coefficients for standardised features, the intercept first."""

    features: list[str]
    fill: list[float]
    means: list[float]
    scales: list[float]
    coefficients: list[float]
    steps: list[float] = field(default_factory=list)  # largest change of a coefficient, by round

    def standardised(self) -> list[Column]:
        columns = zip(self.features, self.fill, self.means, self.scales)
        return [(F.coalesce(_number(c), F.lit(fill)) - F.lit(mean)) / F.lit(scale) for c, fill, mean, scale in columns]

    def probability(self, inputs: list[Column] | None = None) -> Column:
        first, *others = self.coefficients
        total = F.lit(first)
        for b, x in zip(others, inputs or self.standardised()):
            total = total + F.lit(b) * x
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def rows(self) -> list[tuple[str, float]]:
        return list(zip(["intercept", *self.features], self.coefficients))


def _number(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def fit_logistic(
    df: DataFrame, features: list[str], label: str, penalty: float = PENALTY, rounds: int = ROUNDS
) -> Logistic:
    """Minimises the summed log loss plus ``penalty`` / 2 times the squared coefficients, the intercept left free.

    Missing numbers are filled with the exact median and features standardised (a constant one counts as 0). Each
    round adds up the gradient and the Hessian over all rows with a label, built-in expressions only, and the driver
    solves the system of as many unknowns as there are features; nothing else reaches it. The standardised rows are kept
    on the executors between rounds and computed again where one is lost. Without a labelled row all is 0.
    """
    known = df.filter(F.col(label).isNotNull())
    medians = {r["column"]: r["q0"] for r in exact_quantiles(known.select(*features), features, [0.5]).collect()}
    fill = [medians.get(c) or 0.0 for c in features]
    filled = [F.coalesce(_number(c), F.lit(m)) for c, m in zip(features, fill)]
    moments = known.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]
    ).first()
    k = len(features)
    means, scales = [moments[f"m{i}"] or 0.0 for i in range(k)], [moments[f"s{i}"] or 1.0 for i in range(k)]
    model = Logistic(features, fill, means, scales, [0.0] * (k + 1))
    names = [f"x{i}" for i in range(1, k + 1)]
    rows = known.select(F.col(label).cast("double").alias("y"), *[x.alias(n) for n, x in zip(names, model.standardised())])
    rows = rows.persist()
    try:
        for _ in range(rounds):
            step = _newton_step(rows, model, names, penalty)
            model.coefficients = [b + s for b, s in zip(model.coefficients, step)]
            model.steps.append(max(abs(s) for s in step))
    finally:
        rows.unpersist()
    return model


def _newton_step(rows: DataFrame, model: Logistic, names: list[str], penalty: float) -> list[float]:
    p = rows.withColumn("p", model.probability([F.col(n) for n in names]))
    weighed = p.withColumns({"w": F.col("p") * (1 - F.col("p")), "r": F.col("y") - F.col("p")})
    inputs = [F.lit(1.0), *[F.col(n) for n in names]]
    k = len(inputs)
    sums = weighed.agg(
        *[F.sum(F.col("r") * x).alias(f"g{i}") for i, x in enumerate(inputs)],
        *[F.sum(F.col("w") * inputs[i] * inputs[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)],
    ).first()
    if sums["g0"] is None:
        return [0.0] * k
    gradient = np.array([sums[f"g{i}"] for i in range(k)])
    hessian = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    gradient[1:] -= penalty * np.array(model.coefficients[1:])
    hessian[range(1, k), range(1, k)] += penalty
    return np.linalg.lstsq(hessian, gradient, rcond=None)[0].tolist()


def apply_logistic(model: Logistic, df: DataFrame) -> DataFrame:
    """Adds ``probability`` and ``prediction`` (1 from a half on)."""
    scored = df.withColumn("probability", model.probability())
    return scored.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
