"""Row numbers, running totals, exact quantiles and lags that never sort one whole group in one task.

A window without enough partition keys puts a whole class, or the whole table, into a single task.
These functions split the order into ranges first, total each range (a small table), and
run the window inside the ranges only. Results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 3  # 16**3 = 4096 ranges of nearly equal size
STEP = 32
RANGES = STEP * STEP  # ranges of about equal numbers of distinct values


def last_at_most(bounds: Column, value: Column, most: int) -> Column:
    """Place (from 0) of the last of up to ``most`` ascending bounds that is not above the value, by halving; the first
    bound is taken to lie below every value."""
    steps = [1 << s for s in reversed(range(max(1, (most - 1).bit_length())))]
    step = lambda at, s: F.when(F.get(bounds, at + s) <= value, at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def hash_row_numbers(df: DataFrame, key: str, by: list[str] | None = None, seed: str = "") -> DataFrame:
    """Adds ``row_no`` (1-based, by md5 of seed and key, then key) and ``row_total`` per ``by`` group.

    ``by`` must be columns with few values, such as a class label.
    """
    by = by or []
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_range", F.substring("_h", 1, HASH_DIGITS))
    sizes = hashed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("row_total"),
    )
    match = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    # at most 4096 rows per group; without groups that bounds the table, with groups Spark's sizes decide
    joined = hashed.join(offsets if by else F.broadcast(offsets), match)
    inside = Window.partitionBy(*by, "_range").orderBy("_h", key)
    return joined.withColumn("row_no", F.row_number().over(inside) + F.col("_before")).drop(
        "_h", "_range", "_r", "_before", *[f"_by_{i}" for i in range(len(by))]
    )


def running_totals(counts: DataFrame, order: str, values: list[str], by: str | None = None) -> DataFrame:
    """Adds ``cum_<v>`` (total up to and including the row) and ``all_<v>`` (total of the group).

    ``counts`` has one row per (``by``, ``order``) value. The ranges follow the data's own quantiles,
    so clustered values spread over tasks too. ``by`` must have few values.
    """
    # a single group needs a key too, and a literal would turn the joins below into nested loops:
    # no value is both NaN and negative, so this is always 0
    x = F.col(order).cast("double")
    group = F.col(by) if by else (F.isnan(x) & (x < 0)).cast("int")
    rows = counts.withColumn("_by", group)
    # one parsed literal instead of a thousand column objects
    points = F.expr("array(" + ", ".join(f"{i / RANGES!r}D" for i in range(1, RANGES)) + ")")
    # the totals belong to the result; taking them here also lets both uses of ``counts`` share one shuffle
    bounds = rows.groupBy(F.col("_by").alias("_b")).agg(
        F.percentile_approx(order, points, F.lit(10000)).alias("_bounds"),
        *[F.sum(v).alias(f"all_{v}") for v in values],
    )
    coarse = F.transform(F.sequence(F.lit(1), F.lit(STEP - 1)), lambda i: F.get("_bounds", i * STEP - 1))
    bounds = bounds.withColumn("_coarse", coarse)
    # one row per group; a single group bounds the tables joined here, otherwise Spark's sizes decide
    small = (lambda t: t) if by else F.broadcast
    ranged = rows.join(small(bounds), F.col("_by").eqNullSafe(F.col("_b")))
    # count the bounds below the value in two steps: first every STEP-th bound, then those in between
    ranged = ranged.withColumn("_c", F.size(F.filter("_coarse", lambda b: b < F.col(order))))
    between = F.slice("_bounds", F.col("_c") * STEP + 1, F.lit(STEP - 1))
    place = F.col("_c") * STEP + F.size(F.filter(between, lambda b: b < F.col(order)))
    # never null, and said so: otherwise the join below would evaluate the whole expression as a null check
    ranged = ranged.withColumn("_range", F.coalesce(place, F.lit(0))).drop("_b", "_bounds", "_coarse", "_c")
    sizes = ranged.groupBy("_by", "_range").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_by").alias("_b"),
        F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
    )
    # at most RANGES rows per group
    joined = ranged.join(
        small(offsets), F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r"))
    )
    inside = Window.partitionBy("_by", "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns(
        {f"cum_{v}": F.sum(v).over(inside) + F.col(f"_before_{v}") for v in values}
    ).drop("_by", "_b", "_range", "_r", *[f"_before_{v}" for v in values])


def exact_quantiles(df: DataFrame, columns: list[str], points: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of several columns: rows (column, q0, q1, ...).

    Missing values are left out. Works on value counts, so it never holds a column in one task.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    counts = (
        long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    placed = running_totals(counts, "value", ["n"], by="column")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n")), F.col("value")))

    out = []
    for i, p in enumerate(points):
        place = F.lit(float(p)) * (F.col("all_n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(f"q{i}"))
    return placed.groupBy("column").agg(*out)


def previous_row(df: DataFrame, by: str, time: str, tie: str, columns: list[str], unit: str = "day") -> DataFrame:
    """Adds ``previous_<c>``: the value in the row before, per ``by`` in (time, tie) order.

    Equals ``lag`` over the whole group, but sorts one time unit of a group at a time: the first row
    of a unit takes the last row of the nearest earlier unit that has any.
    """
    cut = df.withColumn("_unit", F.date_trunc(unit, F.col(time)))
    packed = F.struct(F.lit(True).alias("seen"), *[F.col(c) for c in columns])
    lasts = cut.groupBy(by, "_unit").agg(F.max_by(packed, F.struct(time, tie)).alias("_last"))
    carried = lasts.select(
        F.col(by).alias("_by"),
        F.col("_unit").alias("_u"),
        F.lag("_last").over(Window.partitionBy(by).orderBy("_unit")).alias("_carried"),
    )
    joined = cut.join(carried, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_unit") == F.col("_u")))
    inside = Window.partitionBy(by, "_unit").orderBy(time, tie)
    found = joined.withColumn("_previous", F.coalesce(F.lag(packed).over(inside), F.col("_carried")))
    return found.withColumns(
        {"has_previous": F.col("_previous").isNotNull(), **{f"previous_{c}": F.col(f"_previous.{c}") for c in columns}}
    ).drop("_unit", "_by", "_u", "_carried", "_previous")
