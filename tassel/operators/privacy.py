"""Privacy rules for education records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .lineage import derived_from

# Identifying columns, small-cell limit and dimensions, telltale parts of column names.
EXCLUDED_COLUMNS = ["student_guid"]
SMALL_CELL = 10
SMALL_CELL_DIMENSIONS = ["race", "gender", "cohort"]
PERSONAL_NAME_PARTS = ["guid", "ssn", "social", "birth", "email"]


#: Stands for a dimension's total among its values, which are marked, too.
TOTAL = "total"


class PrivacyViolation(ValueError):
    """An output would expose an excluded column."""


def published(
    df: DataFrame,
    outputs: list[str | Column],
    group_by: list[str | Column] | None = None,
    where: Column | str | None = None,
    excluded: list[str] | None = None,
) -> DataFrame:
    """Select or aggregate for publication.

    The filter may use any column. Every output is traced back through the whole plan, also through what was
    done to ``df`` before the call; one that holds or is computed from an excluded column is rejected, and so is
    one whose origin is unclear beside such a column.
    """
    rows = df.filter(where) if where is not None else df
    columns = [F.expr(o) if isinstance(o, str) else o for o in outputs]
    out = rows.groupBy(*group_by).agg(*columns) if group_by is not None else rows.select(*columns)
    return assert_no_excluded_columns(out, excluded)


def assert_no_excluded_columns(df: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Last check before a sink: no column that holds or is computed from an excluded one."""
    hidden = EXCLUDED_COLUMNS if excluded is None else excluded
    named = [c for c in df.columns if c.lower() in {h.lower() for h in hidden}]
    found = named or (derived_from(df, hidden) if hidden else [])
    if found:
        raise PrivacyViolation(", ".join(found))
    return df


def suppress_small_cells(cells: DataFrame, n_column: str, values: list[str], minimum: int = SMALL_CELL) -> DataFrame:
    """Null out the values (and the size) of cells below the limit and flag them."""
    small = F.col(n_column) < minimum
    out = cells.withColumn("suppressed", small)
    return out.withColumns({c: F.when(~small, F.col(c)) for c in [*values, n_column]})


#: Partners looked at for each line of a small cell, the smallest first; the line's total is always one more.
NEAREST = 8


def protected_cells(
    rows: DataFrame,
    dimensions: list[str],
    minimum: int = SMALL_CELL,
    values: dict[str, Column] | None = None,
    nearest: int = NEAREST,
) -> DataFrame:
    """Counts by all dimensions with the totals over each of them, of which no hidden one follows from the rest.

    Rows: the dimensions (null also where they are summed over), ``all_<dimension>`` for that, n, the aggregates
    ``values`` and suppressed; n and the values are null in suppressed rows. Cells and totals below ``minimum`` are hidden.
    Each of them is the corner of a box: another value, or the total, in every dimension. All corners of the
    box that hides the fewest rows more are hidden as well. Adding one to a corner and taking it off or adding it
    at the others in turn leaves every visible number as it is, so no corner's number can be worked out; boxes are taken
    only if no corner, which a reader knows to hold a row, would become empty. With the totals as corners there always is
    a box. What was hidden for which reason is not told.

    The cells are a table with as many rows as the dimensions have combinations; the boxes of a small cell are
    ``nearest + 1`` to the power of the number of dimensions, joined corner by corner.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    k = len(dimensions)
    codes = [f"_c{i}" for i in range(k)]
    cube = rows.cube(*dimensions).agg(
        *[F.grouping(d).cast("boolean").alias(f"all_{d}") for d in dimensions],
        F.count("*").alias("n"),
        *[v.alias(name) for name, v in (values or {}).items()],
    )
    code = lambda d: F.when(F.col(f"all_{d}"), TOTAL).otherwise(
        F.coalesce(F.concat(F.lit("value "), F.col(d).cast("string")), F.lit("no value"))
    )
    cube = table(cube.withColumns({c: code(d) for c, d in zip(codes, dimensions)}), "cube")
    cells = cube.select(*codes, "n")
    small = cells.filter(F.col("n") < minimum)

    boxes = small.drop("n")
    for i, c in enumerate(codes):
        others = [o for o in codes if o != c]
        line = Window.partitionBy(*others) if others else Window.partitionBy(F.lit(0))
        placed = cells.filter(F.col(c) != TOTAL).withColumn("_place", F.row_number().over(line.orderBy(F.col("n") < 2, "n", c)))
        near = placed.filter(F.col("_place") <= nearest + 1).drop("_place").unionAll(cells.filter(F.col(c) == TOTAL))
        near = near.select(*[F.col(o).alias(f"_o{o}") for o in others], F.col(c).alias(f"_w{i}"))
        on = [F.col(o) == F.col(f"_o{o}") for o in others] + [F.col(c) != F.col(f"_w{i}")]
        boxes = boxes.join(near, on).drop(*[f"_o{o}" for o in others])
    corners = []
    for mask in range(1 << k):
        at = [F.col(f"_w{i}") if mask >> i & 1 else F.col(c) for i, c in enumerate(codes)]
        changed = sum((((a == TOTAL).cast("int")) for a in at), F.lit(mask.bit_count()))
        corners.append(F.struct(*[a.alias(f"_k{i}") for i, a in enumerate(at)], (changed % 2 == 0).alias("_up")))
    box = [*codes, *[f"_w{i}" for i in range(k)]]
    held = boxes.select(*box, F.inline(F.array(*corners)))
    sizes = cells.select(*[F.col(c).alias(f"_x{i}") for i, c in enumerate(codes)], "n")
    held = held.join(sizes, [F.col(f"_k{i}") == F.col(f"_x{i}") for i in range(k)])
    least = lambda up: F.coalesce(F.min(F.when(F.col("_up") == up, F.col("n"))), F.lit(2))
    judged = held.groupBy(*box).agg(
        F.count("*").alias("_corners"),
        F.sum(F.when(F.col("n") >= minimum, F.col("n")).otherwise(0)).alias("_cost"),
        F.greatest(least(True), least(False)).alias("_least"),
    )
    fit = judged.filter((F.col("_corners") == 1 << k) & (F.col("_least") >= 2))
    best = fit.groupBy(*codes).agg(F.min(F.struct("_cost", *[f"_w{i}" for i in range(k)])).alias("_best"))
    best = best.select(*codes, *[F.col(f"_best._w{i}").alias(f"_w{i}") for i in range(k)])
    hidden = table(best.select(F.inline(F.array(*corners))).drop("_up").distinct(), "hidden")
    marked = cube.join(hidden.withColumn("suppressed", F.lit(True)), [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(codes)], "left")
    marked = marked.withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))
    shown = {c: F.when(~F.col("suppressed"), F.col(c)) for c in ["n", *(values or {})]}
    return marked.withColumns(shown).select(
        *dimensions, *[f"all_{d}" for d in dimensions], "n", *(values or {}), "suppressed"
    )


def small_cell_report(
    df: DataFrame, dimensions: list[str] | None = None, minimum: int = SMALL_CELL
) -> DataFrame:
    """Every value of the watched dimensions with its size and whether it is too small; one pass."""
    names = dimensions or SMALL_CELL_DIMENSIONS
    columns = [F.col(c) for c in names]
    sets = df.groupingSets([[c] for c in columns], *columns).agg(
        *[F.grouping(c).alias(f"no_{c}") for c in names], F.count("*").alias("n")
    )
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in names:
        dimension = F.when(F.col(f"no_{c}") == 0, c).otherwise(dimension)
        value = F.when(F.col(f"no_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return sets.select(
        dimension.alias("dimension"), value.alias("value"), "n", (F.col("n") < minimum).alias("too_small")
    )


def personal_column_scan(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns whose names hint at personal data, over a set of tables, with how many rows fill them.

    One pass over each table that has such a column; only those columns are read.
    """
    out = None
    for table, df in tables.items():
        suspects = [c for c in df.columns if any(part in c.lower() for part in PERSONAL_NAME_PARTS)]
        if not suspects:
            continue
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(suspects)])
        cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(suspects)]
        rows = counts.select(F.lit(table).alias("table_name"), F.explode(F.array(*cells)).alias("x"))
        rows = rows.select("table_name", "x.column_name", "x.filled")
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        raise ValueError("no table has a column that hints at personal data")
    return out
