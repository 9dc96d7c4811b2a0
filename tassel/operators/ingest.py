"""File ingest: layout detection, mapping, conforming, validation, upsert, upload reports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_up_tenth
from ..sources.layouts import (
    BY_ID,
    CONFIDENT,
    COURSE_RENAMES,
    LAYOUTS,
    PERSONAL_COLUMNS,
    TENTATIVE,
    Layout,
    alias_rows,
    normalize_header,
    normalized,
)
from .ranks import previous_row

# ---------------------------------------------------------------- layout detection


@dataclass(frozen=True)
class Detection:
    layout: Layout | None
    confidence: float
    scores: list[tuple[str, float]]


def detect_schema(headers: list[str]) -> Detection:
    """Best layout for one file's headers (metadata only, on the driver)."""
    names = [normalize_header(h) for h in headers]
    scored = []
    for layout in LAYOUTS:
        known = {n for c in layout.columns for n in layout.names_of(c)}
        share = sum(n in known for n in names) / len(names) if names else 0.0
        scored.append((share, len(layout.columns), layout))
    scored.sort(key=lambda x: (-x[0], -x[1]))
    share, _, best = scored[0]
    complete = all(any(n in names for n in best.names_of(c)) for c in best.required)
    confidence = share if share < CONFIDENT or complete else min(share, CONFIDENT - 0.01)
    return Detection(best if share >= TENTATIVE else None, confidence, [(x.id, s) for s, _, x in scored])


def map_columns(headers: list[str], layout: Layout) -> list[tuple[str, str | None]]:
    """(header, layout column or None) in file order."""
    columns = {n: c for c in reversed(layout.columns) for n in layout.names_of(c)}
    return [(h, columns.get(normalize_header(h))) for h in headers]


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alias_rows(), "layout string, name string, column string, required int")


def _names_by_layout(spark: SparkSession) -> DataFrame:
    """One row for each known header name: whether layout i knows it (``m<i>``) and, as a bit, which of its required
    columns it stands for (``r<i>``)."""
    table: dict[str, list[int]] = {}
    place = {x.id: i for i, x in enumerate(LAYOUTS)}
    for layout, name, column, required in alias_rows():
        i = place[layout]
        cells = table.setdefault(name, [0] * (2 * len(LAYOUTS)))
        cells[2 * i] = 1
        if required:
            cells[2 * i + 1] = 1 << LAYOUTS[i].required.index(column)
    columns = ", ".join(f"m{i} long, r{i} long" for i in range(len(LAYOUTS)))
    return spark.createDataFrame([(n, *c) for n, c in table.items()], f"name string, {columns}")


def detect_schemas(headers: DataFrame) -> DataFrame:
    """Layout of many files at once from rows (file, header): one join to the names and one grouped pass.

    Result: file, layout (null below the tentative threshold), confidence. The layout with the most known headers
    wins, then the one with more columns.
    """
    named = headers.select("file", normalized(F.col("header")).alias("name"))
    # the table of names is fixed, about a hundred rows
    known = named.join(F.broadcast(_names_by_layout(headers.sparkSession)), "name", "left")
    per_file = known.groupBy("file").agg(
        F.count("*").alias("headers"),
        *[F.sum(F.coalesce(f"m{i}", F.lit(0))).alias(f"m{i}") for i in range(len(LAYOUTS))],
        *[F.bit_or(F.coalesce(f"r{i}", F.lit(0))).alias(f"r{i}") for i in range(len(LAYOUTS))],
    )

    def all_of(value) -> Column:
        return F.array(*[value(i, x) for i, x in enumerate(LAYOUTS)])

    order = [F.col(f"m{i}") * 2**20 + len(x.columns) * 2**8 + i for i, x in enumerate(LAYOUTS)]
    best = per_file.withColumn("_best", F.greatest(*order).bitwiseAND(255).cast("int"))
    pick = lambda values: F.get(values, F.col("_best"))
    complete = pick(all_of(lambda i, x: F.col(f"r{i}") == (1 << len(x.required)) - 1))
    score = pick(all_of(lambda i, x: F.col(f"m{i}"))) / F.col("headers")
    capped = F.when((score >= CONFIDENT) & ~complete, F.least(score, F.lit(CONFIDENT - 0.01))).otherwise(score)
    return best.select(
        "file",
        F.when(score >= TENTATIVE, pick(all_of(lambda i, x: F.lit(x.id)))).alias("layout"),
        F.round(capped, 4).alias("confidence"),
    )


def map_headers(headers: DataFrame, detected: DataFrame) -> DataFrame:
    """(file, header, mapped_to, status) for files whose layout is known."""
    names = alias_table(headers.sparkSession).select("layout", "name", F.col("column").alias("mapped_to"))
    rows = headers.withColumn("name", normalized(F.col("header"))).join(detected.select("file", "layout"), "file")
    return rows.join(F.broadcast(names), ["layout", "name"], "left").select(
        "file",
        "header",
        "mapped_to",
        F.when(F.col("mapped_to").isNotNull(), "matched").otherwise("unmapped").alias("status"),
    )


@dataclass(frozen=True)
class Preview:
    layout: str | None
    label: str | None
    confidence: float
    columns: list[tuple[str, str | None]]
    sample: list[dict]
    total_rows: int
    warnings: list[str]
    errors: list[str]


def preview(df: DataFrame) -> Preview:
    """What the upload screen shows: layout, mapping, ten rows, row count, missing columns."""
    found = detect_schema(df.columns)
    layout = found.layout
    columns = map_columns(df.columns, layout) if layout else [(h, None) for h in df.columns]
    mapped = {c for _, c in columns}
    missing = [c for c in layout.required if c not in mapped] if layout else []
    absent = [c for c in layout.optional if c not in mapped] if layout else []
    return Preview(
        layout.id if layout else None,
        layout.label if layout else None,
        int(found.confidence * 100 + 0.5) / 100,
        columns,
        [row.asDict() for row in df.limit(10).collect()],
        df.count(),
        [f"Missing optional column: {c}" for c in absent],
        [f"Missing required column: {c}" for c in missing],
    )


# ---------------------------------------------------------------- conforming


def text_or_null(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def yes_no(value: Column) -> Column:
    return F.when(value == "Y", True).when(value == "N", False)


def number_or_null(value: Column) -> Column:
    """Leading number of a text, as loose parsers read it; anything else is null."""
    return F.nullif(F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast(
        "double"
    )


# Columns of the enrollment table.
ENROLLMENT_TEXT = [
    "student_guid", "cohort", "cohort_term", "academic_year", "academic_term", "course_prefix", "course_number",
    "course_name", "course_cip", "course_type", "gateway_type", "core_course_type", "delivery_method", "grade",
    "instructor_status",
]
ENROLLMENT_FLAGS = ["is_co_requisite", "is_core_course"]
ENROLLMENT_NUMBERS = ["credits_attempted", "credits_earned"]


def unify_course_columns(df: DataFrame) -> DataFrame:
    """Normalized headers and one name per course column, whichever layout the file came in."""
    out = df.toDF(*[normalize_header(c) for c in df.columns])
    if "student_id" in out.columns and "student_guid" not in out.columns:
        out = out.withColumnRenamed("student_id", "student_guid")
    return out.withColumnsRenamed({a: b for a, b in COURSE_RENAMES.items() if b not in out.columns})


def conform_enrollments(raw: DataFrame) -> DataFrame:
    """Text rows of a course file to the enrollment table; rows without a student id are dropped."""
    named = unify_course_columns(raw)
    have = set(named.columns)

    def source(name: str) -> Column:
        return text_or_null(name) if name in have else F.lit(None).cast("string")

    return named.select(
        *[source(c).alias(c) for c in ENROLLMENT_TEXT],
        *[yes_no(source(c)).alias(c) for c in ENROLLMENT_FLAGS],
        *[number_or_null(source(c)).alias(c) for c in ENROLLMENT_NUMBERS],
    ).filter(F.col("student_guid").isNotNull())


def recode(value: Column, table: dict[str, str]) -> Column:
    """Label of a trimmed code; unknown codes stay exactly as they came."""
    codes = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.trim(value)), value)


def recode_values(df: DataFrame, layout: Layout) -> DataFrame:
    return df.withColumns({c: recode(F.col(c), t) for c, t in layout.recodes.items() if c in df.columns})


def deidentify_for_table(df: DataFrame) -> DataFrame:
    return df.drop(*PERSONAL_COLUMNS)


def parse_float_date(value: Column) -> Column:
    """Dates that arrive as numbers with a decimal part, such as 20240820.0."""
    return F.try_to_date(F.regexp_replace(value, r"\.0$", ""), "yyyyMMdd")


# ---------------------------------------------------------------- validation


def missing_required_columns(columns: list[str], layout: Layout) -> list[str]:
    return [c for c in layout.required if c not in columns]


def validate_required(df: DataFrame, layout: Layout, row_no: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """(rows to load, errors). A missing required column rejects the whole file with row 0;
    otherwise each row is rejected for its first empty required field, in layout order."""
    absent = missing_required_columns(df.columns, layout)
    if absent:
        errors = df.sparkSession.createDataFrame(
            [(0, c, f"Required column not mapped: {c}") for c in absent], "row long, column string, message string"
        )
        return df.limit(0), errors
    # layout column order decides which empty field is reported
    ordered = [c for c in layout.columns if c in layout.required]
    first_empty = F.coalesce(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in ordered])
    checked = df.withColumn("_empty", first_empty)
    errors = checked.filter(F.col("_empty").isNotNull()).select(
        F.col(row_no).cast("bigint").alias("row"),
        F.col("_empty").alias("column"),
        F.concat(F.lit("Empty required field: "), F.col("_empty")).alias("message"),
    )
    return checked.filter(F.col("_empty").isNull()).drop("_empty"), errors


def rejected_files(df: DataFrame, layout: Layout) -> DataFrame:
    """The errors of a file that lacks required columns, with how many of its rows are rejected for it."""
    absent = missing_required_columns(df.columns, layout)
    listed = F.array(*[F.lit(c) for c in absent]).cast("array<string>")
    counted = df.agg(F.count("*").alias("rows_rejected"))
    return counted.select(F.explode(listed).alias("column"), "rows_rejected").select(
        F.lit(0).cast("bigint").alias("row"),
        "column",
        F.concat(F.lit("Required column not mapped: "), "column").alias("message"),
        "rows_rejected",
    )


@dataclass(frozen=True)
class Rule:
    """One submission check: ``kind`` is present, not_null, parses or allowed."""

    kind: str
    column: str
    detail: object = None


def layout_rules(layout: Layout) -> list[Rule]:
    return (
        [Rule("present", c) for c in layout.required]
        + [Rule("not_null", c) for c in layout.required]
        + [Rule("parses", c, "double") for c in layout.numeric]
        + [Rule("allowed", c, values) for c, values in layout.allowed.items()]
    )


def validate_submission(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Failures per rule from a single pass: rule, column, failures, passed."""
    tests = []
    for rule in rules:
        here = rule.column in df.columns
        value = F.trim(F.col(rule.column)) if here else None
        if rule.kind == "present":
            test = F.lit(not here)
            tests.append(F.when(F.count("*") >= 0, test.cast("bigint")))
            continue
        if not here:
            tests.append(F.count_if(F.lit(rule.kind == "not_null")))
        elif rule.kind == "not_null":
            tests.append(F.count_if(F.coalesce(value, F.lit("")) == ""))
        elif rule.kind == "parses":
            filled = F.coalesce(value, F.lit("")) != ""
            tests.append(F.count_if(filled & value.try_cast(rule.detail).isNull()))
        else:
            filled = F.coalesce(value, F.lit("")) != ""
            tests.append(F.count_if(filled & ~value.isin(list(rule.detail))))
    one = df.agg(*[t.alias(f"f{i}") for i, t in enumerate(tests)])
    rows = F.array(
        *[
            F.struct(
                F.lit(r.kind).alias("rule"), F.lit(r.column).alias("column"), F.col(f"f{i}").alias("failures")
            )
            for i, r in enumerate(rules)
        ]
    )
    return one.select(F.explode(rows).alias("x")).select("x.*", (F.col("x.failures") == 0).alias("passed"))


# ---------------------------------------------------------------- upsert


def last_per_key(batch: DataFrame, keys: list[str], order: str, ties: bool = False) -> DataFrame:
    """The last row of every key by ``order``.

    The newest order of each key comes from a small aggregate, which combines before the shuffle; whole rows
    then only have to match it. ``order`` must be unique within a key, as a row number is; with ``ties`` it need
    not be, and one of the rows alike in key and order stays.
    """
    newest = batch.groupBy(*keys).agg(F.max(order).alias("_newest"))
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    same = F.col(f"b.{order}").eqNullSafe(F.col("n._newest"))
    last = batch.alias("b").join(newest.alias("n"), [*on, same], "left_semi")
    return last.dropDuplicates([*keys, order]) if ties else last


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: str = "row_no") -> DataFrame:
    """The target after inserting or overwriting by key.

    Only columns the batch carries change; the last row of a key wins. A batch without other columns
    adds new keys and leaves known ones alone. Null keys never match, as in a database.
    """
    return merge_rows(target, last_per_key(batch.dropna(subset=keys), keys, order).drop(order), keys)


def merge_rows(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the rows of ``new``, one a key, inserted or written over those of the same key."""
    carried = [c for c in new.columns if c not in keys]
    t, n = target.alias("t"), new.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"t.{k}") == F.col(f"n.{k}") for k in keys]
    joined = t.join(n, on, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"t.{c}"), F.col(f"n.{c}"))
        if c in carried:
            return F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"t.{c}"))
        return F.col(f"t.{c}")

    return joined.select(*[value(c).alias(c) for c in target.columns])


# ---------------------------------------------------------------- upload ledger and reports


def upload_status(errors: Column | str = "error_count", inserted: Column | str = "rows_inserted") -> Column:
    e = F.col(errors) if isinstance(errors, str) else errors
    i = F.col(inserted) if isinstance(inserted, str) else inserted
    return F.when((e > 0) & (i == 0), "failed").when(e > 0, "partial").otherwise("success")


def percent_change(now: Column, before: Column) -> Column:
    """Change in percent to one decimal, halves going up; null without a positive base."""
    return F.when(before > 0, half_up_tenth((now - before) / before * 1000))


SWING_PERCENT = 50  # fixed value: change in percent that is flagged


def upload_diffs(history: DataFrame, unit: str = "day") -> DataFrame:
    """Every upload against the one before it of the same type; null when there is none."""
    counts = ["rows_inserted", "rows_skipped", "error_count"]
    rows = previous_row(history, "file_type", "uploaded_at", "id", ["id", *counts], unit)
    pct = percent_change(F.col("rows_inserted"), F.col("previous_rows_inserted"))
    return rows.select(
        "id",
        "file_type",
        F.col("previous_id"),
        *[(F.col(c) - F.col(f"previous_{c}")).alias(f"{c}_delta") for c in counts],
        pct.alias("percent_inserted_change"),
        F.when(F.col("has_previous"), F.coalesce(F.abs(pct) >= SWING_PERCENT, F.lit(False))).alias("large_swing"),
    )


def latest_upload(history: DataFrame, file_types: list[str] | None = None) -> DataFrame:
    """Newest upload per file type, or the single newest one across the given types."""
    packed = F.max_by(F.struct(*history.columns), F.struct("uploaded_at", "id")).alias("u")
    if file_types is None:
        return history.groupBy("file_type").agg(packed).select("u.*")
    return history.filter(F.col("file_type").isin(file_types)).agg(packed).filter("u is not null").select("u.*")


def upload_history_page(history: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    size = max(1, page_size)
    return (
        history.orderBy(F.desc("uploaded_at"), F.desc("id")).offset((max(1, page) - 1) * size).limit(size)
    )


def upload_status_counts(history: DataFrame) -> DataFrame:
    """Uploads by status with the overall total in the row whose status is null."""
    s = F.col("status")
    return history.groupingSets([[s], []], s).agg(F.count("*").alias("uploads"))


def stored_errors(errors: DataFrame, cap: int | None = None) -> DataFrame:
    """Errors in file order as kept with the upload: all, or the first ``cap``."""
    ordered = errors.orderBy("row", "column")
    return ordered if cap is None else ordered.limit(cap)


def report_lines(
    errors: DataFrame, summary: dict[str, object], diff: dict[str, object] | None = None, cap: int | None = None
) -> Iterator[str]:
    """Lines of the downloadable validation report: all errors in file order, or the first ``cap``.

    Errors come to the driver a partition at a time, as the lines are read.
    """

    def cell(value: object) -> str:
        text = "" if value is None else str(value)
        return '"' + text.replace('"', '""') + '"' if any(ch in text for ch in ',"\n\r') else text

    kept = stored_errors(errors, cap)
    yield "# Upload validation report"
    yield from (f"# {name},{cell(value)}" for name, value in summary.items())
    yield f"# Row-level issues (rows in this file),{kept.count()}"
    yield from (f"# {name},{cell(value)}" for name, value in (diff or {}).items())
    yield from ("", "row,column,message")
    for r in kept.toLocalIterator():
        yield ",".join(cell(v) for v in (r["row"], r["column"], r["message"]))


# ---------------------------------------------------------------- raw and cleaned layers


def bronze_rows(df: DataFrame, endpoint: str, batch_id: str) -> DataFrame:
    """Rows as JSON with their source, load time and batch."""
    return df.select(
        F.to_json(F.struct("*")).alias("data"),
        F.lit(endpoint).alias("source_endpoint"),
        F.current_timestamp().alias("ingested_at"),
        F.lit(batch_id).alias("etl_batch_id"),
    )


def silver_extract(bronze: DataFrame, fields: dict[str, str], key: str, order: str) -> DataFrame:
    """Typed columns from the JSON payload (``fields``: name -> type). Rows without the key are dropped
    and the last row per key by the field ``order`` is kept; text that does not parse is null."""
    parsed = bronze.select(F.from_json("data", "map<string,string>").alias("m"))
    typed = parsed.select(*[F.try_element_at("m", F.lit(c)).try_cast(t).alias(c) for c, t in fields.items()])
    return last_per_key(typed.filter(F.col(key).isNotNull()), [key], order, ties=True)


def counts_by_source(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("source_endpoint").agg(
        F.count("*").alias("records"), F.max("ingested_at").alias("latest_load")
    )


def run_history(runs: DataFrame, limit: int | None = None) -> DataFrame:
    newest = runs.orderBy(F.desc("started_at"), F.desc("run_id"))
    return newest if limit is None else newest.limit(limit)


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("records")).select(F.lit(name).alias("table_name"), "records")
        out = row if out is None else out.unionByName(row)
    return out


def layout_by_id(layout_id: str) -> Layout:
    return BY_ID[layout_id]
