"""Student roster, drill-through from a metric to its rows, and metric provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.numeric import ordinal
from ..functions.scoring import ALERT_ORDER
from ..sources.layouts import LAYOUTS
from .dashboards import at_risk, dashboard_filter
from .ingest import latest_upload


def join_readiness(students: DataFrame, readiness: DataFrame) -> DataFrame:
    """Students with their readiness, if any."""
    return students.join(readiness.select("student_guid", "readiness_score", "readiness_level"), "student_guid", "left")


def roster_filter(
    rows: DataFrame,
    search: str | None = None,
    alerts: list[str] | None = None,
    tier: str | None = None,
    credential: str | None = None,
    cohort: str | None = None,
    enrollment: str | None = None,
) -> DataFrame:
    """All filters combine; ``search`` is literal text anywhere in the id, in any case."""
    out = dashboard_filter(rows, cohort, enrollment, credential)
    if search:
        literal = search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        out = out.filter(F.col("student_guid").ilike(f"%{literal}%"))
    if alerts:
        out = out.filter(F.col("at_risk_alert").isin(alerts))
    if tier:
        out = out.filter(F.lower("readiness_level") == tier.lower())
    return out


def _pct(name: str) -> Column:
    return F.round(F.col(name).cast("double") * 100, 1)


def _score_pct() -> Column:
    """The stored score is a decimal, so its percentage is rounded exactly."""
    return F.round(F.col("readiness_score").cast("decimal(5,4)") * 100, 1).cast("double")


def roster_projection(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return rows.select(
        *(extra or []),
        "student_guid",
        "cohort",
        F.col("enrollment_intensity_first_term").alias("enrollment_intensity"),
        "at_risk_alert",
        _pct("retention_probability").alias("retention_pct"),
        _score_pct().alias("readiness_pct"),
        "readiness_level",
        _pct("gateway_math_probability").alias("gateway_math_pct"),
        _pct("gateway_english_probability").alias("gateway_english_pct"),
        _pct("low_gpa_probability").alias("gpa_risk_pct"),
        F.round("predicted_time_to_credential", 1).alias("time_to_credential"),
        F.col("predicted_credential_label").alias("credential_type"),
    )


# Sort keys a roster accepts and the columns behind them.
SORT_KEYS = {
    "at_risk_alert": "at_risk_alert",
    "retention_probability": "retention_probability",
    "readiness_score": "readiness_score",
    "gateway_math_probability": "gateway_math_probability",
    "gateway_english_probability": "gateway_english_probability",
    "low_gpa_probability": "low_gpa_probability",
    "predicted_time_to_credential": "predicted_time_to_credential",
    "cohort": "cohort",
    "enrollment_intensity": "enrollment_intensity_first_term",
    "credential_type": "predicted_credential_label",
}


def _sort(sort_by: str, descending: bool, worst_first: bool) -> list[tuple[Column, Callable[[Column], Column]]]:
    """What the roster is sorted by, and how."""
    key = SORT_KEYS.get(sort_by, "at_risk_alert")
    if key != "at_risk_alert":
        return [(F.col(key), F.desc_nulls_first if descending else F.asc_nulls_last), (F.col("student_guid"), F.asc)]
    up = worst_first or not descending
    return [
        (ordinal("at_risk_alert", ALERT_ORDER), F.asc if up else F.desc),
        (F.col("retention_probability"), F.desc_nulls_first),
        (F.col("student_guid"), F.asc),
    ]


def roster(
    students: DataFrame,
    readiness: DataFrame,
    sort_by: str = "at_risk_alert",
    descending: bool = True,
    page: int = 1,
    page_size: int = 50,
    worst_first: bool = False,
    **filters,
) -> DataFrame:
    """One page of the roster.

    The alert sort orders by severity rank (URGENT lowest) and then by retention probability, high
    first. ``worst_first`` puts URGENT at the top whatever the direction. Nulls come first when
    descending. The student id breaks ties. Deep pages are better read from a :class:`StoredRoster`.
    """
    size = max(1, page_size)
    rows = roster_filter(join_readiness(students, readiness), **filters)
    order = [way(value) for value, way in _sort(sort_by, descending, worst_first)]
    return roster_projection(rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size))


class StoredRoster:
    """A roster in its order, stored in ranges with their counts, so that a page reads the ranges that it lies in alone.

    Writing sorts once: ranges of the order are dealt to tasks, and each becomes a folder. The counts are one row a range.
    A page finds its ranges in the running total of the counts and sorts their rows only, about ``range_rows`` of them,
    whatever its number.
    """

    def __init__(
        self, spark: SparkSession, folder: str, sort_by: str = "at_risk_alert", descending: bool = True, worst_first: bool = False
    ):
        self.spark, self.folder = spark, folder
        self.sort = _sort(sort_by, descending, worst_first)

    def write(self, students: DataFrame, readiness: DataFrame, range_rows: int = 100_000, **filters) -> StoredRoster:
        rows = roster_filter(join_readiness(students, readiness), **filters)
        sorted_by = [value.alias(f"_o{i}") for i, (value, _) in enumerate(self.sort)]
        kept = roster_projection(rows.select("*", *sorted_by), [f"_o{i}" for i in range(len(self.sort))])
        kept.write.parquet(f"{self.folder}/unsorted")
        kept = self.spark.read.schema(kept.schema).parquet(f"{self.folder}/unsorted")
        ranges = -(-kept.count() // range_rows) or 1  # the count comes from the files' footers
        placed = kept.repartitionByRange(ranges, *self._order()).withColumn("_range", F.spark_partition_id())
        placed.write.partitionBy("_range").parquet(f"{self.folder}/rows")
        self._rows(kept.schema).groupBy("_range").agg(F.count("*").alias("n")).write.parquet(f"{self.folder}/counts")
        return self

    def _order(self) -> list[Column]:
        return [way(F.col(f"_o{i}")) for i, (_, way) in enumerate(self.sort)]

    def _rows(self, schema: StructType) -> DataFrame:
        return self.spark.read.schema(StructType([*schema, StructField("_range", IntegerType())])).parquet(f"{self.folder}/rows")

    def page(self, page: int = 1, page_size: int = 50) -> DataFrame:
        """The rows of one page in order; none beyond the last."""
        size = max(1, page_size)
        first = (max(1, page) - 1) * size
        rows = self._rows(self.spark.read.parquet(f"{self.folder}/unsorted").schema)
        chosen, before, start = [], 0, 0
        for r in self.spark.read.schema("_range int, n long").parquet(f"{self.folder}/counts").orderBy("_range").collect():
            if before < first + size and before + r.n > first:
                start = start if chosen else before
                chosen.append(r["_range"])
            before += r.n
        own = rows.filter(F.col("_range").isin(chosen)).orderBy("_range", *self._order())
        return own.offset(first - start).limit(size).drop("_range", *[f"_o{i}" for i in range(len(self.sort))])


def roster_count(students: DataFrame, readiness: DataFrame, page_size: int = 50, **filters) -> DataFrame:
    size = max(1, page_size)
    total = roster_filter(join_readiness(students, readiness), **filters).agg(F.count("*").alias("total"))
    return total.withColumn("page_count", F.ceil(F.col("total") / size))


def student_detail(students: DataFrame, readiness: DataFrame, student_guid: str) -> DataFrame:
    """Everything shown for one student; both sides are filtered before the join."""
    one = students.filter(F.col("student_guid") == student_guid)
    record = readiness.filter(F.col("student_guid") == student_guid)
    extra = record.select(
        "student_guid", "rationale", "risk_factors", "suggested_actions", "generated_at", "model_name"
    )
    lists = {
        c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
        for c in ("risk_factors", "suggested_actions")
    }
    return (
        roster_projection(join_readiness(one, record)).join(extra, "student_guid", "left").withColumns(lists).limit(1)
    )


PRIORITY_COLUMNS = [
    "student_guid", "risk_score", "at_risk_alert", "retention_probability", "course_completion_rate",
    "average_grade", "program_of_study_year_1", "cohort", "institution_id",
]


def priority_students(scored: DataFrame, **equals: str) -> DataFrame:
    """Every student on HIGH or URGENT alert that meets the filters; no cap."""
    out = scored.filter(at_risk())
    for column, value in equals.items():
        if value:
            out = out.filter(F.col(column) == value)
    return out.select(*PRIORITY_COLUMNS)


# ---------------------------------------------------------------- drill-through

# Metrics that can be traced back to rows, with their labels.
METRIC_LABELS = {
    "overall_retention": "Overall retention rate",
    "avg_predicted_retention": "Average predicted retention",
    "high_critical_risk_count": "Students at high / critical risk",
    "avg_course_completion": "Average course completion",
    "risk_alert_segment": "Risk alert segment",
    "retention_risk_segment": "Retention risk segment",
    "roster_cell": "Roster value",
}


def metric_rows(
    scored: DataFrame, metric: str, category: str | None = None, student_guid: str | None = None, **filters
) -> DataFrame:
    """The student rows a metric is computed from."""
    if metric not in METRIC_LABELS:
        raise ValueError(f"unknown metric: {metric}")
    if metric == "roster_cell":
        if not (student_guid or "").strip():
            raise ValueError("student_guid is required for roster_cell")
        return scored.filter(F.col("student_guid") == student_guid.strip())
    rows = dashboard_filter(scored, **filters)
    if metric == "high_critical_risk_count":
        return rows.filter(at_risk())
    if metric in ("risk_alert_segment", "retention_risk_segment"):
        if not (category or "").strip():
            raise ValueError(f"category is required for {metric}")
        column = "at_risk_alert" if metric == "risk_alert_segment" else "retention_risk_category"
        return rows.filter(F.col(column) == category.strip())
    return rows


def drill_through(
    scored: DataFrame,
    metric: str,
    page: int = 1,
    page_size: int = 50,
    show_ids: bool = False,
    category: str | None = None,
    student_guid: str | None = None,
    **filters,
) -> DataFrame:
    """One page of source rows in id order; ids are blanked unless the reader may see them."""
    size = max(1, page_size)
    rows = metric_rows(scored, metric, category, student_guid, **filters)
    paged = rows.orderBy("student_guid").offset((max(1, page) - 1) * size).limit(size)
    return paged.select(
        (F.col("student_guid") if show_ids else F.lit(None).cast("string")).alias("student_guid"),
        "cohort",
        F.col("enrollment_intensity_first_term").alias("enrollment_intensity"),
        "retention",
        _pct("retention_probability").alias("retention_pct"),
        "at_risk_alert",
        "retention_risk_category",
        _pct("course_completion_rate").alias("course_completion_pct"),
    )


def drill_through_count(scored: DataFrame, metric: str, **given) -> DataFrame:
    return metric_rows(scored, metric, **given).agg(F.count("*").alias("row_count"))


# Provenance texts. Two steps are shared, the third depends on the metric.
SHARED_STEPS = [
    ("Institutional ingest", "Files of the student layouts are validated and upserted into the student table."),
    ("Analysis-ready view", "One row per student; cohort, intensity and credential filters select the rows."),
]
METRIC_STEPS = {
    "overall_retention": ("Aggregate: historical retention", "Mean of retention times 100."),
    "avg_predicted_retention": ("Model: retention probability", "Mean of retention_probability times 100."),
    "high_critical_risk_count": ("Composite: alert bucketing", "Count of students on HIGH or URGENT alert."),
    "avg_course_completion": ("Aggregate: course completion rate", "Mean of course_completion_rate times 100."),
    "risk_alert_segment": ("Slice: risk alert level", "Count of students with one alert level."),
    "retention_risk_segment": ("Slice: retention probability band", "Count of students in one probability band."),
    "roster_cell": ("Roster column", "A value of the student's own row."),
}
# Roster fields and the column each is read from.
ROSTER_FIELDS = {
    "retention_pct": ("Predicted retention %", "retention_probability"),
    "readiness_pct": ("Readiness %", "readiness_score"),
    "gateway_math_pct": ("Gateway math %", "gateway_math_probability"),
    "gateway_english_pct": ("Gateway English %", "gateway_english_probability"),
    "gpa_risk_pct": ("Low-GPA risk %", "low_gpa_probability"),
    "time_to_credential": ("Time to credential", "predicted_time_to_credential"),
    "credential_type": ("Credential type", "predicted_credential_label"),
    "at_risk_alert": ("At-risk alert", "at_risk_alert"),
    "cohort": ("Cohort", "cohort"),
    "enrollment_intensity": ("Enrollment intensity", "enrollment_intensity_first_term"),
}
STUDENT_LAYOUTS = [x.id for x in LAYOUTS if x.target == "student_level_with_predictions"]


def provenance_table(spark: SparkSession) -> DataFrame:
    """Metric, field (roster only), step order, title, detail: a fixed dimension table."""
    rows = []
    for metric, own in METRIC_STEPS.items():
        steps = [*SHARED_STEPS, own]
        if metric != "roster_cell":
            rows += [(metric, None, i, *step) for i, step in enumerate(steps, 1)]
            continue
        for name, (label, column) in ROSTER_FIELDS.items():
            full = [*steps, (label, f"Read from {column}.")]
            rows += [(metric, name, i, *step) for i, step in enumerate(full, 1)]
    return spark.createDataFrame(rows, "metric string, field string, step int, title string, detail string")


def metric_provenance(history: DataFrame, metric: str, field: str | None = None) -> DataFrame:
    """Steps behind a metric, each with the latest upload into the student table."""
    steps = provenance_table(history.sparkSession).filter(F.col("metric") == metric)
    if metric == "roster_cell":
        if field not in ROSTER_FIELDS:
            raise ValueError("a roster field is required for roster_cell")
        steps = steps.filter(F.col("field") == field)
    newest = latest_upload(history, STUDENT_LAYOUTS).select(
        F.lit(metric).alias("metric"),
        F.col("id").alias("upload_id"),
        F.col("filename").alias("upload_file"),
        F.col("file_type").alias("upload_type"),
    )
    return steps.join(newest, "metric", "left")
