"""File ingest, upserts, upload ledger, raw and cleaned layers, sinks."""

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tassel.operators import ingest, privacy
from tassel.session import checkpoint_dir
from tassel.sources import files, sinks, star
from tassel.sources.layouts import BY_ID, LAYOUTS, alias_rows
from tassel.sources.snapshots import SnapshotTable

from .base_sql import with_ctes
from .registry import register
from .tables import enrollments, scored_rows

SUBMISSION = BY_ID["pdp_cohort_submission"]


def folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ conforming

register(
    "conform_enrollments",
    lambda s, d: ingest.conform_enrollments(star.raw_course_rows(s, d))
    .groupBy("student_guid", "academic_year", "academic_term", "course_prefix", "course_number", "grade")
    .agg(
        F.count("*").alias("n"),
        F.sum("credits_attempted").alias("attempted"),
        F.sum("credits_earned").alias("earned"),
        F.count("credits_earned").alias("earned_known"),
        F.count_if("is_co_requisite").alias("coreq_yes"),
        F.count_if(~F.col("is_co_requisite")).alias("coreq_no"),
        F.count("course_cip").alias("cips"),
        F.max("cohort_term").alias("cohort_term"),
    ),
    with_ctes(
        ["enr"],
        """SELECT student_guid, academic_year, academic_term, course_prefix, course_number, CASE WHEN grade<>'' THEN grade END AS grade, count(*) AS n,
 sum(CASE WHEN delivery_method='O' AND grade='F' THEN NULL ELSE credits_attempted END) AS attempted,
 sum(CASE WHEN grade='I' THEN NULL ELSE credits_earned END) AS earned,
 count(CASE WHEN grade='I' THEN NULL ELSE credits_earned END) AS earned_known,
 count(*) FILTER (WHERE is_co_requisite) AS coreq_yes, count(*) FILTER (WHERE NOT is_co_requisite AND is_core_course) AS coreq_no,
 0 AS cips, 'FALL' AS cohort_term
FROM enr WHERE NOT coalesce(delivery_method='H' AND gateway_type='E' AND grade='W', false) GROUP BY 1,2,3,4,5,6""",
    ),
)


def _unified(s, d):
    upload = star.raw_course_rows(s, d).selectExpr(
        "`Student_GUID` as `Student ID`", "`Math_or_English_Gateway` as `Math-or English Gateway`",
        "`Number_of_Credits_Attempted` as number_of_credits_attempted", "`Course_Prefix` as `course prefix`",
    )
    return ingest.unify_course_columns(upload).groupBy("course_prefix", "gateway_type", "credits_attempted").agg(
        F.count_distinct("student_guid").alias("students")
    )


register(
    "unify_course_columns",
    _unified,
    with_ctes(
        ["enr"],
        """SELECT course_prefix, gateway_type, CASE WHEN delivery_method='O' AND grade='F' THEN 'NULL' ELSE CAST(CAST(credits_attempted AS DECIMAL(4,1)) AS VARCHAR) END AS credits_attempted,
 count(DISTINCT CASE WHEN coalesce(delivery_method='H' AND gateway_type='E' AND grade='W', false) THEN '  ' ELSE student_guid END) AS students FROM enr GROUP BY 1,2,3""",
    ),
)

# ------------------------------------------------------------------ layouts

_ALIASES = ", ".join(f"('{a}','{b}','{c}',{r})" for a, b, c, r in alias_rows())
_SIZES = ", ".join(f"('{x.id}',{len(x.columns)},{len(x.required)},{i})" for i, x in enumerate(LAYOUTS))
_POSITIONS = ", ".join(f"({n},{i},'{c}')" for n, x in enumerate(LAYOUTS) for i, c in enumerate(x.columns))
_HEADERS = f"""aliases(layout, name, col, required) AS (VALUES {_ALIASES}),
layouts(layout, width, needed, layout_no) AS (VALUES {_SIZES}),
positions(layout_no, pos, col) AS (VALUES {_POSITIONS}),
headers AS (SELECT c_custkey AS file, CASE WHEN c_custkey%2=0 THEN upper(replace(col,'_',' ')) ELSE col END AS header
  FROM customer JOIN positions ON layout_no=c_custkey%5 WHERE (c_custkey*7+pos*3)%20 < 18
  UNION ALL SELECT c_custkey, 'Local-' || CAST(i AS VARCHAR) FROM customer, range(1,12) t(i) WHERE c_custkey%11=0),
named AS (SELECT *, regexp_replace(replace(lower(trim(header)),'/','_'), '[\\s\\-]+', '_', 'g') AS name FROM headers),
scores AS (SELECT n.file, l.layout, width, needed, count(a.col) AS matched, count(DISTINCT CASE WHEN a.required=1 THEN a.col END) AS present,
   count(*) AS headers
  FROM named n CROSS JOIN layouts l LEFT JOIN aliases a ON a.layout=l.layout AND a.name=n.name GROUP BY 1,2,3,4),
best AS (SELECT *, matched/CAST(headers AS DOUBLE) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY file ORDER BY matched DESC, width DESC)=1),
detected AS (SELECT file, CASE WHEN score>=0.3 THEN layout END AS layout,
  round(CASE WHEN score>=0.6 AND present<needed THEN least(score, 0.6::DOUBLE-0.01::DOUBLE) ELSE score END, 4) AS confidence FROM best)"""

register(
    "detect_schemas",
    lambda s, d: ingest.detect_schemas(star.upload_headers(s, d)),
    f"WITH {_HEADERS} SELECT * FROM detected",
)
register(
    "map_headers",
    lambda s, d: ingest.map_headers(star.upload_headers(s, d), ingest.detect_schemas(star.upload_headers(s, d))),
    f"""WITH {_HEADERS} SELECT n.file, header, a.col AS mapped_to, CASE WHEN a.col IS NULL THEN 'unmapped' ELSE 'matched' END AS status
FROM named n JOIN detected d ON n.file=d.file LEFT JOIN aliases a ON a.layout=d.layout AND a.name=n.name""",
)

# ------------------------------------------------------------------ submissions: recode, validate, upsert


def mapped_submissions(s, d):
    raw = star.submissions(s, d)
    mapping = [(h, c) for h, c in ingest.map_columns(raw.columns, SUBMISSION) if c]
    return raw.select("row_no", *[F.col(f"`{h}`").alias(c) for h, c in mapping])


_LABELS = {
    "et": "CASE trim({0}) WHEN 'F' THEN 'First-Time' WHEN 'R' THEN 'Re-admit' WHEN 'T' THEN 'Transfer-In' ELSE {0} END",
    "race": """CASE trim({0}) WHEN 'W' THEN 'White' WHEN 'B' THEN 'Black or African American' WHEN 'A' THEN 'Asian'
   WHEN 'AN' THEN 'American Indian or Alaska Native' WHEN 'IA' THEN 'American Indian or Alaska Native'
   WHEN 'HP' THEN 'Native Hawaiian or Other Pacific Islander' WHEN 'TM' THEN 'Two or More Races' WHEN 'UK' THEN 'Unknown' ELSE {0} END""",
    "gender": "CASE trim({0}) WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' WHEN 'P' THEN 'Non-binary' WHEN 'X' THEN 'Other' WHEN 'UK' THEN 'Unknown' ELSE {0} END",
}
_SUB = f"""sub AS (SELECT o_orderkey+1 AS row_no, CASE WHEN o_orderkey%101=0 THEN ' ' ELSE 'STU' || lpad(CAST(o_custkey AS VARCHAR),9,'0') END AS student_guid,
  CASE WHEN o_orderkey%211=0 THEN NULL ELSE CAST(2019+o_custkey%5 AS VARCHAR) || '-' || CAST(20+o_custkey%5 AS VARCHAR) END AS cohort,
  (['Fall','Winter','Spring','Autumn'])[o_custkey%4+1] AS cohort_term, 'Name' || CAST(o_custkey AS VARCHAR) AS first_name,
  {_LABELS['et'].format("(['F','R','T',' F ','Z '])[o_orderkey%5+1]")} AS enrollment_type,
  {_LABELS['race'].format("(['W','B','A','AN','IA','HP','TM','UK','XX '])[o_orderkey%9+1]")} AS race,
  {_LABELS['gender'].format("(['M','F','P','X','UK',''])[o_orderkey%6+1]")} AS gender,
  (['C','R','N'])[o_orderkey%3+1] AS math_placement FROM orders),
err AS (SELECT row_no AS row, CASE WHEN trim(student_guid)='' THEN 'student_guid' WHEN coalesce(trim(cohort),'')='' THEN 'cohort' END AS col FROM sub),
good AS (SELECT * FROM sub WHERE trim(student_guid)<>'' AND cohort IS NOT NULL)"""

register(
    "recode_values",
    lambda s, d: ingest.recode_values(mapped_submissions(s, d), SUBMISSION).drop("cohort"),
    f"WITH {_SUB} SELECT * EXCLUDE (cohort) FROM sub",
)
register(
    "deidentify_for_table",
    lambda s, d: ingest.deidentify_for_table(mapped_submissions(s, d)).select("*").drop("race", "gender", "enrollment_type"),
    f"WITH {_SUB} SELECT row_no, student_guid, cohort, cohort_term, math_placement FROM sub",
)
_ERRORS = "SELECT row, col AS \"column\", 'Empty required field: ' || col AS message FROM err WHERE col IS NOT NULL"
register(
    "validate_required_errors",
    lambda s, d: ingest.validate_required(mapped_submissions(s, d), SUBMISSION)[1],
    f"WITH {_SUB} {_ERRORS}",
)
register(
    "validate_required_rows",
    lambda s, d: ingest.validate_required(mapped_submissions(s, d), SUBMISSION)[0].select("row_no", "student_guid", "cohort"),
    f"WITH {_SUB} SELECT row_no, student_guid, cohort FROM good",
)
register(
    "stored_errors",
    lambda s, d: ingest.stored_errors(ingest.validate_required(mapped_submissions(s, d), SUBMISSION)[1]),
    f"WITH {_SUB} {_ERRORS}",
)


def _missing_column(s, d):
    """A file without two required columns: its rows are counted and none is loaded."""
    rows = mapped_submissions(s, d).drop("cohort", "enrollment_type")
    return ingest.rejected_files(rows, SUBMISSION)


register(
    "validate_missing_column",
    _missing_column,
    """SELECT 0 AS row, c AS "column", 'Required column not mapped: ' || c AS message, n AS rows_rejected
FROM (VALUES ('cohort'),('enrollment_type')) v(c), (SELECT count(*) AS n FROM orders)""",
)
_RULES = [
    *ingest.layout_rules(SUBMISSION),
    ingest.Rule("present", "gpa"),
    ingest.Rule("parses", "math_placement", "double"),
    ingest.Rule("allowed", "cohort_term", ("Fall", "Winter", "Spring", "Summer")),
]
register(
    "validate_submission",
    lambda s, d: ingest.validate_submission(mapped_submissions(s, d), _RULES),
    f"""WITH {_SUB}, f AS (
SELECT 'present' AS rule, c AS "column", 0 AS failures FROM (VALUES ('student_guid'),('cohort'),('cohort_term'),('enrollment_type')) v(c)
UNION ALL SELECT 'present', 'gpa', 1
UNION ALL SELECT 'not_null', 'student_guid', count(*) FROM sub WHERE trim(student_guid)=''
UNION ALL SELECT 'not_null', 'cohort', count(*) FROM sub WHERE cohort IS NULL
UNION ALL SELECT 'not_null', c, 0 FROM (VALUES ('cohort_term'),('enrollment_type')) v(c)
UNION ALL SELECT 'parses', 'math_placement', count(*) FROM sub
UNION ALL SELECT 'allowed', 'cohort_term', count(*) FROM sub WHERE cohort_term='Autumn')
SELECT *, failures=0 AS passed FROM f""",
)


def _target_and_batch(s, d):
    target = star.students(s, d).filter("substring(student_guid, 12, 1) <> '3'").select(
        "student_guid", "cohort", "enrollment_type", "race", "gender", "math_placement", "zip_code"
    )
    good, _ = ingest.validate_required(ingest.recode_values(mapped_submissions(s, d), SUBMISSION), SUBMISSION)
    return target, ingest.deidentify_for_table(good).drop("cohort_term")


def _upserted(s, d):
    return ingest.upsert(*_target_and_batch(s, d), ["student_guid"])


_UPSERT_SQL = with_ctes(["cohort_rows"], "@@").replace(
    "\n@@",
    f""",
{_SUB}, last AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY student_guid ORDER BY row_no DESC)=1),
target AS (SELECT * FROM cohort_rows WHERE substr(student_guid,12,1)<>'3')
SELECT coalesce(t.student_guid, l.student_guid) AS student_guid,
 CASE WHEN l.student_guid IS NOT NULL THEN l.cohort ELSE t.cohort END AS cohort,
 CASE WHEN l.student_guid IS NOT NULL THEN l.enrollment_type ELSE t.enrollment_type END AS enrollment_type,
 CASE WHEN l.student_guid IS NOT NULL THEN l.race ELSE t.race END AS race,
 CASE WHEN l.student_guid IS NOT NULL THEN l.gender ELSE t.gender END AS gender,
 CASE WHEN l.student_guid IS NOT NULL THEN l.math_placement ELSE t.math_placement END AS math_placement, t.zip_code
FROM target t FULL JOIN last l ON t.student_guid=l.student_guid""",
)
register("upsert", _upserted, _UPSERT_SQL)


PARTS = 4


def _in_parts(s, d):
    """The target as a stored table in 32 files or more, and the batch in parts by student number, upserted in turn: each
    part rewrites the files of its own students."""
    target, batch = _target_and_batch(s, d)
    table = SnapshotTable(s, folder(s, "students"))
    table.overwrite(target, keys=["student_guid"], file_rows=max(100, target.count() // 32))
    number = F.substring("student_guid", 4, 9).cast("long")
    most = star.students(s, d).agg(F.max(number)).first()[0]
    for part in range(PARTS):
        table.upsert(batch.filter(F.floor(number * PARTS / F.lit(most + 1)) == part))
    return table


register("upsert_by_file", lambda s, d: _in_parts(s, d).read(), _UPSERT_SQL)


def _versions_read(s, d):
    """What every version of the table holds, the older ones read after the newer were published."""
    table, out = _in_parts(s, d), None
    for version in table.versions():
        counts = table.read(version).groupBy("math_placement").agg(
            F.count("*").alias("students"), F.count("zip_code").alias("zips"), F.min("student_guid").alias("first_student")
        )
        counts = counts.withColumn("version", F.lit(version))
        out = counts if out is None else out.unionByName(counts)
    return out


register(
    "upsert_versions",
    _versions_read,
    with_ctes(["cohort_rows"], "@@").replace(
        "\n@@",
        f""",
{_SUB}, last AS (SELECT *, floor(CAST(substr(student_guid,4,9) AS BIGINT) * {PARTS} / (SELECT max(c_custkey)+1 FROM customer)) AS part FROM good
 QUALIFY row_number() OVER (PARTITION BY student_guid ORDER BY row_no DESC)=1),
target AS (SELECT * FROM cohort_rows WHERE substr(student_guid,12,1)<>'3'),
merged AS (SELECT coalesce(t.student_guid, l.student_guid) AS student_guid, t.student_guid IS NOT NULL AS known, l.part, t.zip_code,
 t.math_placement AS old, l.math_placement AS new FROM target t FULL JOIN last l ON t.student_guid=l.student_guid),
held AS (SELECT version, student_guid, zip_code, CASE WHEN coalesce(part < version - 1, false) THEN new ELSE old END AS math_placement
 FROM merged, range(1, {PARTS + 2}) v(version) WHERE known OR part < version - 1)
SELECT CAST(version AS INTEGER) AS version, math_placement, count(*) AS students, count(zip_code) AS zips, min(student_guid) AS first_student
FROM held GROUP BY 1,2""",
    ),
)
register(
    "upsert_keys_only",
    lambda s, d: ingest.upsert(
        star.students(s, d).filter("cohort <> '2021-22'").select("student_guid", "cohort"),
        mapped_submissions(s, d).select("row_no", "student_guid").filter("trim(student_guid) <> ''"),
        ["student_guid"],
    ),
    with_ctes(
        ["cohort_rows"],
        """SELECT student_guid, cohort FROM cohort_rows WHERE cohort<>'2021-22'
UNION ALL SELECT student_guid, NULL FROM cohort_rows WHERE cohort='2021-22' AND k IN (SELECT o_custkey FROM orders WHERE o_orderkey%101<>0)""",
    ),
)

# ------------------------------------------------------------------ upload ledger

register(
    "upload_diffs",
    lambda s, d: ingest.upload_diffs(star.upload_history(s, d)),
    with_ctes(
        ["uploads"],
        """SELECT id, file_type, pid AS previous_id, rows_inserted-pi AS rows_inserted_delta, rows_skipped-ps AS rows_skipped_delta,
 error_count-pe AS error_count_delta, p AS percent_inserted_change,
 CASE WHEN pid IS NOT NULL THEN coalesce(abs(p)>=50, false) END AS large_swing
FROM (SELECT *, CASE WHEN pi>0 THEN floor((rows_inserted-pi)/CAST(pi AS DOUBLE)*1000+0.5)/10.0::DOUBLE END AS p FROM (
 SELECT *, lag(id) OVER w AS pid, lag(rows_inserted) OVER w AS pi, lag(rows_skipped) OVER w AS ps, lag(error_count) OVER w AS pe
 FROM uploads WINDOW w AS (PARTITION BY file_type ORDER BY uploaded_at, id)))""",
    ),
)
register(
    "upload_status",
    lambda s, d: ingest.upload_status_counts(star.upload_history(s, d).withColumn("status", ingest.upload_status())),
    with_ctes(
        ["uploads"],
        """SELECT CASE WHEN error_count>0 AND rows_inserted=0 THEN 'failed' WHEN error_count>0 THEN 'partial' ELSE 'success' END AS status, count(*) AS uploads
FROM uploads GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM uploads""",
    ),
)
register(
    "latest_upload_per_type",
    lambda s, d: ingest.latest_upload(star.upload_history(s, d)).select("id", "file_type", "filename", "rows_inserted"),
    with_ctes(
        ["uploads"],
        "SELECT id, file_type, filename, rows_inserted FROM uploads QUALIFY row_number() OVER (PARTITION BY file_type ORDER BY uploaded_at DESC, id DESC)=1",
    ),
)
register(
    "latest_upload_across_types",
    lambda s, d: ingest.latest_upload(star.upload_history(s, d), ["course_ar", "ml_predictions"]).select("id", "file_type"),
    with_ctes(
        ["uploads"],
        "SELECT id, file_type FROM uploads WHERE file_type IN ('course_ar','ml_predictions') ORDER BY uploaded_at DESC, id DESC LIMIT 1",
    ),
)
register(
    "upload_history_page",
    lambda s, d: ingest.upload_history_page(star.upload_history(s, d), 2, 80).select("id", "user_email", "filename"),
    with_ctes(
        ["uploads"], "SELECT id, user_email, filename FROM uploads ORDER BY uploaded_at DESC, id DESC LIMIT 80 OFFSET 80"
    ),
)
register(
    "audit_log",
    lambda s, d: files.audit_entries(star.audit_lines(s, d), "2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z"),
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, 'inst' || CAST(user_id%7 AS VARCHAR) AS institution,
 'show ' || event_type || ' for user ' || CAST(user_id AS VARCHAR) AS prompt, event_type AS "vizType", CAST(floor(value) AS BIGINT) AS "rowCount"
FROM events WHERE event_id%50<>7 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00.001'""",
)

# ------------------------------------------------------------------ raw and cleaned layers

_FIELDS = {"o_custkey": "bigint", "o_orderkey": "bigint", "o_totalprice": "double", "o_orderstatus": "string", "o_orderpriority": "int"}
register(
    "silver_extract",
    lambda s, d: ingest.silver_extract(
        ingest.bronze_rows(star.table(s, d, "orders"), "/orders", "b1"), _FIELDS, "o_custkey", "o_orderkey"
    ),
    """SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus, CAST(NULL AS INT) AS o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC)=1""",
)


def _bronze(s, d):
    return (
        ingest.bronze_rows(star.table(s, d, "orders"), "/orders", "b1")
        .unionByName(ingest.bronze_rows(star.table(s, d, "customer"), "/customer", "b1"))
        .unionByName(ingest.bronze_rows(star.table(s, d, "part"), "/part", "b2"))
    )


register(
    "counts_by_source",
    lambda s, d: ingest.counts_by_source(_bronze(s, d)).select("source_endpoint", "records"),
    """SELECT '/orders' AS source_endpoint, count(*) AS records FROM orders UNION ALL SELECT '/customer', count(*) FROM customer
UNION ALL SELECT '/part', count(*) FROM part""",
)
register(
    "run_history",
    lambda s, d: ingest.run_history(
        star.table(s, d, "events").selectExpr("event_id as run_id", "ts as started_at", "event_type as source"), 20
    ).select("run_id", "source"),
    "SELECT event_id AS run_id, event_type AS source FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
)
register(
    "record_counts",
    lambda s, d: ingest.record_counts({"course_enrollments": enrollments(s, d), "students": star.students(s, d)}),
    with_ctes(
        ["enr", "cohort_rows"],
        "SELECT 'course_enrollments' AS table_name, count(*) AS records FROM enr UNION ALL SELECT 'students', count(*) FROM cohort_rows",
    ),
)

# ------------------------------------------------------------------ sinks


def _saved(s, d):
    path = folder(s, "students")
    sinks.save_table(star.students(s, d).filter("gender = 'F'"), path)
    sinks.save_table(star.students(s, d).filter("gender = 'M'"), path, mode="append")
    return sinks.read_table(s, path).filter("upload_timestamp is not null").select("student_guid", "gender", "zip_code")


def _saved_or_kept(s, d):
    """Two saves fail, one in the job and one by its count; readers still find the rows of the save before."""
    path = folder(s, "students")
    students = star.students(s, d)
    sinks.save_table(students.filter("gender = 'F'"), path)
    broken = students.withColumn("zip_code", F.when(F.col("gender") == "M", F.raise_error(F.lit("broken row"))).otherwise(F.col("zip_code")))
    for df, expected in ((broken, None), (students, 0)):
        try:
            sinks.save_table(df, path, expected=expected)
        except (PySparkException, RuntimeError):
            continue
        raise AssertionError("the save must fail")
    return sinks.read_table(s, path).select("student_guid", "gender", "zip_code")


register(
    "save_table_after_failures",
    _saved_or_kept,
    with_ctes(["cohort_rows"], "SELECT student_guid, gender, zip_code FROM cohort_rows WHERE gender='F'"),
)
register("save_table", _saved, with_ctes(["cohort_rows"], "SELECT student_guid, gender, zip_code FROM cohort_rows"))


def _exported(s, d):
    path = folder(s, "export")
    rows = scored_rows(s, d).select("student_guid", "cohort", "student_age", "at_risk_alert", "enrollment_intensity_first_term")
    sinks.write_csv(rows, path)
    return files.read_text_table(s, path)


register(
    "write_csv",
    _exported,
    with_ctes(["scored"], "SELECT student_guid, cohort, student_age, at_risk_alert, enrollment_intensity_first_term FROM scored"),
)


def _course_file(s, d):
    path = folder(s, "courses")
    sinks.write_csv(star.raw_course_rows(s, d).drop("Cohort_Term"), path)
    return files.read_courses(s, path).groupBy("course_prefix", "grade").agg(
        F.count("*").alias("n"), F.sum("credits_attempted").alias("attempted"), F.count("cohort_term").alias("terms")
    )


register(
    "read_courses",
    _course_file,
    with_ctes(
        ["enr"],
        """SELECT course_prefix, CASE WHEN grade<>'' THEN grade END AS grade, count(*) AS n,
 sum(CASE WHEN delivery_method='O' AND grade='F' THEN NULL ELSE credits_attempted END) AS attempted, 0 AS terms
FROM enr WHERE NOT coalesce(delivery_method='H' AND gateway_type='E' AND grade='W', false) GROUP BY 1,2""",
    ),
)


def _student_file(s, d):
    path = folder(s, "cohort")
    rows = star.students(s, d)
    sinks.write_csv(rows.withColumnsRenamed({c: f" {c.upper()} " for c in rows.columns}), path)
    return files.read_students(s, path).groupBy("cohort", "retention").agg(
        F.count("*").alias("n"), F.round(F.avg("gpa_group_year_1"), 6).alias("gpa"), F.max("years_to_bachelors_at_cohort_inst_").alias("years")
    )


register(
    "read_students",
    _student_file,
    with_ctes(
        ["cohort_rows"],
        "SELECT cohort, retention, count(*) AS n, round(avg(gpa_group_year_1),6) AS gpa, max(y_bach) AS years FROM cohort_rows GROUP BY 1,2",
    ),
)


def _numbered(s, d):
    """Rows of a one-chunk-per-file export carry a sequence; the position must follow it in every file."""
    path = folder(s, "numbered")
    orders = star.table(s, d, "orders").select("o_orderkey").repartition("o_orderkey").sortWithinPartitions("o_orderkey")
    sinks.write_csv(orders, path)
    rows = files.number_rows(files.read_text_table(s, path))
    earlier = F.lag(F.col("o_orderkey").cast("long")).over(Window.partitionBy("file").orderBy("row_no"))
    rows = rows.withColumn("in_order", F.coalesce(earlier < F.col("o_orderkey").cast("long"), F.lit(True)))
    ranked = rows.groupBy("file").agg(
        F.bool_and("in_order").alias("in_order"),
        F.count("*").alias("n"), F.min("row_no").alias("lowest"), F.max("row_no").alias("highest"),
        F.count_distinct("row_no").alias("distinct_numbers"),
    )
    return ranked.agg(
        F.sum("n").alias("orders"),
        F.bool_and((F.col("lowest") == 1) & (F.col("highest") == F.col("n")) & (F.col("distinct_numbers") == F.col("n"))).alias("dense"),
        F.bool_and("in_order").alias("in_order"),
    )


register("number_rows", _numbered, "SELECT count(*) AS orders, true AS dense, true AS in_order FROM orders")


def _bronze_loaded(s, d):
    path = folder(s, "bronze")
    sinks.bronze_load(star.table(s, d, "orders"), path, "/orders", "b1")
    sinks.bronze_load(star.table(s, d, "customer"), path, "/customer", "b2")
    sinks.bronze_load(star.table(s, d, "customer"), path, "/customer", "b2")
    return s.read.parquet(path).groupBy("etl_batch_id", "source_endpoint").agg(
        F.count("*").alias("n"), F.min(F.get_json_object("data", "$.c_name")).alias("first_name")
    )


register(
    "bronze_load",
    _bronze_loaded,
    """SELECT 'b1' AS etl_batch_id, '/orders' AS source_endpoint, count(*) AS n, CAST(NULL AS VARCHAR) AS first_name FROM orders
UNION ALL SELECT 'b2', '/customer', count(*), min(c_name) FROM customer""",
)


def _ledger(s, d):
    path = folder(s, "ledger")
    run = sinks.start_run(s, path, "rule_engine", "rules_v1")
    n = star.students(s, d).count()
    sinks.finish_run(s, path, run, n, n - 2, 2, ["a", "b"])
    return sinks.run_ledger(s, path).select(
        "source", "model_version", "triggered_by", "students_input", "students_scored", "errors", "error_sample",
        F.col("completed_at").isNotNull().alias("completed"),
    )


register(
    "run_ledger",
    _ledger,
    """SELECT 'rule_engine' AS source, 'rules_v1' AS model_version, 'manual' AS triggered_by, count(*) AS students_input,
 count(*)-2 AS students_scored, 2 AS errors, '["a", "b"]' AS error_sample, true AS completed FROM customer""",
)
register(
    "personal_column_scan",
    lambda s, d: privacy.personal_column_scan(
        {"uploads": star.upload_history(s, d), "students": star.students(s, d), "submissions": mapped_submissions(s, d)}
    ),
    with_ctes(["uploads", "cohort_rows"], "@@").replace(
        "\n@@",
        f""",
{_SUB} SELECT 'uploads' AS table_name, 'user_email' AS column_name, count(user_email) AS filled FROM uploads
 UNION ALL SELECT 'students', 'student_guid', count(student_guid) FROM cohort_rows
 UNION ALL SELECT 'submissions', 'student_guid', count(student_guid) FROM sub""",
    ),
)
