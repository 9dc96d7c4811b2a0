"""Streaming jobs, run over everything available and compared with the batch answer."""

import uuid

from pyspark.sql import functions as F

from tassel.session import checkpoint_dir
from tassel.sources import sinks, star
from tassel.sources.layouts import BY_ID
from tassel.sources.snapshots import SnapshotTable
from tassel.streaming import jobs

from .base_sql import DFWI, PASS, pct, with_ctes
from .registry import register


TURNS = 4


def _folder(s, name):
    return f"{checkpoint_dir(s)}/{name}-{uuid.uuid4().hex}"


def _in_turns(s, rows, at, name, write, job):
    """Rows arrive in four parts, by the number ``at``; after each the job, a function of the folder where they arrive
    and of its own, runs on from where it stopped."""
    base = _folder(s, name)
    bounds = rows.select(F.percentile_approx(at, [i / TURNS for i in range(1, TURNS)], 1000)).first()[0] or []
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = rows.filter(at >= low) if low is not None else rows
        part = part.filter(at < high) if high is not None else part
        write(part, f"{base}/in")
        out = job(f"{base}/in", f"{base}/job")
    return out


def _parquet(part, path):
    part.write.mode("append").parquet(path)


def _event_turns(s, d, name, job, write=_parquet):
    events = star.table(s, d, "events")
    stream = lambda path: star.audit_columns(s.readStream.schema(events.schema).parquet(path))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return _in_turns(s, events, at, name, write, lambda path, out: job(stream(path), out))


DAY_KEYS, WINDOW_KEYS, COURSE_KEYS = ["day_start", "institution", "viz_type"], ["window_start", "institution"], ["course_prefix", "course_number"]


def _daily(log):
    found = log.current()
    return found.select(F.col("day_start").cast("date").cast("string").alias("day"), "institution", "viz_type", "queries")


_INST = "'inst' || CAST(user_id%7 AS VARCHAR)"
_DAILY = f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_INST} AS institution, event_type AS viz_type, count(*) AS queries FROM events"
register(
    "stream_daily_counts",
    lambda s, d: _daily(_event_turns(s, d, "daily", lambda x, out: jobs.run_to_log(jobs.daily_counts(x), out, DAY_KEYS))),
    f"{_DAILY} GROUP BY 1,2,3",
)


def _log_turns(s, d):
    events = star.table(s, d, "events")

    def write(part, path):
        star.as_audit_lines(part).write.mode("append").text(path)

    def job(path, out):
        return jobs.run_to_log(jobs.daily_counts(jobs.stream_audit_log(s, path)), out, DAY_KEYS)

    return _in_turns(s, events, F.unix_micros(F.col("ts").cast("timestamp")), "log", write, job)


register(
    "stream_audit_log", lambda s, d: _daily(_log_turns(s, d)), f"{_DAILY} WHERE event_id%50<>7 GROUP BY 1,2,3"
)
register(
    "stream_sliding_activity",
    lambda s, d: _event_turns(
        s, d, "sliding", lambda x, out: jobs.run_to_log(jobs.sliding_activity(x), out, WINDOW_KEYS, fanout=2)
    ).current().select(F.unix_timestamp("window_start").alias("start_s"), "institution", "queries"),
    f"""SELECT w AS start_s, institution, count(*) AS queries FROM (
 SELECT {_INST} AS institution, unnest([b, b-7200, b-14400]) AS w FROM (SELECT *, CAST(floor(epoch(ts)/7200) AS BIGINT)*7200 AS b FROM events))
GROUP BY 1,2""",
)
register(
    "stream_activity_sessions",
    lambda s, d: _event_turns(s, d, "sessions", jobs.session_table).select(
        "user_id",
        F.unix_micros("session_start").alias("start_us"),
        F.unix_micros("session_end").alias("end_us"),
        "queries",
    ),
    """SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts))+1800000000 AS end_us, count(*) AS queries FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, sid""",
)


def _course_stream(s, d):
    """Order lines arrive in four parts by order; each changes most courses, and the log merges them on the way."""
    lines = star.table(s, d, "lineitem")

    def job(path, out):
        counts = jobs.running_course_counts(star.enrollments(s, d, s.readStream.schema(lines.schema).parquet(path)))
        return jobs.run_to_log(counts, out, COURSE_KEYS, fanout=2)

    log = _in_turns(s, lines, F.col("l_orderkey"), "courses", _parquet, job)
    return jobs.course_rates_so_far(log.current())


register(
    "stream_course_counts",
    _course_stream,
    with_ctes(
        ["enr"],
        f"""SELECT course_prefix, course_number, count(*) AS enrollments, count(*) FILTER (WHERE grade IN {DFWI}) AS dfwi_count,
 count(*) FILTER (WHERE {PASS}) AS pass_count, {pct(f'count(*) FILTER (WHERE grade IN {DFWI})', 'count(*)')} AS dfwi_rate,
 {pct(f'count(*) FILTER (WHERE {PASS})', 'count(*)')} AS pass_rate FROM enr GROUP BY 1,2""",
    ),
)


def _without_repeats(s, d):
    """Every event arrives twice in its own part and again with the next one, when state has dropped most of them."""
    sent = []

    def write(part, path):
        for rows in [*sent[-1:], part, part]:
            _parquet(rows, path)
        sent.append(part)

    unique = lambda x, out: jobs.run_to_table(jobs.without_repeats(x, ["event_id"], "ts", "1 day"), out)
    rows = _event_turns(s, d, "unique", unique, write)
    return rows.groupBy("viz_type").agg(F.count("*").alias("n"))


register("stream_without_repeats", _without_repeats, "SELECT event_type AS viz_type, count(*) AS n FROM events GROUP BY 1")


DROP_TURNS, FILES_A_TURN = 3, 2
DROP_LAYOUT = BY_ID["pdp_cohort_submission"]


def _drop_files(s, d, base):
    """Submission rows as files in their order: a turn holds a range of positions, a file a turn's rows of some students.
    The stream takes one file a micro-batch."""
    raw = star.submissions(s, d).withColumnRenamed("row_no", "position")
    bounds = raw.select(F.percentile_approx("position", [i / DROP_TURNS for i in range(1, DROP_TURNS)], 1000)).first()[0]
    student = next(c for c in raw.columns if c.lower().replace(" ", "_") in ("student_id", "student_guid"))
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = raw.filter(F.col("position") >= low) if low is not None else raw
        part = part.filter(F.col("position") < high) if high is not None else part
        dealt = part.repartition(FILES_A_TURN, student).sortWithinPartitions("position")
        sinks.write_csv(dealt.drop("position"), f"{base}/in", mode="append")
    return jobs.stream_text_files(s, f"{base}/in", [c for c in raw.columns if c != "position"], files_a_batch=1)


def _known(s, d):
    names = ["student_guid", "cohort", "enrollment_type", "math_placement", "school"]
    return star.students(s, d).filter("substring(student_guid, 12, 1) in ('1', '4')").select(*names)


def _dropped_files(s, d):
    """Files ingested one a micro-batch with compactions on the way, then upserted into a table that knows some of the
    students."""
    base = _folder(s, "drop")
    jobs.file_drop_ingest(_drop_files(s, d, base), DROP_LAYOUT, f"{base}/out", compact_every=4)
    return jobs.upserted(_known(s, d), DROP_LAYOUT, f"{base}/out")


def _dropped_upserts(s, d):
    """The same files upserted one a micro-batch into a stored table, each time into the files of its students only."""
    base, known = _folder(s, "drop"), _known(s, d)
    table = SnapshotTable(s, f"{base}/table")
    table.overwrite(known, keys=["student_guid"], file_rows=max(100, known.count() // 32))
    jobs.file_drop_upserts(_drop_files(s, d, base), DROP_LAYOUT, table, f"{base}/out")
    return table.read()


def _dropped_sql() -> str:
    from .q_ingest import _SUB

    return with_ctes(["cohort_rows"], "@@").replace(
        "\n@@",
        f""",
{_SUB}, newest AS (SELECT student_guid, cohort, enrollment_type, math_placement FROM good
  QUALIFY row_number() OVER (PARTITION BY student_guid ORDER BY row_no DESC)=1),
known AS (SELECT student_guid, cohort, enrollment_type, math_placement, school FROM cohort_rows WHERE substr(student_guid,12,1) IN ('1','4'))
SELECT coalesce(k.student_guid, n.student_guid) AS student_guid,
 CASE WHEN n.student_guid IS NOT NULL THEN nullif(n.cohort,'') ELSE k.cohort END AS cohort,
 CASE WHEN n.student_guid IS NOT NULL THEN nullif(n.enrollment_type,'') ELSE k.enrollment_type END AS enrollment_type,
 CASE WHEN n.student_guid IS NOT NULL THEN nullif(n.math_placement,'') ELSE k.math_placement END AS math_placement, school
FROM known k FULL JOIN newest n ON k.student_guid=n.student_guid""",
    )


register("file_drop_ingest", _dropped_files, _dropped_sql())
register("file_drop_upsert", _dropped_upserts, _dropped_sql())
