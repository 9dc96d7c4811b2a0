"""Dashboard aggregates."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tassel.functions import scoring
from tassel.operators import dashboards, privacy, roster, scored
from tassel.session import checkpoint_dir
from tassel.sources import star

from .base_sql import pct, with_ctes
from .registry import register
from .tables import enrollments, readiness_rows, scored_rows, student_rows

_KPI = """SELECT round(coalesce(avg(retention)*100,0),1) AS overall_retention_rate,
 round(coalesce(avg(retention_probability)*100,0),1) AS avg_predicted_retention,
 count(*) FILTER (WHERE at_risk_alert IN ('HIGH','URGENT')) AS high_critical_risk_count,
 round(coalesce(avg(course_completion_rate)*100,0),1) AS avg_course_completion_rate, count(*) AS total_students FROM scored"""
register("kpis", lambda s, d: dashboards.kpis(scored_rows(s, d)), with_ctes(["scored"], _KPI))
register(
    "kpis_filtered",
    lambda s, d: dashboards.kpis(
        scored_rows(s, d), cohort="2020-21", enrollment_type="Part-Time", credential_type="Certificate"
    ),
    with_ctes(
        ["scored"],
        _KPI
        + " WHERE cohort='2020-21' AND enrollment_intensity_first_term='Part-Time' AND predicted_credential_label='Certificate'",
    ),
)


def _dist(column: str) -> str:
    return f"""SELECT category, n AS count, {pct('n', 'total')} AS percentage FROM
 (SELECT {column} AS category, count(*) AS n, sum(count(*)) OVER () AS total FROM scored GROUP BY 1) WHERE category IS NOT NULL"""


register(
    "risk_alert_distribution",
    lambda s, d: dashboards.risk_alert_distribution(scored_rows(s, d)),
    with_ctes(["scored"], _dist("at_risk_alert")),
)
register(
    "retention_risk_distribution",
    lambda s, d: dashboards.retention_risk_distribution(scored_rows(s, d)),
    with_ctes(["scored"], _dist("retention_risk_category")),
)
for _column, _order, _keep in (
    ("retention_risk_category", scoring.RETENTION_ORDER, True),
    ("at_risk_alert", scoring.ALERT_ORDER, True),
    ("predicted_credential_label", list(scoring.CREDENTIAL_LABELS.values()), False),
    ("gateway_math_risk", scoring.GATEWAY_ORDER, False),
    ("gateway_english_risk", scoring.GATEWAY_ORDER, False),
    ("academic_risk_level", scoring.ACADEMIC_ORDER, False),
    ("gpa_performance", scoring.PERFORMANCE_ORDER, False),
):
    _values = ", ".join(f"({i}, '{x}')" for i, x in enumerate(_order))
    register(
        f"band_{_column}",
        lambda s, d, c=_column, o=_order, k=_keep: dashboards.band_distribution(scored_rows(s, d), c, o, k),
        with_ctes(
            ["scored"],
            f"""SELECT * FROM (SELECT position, label, (SELECT count(*) FROM scored WHERE {_column}=label) AS count,
 {pct(f'(SELECT count(*) FROM scored WHERE {_column}=label)', '(SELECT count(*) FROM scored)')} AS percentage
FROM (VALUES {_values}) AS v(position, label)) {'' if _keep else 'WHERE count > 0'}""",
        ),
    )
register(
    "prediction_summary",
    lambda s, d: dashboards.prediction_summary(scored_rows(s, d)),
    with_ctes(
        ["scored"],
        """SELECT round(avg(predicted_time_to_credential),6) AS mean_time_to_credential,
 round(median(predicted_time_to_credential),6) AS median_time_to_credential,
 round(avg(gateway_math_probability),6) AS mean_gateway_math_probability, count(gateway_math_probability) AS gateway_math_scored,
 round(avg(gateway_english_probability),6) AS mean_gateway_english_probability, count(gateway_english_probability) AS gateway_english_scored,
 round(avg(low_gpa_probability),6) AS mean_low_gpa_probability, count(*) FILTER (WHERE low_gpa_probability>=0.5) AS low_gpa_predicted FROM scored""",
    ),
)
register(
    "metric_retention_by_enrollment",
    lambda s, d: dashboards.metric_query(scored_rows(s, d), "retention", "enrollment"),
    with_ctes(
        ["scored"],
        """SELECT coalesce(enrollment_intensity_first_term,'Unknown') AS enrollment, round(avg(retention),2) AS retention FROM scored GROUP BY 1""",
    ),
)
register(
    "metric_completion_by_term",
    lambda s, d: dashboards.metric_query(scored_rows(s, d), "completion", "term", {"gender": "F"}),
    with_ctes(
        ["scored"],
        "SELECT cohort_term AS term, round(avg(persistence),2) AS completion FROM scored WHERE gender='F' GROUP BY 1",
    ),
)
register(
    "metric_gpa_by_program",
    lambda s, d: dashboards.metric_query(scored_rows(s, d), "gpa", "program", {"cohort": 2021}),
    with_ctes(
        ["scored"],
        # from whole ten-thousandths: a floating-point round takes a mean of exactly 2.115 down
        """SELECT program, (2*s + 100*n) // (200*n) / 100.0::DOUBLE AS gpa FROM (SELECT program_of_study_year_1 AS program,
 CAST(sum(CAST(round(gpa_group_year_1*10000) AS BIGINT)) AS BIGINT) AS s, count(gpa_group_year_1) AS n FROM scored WHERE cohort LIKE '2021-%' GROUP BY 1)""",
    ),
)
register(
    "metric_credits_overall",
    lambda s, d: dashboards.metric_query(scored_rows(s, d), "credits"),
    with_ctes(["scored"], "SELECT round(avg(number_of_credits_earned_year_1),2) AS credits FROM scored"),
)
register(
    "metric_count_by_course",
    lambda s, d: dashboards.metric_query(enrollments(s, d), None, "course"),
    with_ctes(["enr"], "SELECT course_prefix AS course, count(*) AS count FROM enr GROUP BY 1"),
)
register(
    "age_segments",
    lambda s, d: dashboards.age_segments(scored_rows(s, d)),
    with_ctes(
        ["scored"],
        """SELECT CASE WHEN student_age IN ('20 and younger','>20 - 24') THEN 'Under 25' ELSE '25 and over' END AS segment, count(*) AS students FROM scored GROUP BY 1""",
    ),
)
for _target, _expr in (
    ("target_retention", "coalesce(retention,0)"),
    ("target_low_gpa", "CASE WHEN gpa_group_year_1<2.0 THEN 1 ELSE 0 END"),
):
    register(
        f"distribution_{_target}",
        lambda s, d, t=_target: dashboards.target_distribution(scored.with_targets(student_rows(s, d)), t),
        with_ctes(["stu"], f"SELECT {_expr} AS value, count(*) AS students FROM stu GROUP BY 1"),
    )
register(
    "dashboard_extract",
    lambda s, d: dashboards.dashboard_extract(scored_rows(s, d)),
    with_ctes(
        ["scored"],
        f"""SELECT 'kpi' AS section, label, CAST(value AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS percentage FROM
 (UNPIVOT (SELECT CAST(overall_retention_rate AS DOUBLE) AS overall_retention_rate, CAST(avg_predicted_retention AS DOUBLE) AS avg_predicted_retention,
   CAST(high_critical_risk_count AS DOUBLE) AS high_critical_risk_count, CAST(avg_course_completion_rate AS DOUBLE) AS avg_course_completion_rate,
   CAST(total_students AS DOUBLE) AS total_students FROM ({_KPI})) ON COLUMNS(*) INTO NAME label VALUE value)
UNION ALL SELECT 'risk_alert', category, CAST(count AS DOUBLE), percentage FROM ({_dist('at_risk_alert')})
UNION ALL SELECT 'retention_risk', category, CAST(count AS DOUBLE), percentage FROM ({_dist('retention_risk_category')})""",
    ),
)

# ------------------------------------------------------------------ roster

_ROSTER = """student_guid, cohort, enrollment_intensity_first_term AS enrollment_intensity, at_risk_alert,
 round(retention_probability*100,1) AS retention_pct, CAST(round(CAST(readiness_score AS DECIMAL(5,4))*100,1) AS DOUBLE) AS readiness_pct, readiness_level,
 round(gateway_math_probability*100,1) AS gateway_math_pct, round(gateway_english_probability*100,1) AS gateway_english_pct,
 round(low_gpa_probability*100,1) AS gpa_risk_pct, round(predicted_time_to_credential,1) AS time_to_credential,
 predicted_credential_label AS credential_type"""
_RANK = "CASE at_risk_alert WHEN 'URGENT' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


def _roster(s, d, **options):
    return roster.roster(scored_rows(s, d), readiness_rows(s, d), **options)


register(
    "roster_worst_first",
    lambda s, d: _roster(s, d, worst_first=True),
    with_ctes(
        ["ready"],
        f"SELECT {_ROSTER} FROM ready ORDER BY {_RANK}, retention_probability DESC NULLS FIRST, student_guid LIMIT 50",
    ),
)
register(
    "roster_alert_descending",
    lambda s, d: _roster(s, d, page=2, page_size=40),
    with_ctes(
        ["ready"],
        f"SELECT {_ROSTER} FROM ready ORDER BY {_RANK} DESC, retention_probability DESC NULLS FIRST, student_guid LIMIT 40 OFFSET 40",
    ),
)
register(
    "roster_by_readiness",
    lambda s, d: _roster(s, d, sort_by="readiness_score", descending=False, page_size=500, alerts=["HIGH", "URGENT"]),
    with_ctes(
        ["ready"],
        f"SELECT {_ROSTER} FROM ready WHERE at_risk_alert IN ('HIGH','URGENT') ORDER BY readiness_score, student_guid LIMIT 500",
    ),
)
register(
    "roster_search",
    lambda s, d: _roster(s, d, search="stu0000000", tier="MEDIUM", credential="Associate", sort_by="cohort"),
    with_ctes(
        ["ready"],
        f"""SELECT {_ROSTER} FROM ready WHERE student_guid ILIKE '%stu0000000%' AND readiness_level='medium' AND predicted_credential_label='Associate'
ORDER BY ready.cohort DESC NULLS FIRST, student_guid LIMIT 50""",
    ),
)


PAGES, PAGE_SIZE = (1, 7, 15), 40


def _stored_pages(s, d):
    """Pages near both ends and in the middle, read from a roster that is stored in ranges of about 100 rows or more."""
    folder = f"{checkpoint_dir(s)}/roster-{uuid.uuid4().hex}"
    rows = scored_rows(s, d)
    stored = roster.StoredRoster(s, folder).write(rows, readiness_rows(s, d), max(100, rows.count() // 16))
    pages = [stored.page(p, PAGE_SIZE).withColumn("page", F.lit(p)) for p in PAGES]
    return reduce(DataFrame.unionAll, pages)


register(
    "roster_stored_pages",
    _stored_pages,
    with_ctes(
        ["ready"],
        f"""SELECT * FROM (SELECT {_ROSTER}, CAST((row_number() OVER (ORDER BY {_RANK} DESC, retention_probability DESC NULLS FIRST, student_guid) - 1) // {PAGE_SIZE} + 1 AS INTEGER) AS page
 FROM ready) WHERE page IN {PAGES}""",
    ),
)
register(
    "roster_count",
    lambda s, d: roster.roster_count(scored_rows(s, d), readiness_rows(s, d), tier="high"),
    with_ctes(
        ["ready"],
        "SELECT count(*) AS total, CAST(ceil(count(*)/50.0) AS BIGINT) AS page_count FROM ready WHERE readiness_level='high'",
    ),
)
register(
    "roster_all_rows",
    lambda s, d: roster.roster_projection(roster.join_readiness(scored_rows(s, d), readiness_rows(s, d))),
    with_ctes(["ready"], f"SELECT {_ROSTER} FROM ready"),
)


def _detail(s, d):
    one = roster.student_detail(scored_rows(s, d), readiness_rows(s, d), "STU000000042")
    return one.select(
        "student_guid",
        "readiness_pct",
        "rationale",
        F.array_join("risk_factors", " | ").alias("risk_factors"),
        F.array_join("suggested_actions", " | ").alias("suggested_actions"),
    )


register(
    "student_detail",
    _detail,
    with_ctes(
        ["ready"],
        """SELECT student_guid, CAST(round(CAST(readiness_score AS DECIMAL(5,4))*100,1) AS DOUBLE) AS readiness_pct, rationale, array_to_string(factors,' | ') AS risk_factors,
 array_to_string(actions,' | ') AS suggested_actions FROM ready WHERE student_guid='STU000000042'""",
    ),
)

# ------------------------------------------------------------------ drill-through

_SOURCE = """cohort, enrollment_intensity_first_term AS enrollment_intensity, retention, round(retention_probability*100,1) AS retention_pct,
 at_risk_alert, retention_risk_category, round(course_completion_rate*100,1) AS course_completion_pct FROM scored"""
register(
    "drill_through_alert_segment",
    lambda s, d: roster.drill_through(
        scored_rows(s, d), "risk_alert_segment", category="HIGH", show_ids=True, cohort="2019-20", page=2, page_size=20
    ),
    with_ctes(
        ["scored"],
        f"SELECT student_guid, {_SOURCE} WHERE at_risk_alert='HIGH' AND scored.cohort='2019-20' ORDER BY student_guid LIMIT 20 OFFSET 20",
    ),
)
register(
    "drill_through_masked",
    lambda s, d: roster.drill_through(scored_rows(s, d), "high_critical_risk_count"),
    with_ctes(
        ["scored"],
        f"""SELECT CAST(NULL AS VARCHAR) AS student_guid, * FROM (SELECT {_SOURCE} WHERE at_risk_alert IN ('HIGH','URGENT') ORDER BY student_guid LIMIT 50)""",
    ),
)
for _metric, _given, _where in (
    ("overall_retention", {}, "true"),
    ("avg_predicted_retention", {"cohort": "2020-21"}, "cohort='2020-21'"),
    ("avg_course_completion", {"enrollment_type": "Full-Time"}, "enrollment_intensity_first_term='Full-Time'"),
    ("high_critical_risk_count", {}, "at_risk_alert IN ('HIGH','URGENT')"),
    ("retention_risk_segment", {"category": "Low Risk"}, "retention_risk_category='Low Risk'"),
    ("roster_cell", {"student_guid": "STU000000007"}, "student_guid='STU000000007'"),
):
    register(
        f"drill_through_count_{_metric}",
        lambda s, d, m=_metric, g=_given: roster.drill_through_count(scored_rows(s, d), m, **g),
        with_ctes(["scored"], f"SELECT count(*) AS row_count FROM scored WHERE {_where}"),
    )
_LATEST = """SELECT id AS upload_id, filename AS upload_file, file_type AS upload_type FROM uploads
WHERE file_type IN ('pdp_cohort_ar','pdp_cohort_submission','ml_predictions') ORDER BY uploaded_at DESC, id DESC LIMIT 1"""
_STEPS = ", ".join(
    "({}, '{}', '{}')".format(i, title.replace("'", "''"), detail.replace("'", "''"))
    for i, (title, detail) in enumerate(
        [*roster.SHARED_STEPS, roster.METRIC_STEPS["roster_cell"], ("Cohort", "Read from cohort.")], 1
    )
)
register(
    "metric_provenance",
    lambda s, d: roster.metric_provenance(star.upload_history(s, d), "roster_cell", "cohort").select(
        "metric", "step", "title", "detail", "upload_id", "upload_file", "upload_type"
    ),
    with_ctes(
        ["uploads"],
        f"SELECT 'roster_cell' AS metric, step, title, detail, u.* FROM (VALUES {_STEPS}) t(step, title, detail), ({_LATEST}) u",
    ),
)

# ------------------------------------------------------------------ privacy


register(
    "published_by_cohort",
    lambda s, d: privacy.published(
        scored_rows(s, d),
        ["count(*) as students", "round(avg(risk_score), 6) as avg_risk"],
        group_by=["cohort"],
        where="student_guid <> 'STU000000001'",
    ),
    with_ctes(
        ["scored"],
        "SELECT cohort, count(*) AS students, round(avg(risk_score),6) AS avg_risk FROM scored WHERE student_guid<>'STU000000001' GROUP BY 1",
    ),
)


def _cells(s, d):
    cells = (
        scored_rows(s, d)
        .groupBy("zip_code", "race")
        .agg(F.count("*").alias("n"), F.round(F.avg("retention_probability"), 6).alias("avg_probability"))
    )
    return privacy.suppress_small_cells(cells, "n", ["avg_probability"], 4)


register(
    "suppress_small_cells",
    _cells,
    with_ctes(
        ["scored"],
        """SELECT zip_code, race, CASE WHEN n>=4 THEN n END AS n, CASE WHEN n>=4 THEN p END AS avg_probability, n<4 AS suppressed
FROM (SELECT zip_code, race, count(*) AS n, round(avg(retention_probability),6) AS p FROM scored GROUP BY 1,2)""",
    ),
)

SMALLEST = 4
_UP = "({changed} + CASE WHEN {0}='total' THEN 1 ELSE 0 END + CASE WHEN {1}='total' THEN 1 ELSE 0 END) % 2 = 0"
_CORNERS = ", ".join(
    f"{{'a': {a}, 'b': {b}, 'up': {_UP.format(a, b, changed=n)}}}"
    for a, b, n in (("c0", "c1", 0), ("w0", "c1", 1), ("c0", "w1", 1), ("w0", "w1", 2))
)
register(
    "protected_cells",
    lambda s, d: privacy.protected_cells(
        scored_rows(s, d), ["zip_code", "race"], SMALLEST, {"avg_probability": F.round(F.avg("retention_probability"), 6)}
    ),
    with_ctes(["scored"], "@@").replace(
        "\n@@",
        f""",
cube_rows AS (SELECT zip_code, race, grouping(zip_code)=1 AS all_zip_code, grouping(race)=1 AS all_race, count(*) AS n,
  round(avg(retention_probability),6) AS p FROM scored GROUP BY CUBE (zip_code, race)),
coded AS (SELECT *, CASE WHEN all_zip_code THEN 'total' ELSE coalesce('value ' || zip_code, 'no value') END AS c0,
  CASE WHEN all_race THEN 'total' ELSE coalesce('value ' || race, 'no value') END AS c1 FROM cube_rows),
near0 AS (SELECT c1, c0 AS w0 FROM coded QUALIFY c0='total' OR row_number() OVER (PARTITION BY c1, c0='total' ORDER BY n<2, n, c0) <= 9),
near1 AS (SELECT c0, c1 AS w1 FROM coded QUALIFY c1='total' OR row_number() OVER (PARTITION BY c0, c1='total' ORDER BY n<2, n, c1) <= 9),
boxes AS (SELECT s.c0, s.c1, w0, w1 FROM coded s JOIN near0 ON near0.c1=s.c1 AND w0<>s.c0 JOIN near1 ON near1.c0=s.c0 AND w1<>s.c1 WHERE n<{SMALLEST}),
corners AS (SELECT c0, c1, w0, w1, unnest([{_CORNERS}]) AS k FROM boxes),
judged AS (SELECT x.c0, x.c1, w0, w1, sum(CASE WHEN n>={SMALLEST} THEN n ELSE 0 END) AS cost
 FROM corners x JOIN coded y ON y.c0=k.a AND y.c1=k.b GROUP BY ALL
 HAVING count(*)=4 AND (coalesce(min(n) FILTER (k.up), 2)>=2 OR coalesce(min(n) FILTER (NOT k.up), 2)>=2)),
best AS (SELECT c0, c1, w0, w1 FROM judged QUALIFY row_number() OVER (PARTITION BY c0, c1 ORDER BY cost, w0, w1)=1),
hidden AS (SELECT DISTINCT k.a AS c0, k.b AS c1 FROM (SELECT unnest([{_CORNERS}]) AS k FROM best))
SELECT zip_code, race, all_zip_code, all_race, CASE WHEN h.c0 IS NULL THEN n END AS n, CASE WHEN h.c0 IS NULL THEN p END AS avg_probability,
 h.c0 IS NOT NULL AS suppressed FROM coded c LEFT JOIN hidden h ON h.c0=c.c0 AND h.c1=c.c1""",
    ),
)
register(
    "small_cell_report",
    lambda s, d: privacy.small_cell_report(scored_rows(s, d), ["race", "gender", "cohort", "zip_code"], 16),
    with_ctes(
        ["scored"],
        " UNION ALL ".join(
            f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n, count(*)<16 AS too_small FROM scored GROUP BY {c}"
            for c in ("race", "gender", "cohort", "zip_code")
        ),
    ),
)
