"""Readiness records and reports."""

from pyspark.sql import functions as F

from tassel.operators import readiness as r

from .base_sql import pct, with_ctes
from .q_students import rounded
from .registry import register
from .tables import readiness_rows, scored_rows

register(
    "readiness_scores",
    lambda s, d: rounded(
        r.with_readiness(scored_rows(s, d)).select(
            "student_guid", "academic_score", "engagement_score", "model_score", "readiness_score", "readiness_level"
        ),
        ["academic_score", "engagement_score", "model_score"],
    ),
    with_ctes(
        ["ready"],
        """SELECT student_guid, round(academic_score,6) AS academic_score, round(engagement_score,6) AS engagement_score,
 round(model_score,6) AS model_score, readiness_score, readiness_level FROM ready""",
    ),
)


def _lists(s, d):
    rows = readiness_rows(s, d)
    as_text = {c: F.array_join(F.from_json(c, "array<string>"), " | ") for c in ("risk_factors", "suggested_actions")}
    return rows.withColumns(as_text).select(
        "student_guid", "institution_id", "cohort", "cohort_term", F.col("readiness_score").cast("double").alias("readiness_score"),
        "readiness_level", "rationale", "risk_factors", "suggested_actions", "source", "model_version",
    )


register(
    "readiness_records",
    _lists,
    with_ctes(
        ["ready"],
        """SELECT student_guid, institution_id, cohort, cohort_term, readiness_score, readiness_level, rationale,
 array_to_string(factors,' | ') AS risk_factors, array_to_string(actions,' | ') AS suggested_actions,
 'rule_engine' AS source, 'rules_v1' AS model_version FROM ready""",
    ),
)
PROFILE = "enrollment_intensity string, gpa_year1 double, credits_earned_y1 double, gateway_math_completed string, at_risk_alert string, retention_risk_category string"


def _profile(s, d):
    parsed = readiness_rows(s, d).select("student_guid", F.from_json("input_features", PROFILE).alias("p"), F.size(F.json_object_keys("input_features")).alias("fields"))
    return parsed.select("student_guid", "fields", "p.*")


register(
    "safe_profile",
    _profile,
    with_ctes(
        ["scored"],
        """SELECT student_guid, 18 AS fields, enrollment_intensity_first_term AS enrollment_intensity, gpa_group_year_1 AS gpa_year1,
 number_of_credits_earned_year_1 AS credits_earned_y1, completedgatewaymathyear1 AS gateway_math_completed, at_risk_alert, retention_risk_category FROM scored""",
    ),
)
_LEVELS = ", ".join(f"count(*) FILTER (WHERE readiness_level='{x}') AS {x}_count" for x in ("high", "medium", "low"))
register(
    "readiness_summary",
    lambda s, d: r.readiness_summary(readiness_rows(s, d)),
    with_ctes(
        ["ready"],
        f"""SELECT count(*) AS total_students, round(avg(readiness_score),4) AS avg_score, min(readiness_score) AS min_score,
 max(readiness_score) AS max_score, {_LEVELS} FROM ready""",
    ),
)
register(
    "readiness_summary_filtered",
    lambda s, d: r.readiness_summary(
        r.select_readiness(
            readiness_rows(s, d), scored_rows(s, d), cohort="2020-21", enrollment_type="Part-Time", level="medium"
        )
    ),
    with_ctes(
        ["ready"],
        f"""SELECT count(*) AS total_students, round(avg(readiness_score),4) AS avg_score, min(readiness_score) AS min_score,
 max(readiness_score) AS max_score, {_LEVELS} FROM ready
WHERE cohort='2020-21' AND enrollment_intensity_first_term='Part-Time' AND readiness_level='medium'""",
    ),
)
register(
    "readiness_by_level",
    lambda s, d: r.readiness_by_level(readiness_rows(s, d)),
    with_ctes(
        ["ready"],
        """SELECT readiness_level, count(*) AS count, round(avg(readiness_score),6) AS avg_score, min(readiness_score) AS min_score,
 max(readiness_score) AS max_score FROM ready GROUP BY 1""",
    ),
)
_RANGE = """CASE WHEN readiness_score>=0.8 THEN '0.8-1.0' WHEN readiness_score>=0.6 THEN '0.6-0.8' WHEN readiness_score>=0.4 THEN '0.4-0.6'
 WHEN readiness_score>=0.2 THEN '0.2-0.4' ELSE '0.0-0.2' END"""
register(
    "readiness_histogram",
    lambda s, d: r.readiness_histogram(readiness_rows(s, d)),
    with_ctes(["ready"], f"SELECT {_RANGE} AS score_range, count(*) AS count FROM ready GROUP BY 1"),
)
register(
    "readiness_by_cohort",
    lambda s, d: r.readiness_by_cohort(readiness_rows(s, d)),
    with_ctes(
        ["ready"],
        f"SELECT cohort, count(*) AS total, round(avg(readiness_score),6) AS avg_score, {_LEVELS} FROM ready GROUP BY 1",
    ),
)
register(
    "readiness_by_major",
    lambda s, d: r.readiness_by_major(readiness_rows(s, d), scored_rows(s, d)),
    with_ctes(
        ["ready"],
        "SELECT program_of_study_year_1, count(*) AS students, round(avg(readiness_score),6) AS avg_score FROM ready GROUP BY 1",
    ),
)
register(
    "top_risk_factors",
    lambda s, d: r.top_risk_factors(readiness_rows(s, d), 10),
    with_ctes(
        ["ready"],
        """SELECT factor, count(*) AS count FROM (SELECT unnest(factors) AS factor FROM ready) GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""",
    ),
)


def _dated(s, d):
    """Records written at different times."""
    moment = F.timestamp_seconds(F.substring("student_guid", 4, 9).cast("bigint") % 977)
    return readiness_rows(s, d).withColumn("generated_at", moment)


register(
    "recent_assessments",
    lambda s, d: r.recent_assessments(_dated(s, d), 100).select(
        "student_guid", "readiness_level", F.size("risk_factors").alias("n_factors"), F.size("suggested_actions").alias("n_actions")
    ),
    with_ctes(
        ["ready"],
        """SELECT student_guid, readiness_level, len(factors) AS n_factors, len(actions) AS n_actions FROM ready ORDER BY CAST(substr(student_guid,4) AS BIGINT)%977 DESC, student_guid LIMIT 100""",
    ),
)
register(
    "readiness_extract",
    lambda s, d: r.readiness_extract(readiness_rows(s, d)),
    with_ctes(
        ["ready"],
        f"""SELECT section, label, n AS count, {pct('n', 'total')} AS percentage FROM (
 SELECT 'level' AS section, readiness_level AS label, count(*) AS n, (SELECT count(*) FROM ready) AS total FROM ready GROUP BY 2
 UNION ALL SELECT 'score_range', {_RANGE}, count(*), (SELECT count(*) FROM ready) FROM ready GROUP BY 2)""",
    ),
)


def _isolated(s, d):
    """Some students' GPA is text no number can be read from or blank, which counts as missing; some have an
    endless number of courses, which cannot be scored."""
    text = scored_rows(s, d).withColumn(
        "gpa_group_year_1",
        F.when(F.substring("student_guid", 11, 2) == "40", F.lit("three"))
        .when(F.substring("student_guid", 11, 2) == "41", F.lit(" "))
        .otherwise(F.col("gpa_group_year_1").cast("string")),
    )
    text = text.withColumn(
        "total_courses_enrolled",
        F.when(F.substring("student_guid", 11, 2) == "42", F.lit("inf")).otherwise(F.col("total_courses_enrolled").cast("string")),
    )
    good, bad = r.split_scorable(text)
    scored = r.with_readiness(good).groupBy(F.lit("scored").alias("outcome")).agg(
        F.count("*").alias("n"), F.count("gpa_group_year_1").alias("with_gpa"), F.count("readiness_score").alias("with_score")
    )
    failed = bad.groupBy(F.col("error").alias("outcome")).agg(
        F.count("*").alias("n"), F.count("gpa_group_year_1").alias("with_gpa"), F.lit(0).cast("long").alias("with_score")
    )
    return scored.unionByName(failed)


register(
    "score_with_error_isolation",
    _isolated,
    with_ctes(
        ["scored"],
        """SELECT CASE WHEN substr(student_guid,11,2)='42' THEN 'cannot convert float infinity to integer' ELSE 'scored' END AS outcome,
 count(*) AS n, count(gpa_group_year_1) FILTER (WHERE substr(student_guid,11,2) NOT IN ('40','41')) AS with_gpa,
 count(*) FILTER (WHERE substr(student_guid,11,2)<>'42') AS with_score FROM scored GROUP BY 1""",
    ),
)
