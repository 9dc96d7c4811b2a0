"""Student table, features, targets, scores."""

from pyspark.sql import functions as F

from tassel.functions.grades import grade_points, is_course_pass, is_dfwi, is_failing, is_passing
from tassel.operators import roster, scored, students
from tassel.sources import star

from .base_sql import DFWI, PASS, with_ctes
from .registry import register
from .tables import enrollments, scored_rows, student_rows

FEATURES = """total_courses_enrolled unique_course_prefixes total_credits_attempted total_credits_earned
avg_credits_per_course course_completion_rate courses_with_grades average_grade min_grade max_grade grade_std_dev
failing_grades_count passing_rate core_courses_taken gateway_math_courses gateway_english_courses corequisite_courses
online_courses face_to_face_courses hybrid_courses pct_online unique_academic_years unique_academic_terms fall_courses
spring_courses summer_courses courses_with_fulltime_instructors courses_with_parttime_instructors
enrolled_other_institutions""".split()
ROUNDED = {"avg_credits_per_course", "course_completion_rate", "average_grade", "grade_std_dev", "passing_rate", "pct_online"}


def rounded(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def _sql_columns(columns) -> str:
    return ", ".join(f"round({c},6) AS {c}" if c in ROUNDED else c for c in columns)


register(
    "course_features",
    lambda s, d: rounded(students.course_features(enrollments(s, d)), ROUNDED),
    with_ctes(["feat"], f"SELECT student_guid, {_sql_columns(FEATURES)} FROM feat"),
)
register(
    "enrollments_adapter",
    lambda s, d: enrollments(s, d)
    .groupBy("cohort", "academic_year", "academic_term", "gateway_type", "grade", "delivery_method", "instructor_status")
    .agg(
        F.count("*").alias("n"),
        F.sum("credits_attempted").alias("attempted"),
        F.sum("credits_earned").alias("earned"),
        F.count_if("is_core_course").alias("core"),
        F.count_if("is_co_requisite").alias("coreq"),
        F.min("student_guid").alias("first_student"),
        F.max("course_name").alias("last_course"),
    ),
    with_ctes(
        ["enr"],
        """SELECT cohort, academic_year, academic_term, gateway_type, grade, delivery_method, instructor_status,
 count(*) AS n, sum(credits_attempted) AS attempted, sum(credits_earned) AS earned,
 count(*) FILTER (WHERE is_core_course) AS core, count(*) FILTER (WHERE is_co_requisite) AS coreq,
 min(student_guid) AS first_student, max(course_name) AS last_course
FROM enr GROUP BY ALL""",
    ),
)
register(
    "grade_points",
    lambda s, d: enrollments(s, d)
    .groupBy("grade")
    .agg(
        F.max(grade_points()).alias("points"),
        F.max(is_failing().cast("int")).alias("failing"),
        F.max(is_passing().cast("int")).alias("passing"),
        F.max(is_dfwi().cast("int")).alias("dfwi"),
        F.max(is_course_pass().cast("int")).alias("course_pass"),
        F.count("*").alias("n"),
    ),
    with_ctes(
        ["enr"],
        f"""SELECT grade, max(CAST(CASE grade WHEN 'A' THEN 4.0 WHEN 'A-' THEN 3.7 WHEN 'B+' THEN 3.3 WHEN 'B' THEN 3.0
  WHEN 'B-' THEN 2.7 WHEN 'C+' THEN 2.3 WHEN 'C' THEN 2.0 WHEN 'C-' THEN 1.7 WHEN 'D' THEN 1.0 WHEN 'F' THEN 0.0 END AS DOUBLE)) AS points,
 max(CASE WHEN grade IN ('F','W','I') THEN 1 ELSE 0 END) AS failing,
 max(CASE WHEN grade IS NOT NULL AND grade NOT IN ('F','W','I') THEN 1 ELSE 0 END) AS passing,
 max(CASE WHEN grade IN {DFWI} THEN 1 ELSE 0 END) AS dfwi,
 max(CASE WHEN {PASS} THEN 1 ELSE 0 END) AS course_pass, count(*) AS n FROM enr GROUP BY grade""",
    ),
)


def _with_records(s, d):
    return students.student_table(star.students(s, d), star.academic_records(s, d), enrollments(s, d))


AR = ["ar_id", "ar_years_to_bachelors_cohort", "ar_years_to_assoc_cert_other", "ar_naspa_first_gen", "ar_school"]
register(
    "student_table",
    lambda s, d: rounded(_with_records(s, d).select("student_guid", "cohort", "zip_code", *AR, *FEATURES), ROUNDED),
    with_ctes(
        ["stu", "ar"],
        f"""SELECT stu.student_guid, cohort, zip_code, {', '.join(AR)}, {_sql_columns(FEATURES)}
FROM stu LEFT JOIN ar ON stu.student_guid=ar.student_guid""",
    ),
)
register(
    "academic_record_columns",
    lambda s, d: students.prefix_academic_records(star.academic_records(s, d)),
    with_ctes(["ar"], "SELECT * FROM ar"),
)
register(
    "merge_summary",
    lambda s, d: students.merge_summary(student_rows(s, d)),
    with_ctes(
        ["stu"],
        """SELECT count(*) AS students, count(total_courses_enrolled) AS with_courses,
 count(*) FILTER (WHERE total_courses_enrolled IS NULL) AS without_courses, round(avg(total_courses_enrolled),1) AS avg_courses FROM stu""",
    ),
)


register(
    "students_without_courses",
    lambda s, d: students.without_courses(star.students(s, d), enrollments(s, d)).select("student_guid", "cohort"),
    with_ctes(
        ["cohort_rows", "enr"],
        """SELECT student_guid, cohort FROM cohort_rows c WHERE NOT EXISTS
 (SELECT 1 FROM enr e WHERE e.student_guid=c.student_guid)""",
    ),
)
register(
    "students_with_courses",
    lambda s, d: students.with_courses(star.students(s, d), enrollments(s, d)).select("student_guid", "cohort"),
    with_ctes(
        ["cohort_rows", "enr"],
        """SELECT student_guid, cohort FROM cohort_rows c WHERE EXISTS
 (SELECT 1 FROM enr e WHERE e.student_guid=c.student_guid)""",
    ),
)
register(
    "enrollments_with_predictions",
    lambda s, d: students.enrollments_with_predictions(enrollments(s, d), scored.predictions(scored_rows(s, d)))
    .groupBy("course_prefix", "course_number", "at_risk_alert")
    .agg(F.count("*").alias("n"), F.round(F.avg("retention_probability"), 6).alias("avg_probability")),
    with_ctes(
        ["enr", "scored"],
        """SELECT course_prefix, course_number, at_risk_alert, count(*) AS n, round(avg(retention_probability),6) AS avg_probability
FROM enr LEFT JOIN (SELECT student_guid, at_risk_alert, retention_probability FROM scored) USING (student_guid) GROUP BY 1,2,3""",
    ),
)


def _id_map(s, d):
    return star.students(s, d).selectExpr("student_guid", "concat('SIS', right(student_guid, 6)) as sis_id").filter(
        "right(student_guid, 1) <> '3'"
    )


register(
    "id_crosswalk",
    lambda s, d: students.attach_system_ids(star.students(s, d).select("student_guid"), _id_map(s, d)),
    with_ctes(
        ["cohort_rows"],
        "SELECT student_guid, CASE WHEN right(student_guid,1)<>'3' THEN 'SIS' || right(student_guid,6) END AS sis_id FROM cohort_rows",
    ),
)
register(
    "normalize_institution_id",
    lambda s, d: students.normalize_institution_id(
        star.students(s, d).selectExpr("student_guid", "concat('1,', institution_id, ' 30') as institution_id")
    ),
    with_ctes(["cohort_rows"], "SELECT student_guid, '1' || institution_id || '30' AS institution_id FROM cohort_rows"),
)


def _aid(s, d):
    return star.students(s, d).selectExpr("school", "student_guid", "pell_status_first_year")


def _recommendations(s, d):
    return scored_rows(s, d).filter("at_risk_alert in ('HIGH', 'URGENT')").select(
        "school", "student_guid", "at_risk_alert"
    )


register(
    "aid_with_recommendations",
    lambda s, d: students.aid_with_recommendations(_aid(s, d), _recommendations(s, d), "ASIA"),
    with_ctes(
        ["scored"],
        """SELECT school, student_guid, pell_status_first_year, at_risk_alert FROM scored
WHERE at_risk_alert IN ('HIGH','URGENT') AND school='ASIA'""",
    ),
)
register(
    "targets",
    lambda s, d: scored.with_targets(student_rows(s, d)).selectExpr(
        "student_guid", "target_retention", "target_at_risk", "target_time_to_credential", "target_credential_type",
        "target_gateway_math", "target_gateway_english", "target_low_gpa",
    ),
    with_ctes(
        ["stu"],
        """SELECT student_guid, coalesce(retention,0) AS target_retention,
 CASE WHEN retention=0 OR persistence=0 OR average_grade<2.0 OR course_completion_rate<0.6 THEN 1 ELSE 0 END AS target_at_risk,
 least(CASE WHEN y_bach>0 THEN y_bach ELSE 99 END, CASE WHEN y_other>0 THEN y_other ELSE 99 END, CASE WHEN y_either>0 THEN y_either ELSE 99 END) AS target_time_to_credential,
 CASE WHEN y_bach>0 OR y_other>0 THEN 3 WHEN y_assoc>0 THEN 2 WHEN y_cert>0 THEN 1
  WHEN y_either>0 THEN CASE WHEN credential_type_sought_year_1 IN ('01','02','03','C1','C2') THEN 1 ELSE 2 END
  WHEN credential_type_sought_year_1 IN ('01','02','03','C1','C2') THEN 1
  WHEN credential_type_sought_year_1 = 'A' THEN 2 WHEN credential_type_sought_year_1 = 'B' THEN 3 ELSE 0 END AS target_credential_type,
 CASE completedgatewaymathyear1 WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS target_gateway_math,
 CASE completedgatewayenglishyear1 WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS target_gateway_english,
 CASE WHEN gpa_group_year_1<2.0 THEN 1 ELSE 0 END AS target_low_gpa FROM stu""",
    ),
)
register(
    "credential_target_completions_only",
    lambda s, d: scored.with_targets(student_rows(s, d), infer_from_sought=False)
    .groupBy("target_credential_type")
    .agg(F.count("*").alias("n")),
    with_ctes(
        ["stu"],
        """SELECT CASE WHEN y_bach>0 OR y_other>0 THEN 3 WHEN y_assoc>0 THEN 2 WHEN y_cert>0 THEN 1
  WHEN y_either>0 THEN CASE WHEN credential_type_sought_year_1 IN ('01','02','03','C1','C2') THEN 1 ELSE 2 END ELSE 0 END AS target_credential_type,
 count(*) AS n FROM stu GROUP BY 1""",
    ),
)
SCORES = """retention_risk_category at_risk_prediction at_risk_alert predicted_credential_label gateway_math_risk
gateway_english_risk academic_risk_level gpa_performance""".split()
register(
    "scored_students",
    lambda s, d: rounded(
        scored_rows(s, d).select(
            "student_guid", "risk_score", "at_risk_probability", "predicted_graduation_year", *SCORES
        ),
        ["risk_score", "at_risk_probability", "predicted_graduation_year"],
    ),
    with_ctes(
        ["scored"],
        f"""SELECT student_guid, round(risk_score,6) AS risk_score, round(at_risk_probability,6) AS at_risk_probability,
 round(predicted_graduation_year,6) AS predicted_graduation_year, {', '.join(SCORES)} FROM scored""",
    ),
)
register(
    "predictions",
    lambda s, d: scored.predictions(scored_rows(s, d)).select(
        "student_guid", "retention_prediction", "predicted_credential_type", "gpa_performance"
    ),
    with_ctes(
        ["scored"],
        "SELECT student_guid, retention_prediction, predicted_credential_type, gpa_performance FROM scored",
    ),
)
_RISK = """least(100.0::DOUBLE, (1.0::DOUBLE - retention_probability)*100*0.5::DOUBLE
  + CASE WHEN g<2.0 THEN 20.0 WHEN g<2.5 THEN 10.0 WHEN g<3.0 THEN 3.0 ELSE 0.0 END::DOUBLE
  + CASE WHEN c<0.5 THEN 20.0 WHEN c<0.7 THEN 10.0 WHEN c<0.85 THEN 5.0 ELSE 0.0 END::DOUBLE
  + CASE WHEN total_credits_earned<6 THEN 10.0 WHEN total_credits_earned<12 THEN 5.0 ELSE 0.0 END::DOUBLE)"""
_ALERT = "CASE WHEN r>=75 THEN 'URGENT' WHEN r>=50 THEN 'HIGH' WHEN r>=25 THEN 'MODERATE' WHEN r IS NOT NULL THEN 'LOW' END"
register(
    "scenario_counts",
    lambda s, d: scored.scenario_counts(scored_rows(s, d), 0.1, 0.3),
    with_ctes(
        ["scored"],
        f"""SELECT 'before' AS stage, at_risk_alert AS alert, count(*) AS students FROM scored GROUP BY 2
UNION ALL SELECT 'after', {_ALERT}, count(*) FROM (SELECT {_RISK} AS r FROM (SELECT *,
 CASE WHEN average_grade IS NOT NULL THEN least(4.0, greatest(0.0, average_grade+0.3::DOUBLE)) END AS g,
 CASE WHEN course_completion_rate IS NOT NULL THEN least(1.0, greatest(0.0, course_completion_rate+0.1::DOUBLE)) END AS c FROM scored)) GROUP BY 2""",
    ),
)


def _later(s, d):
    """A second snapshot: probabilities of every third cohort drop by 0.25."""
    rows = student_rows(s, d).withColumn(
        "retention_probability",
        F.when(
            F.substring("student_guid", 12, 1).isin("0", "3", "6", "9"),
            F.greatest(F.lit(0.0), F.col("retention_probability") - 0.25),
        ).otherwise(F.col("retention_probability")),
    )
    return scored.with_scores(rows)


_LATER = f"""later0 AS (SELECT * REPLACE (CASE WHEN substr(student_guid,12,1) IN ('0','3','6','9')
  THEN greatest(0.0::DOUBLE, retention_probability-0.25::DOUBLE) ELSE retention_probability END AS retention_probability),
  average_grade AS g, course_completion_rate AS c FROM stu),
later1 AS (SELECT *, {_RISK} AS r FROM later0), later AS (SELECT *, {_ALERT} AS alert2 FROM later1)"""


def _with_later(body: str) -> str:
    sql = with_ctes(["scored"], "@@")
    return sql.replace("\n@@", ",\n" + _LATER + "\n" + body)


register(
    "snapshot_changes",
    lambda s, d: scored.snapshot_changes(scored_rows(s, d), _later(s, d)),
    _with_later(
        """SELECT s.student_guid, s.at_risk_alert AS previous_alert, alert2 AS current_alert,
 coalesce(s.at_risk_alert<>alert2 AND alert2='URGENT', false) AS new_urgent,
 s.at_risk_alert='HIGH' AND alert2='LOW' AS high_to_low,
 s.retention_probability - l.retention_probability >= 0.2::DOUBLE AS probability_drop
FROM scored s JOIN later l ON s.student_guid=l.student_guid
WHERE s.at_risk_alert<>alert2 OR s.retention_probability - l.retention_probability >= 0.2::DOUBLE"""
    ),
)
register(
    "change_matrix",
    lambda s, d: scored.change_matrix(scored_rows(s, d), _later(s, d)),
    _with_later(
        """SELECT s.at_risk_alert AS previous_alert, alert2 AS current_alert, count(*) AS students
FROM scored s JOIN later l ON s.student_guid=l.student_guid GROUP BY 1,2"""
    ),
)
register(
    "contradictions",
    lambda s, d: scored.contradictions(scored_rows(s, d)),
    with_ctes(
        ["scored"],
        """SELECT count(*) FILTER (WHERE retention_probability>0.8 AND at_risk_alert='URGENT') AS likely_retained_but_urgent,
 count(*) FILTER (WHERE retention_probability<0.3 AND at_risk_alert='LOW') AS unlikely_retained_but_low FROM scored""",
    ),
)
register(
    "derived_flags",
    lambda s, d: scored.derived_flags(student_rows(s, d)),
    with_ctes(
        ["stu"],
        """SELECT student_guid, round(number_of_credits_earned_year_1/30.0::DOUBLE,4) AS on_track_share,
 coalesce(number_of_credits_earned_year_1>=24 AND gpa_group_year_1>=2.5, false) AS on_track,
 round(unique_course_prefixes/CAST(total_courses_enrolled AS DOUBLE),4) AS prefix_diversity FROM stu""",
    ),
)
register(
    "priority_students",
    lambda s, d: rounded(
        roster.priority_students(scored_rows(s, d), cohort="2021-22"),
        ["risk_score", "retention_probability", "course_completion_rate", "average_grade"],
    ),
    with_ctes(
        ["scored"],
        """SELECT student_guid, round(risk_score,6) AS risk_score, at_risk_alert, round(retention_probability,6) AS retention_probability,
 round(course_completion_rate,6) AS course_completion_rate, round(average_grade,6) AS average_grade, program_of_study_year_1, cohort, institution_id
FROM scored WHERE at_risk_alert IN ('HIGH','URGENT') AND cohort='2021-22'""",
    ),
)
