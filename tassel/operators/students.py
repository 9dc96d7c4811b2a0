"""Student table: course features and the joins that bring the three inputs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import grade_points, is_failing, is_passing
from ..functions.numeric import safe_divide


def _gateway_count(code: str) -> Column:
    return F.count_if(F.col("gateway_type").isin(code, "Y"))


def _term_count(word: str) -> Column:
    return F.count_if(F.upper("academic_term").contains(word))


def _distinct(name: str) -> Column:
    """Number of distinct values. The sets are tiny (prefixes, years, terms of one student), and unlike
    count(distinct) they do not multiply the rows that are shuffled."""
    return F.size(F.collect_set(name)).cast("bigint")


def course_features(enrollments: DataFrame) -> DataFrame:
    """29 features per student in one grouped aggregate; rows without a student id are dropped."""
    rows = enrollments.filter(F.col("student_guid").isNotNull()).withColumn("points", grade_points())
    grouped = rows.groupBy("student_guid").agg(
        F.count("*").alias("total_courses_enrolled"),
        _distinct("course_prefix").alias("unique_course_prefixes"),
        F.coalesce(F.sum("credits_attempted"), F.lit(0.0)).alias("total_credits_attempted"),
        F.coalesce(F.sum("credits_earned"), F.lit(0.0)).alias("total_credits_earned"),
        F.avg("credits_attempted").alias("avg_credits_per_course"),
        F.count("points").alias("courses_with_grades"),
        # points have one decimal: summed as whole tenths the mean is exact, so a student at 2.0 does not
        # fall below the threshold depending on the order of the rows
        F.try_divide(F.sum((F.col("points") * 10 + 0.5).cast("int")), F.count("points") * 10).alias("average_grade"),
        F.min("points").alias("min_grade"),
        F.max("points").alias("max_grade"),
        F.coalesce(F.stddev_samp("points"), F.lit(0.0)).alias("grade_std_dev"),
        F.count_if(is_failing()).alias("failing_grades_count"),
        F.count_if(is_passing()).alias("passing_grades_count"),
        F.count_if("is_core_course").alias("core_courses_taken"),
        _gateway_count("M").alias("gateway_math_courses"),
        _gateway_count("E").alias("gateway_english_courses"),
        F.count_if("is_co_requisite").alias("corequisite_courses"),
        F.count_if(F.col("delivery_method") == "O").alias("online_courses"),
        F.count_if(F.col("delivery_method") == "F").alias("face_to_face_courses"),
        F.count_if(F.col("delivery_method") == "H").alias("hybrid_courses"),
        _distinct("academic_year").alias("unique_academic_years"),
        _distinct("academic_term").alias("unique_academic_terms"),
        _term_count("FALL").alias("fall_courses"),
        _term_count("SPRING").alias("spring_courses"),
        _term_count("SUMMER").alias("summer_courses"),
        F.count_if(F.col("instructor_status") == "FT").alias("courses_with_fulltime_instructors"),
        F.count_if(F.col("instructor_status") == "PT").alias("courses_with_parttime_instructors"),
        F.count_if(F.col("enrolled_at_other_institutions") == "Y").alias("enrolled_other_institutions"),
    )
    graded = F.col("passing_grades_count") + F.col("failing_grades_count")
    delivered = F.col("online_courses") + F.col("face_to_face_courses") + F.col("hybrid_courses")
    return grouped.withColumns(
        {
            "course_completion_rate": safe_divide("total_credits_earned", "total_credits_attempted"),
            "passing_rate": safe_divide("passing_grades_count", graded),
            "pct_online": safe_divide("online_courses", delivered),
        }
    ).drop("passing_grades_count")


def prefix_academic_records(records: DataFrame) -> DataFrame:
    """Academic-record columns renamed for the join: key aligned, others prefixed, zip code dropped."""
    names = {"student_id": "student_guid", "id": "ar_id"}
    names |= {c: f"ar_{c}" for c in records.columns if c not in ("student_id", "id", "student_guid", "zip_code")}
    return records.drop("zip_code").withColumnsRenamed(names)


def student_table(cohort: DataFrame, records: DataFrame | None, enrollments: DataFrame) -> DataFrame:
    """One row per student: cohort, academic record if any, course features if any."""
    out = cohort
    if records is not None:
        out = out.join(prefix_academic_records(records), "student_guid", "left")
    return out.join(course_features(enrollments), "student_guid", "left")


def without_courses(students: DataFrame, enrollments: DataFrame) -> DataFrame:
    return students.join(enrollments.select("student_guid"), "student_guid", "left_anti")


def with_courses(students: DataFrame, enrollments: DataFrame) -> DataFrame:
    return students.join(enrollments.select("student_guid"), "student_guid", "left_semi")


def merge_summary(student_rows: DataFrame) -> DataFrame:
    n = F.col("total_courses_enrolled")
    return student_rows.agg(
        F.count("*").alias("students"),
        F.count(n).alias("with_courses"),
        F.count_if(n.isNull()).alias("without_courses"),
        F.round(F.avg(n), 1).alias("avg_courses"),
    )


def enrollments_with_predictions(enrollments: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every enrollment row with its student's predictions."""
    return enrollments.join(predictions, "student_guid", "left")


def attach_system_ids(students: DataFrame, id_map: DataFrame) -> DataFrame:
    """Left join to the id map; Spark picks a broadcast when the map's size allows it."""
    return students.join(id_map.select("student_guid", "sis_id"), "student_guid", "left")


def aid_with_recommendations(aid: DataFrame, recommendations: DataFrame, school: str | None = None) -> DataFrame:
    """Financial aid matched to recommendations of the same student at the same school."""
    out = aid.join(recommendations, ["school", "student_guid"])
    return out.filter(F.col("school") == school) if school else out


def normalize_institution_id(students: DataFrame) -> DataFrame:
    """Institution id as text without commas and spaces."""
    return students.withColumn("institution_id", F.translate(F.col("institution_id").cast("string"), ", ", ""))
