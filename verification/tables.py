"""The derived Spark tables the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tassel.operators import readiness, scored, students
from tassel.sources import star


def enrollments(spark: SparkSession, d: str) -> DataFrame:
    return star.enrollments(spark, d)


def student_rows(spark: SparkSession, d: str) -> DataFrame:
    return students.student_table(star.students(spark, d), None, star.enrollments(spark, d))


def scored_rows(spark: SparkSession, d: str) -> DataFrame:
    return scored.with_scores(student_rows(spark, d))


def readiness_rows(spark: SparkSession, d: str) -> DataFrame:
    return readiness.readiness_records(scored_rows(spark, d))
