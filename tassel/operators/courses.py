"""Course reports: D/F/W/I rates, gateway funnel, courses taken together."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grades import is_course_pass, is_dfwi
from ..functions.numeric import percent, ratio
from ..session import checkpoint_dir
from .ranks import hash_row_numbers

COURSE = ["course_prefix", "course_number"]
SITTING = ["student_guid", "academic_year", "academic_term"]


def course_filter(
    enrollments: DataFrame, gateway_only: bool = False, cohort: str | None = None, term: str | None = None
) -> DataFrame:
    out = enrollments
    if gateway_only:
        out = out.filter(F.col("gateway_type").isin("M", "E"))
    if cohort:
        out = out.filter(F.col("cohort") == cohort)
    if term:
        out = out.filter(F.col("academic_term") == term)
    return out


def course_rates(enrollments: DataFrame) -> DataFrame:
    """Enrollments, D/F/W/I and pass counts and rates per course; both rates over all rows.

    The rows are first counted per course and text values. A maximum over text cannot be kept in a
    hash aggregate (Spark would sort all rows for it), so it is taken over those few counts.
    """
    texts = ["course_name", "gateway_type"]
    counted = enrollments.groupBy(*COURSE, *texts).agg(
        F.count("*").alias("n"),
        F.count_if(is_dfwi()).alias("n_dfwi"),
        F.count_if(is_course_pass()).alias("n_pass"),
    )
    per_course = counted.groupBy(*COURSE).agg(
        *[F.max(c).alias(c) for c in texts],
        F.sum("n").alias("enrollments"),
        F.sum("n_dfwi").alias("dfwi_count"),
        F.sum("n_pass").alias("pass_count"),
    )
    return per_course.withColumns(
        {
            "dfwi_rate": percent("dfwi_count", "enrollments"),
            "pass_rate": percent("pass_count", "enrollments"),
        }
    )


def dfwi_by_course(
    enrollments: DataFrame,
    gateway_only: bool = False,
    min_enrollments: int = 10,
    cohort: str | None = None,
    term: str | None = None,
    sort_by: str = "dfwi_rate",
    descending: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Course report by rate or by enrollments: all courses, or the first ``limit``."""
    key = sort_by if sort_by in ("dfwi_rate", "enrollments") else "dfwi_rate"
    rates = course_rates(course_filter(enrollments, gateway_only, cohort, term))
    lead = F.desc_nulls_first(key) if descending else F.asc_nulls_last(key)
    ordered = rates.filter(F.col("enrollments") >= max(1, min_enrollments)).drop("pass_count").orderBy(lead, *COURSE)
    return ordered if limit is None else ordered.limit(limit)


def top_dfwi(enrollments: DataFrame, k: int = 5, min_enrollments: int = 10) -> DataFrame:
    """Courses with the highest D/F/W/I share, as a 0-1 ratio with a readable label."""
    return (
        course_rates(enrollments)
        .filter(F.col("enrollments") >= min_enrollments)
        .select(
            F.concat_ws(" ", *COURSE).alias("course"),
            "enrollments",
            ratio("dfwi_count", "enrollments").alias("dfwi_rate"),
        )
        .orderBy(F.desc("dfwi_rate"), "course")
        .limit(k)
    )


def gateway_funnel(enrollments: DataFrame) -> DataFrame:
    """Attempted, passed and D/F/W/I per cohort, for gateway math (M) and English (E) in one pass."""
    return (
        enrollments.filter(F.col("gateway_type").isin("M", "E"))
        .groupBy("gateway_type", "cohort")
        .agg(
            F.count("*").alias("attempted"),
            F.count_if(is_course_pass()).alias("passed"),
            F.count_if(is_dfwi()).alias("dfwi"),
        )
    )


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by hash of ``keys`` in the session's full number of shuffle partitions.

    Adaptive execution would join these partitions up to 64 MB of compressed rows a task, which take ten times that in a
    task's maps and sorts; a number that is asked for stays.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _sittings(enrollments: DataFrame, *extra: str, hit: Column | None = None) -> DataFrame:
    """Rows per student, term and course (and its name) with their pass count.

    The pair reports join these counts instead of the rows. A student's repeats of a course
    become one row, so a term group is no larger than the course catalog even if one student id
    holds a large part of the table.
    """
    return (
        _spread(enrollments.dropna(subset=SITTING), *SITTING, *COURSE)
        .groupBy(*SITTING, *COURSE, *extra)
        .agg(F.count("*").alias("n"), F.count_if(is_course_pass() if hit is None else hit).alias("n_hit"))
    )


def _sides(left: DataFrame, right: DataFrame, keep: list[str]) -> DataFrame:
    """Join two sitting tables on student and term; columns come back with _a and _b endings."""
    # both sides carry the same columns in the same order to the exchange, so that it is made once
    a = _spread(left, *SITTING).select(*SITTING, *[F.col(c).alias(f"{c}_a") for c in left.columns if c not in SITTING])
    b = _spread(right, *SITTING).select(*SITTING, *[F.col(c).alias(f"{c}_b") for c in keep])
    return a.join(b, SITTING)


def _tables(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes tables under a folder of their own in the shared checkpoint folder and reads them back."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(df: DataFrame, part: str) -> DataFrame:
        df.write.parquet(f"{folder}/{part}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{part}")

    return table


def _supported(sat: DataFrame, min_count: int, name: str) -> DataFrame:
    """Sittings of the courses that can be part of a pair counted ``min_count`` times or more.

    A pair's count is a sum of products of both courses' rows in a sitting, so it is at most one course's rows times the
    most rows that any course has in one sitting. The sittings are written first: the courses' sums are taken from
    them, and with the sums in a table of known size Spark chooses how to join them.
    """
    table = _tables(sat.sparkSession, name)
    sat = table(sat, "sittings")
    per_course = table(sat.groupBy(*COURSE).agg(F.sum("n").alias("_rows"), F.max("n").alias("_most")), "courses")
    most = per_course.agg(F.max("_most")).first()[0] or 0
    enough = per_course.filter(F.col("_rows") * most >= min_count)
    if enough.count() == per_course.count():
        return sat
    named = enough.select(*[F.col(c).alias(f"_{c}") for c in COURSE])
    return sat.join(named, [F.col(c) == F.col(f"_{c}") for c in COURSE], "left_semi")


def course_pairs(enrollments: DataFrame, hit: Column | None = None, both: bool = True, min_count: int = 1) -> DataFrame:
    """All course pairs taken by a student in the same term, each pair once in text order.

    ``hit`` is the per-row test (default: passed). With ``both`` a pair scores when both rows meet
    the test, otherwise when either does. Pairs below ``min_count`` are left out, and courses that no such pair can have
    never reach the join. Names go through it as their rank among the names of the course: a task adds up one short
    row for each pair of courses, not one for each pair of names.
    """
    table = _tables(enrollments.sparkSession, "pairs")
    sat = _sittings(enrollments, "course_name", hit=hit)
    sat = _supported(sat, min_count, "pairs") if min_count > 1 else table(sat, "sittings")
    named = sat.dropna(subset=[*COURSE, "course_name"]).select(*COURSE, "course_name").distinct()
    rank = F.row_number().over(Window.partitionBy(*COURSE).orderBy("course_name"))
    names = table(named.withColumn("name_no", rank), "names")
    # a course without a name has rank null, which the maximum below leaves out
    sat = sat.join(names, [*COURSE, "course_name"], "left").select(*SITTING, *COURSE, "name_no", "n", "n_hit")
    pairs = _sides(sat, sat, [*COURSE, "name_no", "n", "n_hit"]).filter(
        (F.col("course_prefix_a") < F.col("course_prefix_b"))
        | (
            (F.col("course_prefix_a") == F.col("course_prefix_b"))
            & (F.col("course_number_a") < F.col("course_number_b"))
        )
    )
    total = F.col("n_a") * F.col("n_b")
    hits = F.col("n_hit_a") * F.col("n_hit_b")
    if not both:
        hits = total - (F.col("n_a") - F.col("n_hit_a")) * (F.col("n_b") - F.col("n_hit_b"))
    summed = pairs.groupBy(
        F.col("course_prefix_a").alias("prefix_a"),
        F.col("course_number_a").alias("number_a"),
        F.col("course_prefix_b").alias("prefix_b"),
        F.col("course_number_b").alias("number_b"),
    ).agg(
        F.max("name_no_a").alias("name_no_a"),
        F.max("name_no_b").alias("name_no_b"),
        F.sum(total).alias("co_enrollment_count"),
        F.sum(hits).alias("hit_count"),
    ).filter(F.col("co_enrollment_count") >= min_count)
    for side in ("a", "b"):
        ends = [f"prefix_{side}", f"number_{side}", f"name_no_{side}"]
        of_side = [F.col(c).alias(e) for c, e in zip([*COURSE, "name_no"], ends)]
        summed = summed.join(names.select(*of_side, F.col("course_name").alias(f"name_{side}")), ends, "left")
    return summed.select(*PAIR, "name_a", "name_b", "co_enrollment_count", "hit_count")


PAIR = ["prefix_a", "number_a", "prefix_b", "number_b"]


def co_enrollment_pairs(
    enrollments: DataFrame, min_count: int = 20, k: int | None = 20, by_pass_rate: bool = False
) -> DataFrame:
    """Pairs taken together most often, with the share where both were passed."""
    pairs = (
        course_pairs(enrollments, min_count=min_count)
        .withColumn("both_pass_rate", percent("hit_count", "co_enrollment_count"))
        .drop("hit_count")
    )
    if k is None:
        return pairs
    top = pairs.orderBy(F.desc("co_enrollment_count"), *PAIR).limit(k)
    return top.orderBy(F.asc("both_pass_rate"), *PAIR) if by_pass_rate else top


def dfwi_by_combo(enrollments: DataFrame, min_count: int = 20, k: int = 10) -> DataFrame:
    """Pairs with the highest share of sittings where either course ended in D/F/W/I."""
    return (
        course_pairs(enrollments, hit=is_dfwi(), both=False, min_count=min_count)
        .withColumn("dfwi_rate", percent("hit_count", "co_enrollment_count"))
        .drop("name_a", "name_b", "hit_count")
        .orderBy(F.desc("dfwi_rate"), F.desc("co_enrollment_count"), *PAIR)
        .limit(k)
    )


def course_sets(enrollments: DataFrame, size: int = 3, min_count: int = 20) -> DataFrame:
    """Combinations of 2 to ``size`` courses that students took in one term, found level by level.

    Rows: courses (text, in order), n_courses, sittings (student-terms that have all of them), dfwi_rate (share of the
    sittings in which any row of any of them is D/F/W/I) and all_pass_rate (in which all their rows are passed).
    Student-terms count once, so a set never has more sittings than a part of it: from the courses with ``min_count``
    on, a set of n courses is made only of two frequent sets of n - 1 that share all but their last course. A
    student-term is one row with its frequent courses as numbers. Its sets are made within the row, so a level
    shuffles and writes counts only.
    """
    if size < 2:
        raise ValueError("a combination has two courses or more")
    table = _tables(enrollments.sparkSession, "course-sets")
    rows = _spread(enrollments.dropna(subset=[*SITTING, *COURSE]), *SITTING, *COURSE)
    sat = rows.groupBy(*SITTING, *COURSE).agg(
        F.bool_or(F.coalesce(is_dfwi(), F.lit(False))).alias("any_dfwi"),
        F.bool_and(F.coalesce(is_course_pass(), F.lit(False))).alias("all_pass"),
    )
    sat = table(sat, "sittings")
    enough = sat.groupBy(*COURSE).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_count)
    numbered = hash_row_numbers(enough.withColumn("_key", F.concat_ws(" ", *COURSE)), "_key")
    catalog = table(numbered.select(*COURSE, F.col("row_no").cast("int").alias("course_no")), "courses")
    # a course and its two marks in one number: 4 x course_no + 2 (any D/F/W/I) + 1 (all passed)
    marked = F.col("course_no") * 4 + F.col("any_dfwi").cast("int") * 2 + F.col("all_pass").cast("int")
    numbered = _spread(sat.join(catalog, COURSE).select(*SITTING, marked.alias("_x")), *SITTING)
    taken = numbered.groupBy(*SITTING).agg(F.array_sort(F.collect_list("_x")).alias("rest"))
    held = table(taken.filter(F.size("rest") > 1).select("rest"), "taken").select(
        F.lit(False).alias("any_dfwi"), F.lit(True).alias("all_pass"), "rest"
    )
    out, frequent = None, None
    for level in range(1, size + 1):
        head, nos = [f"c{i}" for i in range(1, level)], [f"c{i}" for i in range(1, level + 1)]
        if level > 1:
            ends = held.select(*head, "any_dfwi", "all_pass", F.explode("rest").alias("_x"))
            ends = _with_last(ends, nos[-1])
            if level > 2:  # the head is frequent already; so must be the set without the course before the last
                ends = _only(ends, frequent, [*head[:-1], nos[-1]])
            counts = ends.groupBy(*nos).agg(
                F.count("*").alias("sittings"), F.count_if("any_dfwi").alias("_dfwi"), F.count_if("all_pass").alias("_pass")
            )
            frequent = table(counts.filter(F.col("sittings") >= min_count), f"frequent-{level}")
            found = _named_sets(frequent, catalog, nos)
            out = found if out is None else out.unionAll(found)
        if level < size:
            held = held.select(*head, "any_dfwi", "all_pass", "rest", F.posexplode("rest").alias("_at", "_x"))
            held = held.filter(F.col("_at") + 1 < F.size("rest"))
            held = _with_last(held, nos[-1])
            if level > 1:
                held = _only(held, frequent, nos)
            after = F.slice("rest", F.col("_at") + 2, F.size("rest"))
            held = held.select(*nos, "any_dfwi", "all_pass", after.alias("rest"))
    return out


def _with_last(sets: DataFrame, name: str) -> DataFrame:
    """Adds the course of the marked number ``_x`` to a set and its marks."""
    return sets.withColumns(
        {
            name: F.shiftright("_x", 2),
            "any_dfwi": F.col("any_dfwi") | (F.col("_x").bitwiseAND(2) != 0),
            "all_pass": F.col("all_pass") & (F.col("_x").bitwiseAND(1) != 0),
        }
    )


def _only(sets: DataFrame, frequent: DataFrame, nos: list[str]) -> DataFrame:
    """The rows whose courses ``nos`` are one of the frequent sets."""
    named = frequent.select(*[F.col(f"c{i}").alias(f"_c{i}") for i in range(1, len(nos) + 1)])
    return sets.join(named, [F.col(c) == F.col(f"_c{i}") for i, c in enumerate(nos, 1)], "left_semi")


def _named_sets(frequent: DataFrame, catalog: DataFrame, nos: list[str]) -> DataFrame:
    for c in nos:
        course = catalog.select(F.col("course_no").alias(c), F.struct(*COURSE).alias(f"_{c}"))
        frequent = frequent.join(course, c)
    course_text = lambda c: F.concat_ws(" ", *[c[name] for name in COURSE])
    ordered = F.array_sort(F.array(*[F.col(f"_{c}") for c in nos]))
    return frequent.select(
        F.array_join(F.transform(ordered, course_text), " + ").alias("courses"),
        F.lit(len(nos)).alias("n_courses"),
        "sittings",
        percent("_dfwi", "sittings").alias("dfwi_rate"),
        percent("_pass", "sittings").alias("all_pass_rate"),
    )


def _is_course(course: tuple[str, str]) -> Column:
    return (F.col("course_prefix") == course[0]) & (F.col("course_number") == course[1])


def pair_courses(enrollments: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Individual rates of the two courses of a pair."""
    return course_rates(enrollments.filter(_is_course(first) | _is_course(second))).select(
        *COURSE, "enrollments", "dfwi_rate", "pass_rate"
    )


def _attribute_label() -> Column:
    # Labels of delivery and instructor codes.
    delivery = {"F": "Face-to-Face", "O": "Online", "H": "Hybrid"}
    instructor = {"FT": "Full-Time Instructor", "PT": "Part-Time Instructor"}
    value = F.col("value")
    label = F.coalesce(value, F.lit("Unknown"))
    for attribute, names in (("delivery_method", delivery), ("instructor_status", instructor)):
        for code, name in names.items():
            label = F.when((F.col("attribute") == attribute) & (value == code), name).otherwise(label)
    return label


def _breakdown(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Count and both-pass rate by side a's delivery and instructor, both groupings in one pass."""
    weighted = pairs.withColumns(
        {"pair_n": F.col("n_a") * F.col("n_b"), "pair_pass": F.col("n_hit_a") * F.col("n_hit_b")}
    )
    by_delivery = [F.col(k) for k in keys] + [F.col("delivery_method_a")]
    by_instructor = [F.col(k) for k in keys] + [F.col("instructor_status_a")]
    grouped = weighted.groupingSets(
        [by_delivery, by_instructor], *keys, "delivery_method_a", "instructor_status_a"
    ).agg(
        F.grouping("delivery_method_a").alias("no_delivery"),
        F.sum("pair_n").alias("co_count"),
        F.sum("pair_pass").alias("both_passed"),
    )
    return grouped.select(
        *keys,
        F.when(F.col("no_delivery") == 0, "delivery_method").otherwise("instructor_status").alias("attribute"),
        F.when(F.col("no_delivery") == 0, F.col("delivery_method_a"))
        .otherwise(F.col("instructor_status_a"))
        .alias("value"),
        "co_count",
        percent("both_passed", "co_count").alias("both_pass_rate"),
    ).withColumn("label", _attribute_label())


def pair_breakdown(enrollments: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """One pair: how the first course's delivery and instructor go with passing both."""
    a = _sittings(enrollments.filter(_is_course(first)), "delivery_method", "instructor_status")
    b = _sittings(enrollments.filter(_is_course(second)))
    return _breakdown(_sides(a, b, ["n", "n_hit"]), []).drop("value")


def all_pair_breakdowns(enrollments: DataFrame, min_count: int = 20) -> DataFrame:
    """The breakdown of every pair in one job, in both directions."""
    a = _supported(_sittings(enrollments, "delivery_method", "instructor_status"), min_count, "breakdowns")
    # the other side is rolled up from the first, so the enrollments are read once
    b = a.groupBy(*SITTING, *COURSE).agg(F.sum("n").alias("n"), F.sum("n_hit").alias("n_hit"))
    pairs = _sides(a, b, [*COURSE, "n", "n_hit"]).filter(
        (F.col("course_prefix_a") != F.col("course_prefix_b"))
        | (F.col("course_number_a") != F.col("course_number_b"))
    )
    keys = ["course_prefix_a", "course_number_a", "course_prefix_b", "course_number_b"]
    return _breakdown(pairs, keys).filter(F.col("co_count") >= min_count).drop("value")
