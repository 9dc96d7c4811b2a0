"""Worked examples and edge cases of the operators."""

import pytest
from pyspark.sql import functions as F

from tassel.operators import courses, evaluate, ingest, privacy, ranks, roster, students, texts
from tassel.sources import files, sinks
from tassel.sources.layouts import BY_ID, normalize_header, normalized


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


# ---------------------------------------------------------------- features and courses

ENROLLMENT = """student_guid string, academic_year string, academic_term string, course_prefix string,
course_number string, course_name string, gateway_type string, grade string, credits_attempted double,
credits_earned double, delivery_method string, instructor_status string, is_core_course boolean,
is_co_requisite boolean, enrolled_at_other_institutions string"""


def enrollment(spark, data):
    base = ("s1", "2020-21", "FALL", "MAT", "100", "Math", "N", "A", 3.0, 3.0, "F", "FT", True, False, None)
    names = [c.split()[0] for c in ENROLLMENT.split(",")]
    return spark.createDataFrame([tuple({**dict(zip(names, base)), **d}[n] for n in names) for d in data], ENROLLMENT)


def test_features_edge_students(spark):
    e = enrollment(
        spark,
        [
            {"student_guid": "zero", "credits_attempted": 0.0, "credits_earned": 0.0},
            {"student_guid": "nulls", "credits_attempted": None, "credits_earned": None, "grade": None, "delivery_method": None},
            {"student_guid": "one", "grade": "B", "gateway_type": "Y"},
            {"student_guid": "blank", "grade": ""},
            {"student_guid": None},
        ],
    )
    got = {r.student_guid: r for r in students.course_features(e).collect()}
    assert set(got) == {"zero", "nulls", "one", "blank"}
    assert got["zero"].course_completion_rate == 0.0
    n = got["nulls"]
    assert (n.total_credits_attempted, n.avg_credits_per_course, n.average_grade, n.grade_std_dev) == (0.0, None, None, 0.0)
    assert (n.passing_rate, n.pct_online, n.courses_with_grades) == (0.0, 0.0, 0)
    assert (got["one"].gateway_math_courses, got["one"].gateway_english_courses, got["one"].grade_std_dev) == (1, 1, 0.0)
    assert (got["blank"].passing_rate, got["blank"].courses_with_grades) == (1.0, 0)


def test_pairs_count_repeats_compare_text_and_skip_null_keys(spark):
    e = enrollment(
        spark,
        [
            {"course_prefix": "MAT", "course_number": "95"},
            {"course_prefix": "MAT", "course_number": "95", "grade": "F"},
            {"course_prefix": "MAT", "course_number": "101"},
            {"course_prefix": "ENG", "course_number": "100", "academic_year": None},
            {"course_prefix": "ART", "course_number": "100", "academic_year": None},
        ],
    )
    got = courses.co_enrollment_pairs(e, min_count=1)
    # as text '101' < '95'; the repeat counts twice, one of the two was passed
    assert rows(got, "prefix_a", "number_a", "prefix_b", "number_b", "co_enrollment_count", "both_pass_rate") == [
        ("MAT", "101", "MAT", "95", 2, 50.0)
    ]


def test_pairs_of_one_student_holding_most_rows(spark):
    """A student id with a third of the table: counts stay exact and no row pair is formed."""
    hot = [{"student_guid": "hot", "course_number": str(i % 3), "grade": "A" if i % 2 else "F"} for i in range(300)]
    cold = [{"student_guid": f"s{i // 2}", "course_number": str(i % 2)} for i in range(600)]
    e = enrollment(spark, hot + cold)
    got = {(r.number_a, r.number_b): r.co_enrollment_count for r in courses.co_enrollment_pairs(e, 1).collect()}
    assert got == {("0", "1"): 100 * 100 + 300, ("0", "2"): 10000, ("1", "2"): 10000}


def test_blank_grades_are_neither_pass_nor_dfwi(spark):
    e = enrollment(spark, [{"grade": g} for g in ("A", "D", "", None, "P")])
    r = courses.dfwi_by_course(e, min_enrollments=1).first()
    assert (r.enrollments, r.dfwi_count, r.dfwi_rate, r.pass_rate) == (5, 1, 20.0, 40.0)


# ---------------------------------------------------------------- layouts

COHORT = "student_guid institution_id cohort cohort_term student_age enrollment_type race ethnicity gender first_gen".split()


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("Cohort Term", "cohort_term"),
        ("  Student_GUID  ", "student_guid"),
        ("Co-requisite Course", "co_requisite_course"),
        ("Some   Weird--Header", "some_weird_header"),
        ("Semester/Session GPA", "semester_session_gpa"),
    ],
)
def test_normalize_header(spark, raw, wanted):
    assert normalize_header(raw) == wanted
    df = spark.createDataFrame([(raw,)], "h string")
    assert df.select(normalized(F.col("h"))).first()[0] == wanted


def test_detect_schema(spark):
    files_ = {
        "cohort": (COHORT, "pdp_cohort_ar"),
        "mixed": ([c.upper() for c in COHORT], "pdp_cohort_ar"),
        "submission": (
            ["Student ID", "Cohort", "Cohort Term", "First Name", "Last Name", "Date of Birth", "Enrollment Type", "Race", "Ethnicity", "Gender"],
            "pdp_cohort_submission",
        ),
        "course": (
            ["student_guid", "cohort", "academic_year", "academic_term", "course_prefix", "course_number", "section_id", "grade", "delivery_method"],
            "course_ar",
        ),
        "course_sub": (
            ["Student ID", "Cohort", "Academic Year", "Term", "Course Prefix", "Course Number", "Section ID", "Grade", "Semester/Session GPA", "Overall GPA", "Last Name"],
            "course_submission",
        ),
        "predictions": (["student_guid", "prediction_type", "prediction_value", "model_version", "confidence_score"], "ml_predictions"),
    }
    for headers, wanted in files_.values():
        found = ingest.detect_schema(headers)
        assert found.layout.id == wanted and found.confidence > 0.6
    assert ingest.detect_schema(["foo", "bar", "baz", "qux"]).layout is None
    small = ingest.detect_schema(["student_guid", "cohort", "grade"])
    assert small.confidence < 0.6
    data = [(name, h) for name, (headers, _) in files_.items() for h in headers]
    data += [("none", h) for h in ("foo", "bar")] + [("small", h) for h in ("student_guid", "cohort", "grade")]
    got = {r.file: (r.layout, r.confidence) for r in ingest.detect_schemas(spark.createDataFrame(data, "file string, header string")).collect()}
    for name, (headers, wanted) in files_.items():
        assert got[name] == (wanted, round(ingest.detect_schema(headers).confidence, 4))
    assert got["none"] == (None, 0.0) and got["small"][1] == pytest.approx(small.confidence)


def test_map_columns():
    mapped = ingest.map_columns(["Student_GUID", "Cohort_Term", "Unknown_Col"], BY_ID["pdp_cohort_ar"])
    assert mapped == [("Student_GUID", "student_guid"), ("Cohort_Term", "cohort_term"), ("Unknown_Col", None)]


def test_recode_trims_known_codes_only(spark):
    df = spark.createDataFrame([(" F ",), ("Z ",), (None,), ("",)], "enrollment_type string").coalesce(1)
    got = [r[0] for r in ingest.recode_values(df, BY_ID["pdp_cohort_submission"]).collect()]
    assert got == ["First-Time", "Z ", None, ""]


def test_number_or_null_reads_like_a_loose_parser(spark):
    xs = ["3", " 2.5 ", "", "NULL", "null", "n/a", "3 credits", "-1e2", ".5", None]
    df = spark.createDataFrame([(x,) for x in xs], "x string").coalesce(1)
    got = [r[0] for r in df.select(ingest.number_or_null(F.col("x"))).collect()]
    assert got == [3.0, 2.5, None, None, None, None, 3.0, -100.0, 0.5, None]


def test_parse_float_date(spark):
    df = spark.createDataFrame([("20240820.0",), ("20240820",), ("x",), (None,)], "x string").coalesce(1)
    got = [str(r[0]) for r in df.select(ingest.parse_float_date(F.col("x"))).collect()]
    assert got == ["2024-08-20", "2024-08-20", "None", "None"]


def test_upsert_last_row_wins_and_other_columns_stay(spark):
    target = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, v string, n int")
    batch = spark.createDataFrame([(1, "a", "p"), (2, "c", "q"), (3, "a", None), (4, None, "z")], "row_no int, id string, v string")
    assert sorted(map(str, map(tuple, ingest.upsert(target, batch, ["id"]).collect()))) == sorted(
        map(str, [("a", None, 1), ("b", "y", 2), ("c", "q", None)])
    )


def test_upload_diff_worked_example(spark):
    h = spark.createDataFrame(
        [(1, "t", 40, 0, 0, "2024-01-01 10:00:00"), (2, "t", 100, 0, 0, "2024-03-01 10:00:00"), (3, "u", 5, 0, 0, "2024-03-01 11:00:00"),
         (4, "u", 0, 0, 0, "2024-03-01 11:00:00"), (5, "u", 9, 1, 1, "2024-03-02 11:00:00")],
        "id long, file_type string, rows_inserted long, rows_skipped long, error_count long, at string",
    ).withColumn("uploaded_at", F.to_timestamp("at"))
    got = {r.id: r for r in ingest.upload_diffs(h).collect()}
    assert got[1].rows_inserted_delta is None and got[1].large_swing is None
    assert (got[2].rows_inserted_delta, got[2].percent_inserted_change, got[2].large_swing) == (60, 150.0, True)
    assert (got[4].previous_id, got[4].percent_inserted_change) == (3, -100.0)
    assert (got[5].previous_id, got[5].percent_inserted_change, got[5].large_swing) == (4, None, False)


def test_report_lines(spark):
    errors = spark.createDataFrame([(5, "gpa", "invalid"), (2, "x", 'say "hi", please')], "row long, column string, message string")
    lines = list(ingest.report_lines(errors, {"File": "a,b.csv", "Inserted": 3}))
    assert lines[0] == "# Upload validation report" and '# File,"a,b.csv"' in lines
    assert lines[-3:] == ["row,column,message", '2,x,"say ""hi"", please"', "5,gpa,invalid"]


def test_preview(spark):
    df = spark.createDataFrame([(str(i), "2020-21") for i in range(30)], "student_guid string, cohort string")
    p = ingest.preview(df)
    assert p.total_rows == 30 and len(p.sample) == 10 and len(p.warnings) > 5
    assert p.errors and all(e.startswith("Missing required column") for e in p.errors)


# ---------------------------------------------------------------- privacy and roster


def test_published_output_rules(spark):
    df = spark.createDataFrame([("s1", "c1", 1.0), ("s2", "c1", 2.0)], "student_guid string, cohort string, score double")
    assert rows(privacy.published(df, ["count(*) as n"], ["cohort"])) == [("c1", 2)]
    assert rows(privacy.published(df, ["cohort"], where="student_guid = 's1'")) == [("c1",)]
    for bad in (["student_guid"], ["Student_GUID as sid"], ["concat('x', student_guid) as y"], ["*"]):
        with pytest.raises(privacy.PrivacyViolation):
            privacy.published(df, bad)
    with pytest.raises(privacy.PrivacyViolation):
        privacy.published(df, ["max(student_guid) as m"], ["cohort"])
    assert len(privacy.published(df, ["*"], excluded=[]).columns) == 3
    with pytest.raises(privacy.PrivacyViolation):
        privacy.assert_no_excluded_columns(df)


def test_published_traces_what_was_done_before(spark):
    df = spark.createDataFrame([("s1", "c1", 1.0), ("s2", "c1", 2.0)], "student_guid string, cohort string, score double")
    other = spark.createDataFrame([("s1", 5)], "sid string, n int")
    df.createOrReplaceTempView("privacy_rows")
    renamed = df.selectExpr("student_guid as sid", "cohort", "score")
    from pyspark.sql import Window

    leaks = [
        (renamed, ["sid", "cohort"]),
        (df.withColumn("h", F.concat(F.lit("x"), "student_guid")), ["h"]),
        (renamed.join(other.drop("n"), "sid"), ["sid"]),
        (df.withColumn("n", F.row_number().over(Window.orderBy("student_guid"))), ["n"]),
        (df.groupBy("cohort").agg(F.collect_list("student_guid").alias("ids")), ["ids"]),
        (df.select(F.explode(F.array("student_guid")).alias("one")), ["one"]),
        (df.select("cohort").unionAll(df.select("student_guid")), ["cohort"]),
        (df.withColumn("m", F.expr("(select max(student_guid) from privacy_rows)")), ["m"]),
        (df.withColumn("all_of_it", F.struct("*")), ["all_of_it.cohort as c"]),
        (renamed.distinct().filter("score > 0").toDF("a", "b", "c"), ["a"]),
        (df.mapInPandas(lambda it: it, "a string, b string, c double"), ["c"]),
    ]
    for rows_, outputs in leaks:
        with pytest.raises(privacy.PrivacyViolation):
            privacy.published(rows_, outputs)
        with pytest.raises(privacy.PrivacyViolation):
            privacy.assert_no_excluded_columns(rows_.selectExpr(*outputs))
    fine = renamed.join(other, "sid").groupBy("cohort").agg(F.sum("n").alias("n"))
    assert rows(privacy.published(fine, ["cohort", "n"])) == [("c1", 5)]
    assert rows(privacy.published(renamed, ["count(*) as n"], ["cohort"], where="sid = 's1'")) == [("c1", 1)]


def test_search_text_is_literal(spark):
    df = spark.createDataFrame([("a_1",), ("ab1",), ("A_1x",), ("a%1",)], "student_guid string")
    assert rows(roster.roster_filter(df, search="a_1")) == [("A_1x",), ("a_1",)]
    assert rows(roster.roster_filter(df, search="%")) == [("a%1",)]


def test_drill_through_needs_its_arguments(spark):
    df = spark.createDataFrame([("a",)], "student_guid string")
    for metric in ("risk_alert_segment", "roster_cell", "nonsense"):
        with pytest.raises(ValueError):
            roster.metric_rows(df, metric)


# ---------------------------------------------------------------- ranges instead of whole groups


def test_running_totals_with_clustered_values(spark):
    xs = [0.5 + i * 1e-9 for i in range(500)] + [float(i) for i in range(100)] + [0.5] * 7
    df = spark.createDataFrame([(x,) for x in xs], "x double").groupBy("x").agg(F.count("*").alias("n"))
    got = rows(ranks.running_totals(df, "x", ["n"]), "x", "n", "cum_n", "all_n")
    total = 0
    for x, n, cum, everything in got:
        total += n
        assert (cum, everything) == (total, len(xs))


def test_exact_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (4.0, float("nan")), (8.0, None)], "a double, b double")
    got = {r.column: (r.q0, r.q1) for r in ranks.exact_quantiles(df, ["a", "b"], [0.5, 0.9]).collect()}
    assert got["a"] == (3.0, pytest.approx(6.8)) and got["b"] == (5.0, 5.0)


def test_roc_auc_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    data = [(rng.randrange(2), rng.randrange(10) / 10) for _ in range(200)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    wanted = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "label int, score double")
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(wanted)
    assert evaluate.roc_auc(df.filter("label = 1")).first()[0] is None


def test_split_keeps_class_shares(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 10 = 0 as int) as label")
    split = evaluate.stratified_split(df, "id", "label")
    counts = {(r.label, r.is_test): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
    assert counts == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}


# ---------------------------------------------------------------- texts


def test_jaccard_examples(spark):
    data = [("the Cat sat", "the cat sat", 1.0), ("a b", "c d", 0.0), ("a b c", "b c d", 0.5), ("", "a", 0.0), ("", "", 0.0)]
    df = spark.createDataFrame(data, "a string, b string, wanted double")
    assert all(r.j == r.wanted for r in df.withColumn("j", texts.jaccard("a", "b")).collect())


def test_same_words_keep_first_and_all_wordless(spark):
    data = [(1, "b a a"), (2, "A  b"), (3, ""), (4, "  "), (5, None), (6, "a b c"), (7, "a b")]
    df = spark.createDataFrame(data, "id int, t string")
    assert rows(texts.drop_same_words(df, "id", "t"), "id") == [(1,), (3,), (4,), (5,), (6,)]


def test_split_counts(spark):
    parts = texts.split_dataset(spark.range(100), "id").groupBy("part").count()
    assert rows(parts) == [("test", 10), ("train", 80), ("val", 10)]


def test_valid_pairs(spark):
    data = [
        (1, [("system", "x"), ("user", "q"), ("assistant", '{"a": 1}')]),
        (2, [("user", "q"), ("assistant", "not json")]),
        (3, [("user", ""), ("assistant", "{}")]),
        (4, [("assistant", "[1, 2]"), ("user", "q"), ("assistant", "no")]),
        (5, [("user", "q")]),
        (6, [("user", "q"), ("assistant", "null")]),
        (7, [("user", "q"), ("assistant", '{"a": 1} tail')]),
        (8, None),
        (9, [("user", "q"), ("assistant", "1],[2")]),
        (10, [("user", "q"), ("assistant", '1, "x": 2')]),
        (11, [("user", "q"), ("assistant", ' {"a": [1, {"b": null}]}\n')]),
    ]
    df = spark.createDataFrame(data, "id int, messages array<struct<role:string,content:string>>")
    assert rows(texts.filter_valid_pairs(texts.pairs_from_messages(df)), "conv_id") == [(1,), (4,), (6,), (11,)]


def test_answer_checks(spark):
    full = '{"summary": "s 12", "key_insights": [], "context": 1, "action_items": 2, "caveats": ["c"]}'
    data = [(full, "12 of 50"), ('{"caveats": []}', "no numbers"), ("[1]", "7"), ("bad", "1.5"), ('{"caveats": "x"}', "x")]
    df = spark.createDataFrame(data, "output string, source string")
    got = {r.metric: r.value for r in texts.answer_metrics(df, "summarizer").collect()}
    assert got == {"json_validity": 0.6, "schema_adherence": 0.2, "caveat_inclusion": 0.2, "factual_grounding": 0.6}


@pytest.mark.parametrize(
    "metrics, wanted",
    [
        ({"json_validity": 0.95, "actionability": 0.8}, "ship"),
        ({"json_validity": 0.99, "actionability": 0.5}, "ship_with_gaps"),
        ({"json_validity": 0.90, "actionability": 0.5, "unknown": 0.0}, "no_ship"),
    ],
)
def test_ship_decision(spark, metrics, wanted):
    df = spark.createDataFrame([("explainer", k, v) for k, v in metrics.items()], "task string, metric string, value double")
    assert texts.ship_decision(df).first().decision == wanted


# ---------------------------------------------------------------- files


def test_row_numbers_follow_the_file(spark, tmp_path):
    """Files cut into many small chunks still number their rows in file order."""
    for name, n in (("a.csv", 5000), ("b.csv", 3), ("c.csv", 2000)):
        (tmp_path / name).write_text("seq\n" + "".join(f"{i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = files.number_rows(files.read_text_table(spark, str(tmp_path)))
        assert df.rdd.getNumPartitions() > 1
        assert df.count() == 7003
        assert df.filter("cast(seq as long) <> row_no").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_audit_log_skips_bad_lines(spark, tmp_path):
    lines = [
        '{"prompt":"a, b","institution":"i","vizType":"bar","rowCount":3,"timestamp":"2024-01-01T00:00:00.000Z"}',
        '{"prompt":"cut',
        "",
        '{"prompt":"late","institution":"i","vizType":"bar","rowCount":1,"timestamp":"2024-02-01T00:00:00.000Z"}',
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    everything = files.read_audit_log(spark, str(tmp_path / "log.jsonl"))
    assert everything.count() == 2
    first = files.read_audit_log(spark, str(tmp_path / "log.jsonl"), "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z")
    assert rows(first, "prompt") == [("a, b",)]


def test_model_log_keeps_f1_under_either_name(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.log_model_performance(spark, path, "m1", "classification", {"f1_score": 0.5})
    sinks.log_model_performance(spark, path, "m2", "classification", {"f1": 0.7, "accuracy": 0.9})
    assert rows(spark.read.parquet(path), "model_name", "f1_score") == [("m1", 0.5), ("m2", 0.7)]


def test_save_table_reports_a_wrong_count(spark, tmp_path):
    with pytest.raises(RuntimeError):
        sinks.save_table(spark.range(5), str(tmp_path / "t"), expected=6)
