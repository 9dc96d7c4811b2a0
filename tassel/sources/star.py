"""Student tables derived from the star-schema parquet files.

The library works on cohort, academic-record and course-enrollment tables. These functions derive
such tables from the star schema with plain expressions, so that every operator can run on, and
be checked against, the same files. Only the needed columns of each file are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GUID = "concat('STU', lpad(cast({k} as string), 9, '0'))"
COHORT = "concat(cast(2019 + {k} % 5 as string), '-', cast(20 + {k} % 5 as string))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def enrollments(spark: SparkSession, sf_dir: str, line_rows: DataFrame | None = None) -> DataFrame:
    """Conformed course enrollments, one row per student and course taken.

    ``line_rows`` may be a stream of line items; orders and parts are always read as tables.

    Text columns are built on the order and part sides, before the joins multiply the rows.
    """
    start_year = "(year(o_orderdate) - if(month(o_orderdate) <= 5, 1, 0))"
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        GUID.format(k="o_custkey") + " as student_guid",
        COHORT.format(k="o_custkey") + " as cohort",
        f"concat(cast({start_year} as string), '-', lpad(cast(({start_year} + 1) % 100 as string), 2, '0'))"
        " as academic_year",
        "case when month(o_orderdate) <= 5 then 'SPRING' when month(o_orderdate) <= 7 then 'SUMMER'"
        " else 'FALL' end as academic_term",
    )
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "substr(p_type, 1, 3) as course_prefix",
        "cast(95 + 5 * (p_size % 5) as string) as course_number",
        "concat(p_type, ' ', cast(p_size % 5 as string)) as course_name",
        "case substr(p_type, 1, 3) when 'STA' then 'M' when 'ECO' then 'E' else 'N' end as gateway_type",
        "p_size % 2 = 0 as is_core_course",
        "p_size % 7 = 0 as is_co_requisite",
    )
    used = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax", "l_linestatus", "l_returnflag"]
    rows = (table(spark, sf_dir, "lineitem") if line_rows is None else line_rows).select(*used)
    lines = rows.selectExpr(
        "l_orderkey",
        "l_partkey",
        "try_element_at(array('A','A-','B+','B','B-','C+','C','C-','D','F','W','I',null,''),"
        " cast(l_quantity as int) % 14 + 1) as grade",
        "cast(1 + l_linenumber % 4 as double) as credits_attempted",
        "case when cast(l_quantity as int) % 14 in (9, 10, 11) then 0.0D"
        " else cast(1 + l_linenumber % 4 as double) end as credits_earned",
        "element_at(array('F','O','H'), cast(round(l_tax * 100) as int) % 3 + 1) as delivery_method",
        "if(l_linestatus = 'O', 'FT', 'PT') as instructor_status",
        "case l_returnflag when 'R' then 'Y' when 'A' then 'N' end as enrolled_at_other_institutions",
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .drop("l_orderkey", "o_orderkey", "l_partkey", "p_partkey")
    )


def raw_course_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same enrollments as all-text rows in the source layout, with the blemishes of real files:
    padding, blanks, the word NULL, unknown flags and missing ids."""
    e = enrollments(spark, sf_dir)
    return e.selectExpr(
        "case when delivery_method = 'H' and gateway_type = 'E' and grade = 'W' then '  '"
        " else concat(' ', student_guid, ' ') end as `Student_GUID`",
        "cohort as `Cohort`",
        "'FALL' as `Cohort_Term`",
        "concat(academic_year, ' ') as `Academic_Year`",
        "academic_term as `Academic_Term`",
        "course_prefix as `Course_Prefix`",
        "course_number as `Course_Number`",
        "course_name as `Course_Name`",
        "'' as `Course_CIP`",
        "if(is_core_course, 'CU', 'CC') as `Course_Type`",
        "gateway_type as `Math_or_English_Gateway`",
        "case when is_co_requisite then 'Y' when is_core_course then 'N' else 'U' end as `Co_requisite_Course`",
        "if(is_core_course, 'Y', 'N') as `Core_Course`",
        "' ' as `Core_Course_Type`",
        "delivery_method as `Delivery_Method`",
        "coalesce(grade, '') as `Grade`",
        "case when delivery_method = 'O' and grade = 'F' then 'NULL'"
        " else cast(cast(credits_attempted as decimal(4,1)) as string) end as `Number_of_Credits_Attempted`",
        "case when grade = 'I' then 'n/a' else concat(' ', cast(cast(credits_earned as decimal(4,1)) as string))"
        " end as `Number_of_Credits_Earned`",
        "instructor_status as `Course_Instructor_Employment_Status`",
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a cohort submission as text, one per order, so a student is submitted several times.

    Ids and cohorts are sometimes blank, codes sometimes padded or unknown; ``row_no`` is the file position.
    """
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey + 1 as row_no",
        "case when o_orderkey % 101 = 0 then ' ' else " + GUID.format(k="o_custkey") + " end as `Student ID`",
        "case when o_orderkey % 211 = 0 then null else " + COHORT.format(k="o_custkey") + " end as `Cohort`",
        "element_at(array('Fall','Winter','Spring','Autumn'), cast(o_custkey % 4 as int) + 1) as `Cohort Term`",
        "concat('Name', cast(o_custkey as string)) as `First Name`",
        "element_at(array('F','R','T',' F ','Z '), cast(o_orderkey % 5 as int) + 1) as `Enrollment Type`",
        "element_at(array('W','B','A','AN','IA','HP','TM','UK','XX '), cast(o_orderkey % 9 as int) + 1) as `Race`",
        "element_at(array('M','F','P','X','UK',''), cast(o_orderkey % 6 as int) + 1) as `Gender`",
        "element_at(array('C','R','N'), cast(o_orderkey % 3 as int) + 1) as `Math-Placement`",
        "o_orderpriority as `Local Note`",
    )


def upload_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of one uploaded file per customer: most columns of one layout, some in upper case with
    spaces, and in every eleventh file eleven unknown headers."""
    from .layouts import LAYOUTS

    listed = [(n, i, c) for n, layout in enumerate(LAYOUTS) for i, c in enumerate(layout.columns)]
    columns = spark.createDataFrame(listed, "layout_no int, position int, column string")
    files = table(spark, sf_dir, "customer").selectExpr("c_custkey as file", "cast(c_custkey % 5 as int) as layout_no")
    known = (
        files.join(F.broadcast(columns), "layout_no")
        .filter("(file * 7 + position * 3) % 20 < 18")
        .selectExpr("file", "if(file % 2 = 0, upper(replace(column, '_', ' ')), column) as header")
    )
    unknown = files.filter("file % 11 = 0").selectExpr(
        "file", "explode(transform(sequence(1, 11), i -> concat('Local-', cast(i as string)))) as header"
    )
    return known.unionByName(unknown)


# Classification codes of the programs students are spread over.
PROGRAM_CODES = [
    "510000.0", "520201.0", "240101.0", "110101.0", "430107.0", "130101.0", "480508.0", "150303.0", "120401.0",
]


def _spread(m: int) -> str:
    return f"((c_custkey * {m}) % 1009)"


def _picked(labels: list[str], index: str) -> str:
    inside = ", ".join(f"'{x}'" for x in labels)
    return f"element_at(array({inside}), cast({index} as int) + 1)"


def _placement(m: int) -> str:
    return f"case when (c_custkey * {m}) % 20 < 9 then 'C' when (c_custkey * {m}) % 20 < 15 then 'R' else 'N' end"


def _years(j: int) -> str:
    return f"case when c_custkey % 9 = 0 and c_custkey % 4 = {j} then 1.0D + c_custkey % 5 else 0.0D end"


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort table, one row per student, with stand-in model probabilities."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    k, h = "c_custkey", _spread
    return joined.selectExpr(
        GUID.format(k=k) + " as student_guid",
        "cast(c_nationkey as string) as institution_id",
        "r_name as school",
        COHORT.format(k=k) + " as cohort",
        f"case when {k} % 10 < 7 then 'FALL' when {k} % 10 < 9 then 'SPRING' else 'SUMMER' end as cohort_term",
        _picked(["20 and younger", "20 and younger", ">20 - 24", "Older than 24"], f"{k} % 4") + " as student_age",
        _picked(["First-Time", "Transfer-In", "Re-Admit"], f"{k} % 3") + " as enrollment_type",
        "c_mktsegment as race",
        f"if({k} % 2 = 0, 'F', 'M') as gender",
        f"if({k} % 33 = 0, 'H', 'N') as ethnicity",
        _picked(["A", "B", "C", "N", "P", "UK"], f"{k} % 6") + " as first_gen",
        _picked(["Y", "N", "UK"], f"{k} % 3") + " as pell_status_first_year",
        _picked(["DS", "SE", "DE", "UK", ""], f"{k} % 5") + " as dual_and_summer_enrollment",
        f"case when {k} % 97 = 0 then null when {k} % 3 = 0 then 'Full-Time' else 'Part-Time' end"
        " as enrollment_intensity_first_term",
        _placement(7) + " as math_placement",
        _placement(11) + " as english_placement",
        _placement(13) + " as reading_placement",
        _picked(["A", "B", "C1", "C2", "01", "02", "03"], f"{k} % 7") + " as credential_type_sought_year_1",
        _picked(PROGRAM_CODES, f"{k} % 9") + " as program_of_study_year_1",
        f"cast(36601 + {k} % 95 as string) as zip_code",
        f"case when {h(7919)} < 20 then cast(null as double) else round(0.5D + {h(7919)} * 3.5D / 1009, 2) end"
        " as gpa_group_year_1",
        f"cast({h(611953)} % 25 + 3 as double) as number_of_credits_attempted_year_1",
        f"cast({h(611953)} % 25 as double) as number_of_credits_earned_year_1",
        f"cast({h(7919)} % 20 as double) as number_of_credits_earned_year_2",
        f"cast({h(104729)} % 15 as double) as number_of_credits_earned_year_3",
        f"case when {k} % 4 = 0 then cast({h(1299709)} % 10 as double) end as number_of_credits_earned_year_4",
        f"case when {k} % 11 = 0 then null else 'Y' end as attemptedgatewaymathyear1",
        f"case when {k} % 13 = 0 then null else 'Y' end as attemptedgatewayenglishyear1",
        f"case when {k} % 11 = 0 then null when {h(104729)} < 600 then 'Y' else 'N' end as completedgatewaymathyear1",
        f"case when {k} % 13 = 0 then null when {h(1299709)} < 650 then 'Y' else 'N' end"
        " as completedgatewayenglishyear1",
        f"case when {k} % 50 = 0 then null when {h(104729)} < 700 then 1 else 0 end as retention",
        f"case when {k} % 50 = 0 then null when {h(1299709)} < 550 then 1 else 0 end as persistence",
        _years(0) + " as years_to_bachelors_at_cohort_inst_",
        f"case when {k} % 14 = 5 then 2.0D + {k} % 3 else 0.0D end as years_to_bachelor_at_other_inst_",
        _years(1) + " as years_to_latest_associates_at_cohort_inst",
        "0.0D as years_to_latest_associates_at_other_inst",
        _years(2) + " as years_to_latest_certificate_at_cohort_inst",
        "0.0D as years_to_latest_certificate_at_other_inst",
        _years(3) + " as years_to_associates_or_certificate_at_cohort_inst_",
        "0.0D as years_to_associates_or_certificate_at_other_inst_",
        f"case when {k} % 9 = 0 then 1.0D + {k} % 5 else 0.0D end as time_to_credential",
        f"{h(15485863)} / 1008.0D as retention_probability",
        f"if({h(15485863)} >= 504, 1, 0) as retention_prediction",
        f"{h(32452843)} / 1008.0D as gateway_math_probability",
        f"{h(49979687)} / 1008.0D as gateway_english_probability",
        f"{h(67867967)} / 1008.0D as low_gpa_probability",
        f"1.0D + {h(86028121)} / 250.0D as predicted_time_to_credential",
        f"cast({k} % 4 as int) as predicted_credential_type",
        f"round({h(104729)} * 4.0D / 1009, 2) as predicted_gpa",
        f"{h(32452843)} / 4032.0D as prob_no_credential",
        f"{h(49979687)} / 4032.0D as prob_certificate",
        f"{h(67867967)} / 4032.0D as prob_associate",
        f"1.0D - ({h(32452843)} + {h(49979687)} + {h(67867967)}) / 4032.0D as prob_bachelor",
    )


def academic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Academic-record table in its source layout; a few students have none."""
    k = "c_custkey"
    return table(spark, sf_dir, "customer").selectExpr(
        f"{k} as id",
        GUID.format(k=k) + " as student_id",
        f"case when {k} % 6 = 0 then 1.0D + {k} % 4 else 0.0D end as years_to_bachelors_cohort",
        f"case when {k} % 8 = 0 then 2.0D + {k} % 3 else 0.0D end as years_to_assoc_cert_other",
        _picked(["A", "B", "C", "N", "P", "UK"], f"{k} % 6") + " as naspa_first_gen",
        "cast(c_nationkey as string) as school",
        f"cast(36601 + {k} % 95 as string) as zip_code",
    ).filter("id % 17 <> 0")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# Upload layout ids in the order used to spread the events over them.
UPLOAD_TYPES = ["pdp_cohort_ar", "pdp_cohort_submission", "course_ar", "course_submission", "ml_predictions"]


def upload_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "concat('user', cast(user_id as string), '@example.edu') as user_email",
        "concat('upload_', cast(event_id as string), '.csv') as filename",
        _picked(UPLOAD_TYPES, "user_id % 5") + " as file_type",
        "case when event_type = 'error' and event_id % 3 = 0 then 0 else cast(floor(value * 10) as bigint) end"
        " as rows_inserted",
        "event_id % 7 as rows_skipped",
        "case when event_type = 'error' then 1 + event_id % 5 else 0 end as error_count",
        "ts as uploaded_at",
    )


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query audit log as raw lines (``value``), one per event; every 50th line is cut short."""
    return as_audit_lines(table(spark, sf_dir, "events"))


def as_audit_lines(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "case when event_id % 50 = 7 then '{\"prompt\": \"cut' else to_json(named_struct("
        "'prompt', concat('show ', event_type, ' for user ', cast(user_id as string)),"
        "'institution', concat('inst', cast(user_id % 7 as string)),"
        "'vizType', event_type,"
        "'rowCount', cast(floor(value) as bigint),"
        "'timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"))) end as value"
    )


def audit_columns(events: DataFrame) -> DataFrame:
    """The same log already parsed, from a table or a stream of events."""
    return events.selectExpr(
        "event_id", "cast(ts as timestamp) as ts", "concat('inst', cast(user_id % 7 as string)) as institution", "event_type as viz_type", "user_id"
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns; assistant text of some conversations is turned into (valid or cut) JSON."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        "role",
        "case when role <> 'assistant' then text"
        " when conv_id % 3 = 0 then to_json(named_struct('summary', text, 'caveats', array('small n')))"
        " when conv_id % 6 = 1 then concat('{\"summary\": \"', cast(length(text) as string))"
        " when conv_id % 6 = 4 then concat('{\"summary\": 1, \"summary\": NaN, \"key_insights\": [1, -Infinity],"
        " \"context\": \"\", \"action_items\": [], \"caveats\": [\"n = ', cast(length(text) as string), '\"]}')"
        " when conv_id % 30 = 5 then '[\"a\", {\"b\": [NaN, 1e5, true]}] '"
        " else text end as content",
    )


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per conversation with all its messages in order: a conversation is one record, whatever its length."""
    message = F.struct("turn", "role", "content")
    gathered = chat_messages(spark, sf_dir).groupBy(F.col("conv_id").alias("id")).agg(
        F.array_sort(F.collect_list(message)).alias("messages")
    )
    return gathered
