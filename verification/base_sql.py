"""Shared DuckDB common table expressions: the star-schema adapter and the scored tables, in SQL.

Written separately from the Spark code, so that a mistake in one shows up against the other.
"""

from __future__ import annotations

DFWI = "('D','F','W','I')"
PASS = f"(grade IS NOT NULL AND grade <> '' AND grade NOT IN {DFWI})"


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN NULL ELSE ((2000*CAST({a} AS BIGINT) + {b}) // (2*{b})) / 10.0::DOUBLE END"


def _pick(labels: list[str], index: str) -> str:
    return "([" + ", ".join(f"'{x}'" for x in labels) + f"])[({index}) + 1]"


def _h(m: int) -> str:
    return f"((c_custkey * {m}) % 1009)"


def _place(m: int) -> str:
    return f"CASE WHEN (c_custkey*{m})%20 < 9 THEN 'C' WHEN (c_custkey*{m})%20 < 15 THEN 'R' ELSE 'N' END"


def _yr(j: int) -> str:
    return f"CASE WHEN c_custkey%9=0 AND c_custkey%4={j} THEN CAST(1 + c_custkey%5 AS DOUBLE) ELSE 0.0::DOUBLE END"


_START = "(CASE WHEN month(o_orderdate) <= 5 THEN year(o_orderdate)-1 ELSE year(o_orderdate) END)"
_GRADES = ["A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F", "W", "I"]
_GRADE = "CASE CAST(l_quantity AS INT) % 14 " + " ".join(
    f"WHEN {i} THEN '{g}'" for i, g in enumerate(_GRADES)
) + " WHEN 13 THEN '' END"
_PROGRAMS = ["510000.0", "520201.0", "240101.0", "110101.0", "430107.0", "130101.0", "480508.0", "150303.0", "120401.0"]

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


cte(
    "enr",
    [],
    f"""SELECT 'STU' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS student_guid,
  CAST(2019 + o_custkey%5 AS VARCHAR) || '-' || CAST(20 + o_custkey%5 AS VARCHAR) AS cohort,
  CAST({_START} AS VARCHAR) || '-' || lpad(CAST(({_START}+1)%100 AS VARCHAR), 2, '0') AS academic_year,
  CASE WHEN month(o_orderdate)<=5 THEN 'SPRING' WHEN month(o_orderdate)<=7 THEN 'SUMMER' ELSE 'FALL' END AS academic_term,
  substr(p_type,1,3) AS course_prefix, CAST(95+5*(p_size%5) AS VARCHAR) AS course_number,
  p_type || ' ' || CAST(p_size%5 AS VARCHAR) AS course_name,
  CASE substr(p_type,1,3) WHEN 'STA' THEN 'M' WHEN 'ECO' THEN 'E' ELSE 'N' END AS gateway_type,
  {_GRADE} AS grade,
  CAST(1 + l_linenumber%4 AS DOUBLE) AS credits_attempted,
  CASE WHEN CAST(l_quantity AS INT)%14 BETWEEN 9 AND 11 THEN 0.0::DOUBLE ELSE CAST(1+l_linenumber%4 AS DOUBLE) END AS credits_earned,
  {_pick(['F', 'O', 'H'], 'CAST(round(l_tax*100) AS INT) % 3')} AS delivery_method,
  CASE WHEN l_linestatus='O' THEN 'FT' ELSE 'PT' END AS instructor_status,
  p_size%2=0 AS is_core_course, p_size%7=0 AS is_co_requisite,
  CASE l_returnflag WHEN 'R' THEN 'Y' WHEN 'A' THEN 'N' END AS enrolled_at_other_institutions
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey""",
)

cte(
    "cohort_rows",
    [],
    f"""SELECT c_custkey AS k, 'STU' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS student_guid,
  CAST(c_nationkey AS VARCHAR) AS institution_id, r_name AS school,
  CAST(2019 + c_custkey%5 AS VARCHAR) || '-' || CAST(20 + c_custkey%5 AS VARCHAR) AS cohort,
  CASE WHEN c_custkey%10<7 THEN 'FALL' WHEN c_custkey%10<9 THEN 'SPRING' ELSE 'SUMMER' END AS cohort_term,
  {_pick(['20 and younger', '20 and younger', '>20 - 24', 'Older than 24'], 'c_custkey%4')} AS student_age,
  {_pick(['First-Time', 'Transfer-In', 'Re-Admit'], 'c_custkey%3')} AS enrollment_type,
  c_mktsegment AS race, CASE WHEN c_custkey%2=0 THEN 'F' ELSE 'M' END AS gender,
  CASE WHEN c_custkey%33=0 THEN 'H' ELSE 'N' END AS ethnicity,
  {_pick(['A', 'B', 'C', 'N', 'P', 'UK'], 'c_custkey%6')} AS first_gen,
  {_pick(['Y', 'N', 'UK'], 'c_custkey%3')} AS pell_status_first_year,
  {_pick(['DS', 'SE', 'DE', 'UK', ''], 'c_custkey%5')} AS dual_and_summer_enrollment,
  CASE WHEN c_custkey%97=0 THEN NULL WHEN c_custkey%3=0 THEN 'Full-Time' ELSE 'Part-Time' END AS enrollment_intensity_first_term,
  {_place(7)} AS math_placement, {_place(11)} AS english_placement, {_place(13)} AS reading_placement,
  {_pick(['A', 'B', 'C1', 'C2', '01', '02', '03'], 'c_custkey%7')} AS credential_type_sought_year_1,
  {_pick(_PROGRAMS, 'c_custkey%9')} AS program_of_study_year_1,
  CAST(36601 + c_custkey%95 AS VARCHAR) AS zip_code,
  CASE WHEN {_h(7919)}<20 THEN NULL ELSE round(0.5::DOUBLE + {_h(7919)}*3.5::DOUBLE/1009, 2) END AS gpa_group_year_1,
  CAST({_h(611953)}%25+3 AS DOUBLE) AS number_of_credits_attempted_year_1,
  CAST({_h(611953)}%25 AS DOUBLE) AS number_of_credits_earned_year_1,
  CAST({_h(7919)}%20 AS DOUBLE) AS number_of_credits_earned_year_2,
  CAST({_h(104729)}%15 AS DOUBLE) AS number_of_credits_earned_year_3,
  CASE WHEN c_custkey%4=0 THEN CAST({_h(1299709)}%10 AS DOUBLE) END AS number_of_credits_earned_year_4,
  CASE WHEN c_custkey%11=0 THEN NULL ELSE 'Y' END AS attemptedgatewaymathyear1,
  CASE WHEN c_custkey%13=0 THEN NULL ELSE 'Y' END AS attemptedgatewayenglishyear1,
  CASE WHEN c_custkey%11=0 THEN NULL WHEN {_h(104729)}<600 THEN 'Y' ELSE 'N' END AS completedgatewaymathyear1,
  CASE WHEN c_custkey%13=0 THEN NULL WHEN {_h(1299709)}<650 THEN 'Y' ELSE 'N' END AS completedgatewayenglishyear1,
  CASE WHEN c_custkey%50=0 THEN NULL WHEN {_h(104729)}<700 THEN 1 ELSE 0 END AS retention,
  CASE WHEN c_custkey%50=0 THEN NULL WHEN {_h(1299709)}<550 THEN 1 ELSE 0 END AS persistence,
  {_yr(0)} AS y_bach, CASE WHEN c_custkey%14=5 THEN CAST(2 + c_custkey%3 AS DOUBLE) ELSE 0.0::DOUBLE END AS y_other, {_yr(1)} AS y_assoc, {_yr(2)} AS y_cert, {_yr(3)} AS y_either,
  CASE WHEN c_custkey%9=0 THEN CAST(1+c_custkey%5 AS DOUBLE) ELSE 0.0::DOUBLE END AS time_to_credential,
  {_h(15485863)}/1008.0::DOUBLE AS retention_probability,
  CASE WHEN {_h(15485863)}>=504 THEN 1 ELSE 0 END AS retention_prediction,
  {_h(32452843)}/1008.0::DOUBLE AS gateway_math_probability,
  {_h(49979687)}/1008.0::DOUBLE AS gateway_english_probability,
  {_h(67867967)}/1008.0::DOUBLE AS low_gpa_probability,
  1.0::DOUBLE + {_h(86028121)}/250.0::DOUBLE AS predicted_time_to_credential,
  CAST(c_custkey%4 AS INT) AS predicted_credential_type,
  round({_h(104729)}*4.0::DOUBLE/1009, 2) AS predicted_gpa,
  {_h(32452843)}/4032.0::DOUBLE AS prob_no_credential, {_h(49979687)}/4032.0::DOUBLE AS prob_certificate,
  {_h(67867967)}/4032.0::DOUBLE AS prob_associate,
  1.0::DOUBLE - ({_h(32452843)}+{_h(49979687)}+{_h(67867967)})/4032.0::DOUBLE AS prob_bachelor
FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
)

cte(
    "ar",
    [],
    f"""SELECT c_custkey AS ar_id, 'STU' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS student_guid,
  CASE WHEN c_custkey%6=0 THEN CAST(1+c_custkey%4 AS DOUBLE) ELSE 0.0::DOUBLE END AS ar_years_to_bachelors_cohort,
  CASE WHEN c_custkey%8=0 THEN CAST(2+c_custkey%3 AS DOUBLE) ELSE 0.0::DOUBLE END AS ar_years_to_assoc_cert_other,
  {_pick(['A', 'B', 'C', 'N', 'P', 'UK'], 'c_custkey%6')} AS ar_naspa_first_gen, CAST(c_nationkey AS VARCHAR) AS ar_school
FROM customer WHERE c_custkey%17<>0""",
)

_POINTS = (
    "CASE grade WHEN 'A+' THEN 4.0 WHEN 'A' THEN 4.0 WHEN 'A-' THEN 3.7 WHEN 'B+' THEN 3.3 WHEN 'B' THEN 3.0 "
    "WHEN 'B-' THEN 2.7 WHEN 'C+' THEN 2.3 WHEN 'C' THEN 2.0 WHEN 'C-' THEN 1.7 WHEN 'D+' THEN 1.3 "
    "WHEN 'D' THEN 1.0 WHEN 'D-' THEN 0.7 WHEN 'F' THEN 0.0 WHEN 'P' THEN 3.0 WHEN 'S' THEN 3.0 END"
)
_FAIL = "grade IN ('F','W','WF','WN','FN','U','I','E')"

cte(
    "feat",
    ["enr"],
    f"""SELECT student_guid, n AS total_courses_enrolled, np AS unique_course_prefixes,
  att AS total_credits_attempted, ern AS total_credits_earned, avg_att AS avg_credits_per_course,
  CASE WHEN att>0 THEN ern/att ELSE 0.0 END AS course_completion_rate,
  ng AS courses_with_grades, ag AS average_grade, ming AS min_grade, maxg AS max_grade,
  coalesce(sdg, 0.0) AS grade_std_dev, nf AS failing_grades_count,
  CASE WHEN npass+nf>0 THEN npass/CAST(npass+nf AS DOUBLE) ELSE 0.0 END AS passing_rate,
  core AS core_courses_taken, gm AS gateway_math_courses, ge AS gateway_english_courses, coreq AS corequisite_courses,
  o AS online_courses, f AS face_to_face_courses, hy AS hybrid_courses,
  CASE WHEN o+f+hy>0 THEN o/CAST(o+f+hy AS DOUBLE) ELSE 0.0 END AS pct_online,
  ny AS unique_academic_years, nt AS unique_academic_terms, fa AS fall_courses, sp AS spring_courses, su AS summer_courses,
  ft AS courses_with_fulltime_instructors, pt AS courses_with_parttime_instructors, oth AS enrolled_other_institutions
FROM (SELECT student_guid, count(*) n, count(DISTINCT course_prefix) np, coalesce(sum(credits_attempted),0.0) att,
  coalesce(sum(credits_earned),0.0) ern, avg(credits_attempted) avg_att, count(pts) ng, sum(CAST(pts AS DECIMAL(3,1))*10)::BIGINT/(10.0::DOUBLE*count(pts)) ag, min(pts) ming,
  max(pts) maxg, stddev_samp(pts) sdg, count(*) FILTER (WHERE {_FAIL}) nf,
  count(*) FILTER (WHERE grade IS NOT NULL AND NOT {_FAIL}) npass,
  count(*) FILTER (WHERE is_core_course) core, count(*) FILTER (WHERE gateway_type IN ('M','Y')) gm,
  count(*) FILTER (WHERE gateway_type IN ('E','Y')) ge, count(*) FILTER (WHERE is_co_requisite) coreq,
  count(*) FILTER (WHERE delivery_method='O') o, count(*) FILTER (WHERE delivery_method='F') f,
  count(*) FILTER (WHERE delivery_method='H') hy, count(DISTINCT academic_year) ny, count(DISTINCT academic_term) nt,
  count(*) FILTER (WHERE upper(academic_term) LIKE '%FALL%') fa,
  count(*) FILTER (WHERE upper(academic_term) LIKE '%SPRING%') sp,
  count(*) FILTER (WHERE upper(academic_term) LIKE '%SUMMER%') su,
  count(*) FILTER (WHERE instructor_status='FT') ft, count(*) FILTER (WHERE instructor_status='PT') pt,
  count(*) FILTER (WHERE enrolled_at_other_institutions='Y') oth
  FROM (SELECT *, CAST({_POINTS} AS DOUBLE) pts FROM enr) GROUP BY student_guid)""",
)

cte("stu", ["cohort_rows", "feat"], "SELECT * FROM cohort_rows LEFT JOIN feat USING (student_guid)")


def _band(col: str, edges: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN {col} <= {e} THEN '{n}'" for e, n in edges)
    return f"CASE WHEN {col} <= 0 THEN NULL {whens} END"


_GATEWAY = [("0.4", "High Risk"), ("0.6", "Moderate Risk"), ("0.8", "Likely Pass"), ("1.0", "Very Likely Pass")]

cte(
    "risk",
    ["stu"],
    """SELECT *, least(100.0::DOUBLE, (1.0::DOUBLE - retention_probability)*100*0.5::DOUBLE
  + CASE WHEN average_grade<2.0 THEN 20.0 WHEN average_grade<2.5 THEN 10.0 WHEN average_grade<3.0 THEN 3.0 ELSE 0.0 END::DOUBLE
  + CASE WHEN course_completion_rate<0.5 THEN 20.0 WHEN course_completion_rate<0.7 THEN 10.0
         WHEN course_completion_rate<0.85 THEN 5.0 ELSE 0.0 END::DOUBLE
  + CASE WHEN total_credits_earned<6 THEN 10.0 WHEN total_credits_earned<12 THEN 5.0 ELSE 0.0 END::DOUBLE) AS risk_score FROM stu""",
)
cte(
    "scored",
    ["risk"],
    f"""SELECT *, CASE WHEN risk_score>=75 THEN 'URGENT' WHEN risk_score>=50 THEN 'HIGH' WHEN risk_score>=25 THEN 'MODERATE'
    WHEN risk_score IS NOT NULL THEN 'LOW' END AS at_risk_alert,
  risk_score/100 AS at_risk_probability, CASE WHEN risk_score>=50 THEN 1 ELSE 0 END AS at_risk_prediction,
  {_band('retention_probability', [('0.25', 'Critical Risk'), ('0.5', 'High Risk'), ('0.75', 'Moderate Risk'), ('1.0', 'Low Risk')])} AS retention_risk_category,
  {_band('gateway_math_probability', _GATEWAY)} AS gateway_math_risk,
  {_band('gateway_english_probability', _GATEWAY)} AS gateway_english_risk,
  {_band('low_gpa_probability', [('0.2', 'Low Risk'), ('0.4', 'Moderate Risk'), ('0.6', 'High Risk'), ('1.0', 'Critical Risk')])} AS academic_risk_level,
  CAST(left(cohort,4) AS DOUBLE) + predicted_time_to_credential AS predicted_graduation_year,
  CASE predicted_credential_type WHEN 0 THEN 'No Credential' WHEN 1 THEN 'Certificate' WHEN 2 THEN 'Associate' ELSE 'Bachelor' END AS predicted_credential_label,
  CASE WHEN average_grade > predicted_gpa+0.2::DOUBLE THEN 'Above Expected'
       WHEN average_grade < predicted_gpa-0.2::DOUBLE THEN 'Below Expected' ELSE 'As Expected' END AS gpa_performance
FROM risk""",
)

_FT = "upper(trim(enrollment_intensity_first_term)) IN ('FT','FULL-TIME','FULL TIME','FULL_TIME')"
_PT = (
    "coalesce(upper(trim(enrollment_intensity_first_term)) IN "
    "('PT','PART-TIME','PART TIME','PART_TIME','LE','LESS THAN HALF TIME'), false)"
)
_DONE = "coalesce(upper(trim({c})) IN ('1','Y','YES','TRUE','C'), false)"
_MD = _DONE.format(c="completedgatewaymathyear1")
_ED = _DONE.format(c="completedgatewayenglishyear1")

cte(
    "ready0",
    ["scored"],
    f"""SELECT *,
  (CASE WHEN gpa_group_year_1 IS NULL THEN 0.5 ELSE least(gpa_group_year_1/4.0::DOUBLE, 1.0) END
   + coalesce(course_completion_rate, 0.5) + coalesce(passing_rate, 0.5)
   + (0.5::DOUBLE + CASE WHEN {_MD} THEN 0.25 ELSE 0.0 END::DOUBLE + CASE WHEN {_ED} THEN 0.25 ELSE 0.0 END::DOUBLE)
   + CASE WHEN number_of_credits_earned_year_1 IS NULL THEN 0.5 WHEN number_of_credits_earned_year_1>=12 THEN 1.0
       WHEN number_of_credits_earned_year_1>=6 THEN 0.6 ELSE 0.3 END::DOUBLE) / 5.0::DOUBLE AS academic_score,
  (CASE WHEN {_FT} THEN 1.0 WHEN {_PT} THEN 0.5 ELSE 0.3 END::DOUBLE
   + CASE WHEN total_courses_enrolled IS NULL THEN 0.5 ELSE least(total_courses_enrolled/10.0::DOUBLE, 1.0) END
   + CASE math_placement WHEN 'C' THEN 1.0 WHEN 'R' THEN 0.2 ELSE 0.5 END::DOUBLE) / 3.0::DOUBLE AS engagement_score,
  (coalesce(retention_probability, 0.5)
   + CASE at_risk_alert WHEN 'URGENT' THEN 0.1 WHEN 'HIGH' THEN 0.3 WHEN 'MODERATE' THEN 0.6 WHEN 'LOW' THEN 0.9 ELSE 0.5 END::DOUBLE
  ) / 2.0::DOUBLE AS model_score FROM scored""",
)
cte(
    "ready1",
    ["ready0"],
    "SELECT *, academic_score*0.4::DOUBLE + engagement_score*0.3::DOUBLE + model_score*0.3::DOUBLE AS raw FROM ready0",
)
cte(
    "ready",
    ["ready1"],
    f"""SELECT *, CAST(printf('%.4f', raw) AS DOUBLE) AS readiness_score,
  CASE WHEN raw>=0.65 THEN 'high' WHEN raw>=0.40 THEN 'medium' ELSE 'low' END AS readiness_level,
  list_filter([
    CASE WHEN gpa_group_year_1<2.0 THEN 'Low first-year GPA (' || printf('%.1f', gpa_group_year_1) || ' / 4.0)' END,
    CASE WHEN total_courses_enrolled>0 AND failing_grades_count/CAST(total_courses_enrolled AS DOUBLE)>0.2
      THEN 'High course failure rate (' || printf('%.0f', failing_grades_count/CAST(total_courses_enrolled AS DOUBLE)*100) || '% of courses failed)' END,
    CASE WHEN {_PT} THEN 'Part-time enrollment reduces success probability' END,
    CASE WHEN NOT {_MD} THEN 'Gateway math not completed in Year 1' END,
    CASE WHEN NOT {_ED} THEN 'Gateway English not completed in Year 1' END,
    CASE WHEN number_of_credits_earned_year_1<12 THEN 'Below 12-credit Year 1 milestone (' || CAST(CAST(trunc(number_of_credits_earned_year_1) AS BIGINT) AS VARCHAR) || ' credits earned)' END,
    CASE WHEN at_risk_alert='URGENT' THEN 'Retention model flags as Urgent risk' WHEN at_risk_alert='HIGH' THEN 'Retention model flags as High risk' END,
    CASE WHEN course_completion_rate<0.75 THEN 'Below average course completion rate (' || printf('%.0f', course_completion_rate*100) || '%)' END
  ], lambda x: x IS NOT NULL) AS factors,
  list_filter([
    CASE WHEN gpa_group_year_1<2.0 THEN 'Connect with academic advisor for tutoring resources' END,
    CASE WHEN total_courses_enrolled>0 AND failing_grades_count/CAST(total_courses_enrolled AS DOUBLE)>0.2 THEN 'Review course load and consider academic support services' END,
    CASE WHEN {_PT} THEN 'Explore full-time enrollment options and financial aid' END,
    CASE WHEN NOT {_MD} THEN 'Prioritize gateway math enrollment next term' END,
    CASE WHEN NOT {_ED} THEN 'Prioritize gateway English enrollment next term' END,
    CASE WHEN at_risk_alert IN ('URGENT','HIGH') THEN 'Immediate outreach recommended — high dropout risk' END,
    CASE WHEN course_completion_rate<0.75 THEN 'Review course withdrawal patterns with advisor' END,
    CASE WHEN number_of_credits_earned_year_1<12 THEN 'Increase credit load to reach 12-credit first-year milestone' END
  ], lambda x: x IS NOT NULL) AS actions,
  'Readiness score of ' || printf('%.2f', raw) || ' (' || CASE WHEN raw>=0.65 THEN 'high' WHEN raw>=0.40 THEN 'medium' ELSE 'low' END
  || ') based on: academic performance (GPA ' || coalesce(printf('%.1f', gpa_group_year_1), 'N/A') || '/4.0, '
  || coalesce(printf('%.0f', course_completion_rate*100), 'N/A') || '% course completion), engagement ('
  || coalesce(enrollment_intensity_first_term, 'unknown') || ' enrollment, '
  || coalesce(CAST(total_courses_enrolled AS VARCHAR), 'N/A') || ' courses), and ML risk assessment ('
  || coalesce(at_risk_alert, 'unknown') || ' alert, ' || coalesce(printf('%.0f', retention_probability*100), 'N/A')
  || '% predicted retention).' AS rationale
FROM ready1""",
)

cte(
    "uploads",
    [],
    f"""SELECT event_id AS id, 'user' || CAST(user_id AS VARCHAR) || '@example.edu' AS user_email,
  'upload_' || CAST(event_id AS VARCHAR) || '.csv' AS filename,
  {_pick(['pdp_cohort_ar', 'pdp_cohort_submission', 'course_ar', 'course_submission', 'ml_predictions'], 'user_id % 5')} AS file_type,
  CASE WHEN event_type='error' AND event_id%3=0 THEN 0 ELSE CAST(floor(value*10) AS BIGINT) END AS rows_inserted,
  event_id%7 AS rows_skipped, CASE WHEN event_type='error' THEN 1+event_id%5 ELSE 0 END AS error_count,
  ts AS uploaded_at FROM events""",
)


def with_ctes(needs: list[str], body: str) -> str:
    """``body`` preceded by the named expressions and everything they need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body
