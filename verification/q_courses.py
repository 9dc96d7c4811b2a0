"""Course reports."""

from tassel.operators import courses

from .base_sql import DFWI, PASS, pct, with_ctes
from .registry import register
from .tables import enrollments


def _rates(where: str = "", having: str = "HAVING count(*) >= 10") -> str:
    return f"""SELECT course_prefix, course_number, max(course_name) AS course_name, max(gateway_type) AS gateway_type,
 count(*) AS enrollments, count(*) FILTER (WHERE grade IN {DFWI}) AS dfwi_count,
 {pct(f'count(*) FILTER (WHERE grade IN {DFWI})', 'count(*)')} AS dfwi_rate,
 {pct(f'count(*) FILTER (WHERE {PASS})', 'count(*)')} AS pass_rate
FROM enr {where} GROUP BY course_prefix, course_number {having}"""


register(
    "dfwi_by_course",
    lambda s, d: courses.dfwi_by_course(enrollments(s, d)),
    with_ctes(["enr"], _rates() + " "),
)
register(
    "dfwi_gateway_cohort_term",
    lambda s, d: courses.dfwi_by_course(
        enrollments(s, d), True, 1, "2020-21", "FALL", sort_by="enrollments", descending=False
    ),
    with_ctes(
        ["enr"],
        _rates(
            "WHERE gateway_type IN ('M','E') AND cohort='2020-21' AND academic_term='FALL'", "HAVING count(*) >= 1"
        ),
    ),
)
register(
    "top_dfwi",
    lambda s, d: courses.top_dfwi(enrollments(s, d)),
    with_ctes(
        ["enr"],
        f"""SELECT course_prefix || ' ' || course_number AS course, count(*) AS enrollments,
 ((20000*count(*) FILTER (WHERE grade IN {DFWI}) + count(*)) // (2*count(*))) / 10000.0::DOUBLE AS dfwi_rate
FROM enr GROUP BY course_prefix, course_number HAVING count(*)>=10 ORDER BY dfwi_rate DESC, course LIMIT 5""",
    ),
)
register(
    "gateway_funnel",
    lambda s, d: courses.gateway_funnel(enrollments(s, d)),
    with_ctes(
        ["enr"],
        f"""SELECT gateway_type, cohort, count(*) AS attempted, count(*) FILTER (WHERE {PASS}) AS passed,
 count(*) FILTER (WHERE grade IN {DFWI}) AS dfwi
FROM enr WHERE gateway_type IN ('M','E') GROUP BY gateway_type, cohort""",
    ),
)

_PAIR_JOIN = """FROM enr a JOIN enr b ON a.student_guid=b.student_guid AND a.academic_year=b.academic_year
 AND a.academic_term=b.academic_term"""
_ORDERED = """AND (a.course_prefix < b.course_prefix OR (a.course_prefix = b.course_prefix AND a.course_number < b.course_number))"""
_PA = PASS.replace("grade", "a.grade")
_PB = PASS.replace("grade", "b.grade")
_BOTH = f"count(*) FILTER (WHERE {_PA} AND {_PB})"


def _pairs(tail: str) -> str:
    return f"""SELECT a.course_prefix AS prefix_a, a.course_number AS number_a, b.course_prefix AS prefix_b,
 b.course_number AS number_b, max(a.course_name) AS name_a, max(b.course_name) AS name_b,
 count(*) AS co_enrollment_count, {pct(_BOTH, 'count(*)')} AS both_pass_rate
{_PAIR_JOIN} {_ORDERED} GROUP BY 1,2,3,4 HAVING count(*) >= 20 {tail}"""


register(
    "co_enrollment_pairs",
    lambda s, d: courses.co_enrollment_pairs(enrollments(s, d)),
    with_ctes(
        ["enr"], _pairs("ORDER BY co_enrollment_count DESC, prefix_a, number_a, prefix_b, number_b LIMIT 20")
    ),
)
register(
    "co_enrollment_all_pairs",
    lambda s, d: courses.co_enrollment_pairs(enrollments(s, d), k=None),
    with_ctes(["enr"], _pairs("")),
)
register(
    "co_enrollment_top_by_pass_rate",
    lambda s, d: courses.co_enrollment_pairs(enrollments(s, d), by_pass_rate=True),
    with_ctes(
        ["enr"], _pairs("ORDER BY co_enrollment_count DESC, prefix_a, number_a, prefix_b, number_b LIMIT 20")
    ),
)
register(
    "dfwi_by_combo",
    lambda s, d: courses.dfwi_by_combo(enrollments(s, d)),
    with_ctes(
        ["enr"],
        f"""SELECT a.course_prefix AS prefix_a, a.course_number AS number_a, b.course_prefix AS prefix_b,
 b.course_number AS number_b, count(*) AS co_enrollment_count,
 {pct(f"count(*) FILTER (WHERE a.grade IN {DFWI} OR b.grade IN {DFWI})", 'count(*)')} AS dfwi_rate
{_PAIR_JOIN} {_ORDERED} GROUP BY 1,2,3,4 HAVING count(*) >= 20
ORDER BY dfwi_rate DESC, co_enrollment_count DESC, prefix_a, number_a, prefix_b, number_b LIMIT 10""",
    ),
)
A, B = ("STA", "95"), ("ECO", "100")
register(
    "pair_courses",
    lambda s, d: courses.pair_courses(enrollments(s, d), A, B),
    with_ctes(
        ["enr"],
        f"""SELECT course_prefix, course_number, count(*) AS enrollments,
 {pct(f'count(*) FILTER (WHERE grade IN {DFWI})', 'count(*)')} AS dfwi_rate,
 {pct(f'count(*) FILTER (WHERE {PASS})', 'count(*)')} AS pass_rate
FROM enr WHERE (course_prefix='STA' AND course_number='95') OR (course_prefix='ECO' AND course_number='100')
GROUP BY course_prefix, course_number""",
    ),
)

_DELIVERY = "CASE a.delivery_method WHEN 'F' THEN 'Face-to-Face' WHEN 'O' THEN 'Online' WHEN 'H' THEN 'Hybrid' ELSE coalesce(a.delivery_method,'Unknown') END"
_INSTRUCTOR = "CASE a.instructor_status WHEN 'FT' THEN 'Full-Time Instructor' WHEN 'PT' THEN 'Part-Time Instructor' ELSE coalesce(a.instructor_status,'Unknown') END"


def _breakdown(keys: str, where: str, having: str, group: str) -> str:
    parts = []
    for attribute, label, column in (
        ("delivery_method", _DELIVERY, "a.delivery_method"),
        ("instructor_status", _INSTRUCTOR, "a.instructor_status"),
    ):
        parts.append(
            f"""SELECT {keys} '{attribute}' AS attribute, count(*) AS co_count, {pct(_BOTH, 'count(*)')} AS both_pass_rate,
 {label} AS label {_PAIR_JOIN} {where} GROUP BY {group} {column} {having}"""
        )
    return "\nUNION ALL\n".join(parts)


register(
    "pair_breakdown",
    lambda s, d: courses.pair_breakdown(enrollments(s, d), A, B),
    with_ctes(
        ["enr"],
        _breakdown(
            "",
            "WHERE a.course_prefix='STA' AND a.course_number='95' AND b.course_prefix='ECO' AND b.course_number='100'",
            "",
            "",
        ),
    ),
)
_KEYS = "a.course_prefix AS course_prefix_a, a.course_number AS course_number_a, b.course_prefix AS course_prefix_b, b.course_number AS course_number_b,"
_GROUP = "a.course_prefix, a.course_number, b.course_prefix, b.course_number,"
register(
    "all_pair_breakdowns",
    lambda s, d: courses.all_pair_breakdowns(enrollments(s, d)),
    with_ctes(
        ["enr"],
        _breakdown(
            _KEYS,
            "WHERE NOT (a.course_prefix=b.course_prefix AND a.course_number=b.course_number)",
            "HAVING count(*) >= 20",
            _GROUP,
        ),
    ),
)


def _sets_sql(most: int, min_count: int) -> str:
    """Every combination counted for itself: one join a course, no pruning."""
    parts = []
    for n in range(2, most + 1):
        aliases = [f"s{i}" for i in range(n)]
        joins = "".join(f" JOIN sat {b} USING (student_guid, academic_year, academic_term)" for b in aliases[1:])
        order = " AND ".join(f"{a}.course < {b}.course" for a, b in zip(aliases, aliases[1:]))
        names = " || ' + ' || ".join(f"{a}.label" for a in aliases)
        bad, good = " OR ".join(f"{a}.bad" for a in aliases), " AND ".join(f"{a}.good" for a in aliases)
        parts.append(
            f"""SELECT {names} AS courses, {n} AS n_courses, count(*) AS sittings, {pct(f'count(*) FILTER (WHERE {bad})', 'count(*)')} AS dfwi_rate,
 {pct(f'count(*) FILTER (WHERE {good})', 'count(*)')} AS all_pass_rate
FROM sat s0{joins} WHERE {order} GROUP BY 1 HAVING count(*) >= {min_count}"""
        )
    return "\nUNION ALL ".join(parts)


SET_SIZE, SET_COUNT = 4, 3
register(
    "course_sets",
    lambda s, d: courses.course_sets(enrollments(s, d), SET_SIZE, SET_COUNT),
    with_ctes(["enr"], "@@").replace(
        "\n@@",
        f""",
sat AS (SELECT student_guid, academic_year, academic_term, (course_prefix, course_number) AS course, course_prefix || ' ' || course_number AS label,
  coalesce(bool_or(grade IN {DFWI}), false) AS bad, coalesce(bool_and(coalesce({PASS}, false)), false) AS good
 FROM enr WHERE student_guid IS NOT NULL AND academic_year IS NOT NULL AND academic_term IS NOT NULL GROUP BY 1,2,3,4,5)
{_sets_sql(SET_SIZE, SET_COUNT)}""",
    ),
)
