"""Chart tables."""

from pyspark.sql import functions as F

from tassel.functions.scoring import ALERT_ORDER
from tassel.operators import charts, scored

from .base_sql import pct, with_ctes
from .q_students import _later
from .registry import register
from .tables import scored_rows

P = "program_of_study_year_1"


def chart(name, build, sql, needs=("scored",)):
    register(f"chart_{name}", lambda s, d: build(scored_rows(s, d)), with_ctes(list(needs), sql))


chart(
    "risk_score_histogram",
    charts.risk_score_histogram,
    "SELECT CAST(least(floor(risk_score/25)*25, 75) AS INT) AS bin_start, count(*) AS students FROM scored GROUP BY 1",
)
_RISKY = "WHERE at_risk_alert IN ('HIGH','URGENT')"
chart(
    "at_risk_by_program",
    lambda df: charts.at_risk_by_program(df, 5),
    f"SELECT {P}, count(*) AS at_risk_students FROM scored {_RISKY} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
chart(
    "at_risk_by_institution",
    charts.at_risk_by_institution,
    f"SELECT institution_id, count(*) AS at_risk_students FROM scored {_RISKY} GROUP BY 1",
)
chart(
    "retention_by_cohort",
    charts.retention_by_cohort,
    "SELECT cohort, round(avg(retention),6) AS actual_retention, round(avg(retention_probability),6) AS predicted_retention FROM scored GROUP BY 1",
)
chart(
    "gpa_by_performance",
    charts.gpa_by_performance,
    "SELECT gpa_performance, "
    + ", ".join(
        f"round(quantile_cont(average_grade,{q}),6) AS {n}"
        for q, n in ((0, "min_grade"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "max_grade"))
    )
    + " FROM scored WHERE average_grade IS NOT NULL GROUP BY 1",
)
chart(
    "completion_vs_retention",
    charts.completion_vs_retention,
    """SELECT at_risk_alert, count(*) AS students, round(regr_slope(retention_probability, course_completion_rate),4) AS slope,
 round(regr_intercept(retention_probability, course_completion_rate),4) AS intercept,
 round(corr(retention_probability, course_completion_rate),4) AS correlation
FROM scored WHERE course_completion_rate IS NOT NULL GROUP BY 1""",
)
for _by in ("cohort", P):
    chart(
        "credits_by_year" if _by == "cohort" else "credits_by_year_program",
        lambda df, by=_by: charts.credits_by_year(df, by),
        " UNION ALL ".join(
            f"SELECT {_by}, {i} AS year, coalesce(sum(number_of_credits_earned_year_{i}),0.0) AS credits FROM scored GROUP BY {_by}"
            for i in range(1, 5)
        ),
    )
chart(
    "gateway_impact",
    charts.gateway_impact,
    """SELECT completedgatewaymathyear1, completedgatewayenglishyear1, count(*) AS students, round(avg(retention_probability),6) AS avg_probability
FROM scored GROUP BY 1,2""",
)
chart(
    "retention_by_demographic",
    charts.retention_by_demographic,
    " UNION ALL ".join(
        f"""SELECT '{c}' AS dimension, {c} AS value, count(*) AS n, round(avg(retention),6) AS actual_retention,
 round(avg(retention_probability),6) AS predicted_retention FROM scored GROUP BY {c}"""
        for c in charts.DEMOGRAPHICS
    ),
)
chart(
    "firstgen_risk_profile",
    charts.firstgen_risk_profile,
    "SELECT first_gen, "
    + ", ".join(f"count(*) FILTER (WHERE at_risk_alert='{a}') AS {a.lower()}" for a in ALERT_ORDER)
    + " FROM scored GROUP BY 1",
)
chart(
    "placement_vs_retention",
    charts.placement_vs_retention,
    "SELECT math_placement, count(*) AS students, round(avg(retention_probability),6) AS avg_probability FROM scored GROUP BY 1",
)
chart(
    "retention_confusion",
    charts.retention_confusion,
    """SELECT a AS actual, p AS predicted, (SELECT count(*) FROM scored WHERE retention=a AND retention_prediction=p) AS students
FROM (VALUES (0),(1)) x(a), (VALUES (0),(1)) y(p)""",
)
chart(
    "time_to_credential_hist",
    charts.time_to_credential_hist,
    """SELECT years, sum(p) AS predicted, sum(a) AS actual FROM (
 SELECT CAST(least(5, greatest(1, floor(predicted_time_to_credential))) AS INT) AS years, 1 AS p, 0 AS a FROM scored WHERE predicted_time_to_credential>0
 UNION ALL SELECT CAST(least(5, greatest(1, floor(time_to_credential))) AS INT), 0, 1 FROM scored WHERE time_to_credential>0) GROUP BY 1""".replace(
        "sum(p) AS predicted, sum(a) AS actual", "CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(a) AS BIGINT) AS actual"
    ),
)
chart(
    "graduation_year_counts",
    charts.graduation_year_counts,
    "SELECT CAST(floor(predicted_graduation_year) AS INT) AS graduation_year, count(*) AS students FROM scored GROUP BY 1",
)
for _by in ("cohort", P):
    chart(
        "credential_mix" if _by == "cohort" else "credential_mix_program",
        lambda df, by=_by: charts.credential_mix(df, by),
        " UNION ALL ".join(
            f"SELECT {_by}, '{c}' AS credential, round(avg({c}),6) AS mean_probability FROM scored GROUP BY {_by}"
            for c in ("prob_no_credential", "prob_certificate", "prob_associate", "prob_bachelor")
        ),
    )
chart(
    "retention_by_zip",
    charts.retention_by_zip,
    "SELECT zip_code, count(*) AS n, round(avg(retention_probability),6) AS avg_probability FROM scored GROUP BY 1",
)
chart(
    "intensity_impact",
    charts.intensity_impact,
    """SELECT enrollment_intensity_first_term, count(*) AS students, round(avg(retention),6) AS avg_retention,
 round(avg(course_completion_rate),6) AS avg_completion, round(avg(average_grade),6) AS avg_grade FROM scored GROUP BY 1""",
)
chart(
    "online_share_impact",
    charts.online_share_impact,
    """SELECT CASE WHEN pct_online<0.25 THEN '0-25%' WHEN pct_online<0.5 THEN '25-50%' WHEN pct_online<0.75 THEN '50-75%' ELSE '75-100%' END AS online_share,
 count(*) AS students, round(avg(retention_probability),6) AS avg_probability FROM scored WHERE pct_online IS NOT NULL GROUP BY 1""",
)
chart(
    "dual_enrollment_impact",
    charts.dual_enrollment_impact,
    """SELECT CASE WHEN dual_and_summer_enrollment IN ('DS','SE','DE') THEN 'Yes' ELSE 'No' END AS dual_enrollment,
 round(avg(retention),6) AS retention_rate, round(avg(course_completion_rate),6) AS completion_rate, round(avg(average_grade),6) AS avg_grade,
 round(avg(retention_probability),6) AS avg_probability FROM scored GROUP BY 1""",
)
for _name, _bottom, _k in (("program_performance", False, 20), ("program_performance_bottom", True, 5)):
    chart(
        _name,
        lambda df, k=_k, b=_bottom: charts.program_performance(df, k, b),
        f"""SELECT {P}, round(avg(retention_probability),6) AS avg_probability, count(*) AS students FROM scored GROUP BY 1
ORDER BY 2 {'ASC' if _bottom else 'DESC'}, 1 LIMIT {_k}""",
    )
chart(
    "program_risk_score",
    charts.program_risk_score,
    f"SELECT {P}, round(avg(risk_score),6) AS avg_risk_score FROM scored GROUP BY 1",
)


def _gate(x: str) -> str:
    tried = f"count(*) FILTER (WHERE attemptedgateway{x}year1='Y')"
    done = f"count(*) FILTER (WHERE attemptedgateway{x}year1='Y' AND completedgateway{x}year1='Y')"
    return pct(done, tried)


chart(
    "gateway_completion_rate",
    charts.gateway_completion_rate,
    f"SELECT {_gate('math')} AS math_rate, {_gate('english')} AS english_rate FROM scored",
)
chart(
    "roi_estimate",
    lambda df: charts.roi_estimate(df, 0.3, 5000.0),
    f"""SELECT n AS flagged, n*0.3::DOUBLE AS expected_kept, n*0.3::DOUBLE*5000.0::DOUBLE AS estimated_value FROM (SELECT count(*) AS n FROM scored {_RISKY})""",
)


def _baseline(df, k=None):
    return charts.baseline_at_risk(df, k).withColumn("reasons", F.array_join("reasons", ", "))


_MO = "coalesce(completedgatewaymathyear1 NOT IN ('Y','C'), true)"
_EO = "coalesce(completedgatewayenglishyear1 NOT IN ('Y','C'), true)"
_BASE = f"""SELECT student_guid,
 CASE WHEN f>=3 THEN 3 WHEN f>=1 THEN 1 ELSE 0 END + CASE WHEN {_MO} THEN 2 ELSE 0 END + CASE WHEN {_EO} THEN 2 ELSE 0 END
 + CASE WHEN c<12 THEN 2 WHEN c<24 THEN 1 ELSE 0 END AS points,
 array_to_string(list_filter([CASE WHEN f>=1 THEN 'failed courses' END, CASE WHEN {_MO} THEN 'gateway math open' END,
  CASE WHEN {_EO} THEN 'gateway English open' END, CASE WHEN c<24 THEN 'low first-year credits' END], lambda x: x IS NOT NULL), ', ') AS reasons
FROM (SELECT *, coalesce(failing_grades_count,0) AS f, coalesce(number_of_credits_earned_year_1,0) AS c FROM scored)"""
chart("baseline_at_risk", _baseline, _BASE)
chart("baseline_at_risk_top", lambda df: _baseline(df, 25), _BASE + " ORDER BY points DESC, student_guid LIMIT 25")


def _treated(s, d):
    changes = scored.snapshot_pairs(_later(s, d), scored_rows(s, d)).withColumn(
        "treated", F.substring("student_guid", 11, 1).isin("1", "2", "3", "4", "5")
    )
    return charts.intervention_success_rate(changes, ALERT_ORDER)


def _treated_sql() -> str:
    from .q_students import _with_later

    rank = "CASE {0} WHEN 'URGENT' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
    return _with_later(
        f"""SELECT n AS treated_students, i AS improved_students, {pct('i', 'n')} AS success_rate FROM (
SELECT count(*) AS n, count(*) FILTER (WHERE {rank.format('s.at_risk_alert')} > {rank.format('alert2')}) AS i
FROM scored s JOIN later l ON s.student_guid=l.student_guid
WHERE substr(s.student_guid,11,1) IN ('1','2','3','4','5'))"""
    )


register("chart_intervention_success_rate", _treated, _treated_sql())
