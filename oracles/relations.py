"""Common table expressions: the seven relations, the marts and the snapshots."""

from __future__ import annotations


def half_up(numerator: str, denominator: str, places: int) -> str:
    """Exact half-up rounding of a non-negative integer ratio, as a double."""
    scale = 10**places
    n, d = f"(({numerator})::HUGEINT)", f"(({denominator})::HUGEINT)"
    return (
        f"(CASE WHEN {d} = 0 THEN NULL ELSE "
        f"((2 * {n} * {scale} + {d}) // (2 * {d}))::DOUBLE / {scale} END)"
    )


def cents(column: str) -> str:
    """A two-place decimal as an integer number of hundredths."""
    return f"({column} * 100)::BIGINT"


RELATIONS = {
    "ord": """
        SELECT o_orderkey, n_name, c_mktsegment, n_regionkey AS k,
               repeat(chr(65 + n_regionkey), 3) AS code_module,
               2013 + (year(o_orderdate) - 1995) % 2 AS y,
               CASE WHEN month(o_orderdate) <= 6 THEN 0 ELSE 1 END AS h,
               (2013 + (year(o_orderdate) - 1995) % 2)::VARCHAR
                 || CASE WHEN month(o_orderdate) <= 6 THEN 'B' ELSE 'J' END AS code_presentation,
               o_custkey::INTEGER AS id_student,
               CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS dd
        FROM orders
        JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey""",
    "courses": """
        SELECT code_module, code_presentation,
               (234 + 9 * k - CASE WHEN k = 4 THEN 200 ELSE 0 END)::INTEGER
                 AS presentation_length_days
        FROM ord GROUP BY code_module, code_presentation, k""",
    "info": """
        SELECT code_module, code_presentation, id_student,
               CASE WHEN id_student % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               n_name AS region, c_mktsegment AS highest_education,
               CASE WHEN id_student % 29 = 0 THEN NULL
                    ELSE (10 * (id_student % 10))::VARCHAR || '-'
                         || (10 * (id_student % 10) + 10)::VARCHAR || '%' END AS imd_band,
               CASE id_student % 3 WHEN 0 THEN '0-35' WHEN 1 THEN '35-55' ELSE '55<=' END
                 AS age_band,
               (id_student % 4)::INTEGER AS previous_attempts,
               (30 * (1 + id_student % 4))::INTEGER AS studied_credits,
               CASE WHEN id_student % 10 = 0 THEN 'Y' ELSE 'N' END AS disability,
               CASE (id_student::BIGINT * 7 + 2 * y + h) % 10
                    WHEN 0 THEN 'Distinction' WHEN 1 THEN 'Pass' WHEN 2 THEN 'Pass'
                    WHEN 3 THEN 'Pass' WHEN 4 THEN 'Pass' WHEN 5 THEN 'Fail' WHEN 6 THEN 'Fail'
                    ELSE 'Withdrawn' END AS final_result
        FROM ord
        GROUP BY code_module, code_presentation, id_student, n_name, c_mktsegment, y, h""",
    "registration": """
        SELECT code_module, code_presentation, id_student,
               CASE WHEN id_student % 97 <> 0 THEN min(dd % 60) - 50 END::INTEGER
                 AS registration_day,
               CASE WHEN (id_student::BIGINT * 7 + 2 * y + h) % 10 >= 7 AND id_student % 11 <> 0
                    THEN 10 + max(dd) % 120 END::INTEGER AS unregistration_day
        FROM ord GROUP BY code_module, code_presentation, id_student, y, h""",
    "attempts": """
        SELECT info.*, registration_day, unregistration_day
        FROM info LEFT JOIN registration USING (code_module, code_presentation, id_student)""",
    "interactions": """
        SELECT code_module, code_presentation, id_student,
               (l_partkey % 100)::INTEGER AS id_site,
               ((CAST(l_shipdate AS DATE) - DATE '1995-01-01') % 140 - 14)::INTEGER
                 AS activity_day,
               l_quantity::INTEGER AS click_count
        FROM lineitem JOIN ord ON o_orderkey = l_orderkey""",
    "resources": """
        SELECT DISTINCT id_site, code_module, code_presentation,
               CASE id_site % 5 WHEN 0 THEN 'forumng' WHEN 1 THEN 'homepage'
                    WHEN 2 THEN 'oucontent' WHEN 3 THEN 'quiz' ELSE 'resource' END
                 AS activity_type,
               NULL::INTEGER AS week_from, NULL::INTEGER AS week_to
        FROM interactions""",
    "assessments": """
        SELECT ((y - 2013) * 2 + h) * 100 + 10 * k + a AS id_assessment,
               code_module, code_presentation,
               CASE WHEN a = 7 THEN 'Exam' WHEN a % 2 = 1 THEN 'TMA' ELSE 'CMA' END
                 AS assessment_type,
               CASE WHEN a < 7 THEN 20 * a END::INTEGER AS due_day,
               CASE a WHEN 1 THEN 10 WHEN 2 THEN 15 WHEN 3 THEN 20 WHEN 4 THEN 15
                      WHEN 7 THEN 100 ELSE 20 END::DECIMAL(6,2) AS weight
        FROM (SELECT DISTINCT code_module, code_presentation, k, y, h FROM ord) AS p,
             (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS a) AS n""",
    "submissions": """
        SELECT id_assessment::INTEGER AS id_assessment, id_student,
               (due_day + (id_student + id_assessment) % 9 - 5)::INTEGER AS submitted_day,
               (id_student + id_assessment) % 67 = 0 AS is_banked,
               CASE WHEN (id_student + id_assessment) % 53 = 0 THEN NULL
                    ELSE (id_student::BIGINT * 13 + id_assessment * 29) % 101
               END::DECIMAL(5,2) AS score
        FROM info JOIN assessments USING (code_module, code_presentation)
        WHERE assessment_type <> 'Exam'
          AND (id_student::BIGINT * 31 + id_assessment * 17) % 100 < 70""",
    "weekly": """
        SELECT code_module, code_presentation, id_student,
               floor(activity_day / 7.0)::INTEGER AS course_week,
               sum(click_count)::BIGINT AS click_count,
               count(DISTINCT activity_day)::INTEGER AS active_days,
               count(DISTINCT id_site)::INTEGER AS distinct_sites,
               max(activity_day) AS latest_activity_day,
               count(*) AS source_rows
        FROM interactions GROUP BY ALL""",
    "progress": """
        SELECT t.code_module, t.code_presentation, t.id_student,
               a.id_assessment, a.assessment_type, a.due_day, a.weight,
               s.submitted_day, s.score, s.is_banked,
               s.submitted_day - a.due_day AS submission_delay_days,
               (s.id_student IS NULL)::INTEGER AS missing_submission,
               (coalesce(s.score < 40, false) OR s.id_student IS NULL)::INTEGER
                 AS adverse_assessment_event
        FROM attempts t
        JOIN assessments a USING (code_module, code_presentation)
        LEFT JOIN submissions s
          ON s.id_assessment = a.id_assessment AND s.id_student = t.id_student
        WHERE a.due_day IS NOT NULL AND a.assessment_type <> 'Exam'""",
    "aligned": """
        SELECT t.code_module, t.code_presentation, t.id_student, t.final_result,
               t.unregistration_day, w.course_week,
               w.course_week * 7 - t.unregistration_day AS days_relative_to_unregistration,
               w.click_count, w.active_days
        FROM attempts t JOIN weekly w USING (code_module, code_presentation, id_student)
        WHERE t.unregistration_day IS NOT NULL AND t.final_result = 'Withdrawn'""",
    "outcomes": f"""
        SELECT code_module, code_presentation, count(*) AS student_attempts,
               count(DISTINCT id_student) AS unique_students_within_presentation,
               count(*) FILTER (final_result = 'Distinction') AS distinctions,
               count(*) FILTER (final_result = 'Pass') AS passes,
               count(*) FILTER (final_result = 'Fail') AS fails,
               count(*) FILTER (final_result = 'Withdrawn') AS withdrawals,
               {half_up("count(*) FILTER (final_result = 'Withdrawn')", "count(final_result)", 4)}
                 AS withdrawal_rate
        FROM attempts GROUP BY 1, 2""",
    "weekly_summary": f"""
        SELECT code_module, code_presentation, course_week,
               count(*) AS active_student_attempts,
               quantile_cont(click_count, 0.5) AS median_clicks,
               quantile_cont(click_count, 0.75) AS p75_clicks,
               {half_up("sum(active_days)", "count(active_days)", 2)} AS mean_active_days
        FROM weekly WHERE course_week BETWEEN 0 AND 12 GROUP BY 1, 2, 3""",
    "spine": """
        SELECT t.code_module, t.code_presentation, t.id_student, n.course_week,
               n.course_week * 7 + 6 AS snapshot_day
        FROM attempts t
        JOIN courses c USING (code_module, code_presentation)
        JOIN (SELECT unnest(range(0, 13))::INTEGER AS course_week) n
          ON n.course_week <= least(12, floor(c.presentation_length_days / 7.0))
        WHERE t.registration_day <= n.course_week * 7 + 6
          AND coalesce(t.unregistration_day > n.course_week * 7 + 6, true)""",
    "padded": """
        SELECT s.*, coalesce(w.click_count, 0) AS clicks_7d,
               coalesce(w.active_days, 0) AS active_days_7d,
               coalesce(w.distinct_sites, 0) AS distinct_sites_7d, w.latest_activity_day
        FROM spine s
        LEFT JOIN weekly w USING (code_module, code_presentation, id_student, course_week)""",
    "engagement": """
        SELECT *, lag(clicks_7d, 1, 0) OVER att AS clicks_prior_7d,
               sum(clicks_7d) OVER two::BIGINT AS clicks_14d,
               sum(clicks_7d) OVER run::BIGINT AS clicks_to_date,
               sum(active_days_7d) OVER two::BIGINT AS active_days_14d,
               sum(distinct_sites_7d) OVER two::BIGINT AS distinct_sites_14d,
               max(latest_activity_day) OVER run AS latest_feature_day
        FROM padded
        WINDOW att AS (PARTITION BY code_module, code_presentation, id_student
                       ORDER BY course_week),
               two AS (PARTITION BY code_module, code_presentation, id_student
                       ORDER BY course_week ROWS 1 PRECEDING),
               run AS (PARTITION BY code_module, code_presentation, id_student
                       ORDER BY course_week ROWS UNBOUNDED PRECEDING)""",
    "state": f"""
        SELECT e.*, known.submissions_to_date, known.mean_score_to_date,
               known.missing_due_to_date, known.weighted_score_to_date
        FROM engagement e, LATERAL (
            SELECT count(*) FILTER (p.submitted_day <= e.snapshot_day) AS submissions_to_date,
                   {half_up(
                       "coalesce(sum((p.score * 100)::BIGINT)"
                       " FILTER (p.submitted_day <= e.snapshot_day), 0)",
                       "100 * count(p.score) FILTER (p.submitted_day <= e.snapshot_day)",
                       3,
                   )} AS mean_score_to_date,
                   count(*) FILTER (p.due_day <= e.snapshot_day AND p.missing_submission = 1)
                     AS missing_due_to_date,
                   {half_up(
                       "coalesce(sum((p.score * 100)::BIGINT * (p.weight * 100)::BIGINT)"
                       " FILTER (p.submitted_day <= e.snapshot_day), 0)",
                       "1000000",
                       3,
                   )} AS weighted_score_to_date
            FROM progress p
            WHERE p.code_module = e.code_module AND p.code_presentation = e.code_presentation
              AND p.id_student = e.id_student
        ) AS known""",
    "upcoming": """
        SELECT s.*, p.id_assessment AS next_assessment_id, p.due_day AS next_assessment_due_day,
               p.adverse_assessment_event AS target_next_assessment_event
        FROM spine s
        JOIN progress p USING (code_module, code_presentation, id_student)
        WHERE p.due_day > s.snapshot_day
        QUALIFY row_number() OVER (
            PARTITION BY s.code_module, s.code_presentation, s.id_student, s.course_week
            ORDER BY p.due_day, p.id_assessment) = 1""",
    "snapshots": """
        SELECT st.code_module, st.code_presentation, st.id_student,
               t.gender, t.age_band, t.disability, t.imd_band,
               st.course_week, st.snapshot_day, st.clicks_7d, st.clicks_prior_7d,
               st.clicks_14d, st.clicks_to_date, st.active_days_14d, st.distinct_sites_14d,
               st.snapshot_day - st.latest_feature_day AS days_since_activity,
               st.clicks_7d - st.clicks_prior_7d AS engagement_change,
               st.submissions_to_date, st.mean_score_to_date, st.missing_due_to_date,
               st.weighted_score_to_date, st.latest_feature_day,
               u.next_assessment_id, u.next_assessment_due_day, u.target_next_assessment_event,
               coalesce(t.unregistration_day > st.snapshot_day
                        AND t.unregistration_day <= st.snapshot_day + 28, false)::INTEGER
                 AS target_withdrawal_28d
        FROM state st
        JOIN attempts t USING (code_module, code_presentation, id_student)
        JOIN upcoming u USING (code_module, code_presentation, id_student, course_week)""",
    "scored": """
        SELECT *, CASE WHEN left(code_presentation, 4)::INTEGER <= 2013 THEN 'train'
                       WHEN code_presentation = '2014B' THEN 'validation'
                       ELSE 'test' END AS split,
               'arithmetic' AS model,
               ((id_student::BIGINT * 37 + course_week * 101) % 1000) / 1000.0::DOUBLE
                 AS probability,
               target_next_assessment_event AS y
        FROM snapshots""",
}

_NEEDS = {
    "ord": [],
    "courses": ["ord"],
    "info": ["ord"],
    "registration": ["ord"],
    "attempts": ["info", "registration"],
    "interactions": ["ord"],
    "resources": ["interactions"],
    "assessments": ["ord"],
    "submissions": ["info", "assessments"],
    "weekly": ["interactions"],
    "progress": ["attempts", "assessments", "submissions"],
    "aligned": ["attempts", "weekly"],
    "outcomes": ["attempts"],
    "weekly_summary": ["weekly"],
    "spine": ["attempts", "courses"],
    "padded": ["spine", "weekly"],
    "engagement": ["padded"],
    "state": ["engagement", "progress"],
    "upcoming": ["spine", "progress"],
    "snapshots": ["state", "upcoming", "attempts"],
    "scored": ["snapshots"],
}


def sql(needs: str, body: str, **extra: str) -> str:
    """A complete query: the named relations with what they need, then extra CTEs and a body."""
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in _NEEDS[name]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    parts = [f"{n} AS ({RELATIONS[n]})" for n in order]
    parts += [f"{n} AS ({text})" for n, text in extra.items()]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
