import pytest
from pyspark.sql import functions as F

from courselake.functions.columns import week_of
from courselake.operators import features as f
from courselake.operators import marts, quality
from courselake.schemas import ATTEMPT_WEEK

AK = ("AAA", "2013J", 1)


def attempts(spark, registration=-5, unregistration=None):
    return spark.createDataFrame(
        [(*AK, "F", "0-35", "N", None, registration, unregistration)],
        "code_module string, code_presentation string, id_student int, gender string,"
        "age_band string, disability string, imd_band string, registration_day int,"
        "unregistration_day int",
    )


def presentations(spark, length):
    return spark.createDataFrame(
        [("AAA", "2013J", length)],
        "code_module string, code_presentation string, presentation_length_days int",
    )


def activity(spark, *rows):
    return spark.createDataFrame(
        [(*AK, site, day, clicks) for site, day, clicks in rows],
        "code_module string, code_presentation string, id_student int, id_site int,"
        "activity_day int, click_count int",
    )


def progress(spark, *rows):
    """Rows of (id, due, weight, submitted, score); submitted None means no row exists."""
    return spark.createDataFrame(
        [
            (*AK, i, due, weight, sub, score, int(sub is None),
             int(sub is None or (score is not None and score < 40)))
            for i, due, weight, sub, score in rows
        ],
        "code_module string, code_presentation string, id_student int, id_assessment int,"
        "due_day int, weight double, submitted_day int, score double, missing_submission int,"
        "adverse_assessment_event int",
    ).withColumns(
        {"weight": F.col("weight").cast("decimal(6,2)"), "score": F.col("score").cast("decimal(5,2)")}
    )


def test_snapshot_day(spark):
    weeks = spark.createDataFrame([(0,), (1,), (4,)], "course_week int")
    days = [r.d for r in weeks.select(f.snapshot_day("course_week").alias("d")).collect()]
    assert days == [6, 13, 34]
    bad = spark.createDataFrame([(0,), (-1,)], "course_week int")
    with pytest.raises(Exception, match="negative"):
        bad.select(f.snapshot_day("course_week").alias("d")).collect()


def test_week_floors(spark):
    days = spark.createDataFrame([(-8,), (-7,), (-1,), (0,), (6,), (7,)], "d int")
    assert [r.w for r in days.select(week_of("d").alias("w")).collect()] == [-2, -1, -1, 0, 0, 1]


@pytest.mark.parametrize("length,last", [(70, 10), (69, 9), (6, 0), (0, 0), (-1, None), (300, 12)])
def test_spine_length(spark, length, last):
    weeks = f.attempt_weeks(attempts(spark), presentations(spark, length)).collect()
    expected = [] if last is None else list(range(last + 1))
    assert sorted(r.course_week for r in weeks) == expected


def test_spine_registration_edges(spark):
    def weeks(reg, unreg):
        rows = f.attempt_weeks(attempts(spark, reg, unreg), presentations(spark, 34)).collect()
        return sorted(r.course_week for r in rows)

    assert weeks(None, None) == []
    assert weeks(13, None) == [1, 2, 3, 4]
    assert weeks(14, None) == [2, 3, 4]
    assert weeks(-5, 13) == [0]
    assert weeks(-5, 14) == [0, 1]


def test_days_since(spark):
    probe = spark.createDataFrame(
        [(*AK, 28), (*AK, -4), (*AK, 4)],
        "code_module string, code_presentation string, id_student int, cutoff int",
    )
    events = activity(spark, (1, -3, 1), (1, 4, 1), (1, 18, 1), (1, 35, 1))
    out = {r.cutoff: r.days_since for r in f.days_since(probe, events, "cutoff").collect()}
    assert out == {28: 10, -4: None, 4: 0}


def test_leakage_guard(spark):
    leaking = spark.createDataFrame([(14, 15)], "snapshot_day int, latest_feature_day int")
    with pytest.raises(ValueError, match="future information"):
        quality.assert_no_future(leaking)
    unknown = spark.createDataFrame([(14, None)], "snapshot_day int, latest_feature_day int")
    quality.assert_no_future(unknown)
    with pytest.raises(ValueError, match="missing"):
        quality.assert_no_future(unknown.drop("snapshot_day"))


def test_split(spark):
    codes = spark.createDataFrame(
        [("2013B",), ("2013J",), ("2014B",), ("2014J",)], "code_presentation string"
    )
    split = {r.code_presentation: r.split for r in f.temporal_split(codes).collect()}
    assert split == {"2013B": "train", "2013J": "train", "2014B": "validation", "2014J": "test"}
    with pytest.raises(ValueError, match="empty"):
        f.require_splits(f.temporal_split(codes.filter("code_presentation <> '2014B'")))


def test_engagement_windows_ignore_ineligible_weeks(spark):
    weekly = marts.weekly_engagement(
        activity(spark, (1, -2, 50), (1, 1, 7), (2, 8, 5), (3, 8, 1), (2, 15, 2), (4, 30, 4))
    )
    spine = f.attempt_weeks(attempts(spark, registration=10), presentations(spark, 34))
    rows = {r.course_week: r for r in f.engagement_windows(spine, weekly).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert [rows[w].clicks_7d for w in (1, 2, 3, 4)] == [6, 2, 0, 4]
    assert [rows[w].clicks_prior_7d for w in (1, 2, 3, 4)] == [0, 6, 2, 0]
    assert [rows[w].clicks_14d for w in (1, 2, 3, 4)] == [6, 8, 2, 4]
    assert [rows[w].clicks_to_date for w in (1, 2, 3, 4)] == [6, 8, 8, 12]
    assert [rows[w].distinct_sites_14d for w in (1, 2, 3, 4)] == [2, 3, 1, 1]
    assert [rows[w].days_since_activity for w in (1, 2, 3, 4)] == [5, 5, 12, 4]


def test_packed_events_keep_order_and_content(spark):
    rows = spark.createDataFrame(
        [(-9, 5, 1), (0, 2147483647, 1), (0, 2147483647, 0), (1, 1, 0), (20, 7, 1)],
        "due int, id int, bad int",
    ).withColumn("e", f._pack_event("due", "id", "bad"))
    out = rows.orderBy("e").select(
        f._event_due_day(F.col("e")), f._event_assessment(F.col("e")), f._event_adverse(F.col("e"))
    )
    got = [tuple(r) for r in out.collect()]
    assert got == sorted(tuple(r)[:3] for r in rows.collect())


def history(spark, rows, rule="reference", length=40):
    spine = f.attempt_weeks(attempts(spark), presentations(spark, length))
    weekly = marts.weekly_engagement(activity(spark, (1, 0, 1)))
    state = f.assessment_state(spine, weekly, progress(spark, *rows), rule)
    ahead = f.next_assessment(state).withColumn(
        "upcoming",
        F.struct("next_assessment_id", "next_assessment_due_day", "target_next_assessment_event"),
    )
    return {r.course_week: r for r in ahead.collect()}


def test_history_and_next_assessment(spark):
    rows = history(
        spark,
        [
            (11, 6, 10.0, 6, 33.33),   # due and handed in on the snapshot day of week 0
            (12, 20, 20.0, 29, 80.0),  # handed in late, in week 4
            (13, 20, 30.0, None, None),  # never handed in
            (14, 200, 40.0, -9, None),  # handed in before the start, no score, due after week 12
        ],
    )
    assert [rows[w].submissions_to_date for w in range(6)] == [2, 2, 2, 2, 3, 3]
    assert float(rows[0].mean_score_to_date) == 33.33
    assert float(rows[4].mean_score_to_date) == 56.665
    assert float(rows[4].weighted_score_to_date) == 19.333
    assert [rows[w].missing_due_to_date for w in range(6)] == [0, 0, 1, 1, 1, 1]
    nexts = [rows[w].upcoming for w in range(6)]
    assert nexts == [(12, 20, 0), (12, 20, 0)] + [(14, 200, 0)] * 4


def test_as_of_rule_counts_late_work_until_it_arrives(spark):
    rows = history(
        spark,
        [(12, 20, 20.0, 29, 80.0), (13, 20, 30.0, None, None), (14, 300, 1.0, 0, 5.0)],
        "as_of",
    )
    assert [rows[w].missing_due_to_date for w in range(6)] == [0, 0, 2, 2, 1, 1]
    with pytest.raises(ValueError):
        f.assessment_weeks(progress(spark, (1, 1, 1.0, None, None)), "other")


def test_attempt_without_assessments(spark):
    rows = history(spark, [(1, 500, 1.0, None, None)])
    assert rows[0].submissions_to_date == 0 and rows[0].mean_score_to_date is None
    assert float(rows[0].weighted_score_to_date) == 0.0
    assert rows[5].upcoming == (1, 500, 1)


def test_withdrawal_horizon_edges(spark):
    spine = f.attempt_weeks(attempts(spark, -5, 34), presentations(spark, 34))
    label = f.withdrawal_label(spine, attempts(spark, -5, 34), 27)
    out = {r.course_week: r.target_withdrawal_28d for r in label.collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 1}


def test_range_join_forms_agree(lake):
    by_window = f.range_join_clicks(lake.spine, lake.weekly)
    by_join = f.range_join_clicks_by_join(lake.spine, lake.weekly)
    assert by_window.exceptAll(by_join).count() == 0
    assert by_join.exceptAll(by_window).count() == 0


def test_clicks_are_conserved(lake):
    in_fact = lake.interactions.agg(F.sum("click_count")).first()[0]
    assert lake.weekly.agg(F.sum("click_count")).first()[0] == in_fact


@pytest.mark.parametrize("rule", ["as_of", "reference"])
def test_features_do_not_see_the_future(lake, rule):
    """Removing everything after week 2 must not change features at week 2."""
    week, day = 2, 20
    columns = ["clicks_7d", "clicks_14d", "clicks_to_date", "days_since_activity",
               "submissions_to_date", "mean_score_to_date", "weighted_score_to_date",
               "missing_due_to_date"]
    known = lake.submissions.filter(F.col("submitted_day") <= day)
    past = marts.assessment_progress(lake.attempts, lake.assessments, known)
    seen = marts.weekly_engagement(lake.interactions.filter(F.col("activity_day") <= day))

    def at_week(weekly, prog):
        state = f.assessment_state(lake.spine, weekly, prog, rule)
        return state.filter(F.col("course_week") == week).select(*ATTEMPT_WEEK, *columns)

    full, cut = at_week(lake.weekly, lake.progress), at_week(seen, past)
    changed = full.exceptAll(cut)
    if rule == "as_of":
        assert changed.count() == 0
    else:  # the reference rule knows of submissions made after the snapshot
        assert changed.count() > 0
        rest = [c for c in full.columns if c != "missing_due_to_date"]
        assert full.select(*rest).exceptAll(cut.select(*rest)).count() == 0


def test_weekly_engagement_with_a_hot_attempt(spark):
    """One attempt and one site hold most rows; duplicates of a key are legal."""
    hot = spark.range(20000).select(
        F.lit("AAA").alias("code_module"), F.lit("2013J").alias("code_presentation"),
        F.lit(1).alias("id_student"), (F.col("id") % 3).cast("int").alias("id_site"),
        (F.col("id") % 21 - 7).cast("int").alias("activity_day"), F.lit(2).alias("click_count"),
    )
    cold = hot.limit(50).withColumn("id_student", (F.col("activity_day") + 100).cast("int"))
    fact = hot.unionByName(cold)
    actual = marts.weekly_engagement(fact).toPandas()
    table = fact.toPandas()
    table["course_week"] = table.activity_day // 7
    expected = table.groupby(["id_student", "course_week"]).agg(
        click_count=("click_count", "sum"), active_days=("activity_day", "nunique"),
        distinct_sites=("id_site", "nunique"), latest_activity_day=("activity_day", "max"),
        source_rows=("activity_day", "size"),
    ).reset_index().sort_values(["id_student", "course_week"])
    actual = actual.sort_values(["id_student", "course_week"])
    for column in expected.columns:
        assert list(actual[column]) == list(expected[column])


def test_registry_lists_every_feature(spark):
    names = {r.feature_name for r in f.availability_registry(spark).collect()}
    assert len(names) == 14


def test_interval_join_is_the_join_by_comparison(spark):
    import random

    from courselake.operators import features

    r = random.Random(5)
    points = [(r.choice("ab"), r.randint(-50, 400), i) for i in range(300)] + [("a", None, 900), (None, 3, 901)]
    spans = []
    for i in range(200):
        begin = r.randint(-60, 400)
        spans.append((r.choice("ab"), begin, begin + r.choice([-1, 0, 0, 1, 5, 6, 7, 300, 2000]), i))
    spans += [("a", None, 5, 900), ("b", 5, None, 901), (None, 0, 10, 902), ("a", -(10**9), 10**9, 903)]
    p = spark.createDataFrame(points, "k string, at int, point int")
    s = spark.createDataFrame(spans, "k string, since int, until int, span int")
    joined = features.interval_join(p, s, ["k"], "at", "since", "until")
    got = sorted((x["point"], x["span"]) for x in joined.collect())
    whole = lambda *v: None not in v
    assert got == sorted(
        (i, j) for k, at, i in points for l, b, e, j in spans if whole(k, at, l, b, e) and k == l and b <= at <= e
    )
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert features.interval_join(p, s.limit(0), ["k"], "at", "since", "until").count() == 0


def test_shuffles_grow_with_the_source_folder(spark, lake, monkeypatch):
    from courselake import session
    from courselake.sources.shelf import Shelf, folder_size

    before = spark.conf.get(session.SHUFFLE_SETTING)
    size = folder_size(spark, lake.sf_dir).bytes
    try:
        spark.conf.set(session.SHUFFLE_SETTING, "4")
        monkeypatch.setattr(session, "TABLE_BYTES_PER_PARTITION", -(-size // 7))
        Shelf(spark, lake.sf_dir)
        assert spark.conf.get(session.SHUFFLE_SETTING) == "7"
        monkeypatch.setattr(session, "TABLE_BYTES_PER_PARTITION", size)
        Shelf(spark, lake.sf_dir)  # never lowered
        assert spark.conf.get(session.SHUFFLE_SETTING) == "7"
    finally:
        spark.conf.set(session.SHUFFLE_SETTING, before)
