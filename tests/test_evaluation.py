import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from courselake.functions.ranking import exact_quantiles, with_prefix_sums
from courselake.operators import evaluation as ev
from courselake.plans import analysis, gallery


def scored(spark, y, p, **columns):
    table = pd.DataFrame({"y": y, "probability": p, "model": "m", "split": "test", **columns})
    return spark.createDataFrame(table)


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    diff = pos[:, None] - neg[None, :]
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / (len(pos) * len(neg))


def brute_ap(y, p):
    total, before = 0.0, 0
    for s in sorted(set(p), reverse=True):
        hits, seen = ((p >= s) & (y == 1)).sum(), (p >= s).sum()
        total += (hits - before) / y.sum() * hits / seen
        before = hits
    return total


def test_four_rows(spark):
    row = ev.evaluate(scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9])).first()
    assert (row.precision, row.recall, row.roc_auc, row.pr_auc) == (1.0, 1.0, 1.0, 1.0)
    assert row.brier < 0.1


@pytest.mark.parametrize("kind", ["ties", "continuous", "crowded", "edges"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 600)
    p = {
        "ties": rng.integers(0, 12, 600) / 11.0,
        "continuous": rng.random(600),
        "crowded": 0.5 + rng.random(600) * 1e-9,
        "edges": rng.choice([0.0, 1.0, 0.5], 600),
    }[kind]
    row = ev.evaluate(scored(spark, y, p)).first()
    assert row.roc_auc == pytest.approx(brute_auc(y, p))
    assert row.pr_auc == pytest.approx(brute_ap(y, p))
    assert row.brier == pytest.approx(((p - y) ** 2).mean())
    assert row.flag_rate == pytest.approx((p >= 0.5).mean())
    assert row.accuracy == pytest.approx(((p >= 0.5) == y).mean())


def test_undefined_ratios_are_zero_and_one_class_has_no_area(spark):
    row = ev.evaluate(scored(spark, [0, 0], [0.1, 0.2])).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)
    assert row.roc_auc is None


def test_prefix_sums_do_not_depend_on_buckets(spark):
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"g": rng.choice(["a", "b"], 300), "v": rng.random(300), "n": 1})
    counts = spark.createDataFrame(table).groupBy("g", "v").agg(F.sum("n").alias("n"))
    expected = {(r.g, r.v): int(((table.g == r.g) & (table.v < r.v)).sum())
                for r in table.itertuples()}
    for buckets in (1, 7, 1 << 16):
        out = with_prefix_sums(counts, ["g"], "v", ["n"], buckets=buckets).collect()
        assert {(r.g, r.v): r.before_n for r in out} == expected


def test_exact_quantiles(spark):
    values = np.random.default_rng(5).random(137)
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = exact_quantiles(df, "v", probs).first().quantiles
    assert got == pytest.approx(list(np.quantile(values, probs)))


@pytest.mark.parametrize("kind", ["ties", "continuous"])
def test_calibration_bins_match_qcut(spark, kind):
    rng = np.random.default_rng(11)
    p = rng.random(500) if kind == "continuous" else rng.choice([0.1, 0.1, 0.1, 0.2, 0.7], 500)
    y = rng.integers(0, 2, 500)
    table = pd.DataFrame({"p": p, "y": y})
    expected = table.groupby(pd.qcut(table.p, 10, duplicates="drop"), observed=True).agg(
        p=("p", "mean"), y=("y", "mean"), n=("y", "size")
    )
    got = ev.calibration_bins(scored(spark, y, p)).orderBy("bin").toPandas()
    assert list(got.records) == list(expected.n)
    assert list(got.mean_predicted_probability) == pytest.approx(list(expected.p))
    assert list(got.observed_event_rate) == pytest.approx(list(expected.y))


def test_threshold_sweep(spark):
    rng = np.random.default_rng(2)
    p = np.append(rng.integers(0, 80, 399) / 100.0, np.linspace(0.1, 0.9, 17)[3])
    y, lead = rng.integers(0, 2, 400), rng.integers(1, 40, 400)
    df = scored(spark, y, p, prediction_horizon_days=lead)
    got = ev.threshold_sweep(df).orderBy("threshold").toPandas()
    assert list(got.threshold) == list(np.linspace(0.1, 0.9, 17))
    for row in got.itertuples():
        hit = p >= row.threshold
        true = int((hit & (y == 1)).sum())
        assert (row.records_flagged, row.true_alerts) == (int(hit.sum()), true)
        if true:
            assert row.median_true_alert_lead_days == np.median(lead[hit & (y == 1)])
            assert row.false_alerts_per_true_alert == pytest.approx((hit.sum() - true) / true)
        else:
            assert np.isnan(row.median_true_alert_lead_days)


def test_grouped_metrics_skip_small_and_one_class_groups(spark):
    n = 450
    group = np.array(["big"] * 200 + ["small"] * 50 + ["onesided"] * 200)
    y = np.where(group == "onesided", 1, np.arange(n) % 2)
    df = scored(spark, y, np.arange(n) / n, course_week=0, code_module=group)
    got = ev.grouped_metrics(df, ["course_week", "code_module"]).collect()
    assert {(r.dimension, r.group) for r in got} == {("course_week", "0"), ("code_module", "big")}


def test_timed_pair_refuses_different_answers(spark, lake):
    variants = {
        "fact": lambda: analysis.weekly_totals_from_fact(lake.interactions),
        "mart": lambda: analysis.weekly_totals_from_mart(lake.weekly),
    }
    timed = analysis.timed_pair(spark, "weekly", variants, runs=1).collect()
    assert [r.variant for r in timed] == ["fact", "mart"]
    variants["mart"] = lambda: analysis.weekly_totals_from_mart(lake.weekly.filter("course_week > 0"))
    with pytest.raises(ValueError, match="different answers"):
        analysis.timed_pair(spark, "weekly", variants, runs=1)


def test_cohort_percentile_equals_percent_rank(spark):
    rng = np.random.default_rng(4)
    table = pd.DataFrame({
        "code_module": "AAA", "code_presentation": "2013J", "id_student": range(200),
        "course_week": np.where(np.arange(200) == 199, 5, 1),
        "click_count": np.where(rng.random(200) < 0.4, 1, rng.integers(1, 30, 200)),
    })
    df = spark.createDataFrame(table)
    got = gallery.cohort_percentile(df).toPandas().set_index("id_student")
    week = table[table.course_week == 1]
    rank = (week.click_count.rank(method="min") - 1) / (len(week) - 1)
    assert list(got.loc[week.id_student].cohort_activity_percentile) == pytest.approx(list(rank))
    assert got.loc[199].cohort_activity_percentile == 0.0
