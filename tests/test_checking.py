"""Compiled checks, checks on a write, rejected lines, stored results, permutations, contracts."""

import pytest
from pyspark.sql import functions as F

from courselake.functions import permutation
from courselake.operators import checking, models, quality
from courselake.plans import analyze, pipeline
from courselake.sources import files, tables


def test_rules_ride_on_one_grouping(spark):
    child = spark.createDataFrame([(1, 5), (1, -5), (2, None), (None, -1), (9, 3)], "k int, v int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    broken = lambda: F.col("v") < 0
    rules = [
        checking.Rule("child", "negative", broken),
        checking.Rule("child", "rows", expected_rows=7),
        checking.Rule("child", "orphans", parent="parent", reference=("k",)),
        checking.Rule("child", "known orphans", parent="parent", reference=("k",), null_passes=True),
        checking.Rule("child", "once", unique=("k",)),
        checking.Rule("parent", "rows", expected_rows=3),
    ]
    assert {t: len(r) for t, r in checking.passes(rules).items()} == {("child", ("k",)): 5, ("parent", ()): 1}
    got = {(r.table_name, r.rule): r.violations for r in checking.violations(rules, {"child": child, "parent": parent}).collect()}
    assert got == {
        ("child", "negative"): 2, ("child", "rows"): 2, ("child", "orphans"): 2,
        ("child", "known orphans"): 1, ("child", "once"): 1, ("parent", "rows"): 0,
    }
    none = {"child": child.limit(0), "parent": parent.limit(0)}
    got = {(r.table_name, r.rule): r.violations for r in checking.violations(rules, none).collect()}
    assert got[("child", "rows")] == 7 and got[("child", "negative")] == got[("child", "orphans")] == 0


def test_core_checks_scan_the_fact_once_per_key(lake):
    checks = quality.core_checks()
    keys = {k for (t, k) in checking.passes([c.rule() for c in checks]) if t == "interactions"}
    assert len(keys) == 2 and () not in keys
    plan = quality.failing_rows(checks, lake.core_tables())._jdf.queryExecution().optimizedPlan().toString()
    fact = [line for line in plan.splitlines() if "Relation" in line and "click_count" in line]
    assert len(fact) == 2


def test_watched_write_counts_without_reading_again(spark, tmp_path):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("v"))
    rules = [
        checking.Rule("t", "missing", lambda: F.col("v").isNull()),
        checking.Rule("t", "large", lambda: F.col("v") > 989),
        checking.Rule("other", "none", lambda: F.lit(True)),
        checking.Rule("t", "key", unique=("v",)),
    ]
    watched = checking.Watched(df.repartitionByRange(5, "v"), "t", rules)
    tables.write_table(watched.frame, str(tmp_path / "t"), order_by=["v"])
    assert watched.violations() == [("t", "missing", 100), ("t", "large", 9)]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000


def test_malformed_lines_are_kept_with_file_and_reason(spark, tmp_path):
    path = tmp_path / "studentAssessment.csv"
    good = ["1,100,19,0,70", '2,"10,0",19,0,?']
    bad = ["1,100,19,0", "1,100,19,0,70,8", "", '3,"1,1",2,0']
    path.write_text("\n".join(["id_assessment,id_student,date_submitted,is_banked,score", *good, *bad]) + "\n")
    landed, rejected = files.land_or_reject(spark, str(path), "student_assessment")
    assert sorted(r.id_student for r in landed.collect()) == ["10,0", "100"]
    got = {r.line: (r.file, r.fields, r.reason) for r in rejected.collect()}
    name = "studentAssessment.csv"
    assert got == {
        "1,100,19,0": (name, 4, "too few fields"), "1,100,19,0,70,8": (name, 6, "too many fields"),
        '3,"1,1",2,0': (name, 4, "too few fields"),
    }
    assert landed.select("score").count() == 2 and rejected.select("file").count() == 3


def test_an_interrupted_replacement_leaves_the_old_state(spark, tmp_path):
    path = str(tmp_path / "results")

    def frame(*rows):
        return spark.createDataFrame(list(rows), "check_name string, failing_rows long")

    def state():
        return sorted(map(tuple, spark.read.parquet(path).select("check_name", "failing_rows").collect()))

    tables.replace_by(frame(("a", 1), ("b", 2)), path, "check_name")
    new = frame(("b", 3), ("c", 4))
    stopped = new.withColumn(
        "failing_rows", F.when(F.col("check_name") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("failing_rows")).cast("long")
    )
    with pytest.raises(Exception, match="lost"):
        tables.replace_by(stopped, path, "check_name")
    assert state() == [("a", 1), ("b", 2)]
    for _ in range(2):
        tables.replace_by(new, path, "check_name")
        assert state() == [("a", 1), ("b", 3), ("c", 4)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 360, 1009, 4111])
def test_permutation_is_one_to_one(spark, n):
    a, b = permutation.grid(n)
    assert n <= a * b < n + a
    seen = []
    for name in ("x:0", "x:1"):
        keys = [F.lit(k).cast("long") for k in permutation.round_keys(7, name)]
        got = [r[0] for r in spark.range(n).select(permutation.permuted(F.col("id"), n, keys)).collect()]
        assert sorted(got) == list(range(n))
        seen.append(got)
    if n > 90:
        assert sum(x == y for x, y in zip(*seen)) < 12 and sum(i == x for i, x in enumerate(seen[0])) < 12


def test_features_have_shuffles_of_their_own(lake):
    rows = lake.split("test")
    n = rows.count()
    drawn = models.with_donors(models.numbered_rows(rows), n, ["clicks_to_date", "clicks_7d"], 1).toPandas()
    by = {f: g.set_index("_row")._donor for f, g in drawn.groupby("feature")}
    assert all(sorted(d) == list(range(n)) for d in by.values())
    assert (by["clicks_to_date"] == by["clicks_7d"]).mean() < 0.05


def test_contract_is_checked_on_load_and_before_scoring(spark, lake, tmp_path):
    train = lake.split("train")
    path = str(tmp_path / "model")
    models.save_model(models.fit_logistic(train, max_iter=2), train, path)
    loaded = models.load_model(spark, path)
    assert models.score_by_contract(loaded, lake.split("test").limit(5)).count() == 5
    with pytest.raises(ValueError, match="clicks_7d is missing"):
        models.score_by_contract(loaded, train.drop("clicks_7d"))
    with pytest.raises(ValueError, match="must not be features"):
        models.feature_contract(train, [*models.FEATURES, "gender"])
    banned = train.limit(0).select(F.col("gender").alias("gender", metadata={"role": "feature"}))
    banned.write.mode("overwrite").parquet(f"{path}/contract")
    with pytest.raises(ValueError, match="must not be features"):
        models.load_model(spark, path)


def test_analysis_run_writes_what_it_computes(spark, landing, tmp_path):
    expected = {"presentations": 1, "student_info": 1, "interactions": 1}
    lake = pipeline.build_lake(spark, landing(), str(tmp_path / "out"), expected)
    computed = analyze.run_analysis(lake)
    for name, df in computed.items():
        path = f"{lake.root}/reports/analysis/{name}"
        stored = spark.read.parquet(path) if name == "consistency" else spark.read.schema(
            df.schema).option("header", "true").csv(path)
        assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect())), name
    assert computed["outcome_distribution"].count() == 4
    assert computed["resource_type_usage"].first().activity_type == "resource"
