import hashlib

import pytest
from pyspark.sql import functions as F

from courselake.operators import audit, constraints, quality, staging
from courselake.plans import pipeline
from courselake.schemas import LANDING_FILES
from courselake.sources import files


def test_profile_of_one_row_files(spark, landing):
    folder = landing()
    raw = files.land_folder(spark, folder)
    scale = audit.calculated_scale(raw).first()
    assert scale.csv_rows == 7
    assert scale.unique_students == 1
    assert scale.student_module_attempts == 1
    assert audit.anomalies(raw).first().missing_imd_band == 1
    profile = audit.narrow_profile(audit.file_profile(raw), files.file_digests(spark, folder))
    assert profile.filter("parts = 1 AND sha256 IS NOT NULL").count() == 7


def test_missing_markers(spark, landing):
    folder = landing(vle=["10,AAA,2013J,resource,?,", "11,AAA,2013J,,?,3"])
    found = audit.missing_cells(files.land_csv(spark, f"{folder}/vle.csv", "vle"))
    assert {r.column_name: r.missing for r in found.collect()} == {
        "activity_type": 1, "week_from": 2, "week_to": 1,
    }


def test_missing_file_is_named(spark, landing, tmp_path):
    folder = landing()
    (tmp_path / "source" / "vle.csv").unlink()
    absent = files.missing_files(spark, folder, list(LANDING_FILES.values()))
    assert [r.file for r in absent.collect()] == ["vle.csv"]
    with pytest.raises(FileNotFoundError, match="vle.csv"):
        files.require_files(spark, folder, list(LANDING_FILES.values()))


def test_header_and_row_shape_are_enforced(spark, landing, tmp_path):
    folder = landing()
    (tmp_path / "source" / "courses.csv").write_text("code_module,other,length\nA,B,1\n")
    with pytest.raises(Exception):
        files.land_csv(spark, f"{folder}/courses.csv", "courses").collect()
    (tmp_path / "source" / "studentVle.csv").write_text(
        "code_module,code_presentation,id_student,id_site,date,sum_click\nAAA,2013J,1,1,x,1\n"
    )
    with pytest.raises(Exception):
        files.land_csv(spark, f"{folder}/studentVle.csv", "student_vle").collect()


def test_digest(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"lake\n")
    digests = files.file_digests(spark, str(folder))
    assert digests.first().sha256 == hashlib.sha256(b"lake\n").hexdigest()
    expected = spark.createDataFrame([("a.bin", "0" * 64), ("b.bin", "1" * 64)],
                                     "part string, sha256 string")
    differing = files.compare_digests(digests, expected).collect()
    assert {r.part: r.actual is None for r in differing} == {"a.bin": False, "b.bin": True}
    with pytest.raises(ValueError, match="a.bin.*b.bin"):
        files.require_digests(digests, expected)


def test_digest_of_a_file_above_two_gigabytes(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"lake\n")
    size = (2 << 30) + 5
    with open(folder / "large file.bin", "wb") as sparse:
        sparse.truncate(size)
    whole = hashlib.sha256()
    for at in range(0, size, 1 << 24):
        whole.update(bytes(min(1 << 24, size - at)))
    got = {r.part: (r.length, r.sha256) for r in files.file_digests(spark, str(folder)).collect()}
    assert got == {
        "a.bin": (5, hashlib.sha256(b"lake\n").hexdigest()),
        "large file.bin": (size, whole.hexdigest()),
    }


def test_staging_trims_and_blanks(spark):
    raw = spark.createDataFrame(
        [(" AAA ", "2013J", "7", "F", " North ", "Lower", " 10-20% ", "0-35", "0", "60", "N", "Pass"),
         ("AAA", "2013J", "8", "F", "North", "Lower", "?", "0-35", "0", "60", "N", "Pass")],
        files.landing_schema("student_info"),
    )
    first, second = staging.stage_student_info(raw).orderBy("id_student").collect()
    assert (first.code_module, first.region, first.imd_band) == ("AAA", "North", " 10-20% ")
    assert second.imd_band is None


def test_bad_cast_stops_and_quarantine_continues(spark):
    raw = spark.createDataFrame(
        [("1", "2", "5", "0", "70"), ("1", "3", "x", "1", "?"), ("1", "4", "6", "yes", "a")],
        files.landing_schema("student_assessment"),
    )
    with pytest.raises(Exception):
        staging.stage_submissions(raw).collect()
    typed, rejected = staging.quarantine(raw, "student_assessment")
    assert [(r.id_student, r.is_banked, float(r.score)) for r in typed.collect()] == [(2, False, 70.0)]
    assert {r.id_student: r.reason for r in rejected.collect()} == {
        "3": "date_submitted", "4": "is_banked,score",
    }


EXPECTED = {"presentations": 1, "student_info": 1, "interactions": 1}


def test_pipeline_end_to_end(spark, landing, tmp_path):
    folder = landing()
    lake = pipeline.build_lake(spark, folder, str(tmp_path / "out"), EXPECTED)
    weekly = lake.read("marts", "weekly_engagement").first()
    assert (weekly.course_week, weekly.click_count, weekly.active_days) == (0, 3, 1)
    snapshots = lake.read("marts", "model_snapshots").orderBy("course_week").collect()
    assert [r.course_week for r in snapshots] == [0, 1]
    assert snapshots[0].next_assessment_id == 1
    assert lake.read("quality", "run_results").count() == 24
    exported = spark.read.option("header", "true").csv(f"{lake.root}/export/model_snapshots")
    assert exported.count() == 2
    again = pipeline.build_lake(spark, folder, str(tmp_path / "out"), EXPECTED)
    assert again.read("quality", "run_results").count() == 24


def test_pipeline_gate_stops(spark, landing, tmp_path):
    folder = landing(studentAssessment=["1,100,19,0,101"])
    with pytest.raises(ValueError, match="invalid_score_ranges"):
        pipeline.build_lake(spark, folder, str(tmp_path / "out"), EXPECTED)
    stored = spark.read.parquet(str(tmp_path / "out" / "quality" / "core_results"))
    assert stored.filter("status = 'fail'").count() == 1


def test_constraints_enforced_and_null_rules(spark):
    parent = spark.createDataFrame([("AAA", "2013J")], "code_module string, code_presentation string")
    child = spark.createDataFrame(
        [("AAA", "2013J"), ("AAA", None), ("BBB", "2013J"), ("BBB", "2013J")],
        "code_module string, code_presentation string",
    )
    keys = ["code_module", "code_presentation"]
    broken = constraints.foreign_key(child, parent, keys).collect()
    assert [(r.code_module, r.rows) for r in broken] == [("BBB", 2)]
    assert constraints.unmatched(child, parent, keys).count() == 2
    values = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    assert constraints.check(values, "positive", F.col("v") > 0).count() == 1
    report = spark.createDataFrame([("t", "c", 2)],
                                   "table_name string, constraint_name string, violations long")
    with pytest.raises(ValueError, match="t: c"):
        constraints.enforce([report])
    constraints.enforce([report.withColumn("violations", F.lit(0).cast("long"))])


def results(spark, *rows):
    return spark.createDataFrame(
        [(t, n, s, k, st, "d") for t, n, s, k, st in rows],
        "run_at string, check_name string, severity string, failing_rows long, status string,"
        "detail string",
    ).withColumn("run_at", F.col("run_at").cast("timestamp"))


def test_replace_latest_and_gate(spark):
    old = results(spark, ("2020-01-01", "a", "error", 1, "fail"),
                  ("2020-01-01", "b", "warning", 1, "fail"))
    new = results(spark, ("2020-01-02", "a", "error", 0, "pass"))
    replaced = quality.replace(old, new)
    assert {r.check_name: r.status for r in replaced.collect()} == {"a": "pass", "b": "fail"}
    newest = quality.latest(old.unionByName(new)).collect()
    assert [(r.check_name, r.status) for r in newest] == [("a", "pass"), ("b", "fail")]
    quality.gate(replaced)
    with pytest.raises(ValueError, match="a \\(1\\)"):
        quality.gate(old)


def test_fingerprint_sees_changed_swapped_and_repeated_rows(spark):
    from courselake.operators import audit

    base = [("a", "1"), ("b", "2"), ("c", None), ("c", None)]
    schema = "x string, y string"
    mark = lambda rows: tuple(audit.fingerprint(spark.createDataFrame(rows, schema)).first())
    assert mark(base) == mark(base[::-1]) == mark([*base[:3], ("c", "?")]) == mark([*base[:3], ("c", "")])
    others = [mark([]), mark(base[:3]), mark([("a", "2"), ("b", "1"), *base[2:]]), mark([*base[:2], ("d", None), ("d", None)])]
    assert len({mark(base), *others}) == 5


def test_a_table_that_did_not_land_or_changed_disagrees(spark):
    from courselake.operators import audit

    one = spark.createDataFrame([("a", 1), ("b", 2)], "code string, n int")
    changed = spark.createDataFrame([("a", "2"), ("b", "1")], "code string, n string")
    got = audit.landed_against_expected({"courses": one, "vle": one, "assessments": one}, {"courses": one, "vle": changed})
    assert {r["file"]: (r["landed_rows"], r["agrees"]) for r in got.collect()} == {
        "courses.csv": (2, True), "vle.csv": (2, False), "assessments.csv": (None, False),
    }
