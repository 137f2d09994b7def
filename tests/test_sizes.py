"""The sizes of merged partitions."""

from courselake import session


def test_merged_partitions_stay_small_unless_the_session_names_a_size(spark):
    own = spark.newSession()
    session.raise_shuffles(own, 1)
    assert own.conf.get(session.MERGE_SETTING) == session.MERGED_PARTITIONS
    named = spark.newSession()
    named.conf.set(session.MERGE_SETTING, "8MB")
    session.raise_shuffles(named, 1)
    assert named.conf.get(session.MERGE_SETTING) == "8MB"


def test_a_partition_holds_few_megabytes_of_source_tables(spark):
    own = spark.newSession()
    own.conf.set(session.SHUFFLE_SETTING, "12")
    session.raise_shuffles(own, 1 << 30)
    assert int(own.conf.get(session.SHUFFLE_SETTING)) >= 128
    session.raise_shuffles(own, 1 << 20)
    assert int(own.conf.get(session.SHUFFLE_SETTING)) >= 128


def test_a_scan_task_reads_few_megabytes_unless_the_session_names_a_size(spark):
    own = spark.newSession()
    session.raise_shuffles(own, 1)
    assert int(own.conf.get(session.SCAN_SETTING)) == session.SCANNED_BYTES < 16 << 20
    named = spark.newSession()
    named.conf.set(session.SCAN_SETTING, "64MB")
    session.raise_shuffles(named, 1)
    assert named.conf.get(session.SCAN_SETTING) == "64MB"
