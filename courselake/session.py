"""Session settings for batch runs, and shuffle sizing from the input."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings a batch run wants. AQE merges small shuffle partitions and splits skewed
# ones; a broadcast happens only below the size threshold.
BATCH_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
}
BYTES_PER_PARTITION = 192 << 20
# A byte of the packed source tables takes about 60 bytes of a task's memory in the windows of the
# snapshots (measured at 6 times sf0.1), so a partition holds less of them than of landing text.
TABLE_BYTES_PER_PARTITION = 6 << 20
# A shuffled byte of these windows takes about 32 bytes of a task's memory (measured at 6 times
# sf0.1), so AQE must not merge partitions up to its usual 64 MB.
MERGED_PARTITIONS = "16MB"
# A stored byte of the fact rows takes about 37 bytes of a task's memory in the aggregates before a
# shuffle (measured at 12 times sf0.1: 168 MB for 4.5 MB), so a scan reads less than the usual 128 MB.
SCANNED_BYTES = 8 << 20
SCAN_SETTING = "spark.sql.files.maxPartitionBytes"
SHUFFLE_SETTING = "spark.sql.shuffle.partitions"
MERGE_SETTING = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# Shuffle files go when the query that wrote them ends, not when the driver next collects its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


PLACED_SETTING = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def placed_joins(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile join sides that are both dealt by some of the join's keys as they lie."""
    before = spark.conf.get(PLACED_SETTING, "true")
    spark.conf.set(PLACED_SETTING, "false")
    try:
        yield
    finally:
        spark.conf.set(PLACED_SETTING, before)


def batch_session(name: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the batch settings; the cluster's own submit settings stay in force."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**BATCH_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def partitions_for(total_bytes: int, at_least: int, each: int = BYTES_PER_PARTITION) -> int:
    """Shuffle partitions so that one holds about ``each`` bytes of input."""
    return max(at_least, -(-int(total_bytes) // each))


def raise_shuffles(spark: SparkSession, total_bytes: int) -> None:
    """Raises the number of shuffle partitions for source tables of this size and leaves it raised,
    as queries run after they are built. It is never lowered. AQE merges them up to a size that
    suits these tables, and a scan's task reads no more of them, unless the session names a size. From
    here on a query's shuffle files go when it ends, unless the session says otherwise."""
    if spark.conf.get(CLEANUP_SETTING, None) is None:
        spark.conf.set(CLEANUP_SETTING, "true")
    if spark.conf.get(SCAN_SETTING, None) is None:
        spark.conf.set(SCAN_SETTING, str(SCANNED_BYTES))
    if spark.conf.get(MERGE_SETTING, None) is None:
        spark.conf.set(MERGE_SETTING, MERGED_PARTITIONS)
    now = int(spark.conf.get(SHUFFLE_SETTING))
    needed = partitions_for(total_bytes, now, TABLE_BYTES_PER_PARTITION)
    if needed > now:
        spark.conf.set(SHUFFLE_SETTING, str(needed))


@contextmanager
def sized_shuffles(spark: SparkSession, total_bytes: int) -> Iterator[None]:
    """Raises the number of shuffle partitions for a large input, then restores it.

    AQE can merge partitions but not create them, so the number must start high.
    """
    before = spark.conf.get(SHUFFLE_SETTING)
    spark.conf.set(SHUFFLE_SETTING, str(partitions_for(total_bytes, int(before))))
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_SETTING, before)
