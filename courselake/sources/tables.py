"""Writing tables: layered parquet, ordered exports, one folder per result table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    order_by: list[str] | None = None,
    fmt: str = "parquet",
    total_order: bool = False,
) -> None:
    """Writes a table, replacing what the path held.

    ``order_by`` sorts within each file, which is what row-group statistics need;
    with ``total_order`` the files follow each other in that order as well.
    """
    if order_by and total_order:
        df = df.orderBy(*order_by)
    elif order_by:
        df = df.sortWithinPartitions(*(partition_by or []), *order_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unknown format {fmt}")


def replace_by(df: DataFrame, path: str, name: str) -> None:
    """Stores the rows of the names that ``df`` holds in place of those stored for them.

    One folder per name; only folders of names in ``df`` are replaced, when all rows are written.
    So a run that stops on the way leaves what was there, and running it again leaves one state.
    """
    (
        df.repartition(name)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(name)
        .parquet(path)
    )


def write_results(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """One folder per result table."""
    for name, df in tables.items():
        write_table(df, f"{folder.rstrip('/')}/{name}", fmt=fmt)
