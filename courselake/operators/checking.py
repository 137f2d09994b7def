"""Checks of tables compiled to few passes, and checks that ride on a table's write.

A pass is one scan of one table, grouped by one key where its checks need a key. Conditions on
rows, missing cells and expected row counts of a table ride on one of its passes: on a plain
aggregate, or on the grouping that a reference check needs anyway. So a table is read once per
key that is checked, however many checks it has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ROWS = "_rows"


@dataclass(frozen=True)
class Rule:
    """One check of a table: rows that break a condition, an expected number of rows, a key
    that may occur once, or a key that another table must hold."""

    table: str
    name: str
    broken: Callable[[], Column] | None = None
    expected_rows: int | None = None
    unique: tuple[str, ...] = ()
    parent: str | None = None
    reference: tuple[str, ...] = ()
    null_passes: bool = False

    @property
    def keys(self) -> tuple[str, ...]:
        return self.unique or self.reference


def passes(rules: list[Rule]) -> dict[tuple[str, tuple[str, ...]], list[Rule]]:
    """The rules by table and key. Rules without a key join a reference's pass of their table, whose
    groups are fewer than its rows, else a unique key's, else they have a pass of their own."""
    out: dict[tuple[str, tuple[str, ...]], list[Rule]] = {}
    for rule in sorted((r for r in rules if r.keys), key=lambda r: bool(r.unique)):
        out.setdefault((rule.table, rule.keys), []).append(rule)
    for rule in rules:
        if not rule.keys:
            carrier = next((p for p in out if p[0] == rule.table), (rule.table, ()))
            out.setdefault(carrier, []).append(rule)
    return out


def _on_rows(rule: Rule) -> Column:
    if rule.broken is not None:
        return F.count_if(rule.broken())
    return F.abs(F.count(F.lit(1)) - F.lit(rule.expected_rows))


def _on_groups(rule: Rule, at: int) -> Column:
    """The rule's violations from one row per key, with ROWS rows and ``_c<at>`` of its own."""
    own = F.col(f"_c{at}")
    if rule.unique:
        return F.count_if(F.col(ROWS) > 1)
    if rule.reference:
        known = F.lit(True)
        if rule.null_passes:
            known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in rule.reference])
        return F.coalesce(F.sum(F.when(own.isNull() & known, F.col(ROWS))), F.lit(0))
    if rule.broken is not None:
        return F.coalesce(F.sum(own), F.lit(0))
    return F.abs(F.coalesce(F.sum(ROWS), F.lit(0)) - F.lit(rule.expected_rows))


def _measured(table: str, keys: tuple[str, ...], rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """One row with a column per rule, from one scan of the table."""
    df = tables[table]
    if not keys:
        return df.agg(*[_on_rows(r).alias(f"_c{i}") for i, r in enumerate(rules)])
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(ROWS),
        *[F.count_if(r.broken()).alias(f"_c{i}") for i, r in enumerate(rules) if r.broken is not None],
    )
    for i, rule in enumerate(rules):
        if rule.reference:
            held = tables[rule.parent].select(*keys).distinct().withColumn(f"_c{i}", F.lit(True))
            grouped = grouped.join(held, list(keys), "left")
    return grouped.agg(*[_on_groups(r, i).alias(f"_c{i}") for i, r in enumerate(rules)])


def violations(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, violations) of every rule; a row per rule whatever the tables hold.

    A unique key counts the keys held by several rows, a reference the rows without a parent
    (a key with a NULL has none, unless ``null_passes``), an expected number the difference.
    """
    parts = []
    for (table, keys), own in passes(rules).items():
        row = _measured(table, keys, own, tables)
        structs = [
            F.struct(
                F.lit(table).alias("table_name"), F.lit(r.name).alias("rule"),
                F.col(f"_c{i}").cast("long").alias("violations"),
            )
            for i, r in enumerate(own)
        ]
        parts.append(row.select(F.inline(F.array(*structs))))
    return reduce(DataFrame.unionByName, parts)


class Watched:
    """A table whose rules without a key are counted while it is written.

    ``frame`` is the table with the counts attached; write it once, then ``violations`` has them.
    The counts belong to the tasks that write, each of which counts once however often it is
    retried, and the written table is not read again. Attach them above the last exchange.
    """

    def __init__(self, df: DataFrame, table: str, rules: list[Rule]):
        self.table = table
        self.rules = [r for r in rules if r.table == table and not r.keys]
        self.seen = Observation()
        self.frame = df
        if self.rules:
            counts = [_on_rows(r).alias(f"_c{i}") for i, r in enumerate(self.rules)]
            self.frame = df.observe(self.seen, *counts)

    def violations(self) -> list[tuple[str, str, int]]:
        """(table, rule, violations); waits for the write."""
        if not self.rules:
            return []
        found = self.seen.get
        return [(self.table, r.name, int(found[f"_c{i}"])) for i, r in enumerate(self.rules)]
