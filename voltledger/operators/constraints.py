"""Constraints of the stored tables, checked over whole frames before a write."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.operators.checks import duplicate_rows
from voltledger.schemas import Table


def unique_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys that occur more than once. As in SQL, a key with a null in it is never a duplicate."""
    present = df.where(reduce(and_, [F.col(c).isNotNull() for c in cols]))
    return duplicate_rows(present, cols)


def conflicts_with_stored(new: DataFrame, stored: DataFrame, cols: Sequence[str]) -> DataFrame:
    """New rows whose key is stored already."""
    return new.join(stored.select(*cols), list(cols), "left_semi")


def unique_violations_of_changes(
    changes: DataFrame, stored: DataFrame, key: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Values of ``cols`` that would occur more than once after ``changes`` replace or join the stored rows
    with the same ``key``.

    Stored rows were unique before, so only those that share a value with a change and are not replaced
    themselves count: the stored table is read once and neither grouped nor, for a small drop, shuffled.
    """
    cols = list(cols)
    touched = stored.select(*dict.fromkeys((*key, *cols))).join(changes.select(*cols), cols, "left_semi")
    staying = touched.join(changes.select(*key), list(key), "left_anti")
    return unique_violations(changes.select(*cols).unionByName(staying.select(*cols)), cols)


def orphans(changes: DataFrame, table: Table, parents: Callable[[str], DataFrame]) -> DataFrame:
    """Keys in ``changes`` that have no parent row: constraint, key_value (as text), nr_rows.

    Keys are counted before they meet the parents, and only those of the changes are looked up.
    """
    parts = []
    for fk in table.foreign_keys:
        if fk.column in changes.columns:
            lacking = foreign_key_violations(changes, fk.column, parents(fk.parent), fk.parent_column)
            key = F.col(fk.column).cast("string").alias("key_value")
            parts.append(lacking.select(F.lit(f"{fk.column}_fk").alias("constraint"), key, "nr_rows"))
    if not parts:
        return changes.sparkSession.createDataFrame([], "constraint string, key_value string, nr_rows long")
    return reduce(DataFrame.unionByName, parts)


def foreign_key_violations(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Keys without a parent, with the number of rows that use them.

    The child keys are counted before the join, so a key used by most rows joins as one row.
    """
    used = (
        child.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("nr_rows"))
    )
    parents = parent.select(F.col(parent_column).alias(column))
    return used.join(parents, column, "left_anti")


def row_violations(df: DataFrame, table: Table) -> DataFrame:
    """One row: how many rows break each not-null, month-start and check constraint. One scan."""
    broken = {f"{c}_not_null": F.col(c).isNull() for c in (*table.key, *table.not_null)}
    if table.month_start is not None:
        broken[f"{table.month_start}_month_start"] = F.dayofmonth(table.month_start) != 1
    for name, condition in table.checks.items():
        broken[name] = ~F.expr(condition)
    return df.agg(*[F.count_if(condition).alias(name) for name, condition in broken.items()])


def table_violations(
    df: DataFrame, table: Table, parents: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Every broken constraint of a table with its number of rows (of keys, where keys repeat).

    Foreign keys are checked against the ``parents`` that are given. Two scans, whatever the number of
    constraints: one counts the rows that break something by themselves, one counts all keys of all
    constraints together, and the counts meet the keys of all parents in one join.
    """
    counts = row_violations(df, table)
    per_row = counts.unpivot([], list(counts.columns), "constraint", "nr_violations")
    entries, known = [], []
    for key in (table.key, *table.unique):
        present = reduce(and_, [F.col(c).isNotNull() for c in key])
        entry = F.struct(
            F.lit(f"{'_'.join(key)}_unique").alias("constraint"),
            F.lit(False).alias("refers"),
            F.to_json(F.struct(*key)).alias("key"),
        )
        entries.append(F.when(present, entry))
    for fk in table.foreign_keys:
        if parents is None or fk.parent not in parents:
            continue
        name = F.lit(f"{fk.column}_fk").alias("constraint")
        value = F.col(fk.column).cast("string")
        entry = F.struct(name, F.lit(True).alias("refers"), value.alias("key"))
        entries.append(F.when(value.isNotNull(), entry))
        known.append(parents[fk.parent].select(name, F.col(fk.parent_column).cast("string").alias("key")))
    keys = (
        df.select(F.explode(F.array_compact(F.array(*entries))).alias("entry"))
        .select("entry.*")
        .groupBy("constraint", "refers", "key")
        .agg(F.count("*").alias("n"))
    )
    broken = F.when(F.col("n") > 1, 1).otherwise(0)
    if known:
        there = reduce(DataFrame.unionByName, known).distinct().withColumn("there", F.lit(True))
        keys = keys.join(there, ["constraint", "key"], "left")
        broken = F.when(F.col("refers"), F.when(F.col("there"), 0).otherwise(F.col("n"))).otherwise(broken)
    per_key = keys.groupBy("constraint").agg(F.sum(broken).alias("nr_violations"))
    return per_row.unionByName(per_key).where(F.col("nr_violations") > 0)
