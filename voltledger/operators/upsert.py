"""Inserting and updating rows by key, and assigning surrogate ids."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.functions.conversion import conform, has_required_columns
from voltledger.results import OperationResult
from voltledger.sources.staging import Staging

# Columns a frame must have to be inserted into or to update a table.
INSERT_COLUMNS = {
    "product": ("external_id", "name"),
    "facility": ("ean", "facility_type_id"),
    "facility_contract": ("date_id", "customer_type_id"),
    "facility_customer_group_link": ("facility_id", "date_id", "customer_group_id"),
}
UPDATE_COLUMNS = {
    "product": ("product_id", "external_id", "name"),
    "facility": ("facility_id",),
    "facility_contract": ("facility_id", "date_id", "customer_type_id"),
    "facility_customer_group_link": ("facility_id", "date_id", "customer_group_id"),
}


def check_insert_columns(name: str, new: DataFrame) -> OperationResult:
    return has_required_columns(new.columns, INSERT_COLUMNS[name])


def check_update_columns(name: str, updates: DataFrame) -> OperationResult:
    return has_required_columns(updates.columns, UPDATE_COLUMNS[name])


def insert_rows(target: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the new rows; columns they lack are null."""
    return target.unionByName(conform(new, target.schema))


def _joined(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], how: str
) -> tuple[DataFrame, list[str]]:
    """Target and changes side by side: changed columns get a prefix, matches a flag."""
    changed = [c for c in changes.columns if c not in keys]
    unknown = set(changed) - set(target.columns)
    if unknown:
        raise ValueError(f"The table has no columns {tuple(sorted(unknown))}!")
    side = changes.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_changed")
    )
    return target.join(side, list(keys), how), changed


def _merged_columns(target: DataFrame, changed: Sequence[str]) -> list[Column]:
    """A changed row takes the new value, null included; a column that was not given stays."""
    return [
        (
            F.when(F.col("_changed"), F.col(f"_new_{f.name}")).otherwise(F.col(f.name))
            if f.name in changed
            else F.col(f.name)
        )
        .cast(f.dataType)
        .alias(f.name)
        for f in target.schema.fields
    ]


def update_by_key(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with its rows updated by primary key; updates without a row change nothing."""
    joined, changed = _joined(target, updates, keys, "left")
    return joined.select(*_merged_columns(target, changed))


def upsert_by_key(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with ``changes`` inserted or updated by primary key, in a single join."""
    joined, changed = _joined(target, changes, keys, "full")
    return joined.select(*_merged_columns(target, changed))


def max_id(table: DataFrame, id_col: str) -> int:
    return table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("id")).first().id


def assign_ids(
    new: DataFrame, order_by: str, id_col: str, first_id: int, staging: Staging
) -> DataFrame:
    """Number the rows consecutively in the order of a unique column, starting at ``first_id``.

    The rows are range-partitioned and sorted per partition, never in one task. Where a row ended
    up is written down once; the size of each block then gives its offset. Only those sizes, one
    per shuffle partition, go through the driver.
    """
    position = F.monotonically_increasing_id()
    placed = staging.write(
        new.repartitionByRange(order_by)
        .sortWithinPartitions(order_by)
        .withColumn("_block", F.shiftright(position, 33).cast("int"))
        .withColumn("_offset", position.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    blocks = placed.groupBy("_block").count().orderBy("_block").collect()
    starts = accumulate((row["count"] for row in blocks), initial=first_id)
    sizes = new.sparkSession.createDataFrame(
        [(row["_block"], start) for row, start in zip(blocks, starts)],
        "_block int, _start bigint",
    )
    return placed.join(F.broadcast(sizes), "_block").select(
        (F.col("_start") + F.col("_offset")).alias(id_col), *new.columns
    )
