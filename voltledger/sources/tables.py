"""Stored tables and the scans the jobs make over them."""

from __future__ import annotations

from collections.abc import Collection
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltledger.functions.conversion import conform, has_required_columns
from voltledger.operators.joins import broadcast_if_small
from voltledger.results import OperationResult
from voltledger.schemas import TABLES
from voltledger.sources.staging import hadoop_path

COMMITTED = "_SUCCESS"
# Beside it: the unique columns of this version were found unique when it was written.
CHECKED = "_UNIQUE"


class TableStore:
    """Parquet tables under one root, each write a new directory ``<table>/version=<n>``.

    Spark puts the marker file of a write in place last, so a version without it is invisible and a
    reader never sees half a table. In a table that is partitioned by month a version holds only the
    months it replaces; a month is read from the newest version that has it, so an import costs what
    its months cost and not what the table costs.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _children(self, path: str) -> list[str]:
        file_system, hadoop = hadoop_path(self.spark, path)
        if not file_system.exists(hadoop):
            return []
        return [status.getPath().getName() for status in file_system.listStatus(hadoop)]

    def _versions(self, name: str) -> list[int]:
        prefix = "version="
        numbers = [
            int(child.removeprefix(prefix))
            for child in self._children(f"{self.root}/{name}")
            if child.startswith(prefix)
        ]
        return sorted(numbers, reverse=True)

    def _current_paths(self, name: str, months: Collection[date] | None) -> list[str]:
        table, paths, seen = TABLES[name], [], set()
        wanted = None if months is None else {f"{table.partition_by}={m}" for m in months}
        for version in self._versions(name):
            path = f"{self.root}/{name}/version={version}"
            children = self._children(path)
            if COMMITTED not in children:
                continue
            if table.partition_by is None:
                return [path]
            for child in children:
                if child in seen or not child.startswith(f"{table.partition_by}="):
                    continue
                seen.add(child)
                if wanted is None or child in wanted:
                    paths.append(f"{path}/{child}")
            if wanted is not None and wanted <= seen:
                break  # older versions have nothing to add
        return paths

    def read(self, name: str, months: Collection[date] | None = None) -> DataFrame:
        """The current rows. Filters on the month column prune directories; when the ``months`` are
        known beforehand, those of other months are not even listed."""
        schema = TABLES[name].schema
        paths = self._current_paths(name, months)
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        return reader.parquet(*paths).select(*schema.names)

    def is_checked(self, name: str) -> bool:
        """Whether the current version of a table (one without months) was written as checked."""
        for version in self._versions(name):
            children = self._children(f"{self.root}/{name}/version={version}")
            if COMMITTED in children:
                return CHECKED in children
        return True

    def commit(self, name: str, df: DataFrame, checked: bool = False) -> None:
        """Publish ``df``: as the whole table, or as the months it contains. ``checked`` says that its
        unique columns are unique, so that a later commit need only look at what it changes."""
        table = TABLES[name]
        version = max(self._versions(name), default=0) + 1
        path = f"{self.root}/{name}/version={version}"
        df = conform(df, table.schema)
        if table.partition_by is None:
            df.write.parquet(path)
            if checked:
                file_system, marker = hadoop_path(self.spark, f"{path}/{CHECKED}")
                file_system.create(marker).close()
            return
        # Rebalance splits a large month over several tasks; a plain repartition would not.
        (
            df.hint("rebalance", table.partition_by)
            .sortWithinPartitions(table.partition_by, *table.key)
            .write.partitionBy(table.partition_by)
            .parquet(path)
        )


def typed_scan(
    df: DataFrame, schema: T.StructType, error_msg: str = "Unable to load the table!"
) -> tuple[DataFrame, OperationResult]:
    """Bring any scan (parquet, JDBC, a query) to a fixed schema, in its column order."""
    result = has_required_columns(df.columns, schema.names)
    if not result.ok:
        return df, OperationResult.failed(error_msg, result.short_msg)
    return conform(df, schema), OperationResult()


def key_mapping(table: DataFrame, key: str, id_col: str) -> DataFrame:
    """Business key to surrogate id; the other columns are not read."""
    return table.select(key, id_col)


def contract_keys_between(contracts: DataFrame, first: date, last: date) -> DataFrame:
    """Keys of the contracts in an inclusive range of months."""
    return contracts.where(F.col("date_id").between(first, last)).select("facility_id", "date_id")


def _from_month(df: DataFrame, start: date, end: date | None) -> DataFrame:
    df = df.where(F.col("date_id") >= F.lit(start))
    return df if end is None else df.where(F.col("date_id") < F.lit(end))


def contracts_extended(
    contracts: DataFrame,
    facilities: DataFrame,
    facility_types: DataFrame,
    start: date,
    end: date | None = None,
) -> DataFrame:
    """Contracts with the type of their facility, in ``[start, end)`` or from ``start`` on."""
    # The facility types are a handful of hot keys: a shuffle on them would be a few huge tasks.
    types = broadcast_if_small(facility_types.select("facility_type_id"))
    typed = facilities.select("facility_id", "facility_type_id").join(types, "facility_type_id")
    in_range = _from_month(contracts, start, end)
    return in_range.join(typed, "facility_id").select(*contracts.columns, "facility_type_id")


def links_between(links: DataFrame, start: date, end: date | None = None) -> DataFrame:
    """Links in ``[start, end)`` or from ``start`` on."""
    return _from_month(links, start, end)


def customer_groups_with_strategy(groups: DataFrame, strategies: DataFrame) -> DataFrame:
    """Customer groups with the code of their mapping strategy."""
    codes = strategies.select(
        F.col("customer_group_mapping_strategy_id").alias("mapping_strategy_id"),
        F.col("code").alias("mapping_strategy_code"),
    )
    return groups.join(codes, "mapping_strategy_id").select(
        *groups.columns, "mapping_strategy_code"
    )
