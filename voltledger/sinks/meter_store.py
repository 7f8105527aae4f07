"""Writing the meter store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voltledger.results import SPARK_ERRORS, OperationResult
from voltledger.schemas import METER_PARTITIONS


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = (),
    overwrite: bool = False,
    cluster_by: tuple[str, ...] = (),
    row_group_bytes: int | None = None,
) -> OperationResult:
    """Write parquet, optionally as a hive. Overwriting a hive replaces only the partitions in ``df``.

    Rows are rebalanced on the partition columns: small partitions share a task and large ones are
    split by size over several, so neither the number of files nor the size of a task gets out of
    hand when one partition holds most of the rows. ``cluster_by`` sorts inside each file, which
    lets readers skip row groups.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if partition_by or cluster_by:
        df = df.sortWithinPartitions(*partition_by, *cluster_by)
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", row_group_bytes)
    try:
        writer.parquet(path)
    except SPARK_ERRORS as e:
        return OperationResult.from_error(f'Could not write parquet files to "{path}"!', e)
    return OperationResult()


def write_meter_store(serie_values: DataFrame, root: str) -> OperationResult:
    """Replace the (serie type, month) partitions that occur in ``serie_values``."""
    return write_parquet(
        serie_values, root, partition_by=METER_PARTITIONS, overwrite=True, cluster_by=("ean",)
    )
