"""Global order that does not put equal keys into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Order = Sequence[tuple[str, str]]


def ordered(df: DataFrame, order_by: Order | None) -> DataFrame:
    """Sort by (column, "ASC" or "DESC") pairs, nulls last.

    The range partitioning has the task a row comes from as its last key. Partitions are still in
    order, but rows with one and the same key can be cut into several of them, which ``orderBy``
    would not do: a key or a null that most rows share does not end up in a single task.
    """
    if not order_by:
        return df
    keys = [
        F.col(c).desc_nulls_last() if direction == "DESC" else F.col(c).asc_nulls_last()
        for c, direction in order_by
    ]
    return (
        df.withColumn("_source", F.spark_partition_id())
        .repartitionByRange(*keys, F.col("_source").asc())
        .sortWithinPartitions(*keys)
        .drop("_source")
    )
