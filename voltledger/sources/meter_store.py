"""Reading the meter store, a parquet hive by serie type and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltledger.schemas import SERIE_VALUE


def read_meter_store(spark: SparkSession, root: str) -> DataFrame:
    """All stored serie values. Filters on serie type and month prune directories."""
    return spark.read.schema(SERIE_VALUE).parquet(root)
