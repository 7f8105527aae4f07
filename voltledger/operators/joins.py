"""Look-ups of surrogate ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltledger.schemas import CODE_TABLE_MAX_ROWS

BROADCAST_MAX_TEXT_BYTES = 64 * 1024 * 1024
# A facility is two numbers in a look-up; this many take some 200 MB in every executor, which is
# little next to shuffling all meter readings.
FACILITY_BROADCAST_MAX_ROWS = 4_000_000


def fits_broadcast(
    df: DataFrame,
    max_rows: int = CODE_TABLE_MAX_ROWS,
    max_text_bytes: int = BROADCAST_MAX_TEXT_BYTES,
) -> bool:
    """Measure whether a table is small enough: its rows, and the bytes in its text columns.

    Without text columns the count of a stored table comes from parquet footers.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    size = F.lit(0)
    for text in texts:
        size = size + F.coalesce(F.octet_length(text), F.lit(0))
    row = df.agg(
        F.count("*").alias("nr_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("text_bytes")
    ).first()
    return row.nr_rows <= max_rows and row.text_bytes <= max_text_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = CODE_TABLE_MAX_ROWS) -> DataFrame:
    """The table with a broadcast hint when it is measured to be small, without otherwise."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def lookup(
    df: DataFrame,
    table: DataFrame,
    column: str,
    key: str,
    max_broadcast_rows: int | None = CODE_TABLE_MAX_ROWS,
) -> DataFrame:
    """Left join the other columns of ``table`` to ``df`` where ``df.column = table.key``.

    ``key`` is unique in ``table``. A table of up to ``max_broadcast_rows`` is broadcast, so ``df``
    stays where it is: the keys of code tables are few and hot, and a shuffle on them would put most
    rows into a handful of tasks. A larger table is joined by shuffle, and the adaptive join splits
    the partitions of ``df`` that hot keys make large. None leaves the choice to Spark.
    """
    values = [F.col(c) for c in table.columns if c != key]
    keyed = table.select(F.col(key).alias(f"_{key}"), *values)
    if max_broadcast_rows is not None:
        keyed = broadcast_if_small(keyed, max_broadcast_rows)
    return df.join(keyed, F.col(column) == F.col(f"_{key}"), "left").drop(f"_{key}")


def lookup_facility(df: DataFrame, facilities: DataFrame) -> DataFrame:
    """Add ``facility_id`` to rows that have an ``ean``."""
    mapping = facilities.select("ean", "facility_id")
    return lookup(df, mapping, "ean", "ean", FACILITY_BROADCAST_MAX_ROWS)


def lookup_code(df: DataFrame, table: DataFrame, column: str, key: str, id_col: str) -> DataFrame:
    """Add the id of a code table to rows that have the code."""
    return lookup(df, table.select(key, id_col), column, key)
