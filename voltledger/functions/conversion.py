"""Typed projections over drops whose optional columns may be absent."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltledger import messages
from voltledger.results import OperationResult


def has_required_columns(columns: Sequence[str], required: Sequence[str]) -> OperationResult:
    """Check the schema only; no job is started."""
    missing = set(required) - set(columns)
    if not missing:
        return OperationResult()
    text = messages.MISSING_COLUMNS.format(
        missing=tuple(sorted(missing)),
        required=tuple(sorted(set(required))),
        available=tuple(sorted(set(columns))),
    )
    return OperationResult.failed(text, text)


def _rounded(number: Column, digits: int) -> Column:
    """A double as ``F.round`` rounds it, halves away from zero, as a decimal of so many digits. Below 2^52 what
    is beyond the whole number is exact: the number need not become a decimal to be rounded."""
    whole, kind = F.floor(F.abs(number)), T.DecimalType(digits, 0)
    up = F.when(F.abs(number) - whole >= 0.5, whole + 1).otherwise(whole)
    signed = F.when(number < 0, -up).otherwise(up)
    return F.when(F.abs(number) < float(2**52), signed.cast(kind)).otherwise(F.round(number, 0).cast(kind))


def cast_column(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast with the rounding of a SQL ``::``, where Spark would cut off or round otherwise.

    To an integer, floating point halves go to the even neighbour and decimal halves away from zero.
    A floating point number becomes a decimal by scaling it in floating point first and rounding
    the product, halves away from zero, so 1034.0575 (a little less in binary) is 1034.057.
    """
    floating = isinstance(source, (T.DoubleType, T.FloatType))
    if isinstance(target, T.IntegralType):
        if floating:
            column = F.bround(column, 0)
        elif isinstance(source, T.DecimalType) and source.scale > 0:
            column = F.round(column, 0)
    elif isinstance(target, T.DecimalType) and floating:
        units = _rounded(column.cast("double") * F.lit(float(10**target.scale)), target.precision)
        column = units * F.lit(Decimal(1).scaleb(-target.scale))
        return column.cast(target)
    return column if source == target else column.cast(target)


def cast_present(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` that ``df`` has, cast to their types."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            cast_column(F.col(f.name), types[f.name], f.dataType).alias(f.name)
            for f in schema.fields
            if f.name in types
        ]
    )


def cast_in_place(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with the columns of ``schema`` that it has cast to their types."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {
            f.name: cast_column(F.col(f.name), types[f.name], f.dataType)
            for f in schema.fields
            if f.name in types and types[f.name] != f.dataType
        }
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All columns of ``schema`` in its order; absent ones are null, the others are cast."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            (
                cast_column(F.col(f.name), types[f.name], f.dataType)
                if f.name in types
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in schema.fields
        ]
    )
