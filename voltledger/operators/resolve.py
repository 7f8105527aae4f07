"""Resolving the business keys of drops to surrogate ids and splitting into insert and update.

The ``resolve_*`` functions return one lazy frame per drop; the ``split_*`` functions divide it. Ids
that could not be found are null in the resolved frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.functions.conversion import cast_present
from voltledger.operators import checks
from voltledger.operators.joins import lookup, lookup_code, lookup_facility
from voltledger.results import Upsert


def resolve_products(drop: DataFrame, products: DataFrame) -> DataFrame:
    """The drop with ``product_id``, null for new products."""
    rows = cast_present(drop, schemas.PRODUCT_DROP)
    found = lookup_code(rows, products, "external_id", "external_id", "product_id")
    return found.select(F.col("product_id").cast("int"), *rows.columns)


def split_products(resolved: DataFrame) -> Upsert:
    is_new = F.col("product_id").isNull()
    return Upsert(insert=resolved.where(is_new).drop("product_id"), update=resolved.where(~is_new))


def resolve_facilities(
    drop: DataFrame, facilities: DataFrame, facility_types: DataFrame
) -> DataFrame:
    """The drop with ``facility_id`` (null for new facilities) and ``facility_type_id``."""
    rows = cast_present(drop, schemas.FACILITY_DROP)
    found = lookup_facility(rows, facilities)
    found = lookup_code(found, facility_types, "facility_type_code", "code", "facility_type_id")
    return found.select(
        F.col("facility_id").cast("long"), F.col("facility_type_id").cast("byte"), *rows.columns
    )


def split_facilities(resolved: DataFrame) -> Upsert:
    """New, existing, and those with an unknown facility type."""
    is_new = F.col("facility_id").isNull()
    return Upsert(
        insert=resolved.where(is_new).drop("facility_id", "facility_type_code"),
        update=resolved.where(~is_new).drop("facility_type_code"),
        invalid=resolved.where(F.col("facility_type_id").isNull()).select(
            "facility_id", "ean", "facility_type_id", "facility_type_code"
        ),
    )


def resolve_contracts(
    drop: DataFrame,
    facilities: DataFrame,
    customer_types: DataFrame,
    products: DataFrame,
    existing: DataFrame | None = None,
) -> DataFrame:
    """The drop with ``facility_id``, ``customer_type_id`` and ``product_id``.

    With the keys of the ``existing`` contracts there is also a flag ``to_insert``. A product that is
    not found is not an error; a drop without products leaves the stored ones alone.
    """
    rows = cast_present(drop, schemas.CONTRACT_DROP)
    found = lookup_facility(rows, facilities)
    found = lookup_code(found, customer_types, "customer_type_code", "code", "customer_type_id")
    ids = [F.col("facility_id").cast("long"), F.col("customer_type_id").cast("short")]
    if "ext_product_id" in rows.columns:
        found = lookup_code(found, products, "ext_product_id", "external_id", "product_id")
        ids.append(F.col("product_id").cast("int"))
    if existing is not None:
        stored = existing.select(
            F.col("facility_id").alias("_facility_id"), F.col("date_id").alias("_date_id")
        )
        same_key = (F.col("facility_id") == F.col("_facility_id")) & (
            F.col("date_id") == F.col("_date_id")
        )
        found = found.join(stored, same_key, "left")
        ids.append((F.col("_facility_id").isNull() & F.col("_date_id").isNull()).alias("to_insert"))
    return found.select(*ids, *rows.columns)


def contract_rows(resolved: DataFrame) -> DataFrame:
    """Resolved contracts as they are stored: ids in place of the business keys."""
    return resolved.drop("ean", "customer_type_code", "ext_product_id", "to_insert")


def split_contracts(resolved: DataFrame) -> Upsert:
    to_insert = F.col("to_insert")
    return Upsert(
        insert=contract_rows(resolved.where(to_insert)),
        update=contract_rows(resolved.where(~to_insert)),
    )


def contracts_with_unknown_customer_type(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("customer_type_id").isNull()).select(
        "facility_id", "ean", "date_id", "customer_type_id", "customer_type_code"
    )


def contracts_with_unknown_ean(resolved: DataFrame) -> DataFrame:
    shown = (
        "facility_id",
        "ean",
        "date_id",
        "fuse_size",
        "subscribed_power",
        "connection_power",
        "account_nr",
        "customer_type_code",
        "customer_type_id",
        "ext_product_id",
        "product_id",
    )
    present = [c for c in shown if c in resolved.columns]
    return resolved.where(F.col("facility_id").isNull()).select(*present)


def _resolve_meter_keys(rows: DataFrame, facilities: DataFrame, serie_types: DataFrame) -> DataFrame:
    found = lookup_facility(rows, facilities)
    found = lookup_code(found, serie_types, "serie_type_code", "code", "serie_type_id")
    return found.select(
        F.col("facility_id").cast("long"), F.col("serie_type_id").cast("int"), *rows.columns
    )


def resolve_meter_rows(drop: DataFrame, facilities: DataFrame, serie_types: DataFrame) -> DataFrame:
    """The drop with ``facility_id`` and ``serie_type_id``, values as decimals."""
    rows = cast_present(drop, schemas.METER_DROP)
    return _resolve_meter_keys(rows, facilities, serie_types)


def meter_row_is_unresolved() -> Column:
    return F.col("facility_id").isNull() | F.col("serie_type_id").isNull()


def unresolved_meter_rows(resolved: DataFrame) -> DataFrame:
    """Rows with an unknown facility or serie type."""
    return resolved.where(meter_row_is_unresolved())


def serie_values(resolved: DataFrame) -> DataFrame:
    """Resolved meter rows as they are stored; the serie type id only served the check."""
    return resolved.drop("serie_type_id")


def count_unresolved_meter_rows(
    drop: DataFrame, facilities: DataFrame, serie_types: DataFrame
) -> DataFrame:
    """One row: how many meter rows cannot be resolved.

    The serie types are looked up row by row, which needs no shuffle. Then rows are counted per EAN,
    so that a facility with very many rows reaches the join as one row per task, and the join finds
    the counts already partitioned by EAN.
    """
    keys = cast_present(drop.select("serie_type_code", "ean"), schemas.METER_DROP)
    typed = lookup_code(keys, serie_types, "serie_type_code", "code", "serie_type_id")
    counted = typed.groupBy("ean").agg(
        F.count("*").alias("nr_rows"),
        F.count_if(F.col("serie_type_id").isNull()).alias("nr_untyped"),
    )
    found = lookup(counted, facilities.select("ean", "facility_id"), "ean", "ean", None)
    invalid = F.when(F.col("facility_id").isNull(), F.col("nr_rows")).otherwise(F.col("nr_untyped"))
    return found.agg(F.coalesce(F.sum(invalid), F.lit(0)).alias("nr_invalid"))


def meter_profile(drop: DataFrame, facilities: DataFrame, serie_types: DataFrame) -> DataFrame:
    """One row with all that decides on a meter drop whose columns are there: the profile of
    ``drop_profile``, ``nr_repeated`` keys and ``nr_unresolved`` rows.

    The rows are counted by key, so the drop is read once and shuffled once; ids are then looked up for
    keys, each with its rows and flags, and the keys are folded to one row.
    """
    (key,) = checks.METER_RULES.unique
    month = F.col(checks.METER_RULES.month_start)
    keyed = drop.groupBy(*key.cols).agg(
        F.count("*").alias("nr_rows"),
        F.count_if(checks.any_null(checks.METER_RULES.required)).alias("nr_missing"),
    )
    resolved = _resolve_meter_keys(keyed, facilities, serie_types)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("nr_rows"))), F.lit(0))

    return resolved.agg(
        total(F.lit(True)).alias("nr_rows"),
        F.coalesce(F.sum("nr_missing"), F.lit(0)).alias("nr_missing"),
        total(F.dayofmonth(month) != 1).alias("nr_not_month_start"),
        F.min(month).cast("date").alias("first_date"),
        F.max(month).cast("date").alias("last_date"),
        F.count_if(F.col("nr_rows") > 1).alias("nr_repeated"),
        total(meter_row_is_unresolved()).alias("nr_unresolved"),
    )
