"""Seed rows of the code tables. Ids are 1..n in the listed order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voltledger import schemas
from voltledger.results import OperationResult

# Codes and names that stored data refers to.
FACILITY_TYPES = (("consumption", "Consumption"), ("production", "Production"))
CUSTOMER_TYPES = (("private_person", "Private person"), ("company", "Company"))
MAPPING_STRATEGIES = (
    ("fuse_size", "Fuse Size"),
    ("subscribed_power", "Subscribed Power"),
    ("connection_power", "Connection Power"),
    ("product", "Product"),
)
CALC_STRATEGIES = (
    ("fixed", "Fixed"),
    ("per_unit", "Per Unit"),
    ("subscribed_power", "Subscribed Power"),
    ("connection_power", "Connection Power"),
    ("overshoot_subscribed_power", "Overshoot Subscribed Power"),
    ("overshoot_connection_power", "Overshoot Connection Power"),
    ("overshoot_comparison_meter_data_serie", "Overshoot Compared to a Meter Data Serie"),
)
PERIODIZE_STRATEGIES = (
    ("per_month", "Per Month"),
    ("per_year_divide_by_12", "Per Year Divide By 12"),
    ("per_year_periodize_over_month_length", "Per Year Periodize Over Month Length"),
)
SERIE_TYPES = (
    ("active_energy_cons", "Active Energy Consumption"),
    ("active_energy_prod", "Active Energy Production"),
    ("reactive_energy_cons", "Reactive Energy Consumption"),
    ("reactive_energy_prod", "Reactive Energy Production"),
    ("apparent_energy_cons", "Apparent Energy Consumption"),
    ("apparent_energy_prod", "Apparent Energy Production"),
    ("active_power_cons", "Active Power Consumption"),
    ("active_power_prod", "Active Power Production"),
    ("reactive_power_cons", "Reactive Power Consumption"),
    ("reactive_power_prod", "Reactive Power Production"),
    ("apparent_power_cons", "Apparent Power Consumption"),
    ("apparent_power_prod", "Apparent Power Production"),
    ("max_active_power_cons", "Max Active Power Consumption"),
    ("max_active_power_prod", "Max Active Power Production"),
    ("max_reactive_power_cons", "Max Reactive Power Consumption"),
    ("max_reactive_power_prod", "Max Reactive Power Production"),
    ("max_apparent_power_cons", "Max Apparent Power Consumption"),
    ("max_apparent_power_prod", "Max Apparent Power Production"),
    ("max_deb_active_power_cons_high_load", "Max Debitable Active Power Consumption High Load"),
    ("max_deb_active_power_cons_low_load", "Max Debitable Active Power Consumption Low Load"),
)
CURRENCIES = (
    # iso_code, name, minor_unit_name, minor_per_major, display_decimals, symbol, symbol_minor_unit
    ("SEK", "Svenska enkronor", "öre", 100, 2, "kr", None),
    ("EUR", "Euro", "euro cent", 100, 2, "€", "c"),
)
UNITS = (
    ("kWh", "kWh"),
    ("kVArh", "kVArh"),
    ("kVAh", "kVAh"),
    ("MWh", "MWh"),
    ("MVArh", "MVArh"),
    ("MVAh", "MVAh"),
    ("GWh", "GWh"),
    ("GVArh", "GVArh"),
    ("GVAh", "GVAh"),
    ("TWh", "TWh"),
    ("TVArh", "TVArh"),
    ("TVAh", "TVAh"),
    ("kW", "kW"),
    ("kVAr", "kVAr"),
    ("kVA", "kVA"),
    ("MW", "MW"),
    ("MVAr", "MVAr"),
    ("MVA", "MVA"),
    ("GW", "GW"),
    ("GVAr", "GVAr"),
    ("GVA", "GVA"),
    ("TW", "TW"),
    ("TVAr", "TVAr"),
    ("TVA", "TVA"),
    ("degrees_celsius", "°C"),
    ("per_month", "/month"),
    ("per_year", "/year"),
    ("per_kWh", "/kWh"),
    ("per_kVArh", "/kVArh"),
    ("per_kW_per_month", "/kW/month"),
    ("per_kVAr_per_month", "/kVAr/month"),
    ("per_kW_per_year", "kW/year"),
    ("per_kVAr_per_year", "/kVAr/year"),
)

_SEEDS: dict[str, tuple[tuple[str, ...], tuple[tuple, ...]]] = {
    "facility_type": (("code", "name"), FACILITY_TYPES),
    "customer_type": (("code", "name"), CUSTOMER_TYPES),
    "customer_group_mapping_strategy": (("code", "name"), MAPPING_STRATEGIES),
    "calc_strategy": (("code", "name"), CALC_STRATEGIES),
    "periodize_strategy": (("code", "name"), PERIODIZE_STRATEGIES),
    "serie_type": (("code", "name"), SERIE_TYPES),
    "currency": (
        (
            "iso_code",
            "name",
            "minor_unit_name",
            "minor_per_major",
            "display_decimals",
            "symbol",
            "symbol_minor_unit",
        ),
        CURRENCIES,
    ),
    "unit": (("code", "display_name"), UNITS),
}


def local_table(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    """A small literal table as a local relation, so that its size is known to the optimizer."""
    columns = {f.name: [row.get(f.name) for row in rows] for f in schema.fields}
    if not rows:
        return spark.createDataFrame([], schema)
    arrow = pa.table(
        {
            f.name: pa.array(columns[f.name], type=_ARROW_TYPES[f.dataType.simpleString()])
            for f in schema.fields
        }
    )
    return spark.createDataFrame(arrow)


_ARROW_TYPES = {
    "tinyint": pa.int8(),
    "smallint": pa.int16(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "date": pa.date32(),
    "string": pa.string(),
}


def seed_table(spark: SparkSession, name: str) -> DataFrame:
    """The seed rows of one code table in its stored schema."""
    columns, values = _SEEDS[name]
    schema = schemas.TABLES[name].schema
    id_col = schema.fields[0].name
    rows = [{id_col: i, **dict(zip(columns, row))} for i, row in enumerate(values, start=1)]
    return local_table(spark, rows, schema)


def init_tables(store) -> OperationResult:
    """Write all seed tables. A second run fails, because every code exists already."""
    stored = [name for name in _SEEDS if not store.read(name).isEmpty()]
    if stored:
        return OperationResult.failed(f"The tables {tuple(sorted(stored))} already hold their seed rows!")
    for name in _SEEDS:
        store.commit(name, seed_table(store.spark, name))
    return OperationResult()
