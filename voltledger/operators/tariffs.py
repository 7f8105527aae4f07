"""Monthly costs of contracts by the components of the tariffs they are under.

The tables declare what a cost is made of; how it is computed is this module's own reading:

* a tariff holds for the months whose first day lies in [validity_start, validity_end), open where null;
* a component's price holds in its months of the year, both ends included, wrapping over the new year
  where the start is the greater; in other months its price outside validity holds;
* quantity: 1; the meter value; the subscribed or connection power; or what the meter value exceeds the
  limit times subscribed power, connection power or the other meter value by, 0 if it does not;
* amount: quantity times price, per month as it is, per year divided by 12 or multiplied by the days of the
  month over the days of the year; rounded half up to six decimals, once;
* revenues count positive, other amounts negative. Sums are exact.

A component whose meter value or power is missing has no quantity and no amount; it is counted apart.

All that depends on tariffs is put on one price sheet, one row per customer group, month and component, with
validity spans turned into months. Contracts with their links and readings, all keyed by facility and month, meet
it by customer group and month, so no join has a range in its condition and contracts are shuffled once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.operators.joins import broadcast_if_small
from voltledger.schemas import MONEY_PRICE, MONEY_TOTAL

# A sheet row is a dozen numbers and three codes; this many take some 100 MB in every executor.
SHEET_BROADCAST_MAX_ROWS = 500_000
#: Eleven digits before the point: with a price of 20 digits a product still has all its decimals.
QUANTITY = "decimal(17,6)"
#: Wide enough for a money price; times days and over days it keeps 16 decimals, so that rounding to
#: six afterwards is rounding once (multiples of 1 / (366 * 10^12) are further apart than 10^-15).
EXACT = "decimal(28,12)"
#: Holds powers and meter values alike.
REFERENCE = "decimal(21,6)"
COMPONENT_KEY = ("facility_id", "date_id", "tariff_component_id")

OVERSHOOT = "overshoot_"


# -- validity ---------------------------------------------------------------------------------------


def tariff_months(tariffs: DataFrame, first: date, last: date) -> DataFrame:
    """tariff_id and each month from ``first`` to ``last`` (first days of months) that it holds in.

    A span becomes a sequence of months, so that what follows joins on equal months.
    """
    # The first month whose first day is not before the start.
    begun = F.trunc("validity_start", "month")
    start = F.when(begun == F.col("validity_start"), begun).otherwise(F.add_months(begun, 1))
    begin = F.greatest(start, F.lit(first))
    # The last month whose first day is before the end.
    final = F.least(F.trunc(F.date_sub("validity_end", 1), "month"), F.lit(last))
    spans = tariffs.select("tariff_id", begin.alias("begin"), final.alias("final"))
    months = F.sequence("begin", "final", F.expr("INTERVAL 1 MONTH"))
    return spans.where(F.col("begin") <= F.col("final")).select(
        "tariff_id", F.explode(months).alias("date_id")
    )


def in_validity_months(month: Column) -> Column:
    """Whether a month of the year lies in validity_start..validity_end, which may wrap."""
    start, end = F.col("validity_start"), F.col("validity_end")
    return F.when(start <= end, month.between(start, end)).otherwise((month >= start) | (month <= end))


def _in_effect(price: str) -> Column:
    """The price of the month of date_id; one that is not given outside validity is 0."""
    outside = F.coalesce(F.col(f"{price}_outside_validity"), F.lit(0))
    inside = F.coalesce(F.col(price), F.lit(0))
    chosen = F.when(in_validity_months(F.month("date_id")), inside).otherwise(outside)
    return chosen.cast(MONEY_PRICE).alias(price)


def price_sheet(
    months: DataFrame,
    cost_groups: DataFrame,
    cost_group_links: DataFrame,
    components: DataFrame,
    component_types: DataFrame,
    calc_strategies: DataFrame,
    periodize_strategies: DataFrame,
    serie_types: DataFrame,
) -> DataFrame:
    """One row per customer group, month and component with the price in effect.

    ``months`` are those of ``tariff_months``. All tables are the user's price lists: their size is that
    of the lists, whatever the number of contracts.
    """
    calc = calc_strategies.select("calc_strategy_id", F.col("code").alias("calc_strategy"))
    periodize = periodize_strategies.select(
        "periodize_strategy_id", F.col("code").alias("periodize_strategy")
    )
    serie = serie_types.select("serie_type_id", F.col("code").alias("serie_type_code"))
    comparison = serie_types.select(
        F.col("serie_type_id").alias("comparison_serie_type_id"),
        F.col("code").alias("comparison_serie_type_code"),
    )
    types = (
        component_types.join(calc, "calc_strategy_id")
        .join(periodize, "periodize_strategy_id")
        .join(serie, "serie_type_id", "left")
        .join(comparison, "comparison_serie_type_id", "left")
    )
    return (
        cost_group_links.join(cost_groups.select("tariff_cost_group_id", "tariff_id"), "tariff_cost_group_id")
        .join(months, "tariff_id")
        .join(components, "tariff_cost_group_id")
        .join(types, "tariff_component_type_id")
        .select(
            "customer_group_id",
            "date_id",
            "tariff_id",
            "tariff_cost_group_id",
            "tariff_component_id",
            "calc_strategy",
            "periodize_strategy",
            "serie_type_code",
            "comparison_serie_type_code",
            F.coalesce("overshoot_limit", F.lit(1)).cast("decimal(9,6)").alias("overshoot_limit"),
            F.coalesce("is_revenue", F.lit(True)).alias("is_revenue"),
            _in_effect("price"),
            _in_effect("authority_fee"),
        )
    )


def unavailable_components(
    components: DataFrame, cost_groups: DataFrame, type_links: DataFrame
) -> DataFrame:
    """Components of a type that their tariff does not offer."""
    of_tariff = components.join(cost_groups.select("tariff_cost_group_id", "tariff_id"), "tariff_cost_group_id")
    return of_tariff.join(type_links, ["tariff_id", "tariff_component_type_id"], "left_anti").select(
        "tariff_component_id", "tariff_component_type_id", "tariff_cost_group_id", "tariff_id"
    )


# -- contracts --------------------------------------------------------------------------------------


def serie_codes(sheet: DataFrame) -> list[str]:
    """The serie types that prices depend on, brought to the driver: a few of the code table's."""
    both = F.array("serie_type_code", "comparison_serie_type_code")
    rows = sheet.select(F.explode(both).alias("code")).where(F.col("code").isNotNull()).distinct()
    return sorted(row.code for row in rows.collect())


def _field(codes: list[str]) -> dict[str, str]:
    """Fields of ``readings`` by serie type: numbered, so that codes may differ in case only."""
    return {code: f"{i}:{code}" for i, code in enumerate(codes)}


def readings_by_month(meter: DataFrame, codes: list[str]) -> DataFrame:
    """One row per facility and month with its meter values of the serie types ``codes``, a field each.

    There is one value per serie type, facility and month; were there more, the greatest counts. As greatest
    values are of fixed size, they are aggregated by hash and before the shuffle.
    """
    code, fields = F.col("serie_type_code"), _field(codes)
    wanted = meter.where(F.col("serie_value").isNotNull() & code.isin(codes))
    greatest = [F.max(F.when(code == c, F.col("serie_value"))).alias(f"_{field}") for c, field in fields.items()]
    return wanted.groupBy("facility_id", "date_id").agg(*greatest).select(
        "facility_id",
        "date_id",
        F.struct(*[F.col(f"`_{field}`").alias(field) for field in fields.values()]).alias("readings"),
    )


def _reading(fields: list[str], code: str) -> Column:
    value = F.lit(None).cast("decimal(18,3)")
    for field in fields:
        of_type = F.col(code) == field.split(":", 1)[1]
        value = F.when(of_type, F.col("readings").getField(field)).otherwise(value)
    return value


def priced_contracts(
    contracts: DataFrame,
    links: DataFrame,
    meter: DataFrame,
    sheet: DataFrame,
    max_broadcast_rows: int = SHEET_BROADCAST_MAX_ROWS,
) -> DataFrame:
    """One row per contract and component of its customer group's tariffs, with the readings.

    Contracts, links and readings share their key, so each is shuffled once. The sheet is broadcast after it is
    measured; a larger one is joined by customer group and month, where the adaptive join splits large groups.
    """
    keyed = contracts.select("facility_id", "date_id", "subscribed_power", "connection_power")
    read = keyed.join(links.select("facility_id", "date_id", "customer_group_id"), ["facility_id", "date_id"])
    codes = serie_codes(sheet)
    if codes:
        read = read.join(readings_by_month(meter, codes), ["facility_id", "date_id"], "left")
    numerator, denominator = month_share()
    shared = sheet.withColumns({"_share_numerator": numerator, "_share_denominator": denominator})
    return read.join(broadcast_if_small(shared, max_broadcast_rows), ["customer_group_id", "date_id"])


def with_quantity(priced: DataFrame) -> DataFrame:
    """All calculation strategies in one pass: the ``quantity`` that the price is for.

    What several strategies use is a column of its own, so that it is computed once a row and the compiled code
    stays small.
    """
    readings = priced.schema["readings"].dataType.names if "readings" in priced.columns else []
    strategy, value, excess = F.col("calc_strategy"), F.col("_value"), F.col("_excess")
    power = {name: F.col(name).cast(QUANTITY) for name in ("subscribed_power", "connection_power")}
    reference = F.when(
        strategy == "overshoot_comparison_meter_data_serie",
        _reading(readings, "comparison_serie_type_code").cast(REFERENCE),
    )
    quantity = F.when(strategy == "fixed", F.lit(1).cast(QUANTITY)).when(strategy == "per_unit", value.cast(QUANTITY))
    for name, column in power.items():
        reference = reference.when(strategy == f"{OVERSHOOT}{name}", column.cast(REFERENCE))
        quantity = quantity.when(strategy == name, column)
    quantity = quantity.when(excess > 0, excess.cast(QUANTITY)).when(excess <= 0, F.lit(0).cast(QUANTITY))
    return (
        priced.withColumns({"_value": _reading(readings, "serie_type_code"), "_reference": reference})
        .withColumn("_excess", value - F.col("overshoot_limit") * F.col("_reference"))
        .withColumn("quantity", quantity)
        .drop("readings", "_value", "_reference", "_excess")
    )


# -- amounts ----------------------------------------------------------------------------------------


def month_share() -> tuple[Column, Column]:
    """What part of a price falls on the month of date_id: numerator and denominator."""
    yearly, by_days = "per_year_divide_by_12", "per_year_periodize_over_month_length"
    strategy = F.col("periodize_strategy")
    days = F.dayofmonth(F.last_day("date_id"))
    days_of_year = F.dayofyear(F.make_date(F.year("date_id"), F.lit(12), F.lit(31)))
    numerator = F.when(strategy == by_days, days).otherwise(1)
    denominator = F.when(strategy == by_days, days_of_year).when(strategy == yearly, 12).otherwise(1)
    return numerator.cast("decimal(2,0)"), denominator.cast("decimal(3,0)")


def _signed(price: str) -> Column:
    exact = (F.col("quantity") * F.col(price)).cast(EXACT)
    return F.when(F.col("is_revenue"), exact).otherwise(-exact)


def _monthly(signed: str) -> Column:
    """The part of a month; most prices are per month and need no division."""
    numerator, denominator = F.col("_share_numerator"), F.col("_share_denominator")
    whole = F.when(denominator == 1, F.col(signed).cast(MONEY_PRICE))
    return whole.otherwise((F.col(signed) * numerator / denominator).cast(MONEY_PRICE))


def with_amounts(calculated: DataFrame) -> DataFrame:
    """The month's signed amount, and the authority fee within it."""
    signed = calculated.withColumns({"_signed": _signed("price"), "_signed_fee": _signed("authority_fee")})
    amounts = signed.withColumns({"amount": _monthly("_signed"), "fee_amount": _monthly("_signed_fee")})
    return amounts.drop("_signed", "_signed_fee", "_share_numerator", "_share_denominator")


def monthly_totals(amounts: DataFrame) -> DataFrame:
    """Per facility and month: revenue, cost, their balance, the authorities' share, and how many
    components there are and how many lack a value. Amounts are added exactly and rounded once."""

    def total(column: Column | str, name: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast(MONEY_TOTAL).alias(name)

    return amounts.groupBy("facility_id", "date_id").agg(
        total(F.when(F.col("is_revenue"), F.col("amount")), "revenue"),
        total(F.when(~F.col("is_revenue"), F.col("amount")), "cost"),
        total("amount", "balance"),
        total("fee_amount", "authority_fee"),
        F.count("*").alias("nr_components"),
        F.count_if(F.col("amount").isNull()).alias("nr_without_value"),
    )
