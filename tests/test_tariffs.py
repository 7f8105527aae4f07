"""Tariff costs against a plain computation with decimals, and the shape of their plan."""

from __future__ import annotations

import calendar
import random
from datetime import date
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.operators import tariffs
from voltledger.plans.costs import monthly_costs
from voltledger.seeds import CALC_STRATEGIES, PERIODIZE_STRATEGIES, local_table, seed_table
from voltledger.sinks.meter_store import write_meter_store

MONTHS = [date(y, m, 1) for y in (1999, 2000, 2001) for m in range(1, 13)]
ENERGY, PEAK = 1, 13
SERIES = {ENERGY: "active_energy_cons", PEAK: "max_active_power_cons"}


@pytest.fixture(scope="module")
def tables():
    """Two tariffs over three years with a leap year in it, every pair of strategies, random prices."""
    rnd = random.Random(11)

    def money(most: int) -> Decimal:
        return Decimal(rnd.randrange(most * 10**6)) / 10**6

    types, components = [], []
    for c in range(1, 8):
        for p in range(1, 4):
            types.append(dict(
                tariff_component_type_id=len(types) + 1, name=f"t{c}{p}", unit_id=1, calc_strategy_id=c,
                periodize_strategy_id=p, serie_type_id=ENERGY if c in (2, 7) else PEAK if c in (5, 6) else None,
                comparison_serie_type_id=PEAK if c == 7 else None, is_revenue=rnd.random() < 0.7))
    for group in (1, 2, 3):
        for t in types:
            outside = rnd.random() < 0.5
            components.append(dict(
                tariff_component_id=len(components) + 1, tariff_component_type_id=t["tariff_component_type_id"],
                tariff_cost_group_id=group, price=money(300), authority_fee=money(9) if outside else None,
                price_outside_validity=money(30) if outside else None, authority_fee_outside_validity=money(3),
                overshoot_limit=rnd.choice([None, Decimal("0.9"), Decimal("0.333333")]),
                validity_start=rnd.randrange(1, 13), validity_end=rnd.randrange(1, 13)))
    return dict(
        tariff=[dict(tariff_id=1, name="a", currency_id=1, validity_start=None, validity_end=date(2000, 3, 2)),
                dict(tariff_id=2, name="b", currency_id=1, validity_start=date(1999, 12, 2), validity_end=None),
                dict(tariff_id=3, name="c", currency_id=1, validity_start=date(2001, 5, 1), validity_end=date(2001, 5, 1))],
        tariff_cost_group=[dict(tariff_cost_group_id=g, tariff_id=t, name=f"g{g}") for g, t in ((1, 1), (2, 2), (3, 3))],
        tariff_cost_group_customer_group_link=[
            dict(tariff_cost_group_id=g, customer_group_id=k) for g, k in ((1, 1), (2, 1), (2, 2), (3, 2))],
        tariff_component_type=types,
        tariff_component=components,
        facility_contract=[
            dict(facility_id=f, date_id=m, customer_type_id=1, subscribed_power=rnd.choice([None, 12.5, 80.125]),
                 connection_power=rnd.choice([None, 3.25, 70.0])) for f in (1, 2, 3) for m in MONTHS[::f]],
        facility_customer_group_link=[
            dict(facility_id=f, date_id=m, customer_group_id=f) for f in (1, 2, 3) for m in MONTHS if m.month != 7],
        meter=[dict(facility_id=f, ean=f, date_id=m, serie_type_code=SERIES[s], status_id=None,
                    serie_value=Decimal(rnd.randrange(200_000)) / 1000)
               for f in (1, 2, 3) for m in MONTHS for s in SERIES if rnd.random() < 0.8],
    )


def half_up(x: Fraction, digits: int) -> Decimal:
    scaled = abs(x) * 10**digits
    units = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
    return Decimal(units if x >= 0 else -units).scaleb(-digits)


def holds(t: dict, m: date) -> bool:
    return (t["validity_start"] is None or t["validity_start"] <= m) and (
        t["validity_end"] is None or m < t["validity_end"])


def plain_amounts(tables) -> dict:
    readings = {(r["facility_id"], r["date_id"], r["serie_type_code"]): r["serie_value"] for r in tables["meter"]}
    of_type = {t["tariff_component_type_id"]: t for t in tables["tariff_component_type"]}
    tariff_of = {g["tariff_cost_group_id"]: g["tariff_id"] for g in tables["tariff_cost_group"]}
    tariff = {t["tariff_id"]: t for t in tables["tariff"]}
    link = {(r["facility_id"], r["date_id"]): r["customer_group_id"] for r in tables["facility_customer_group_link"]}
    out = {}
    for c in tables["facility_contract"]:
        f, m = c["facility_id"], c["date_id"]
        groups = [x["tariff_cost_group_id"] for x in tables["tariff_cost_group_customer_group_link"]
                  if x["customer_group_id"] == link.get((f, m))]
        for comp in tables["tariff_component"]:
            if comp["tariff_cost_group_id"] not in groups or not holds(tariff[tariff_of[comp["tariff_cost_group_id"]]], m):
                continue
            kind = of_type[comp["tariff_component_type_id"]]
            strategy = CALC_STRATEGIES[kind["calc_strategy_id"] - 1][0]
            value = readings.get((f, m, SERIES.get(kind["serie_type_id"])))
            power = {k: None if c[k] is None else Decimal(str(c[k])) for k in ("subscribed_power", "connection_power")}
            if strategy == "fixed":
                quantity = Decimal(1)
            elif strategy == "per_unit":
                quantity = value
            elif strategy in power:
                quantity = power[strategy]
            else:
                reference = (readings.get((f, m, SERIES[PEAK])) if kind["comparison_serie_type_id"]
                             else power[strategy.removeprefix("overshoot_")])
                limit = Decimal(1) if comp["overshoot_limit"] is None else comp["overshoot_limit"]
                quantity = None if value is None or reference is None else max(Decimal(0), value - limit * reference)
                quantity = quantity and quantity.quantize(Decimal("0.000001"), ROUND_HALF_UP)
            a, b = comp["validity_start"], comp["validity_end"]
            months = range(a, b + 1) if a <= b else [*range(a, 13), *range(1, b + 1)]
            suffix = "" if m.month in months else "_outside_validity"
            share = {"per_month": Fraction(1), "per_year_divide_by_12": Fraction(1, 12)}.get(
                PERIODIZE_STRATEGIES[kind["periodize_strategy_id"] - 1][0],
                Fraction(calendar.monthrange(m.year, m.month)[1], 366 if calendar.isleap(m.year) else 365))
            row = []
            for price in ("price", "authority_fee"):
                exact = None if quantity is None else Fraction(quantity) * Fraction(comp[price + suffix] or 0) * share
                row.append(None if exact is None else half_up(exact if kind["is_revenue"] else -exact, 6))
            out[f, m, comp["tariff_component_id"]] = (quantity, *row)
    return out


def frame(spark, tables, name):
    schema = schemas.SERIE_VALUE if name == "meter" else schemas.TABLES[name].schema
    return spark.createDataFrame([tuple(row.get(c) for c in schema.names) for row in tables[name]], schema)


def sheet_of(spark, tables):
    return tariffs.price_sheet(
        tariffs.tariff_months(frame(spark, tables, "tariff"), MONTHS[0], MONTHS[-1]),
        *(frame(spark, tables, n) for n in ("tariff_cost_group", "tariff_cost_group_customer_group_link",
                                            "tariff_component", "tariff_component_type")),
        *(seed_table(spark, n) for n in ("calc_strategy", "periodize_strategy", "serie_type")))


def amounts_of(spark, tables, **options):
    priced = tariffs.priced_contracts(
        *(frame(spark, tables, n) for n in ("facility_contract", "facility_customer_group_link", "meter")),
        sheet_of(spark, tables), **options)
    return tariffs.with_amounts(tariffs.with_quantity(priced))


def found(df) -> dict:
    rows = df.select(*tariffs.COMPONENT_KEY, "quantity", "amount", "fee_amount").collect()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("options", [{}, {"max_broadcast_rows": 0}])
def test_amounts_equal_a_plain_computation(spark, tables, options):
    wanted = plain_amounts(tables)
    assert found(amounts_of(spark, tables, **options)) == wanted
    kinds = {c["tariff_component_id"]: c["tariff_component_type_id"] for c in tables["tariff_component"]}
    assert len({kinds[k[2]] for k, v in wanted.items() if v[0]}) == 21, "every pair of strategies has a quantity"


def test_totals_are_exact_sums(spark, tables):
    wanted = {}
    revenue = {t["tariff_component_type_id"]: t["is_revenue"] for t in tables["tariff_component_type"]}
    kinds = {c["tariff_component_id"]: revenue[c["tariff_component_type_id"]] for c in tables["tariff_component"]}
    for (f, m, c), (_, amount, fee) in plain_amounts(tables).items():
        row = wanted.setdefault((f, m), [Fraction(0)] * 4 + [0, 0])
        row[0 if kinds[c] else 1] += Fraction(amount or 0)
        row[2] += Fraction(amount or 0)
        row[3] += Fraction(fee or 0)
        row[4] += 1
        row[5] += amount is None
    got = {tuple(r)[:2]: tuple(r)[2:] for r in tariffs.monthly_totals(amounts_of(spark, tables)).collect()}
    assert got == {k: (*(half_up(x, 3) for x in v[:4]), *v[4:]) for k, v in wanted.items()}


def test_validity_spans_become_months(spark, tables):
    rows = tariffs.tariff_months(frame(spark, tables, "tariff"), MONTHS[0], MONTHS[-1]).collect()
    wanted = {(t["tariff_id"], m) for t in tables["tariff"] for m in MONTHS if holds(t, m)}
    assert sorted(map(tuple, rows)) == sorted(wanted)


@pytest.mark.parametrize("start,end,inside", [
    (11, 3, {11, 12, 1, 2, 3}), (3, 11, set(range(3, 12))), (5, 5, {5}), (1, 12, set(range(1, 13))), (12, 1, {12, 1}),
    (6, 5, set(range(1, 13)))])
def test_validity_months_wrap(spark, start, end, inside):
    months = spark.range(1, 13).selectExpr("CAST(id AS INT) AS m", f"{start} AS validity_start", f"{end} AS validity_end")
    assert {r.m for r in months.where(tariffs.in_validity_months(F.col("m"))).collect()} == inside


def test_a_yearly_price_adds_up_over_a_leap_year(spark):
    rows = [dict(date_id=date(y, m, 1), periodize_strategy="per_year_periodize_over_month_length")
            for y in (1900, 2000, 2023, 2024) for m in range(1, 13)]
    df = local_table(spark, rows, schemas.struct(date_id=schemas.DATE, periodize_strategy=schemas.STRING))
    part, whole = tariffs.month_share()
    sums = df.groupBy(F.year("date_id").alias("y"), whole.alias("whole")).agg(F.sum(part).alias("days")).collect()
    assert {(r.y, int(r.whole), int(r.days)) for r in sums} == {
        (1900, 365, 365), (2000, 366, 366), (2023, 365, 365), (2024, 366, 366)}


def test_no_join_without_equal_keys(spark, tables):
    for options in ({}, {"max_broadcast_rows": 0}):
        plan = tariffs.monthly_totals(amounts_of(spark, tables, **options))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert "Window" not in plan


def test_empty_tables_give_no_costs(spark, tables):
    for name in tables:
        assert found(amounts_of(spark, {**tables, name: []})) == {} or name == "meter"


def test_components_their_tariff_does_not_offer(spark, tables):
    links = local_table(spark, [dict(tariff_id=t, tariff_component_type_id=k) for t in (1, 3) for k in range(1, 22)],
                        schemas.TARIFF_COMPONENT_TYPE_LINK.schema)
    rows = tariffs.unavailable_components(
        frame(spark, tables, "tariff_component"), frame(spark, tables, "tariff_cost_group"), links).collect()
    assert sorted(r.tariff_component_id for r in rows) == list(range(22, 43))


def test_costs_of_stored_contracts(store, tables, tmp_path):
    """The months asked for, from stored tables and a meter store."""
    spark, root = store.spark, str(tmp_path / "meter")
    for name in tables:
        if name != "meter":
            store.commit(name, frame(spark, tables, name))
    assert write_meter_store(frame(spark, tables, "meter"), root).ok
    first, last = date(1999, 11, 1), date(2000, 4, 1)
    wanted = {k: v for k, v in plain_amounts(tables).items() if first <= k[1] <= last}
    costs = monthly_costs(store, root, first, last)
    assert found(costs.amounts) == wanted
    assert costs.totals.count() == len({k[:2] for k in wanted})


def test_readings_are_aggregated_by_hash(spark, tables):
    """Values of a facility's month meet in a hash aggregate before the shuffle, not in lists."""
    plan = amounts_of(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    assert "lambda" not in plan


def test_greatest_reading_counts_and_codes_may_differ_in_case(spark):
    rows = [(1, "a", 2), (1, "a", 5), (1, "A", 3), (1, None, 9), (2, "b", 1), (2, "a", None), (None, "a", 4)]
    meter = spark.createDataFrame(rows, "facility_id int, serie_type_code string, serie_value int").selectExpr(
        "facility_id", "serie_type_code", "CAST(serie_value AS DECIMAL(18,3)) AS serie_value",
        "DATE'2025-01-01' AS date_id")
    got = {r.facility_id: tuple(r.readings) for r in tariffs.readings_by_month(meter, ["A", "a"]).collect()}
    assert got == {1: (3, 5), None: (None, 4)}
