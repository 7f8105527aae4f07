"""Monthly costs of the stored contracts."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.operators import tariffs
from voltledger.sources.meter_store import read_meter_store
from voltledger.sources.tables import TableStore


class Costs(NamedTuple):
    """Lazy frames: what each component of each contract-month comes to, and their monthly totals."""

    amounts: DataFrame
    totals: DataFrame


def monthly_costs(store: TableStore, meter_root: str, first: date, last: date) -> Costs:
    """Costs of the contracts from month ``first`` to month ``last`` (first days, both included).

    Only these months of contracts, links and readings are read. Contracts without a customer group and
    customer groups without a tariff have no costs.
    """
    contracts = store.read("facility_contract").where(F.col("date_id").between(first, last))
    links = store.read("facility_customer_group_link").where(F.col("date_id").between(first, last))
    meter = read_meter_store(store.spark, meter_root).where(F.col("date_id").between(first, last))
    sheet = tariffs.price_sheet(
        tariffs.tariff_months(store.read("tariff"), first, last),
        store.read("tariff_cost_group"),
        store.read("tariff_cost_group_customer_group_link"),
        store.read("tariff_component"),
        store.read("tariff_component_type"),
        store.read("calc_strategy"),
        store.read("periodize_strategy"),
        store.read("serie_type"),
    )
    priced = tariffs.priced_contracts(contracts, links, meter, sheet)
    amounts = tariffs.with_amounts(tariffs.with_quantity(priced))
    return Costs(amounts, tariffs.monthly_totals(amounts))
