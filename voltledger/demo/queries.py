"""The registered queries: one function per operator, named by its inventory id."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.demo import adapters as a
from voltledger.functions.conversion import cast_present
from voltledger.functions.intervals import filter_interval
from voltledger.operators import checks, constraints, grouping, resolve, tariffs, upsert
from voltledger.plans import jobs
from voltledger.results import JobReport, Upsert
from voltledger.schemas import DATE, INT, SERIE_VALUE_TYPE, struct
from voltledger.seeds import seed_table
from voltledger.sinks.meter_store import write_meter_store
from voltledger.sources import tables
from voltledger.sources.drops import load_drop
from voltledger.sources.meter_store import read_meter_store
from voltledger.sources.staging import Staging
from voltledger.sources.tables import TableStore
from voltledger.streaming.meter_drops import import_new_meter_drops

Query = Callable[[SparkSession, str], DataFrame]

# "Now" of the interval queries: intervals written relative to it are then fixed.
NOW = datetime(1997, 10, 20, 13, 37, 37, tzinfo=ZoneInfo("Europe/Stockholm"))
RANGE_FIRST, RANGE_LAST = date(1996, 3, 1), date(1997, 2, 1)


# --- scans -----------------------------------------------------------------------------------


def s1_parquet_scan(spark, sf_dir):
    df, result = load_drop(spark, f"{sf_dir}/orders.parquet")
    assert result.ok, result
    return df.selectExpr("o_orderkey", "o_custkey", "CAST(o_orderdate AS DATE) AS date_id")


def s3_typed_scan(spark, sf_dir):
    df, result = tables.typed_scan(a.facilities(spark, sf_dir), schemas.FACILITY.schema)
    assert result.ok, result
    return df


def s4_facility_keys(spark, sf_dir):
    return tables.key_mapping(a.facilities(spark, sf_dir), "ean", "facility_id")


def s4_product_keys(spark, sf_dir):
    return tables.key_mapping(a.products(spark, sf_dir), "external_id", "product_id")


def s5_contract_keys_between(spark, sf_dir):
    return tables.contract_keys_between(a.contracts(spark, sf_dir), RANGE_FIRST, RANGE_LAST)


def _extended(spark, sf_dir, start, end=None):
    return tables.contracts_extended(
        a.contracts(spark, sf_dir),
        a.facilities(spark, sf_dir),
        seed_table(spark, "facility_type"),
        start,
        end,
    )


def s6_contracts_extended(spark, sf_dir):
    return _extended(spark, sf_dir, RANGE_FIRST, RANGE_LAST)


def s6_contracts_extended_open(spark, sf_dir):
    return _extended(spark, sf_dir, RANGE_FIRST)


def s8_links_between(spark, sf_dir):
    return tables.links_between(a.stored_links(spark, sf_dir), RANGE_FIRST, RANGE_LAST)


def _filled_meter_store(spark, sf_dir, staging: Staging) -> str:
    root = staging.path("meter_data")
    resolved = resolve.resolve_meter_rows(
        a.meter_drop(spark, sf_dir), a.facilities(spark, sf_dir), seed_table(spark, "serie_type")
    )
    result = write_meter_store(resolve.serie_values(resolved), root)
    assert result.ok, result
    return root


def s9_meter_store_read(spark, sf_dir):
    root = _filled_meter_store(spark, sf_dir, Staging(spark, "s9"))
    return read_meter_store(spark, root).where(
        (F.col("serie_type_code") == "max_active_power_cons")
        & F.col("date_id").between(RANGE_FIRST, RANGE_LAST)
    )


# --- sinks -----------------------------------------------------------------------------------


def k1_meter_partition_overwrite(spark, sf_dir):
    root = _filled_meter_store(spark, sf_dir, Staging(spark, "k1"))
    resolved = resolve.resolve_meter_rows(
        a.meter_correction(spark, sf_dir),
        a.facilities(spark, sf_dir),
        seed_table(spark, "serie_type"),
    )
    result = write_meter_store(resolve.serie_values(resolved), root)
    assert result.ok, result
    return read_meter_store(spark, root)


def _facility_split(spark, sf_dir) -> Upsert:
    return resolve.split_facilities(
        resolve.resolve_facilities(
            a.facility_drop(spark, sf_dir),
            a.stored_facilities(spark, sf_dir),
            seed_table(spark, "facility_type"),
        )
    )


def k2_insert_rows(spark, sf_dir):
    new = _facility_split(spark, sf_dir).insert
    assert upsert.check_insert_columns("facility", new).ok
    return upsert.insert_rows(a.stored_facilities(spark, sf_dir), new)


def k3_update_by_key(spark, sf_dir):
    """The drop has no descriptions: the stored ones stay, while null ean_prod overwrite 123."""
    updates = _facility_split(spark, sf_dir).update.drop("description")
    assert upsert.check_update_columns("facility", updates).ok
    return upsert.update_by_key(a.stored_facilities(spark, sf_dir), updates, ("facility_id",))


def k6_assigned_ids(spark, sf_dir):
    stored = a.stored_facilities(spark, sf_dir)
    first = upsert.max_id(stored, "facility_id") + 1
    new = _facility_split(spark, sf_dir).insert.select("ean", "name")
    return upsert.assign_ids(new, "ean", "facility_id", first, Staging(spark, "k6"))


def k7_contract_upsert(spark, sf_dir):
    resolved = resolve.resolve_contracts(
        a.contract_drop(spark, sf_dir),
        a.facilities(spark, sf_dir),
        seed_table(spark, "customer_type"),
        a.products(spark, sf_dir),
    )
    changes = resolve.contract_rows(resolved).drop("account_nr")
    return upsert.upsert_by_key(
        a.stored_contracts(spark, sf_dir), changes, schemas.FACILITY_CONTRACT.key
    )


def u1_union_of_strategies(spark, sf_dir):
    contracts, groups = a.contracts_with_type(spark, sf_dir), a.customer_groups(spark)
    parts = [grouping.map_by_strategy(contracts, groups, s) for s in grouping.STRATEGIES]
    return reduce(DataFrame.unionByName, parts)


# --- projections -----------------------------------------------------------------------------


def p3_cast_present(spark, sf_dir):
    """Doubles with halves to integers and to decimals; the schema has columns the input lacks."""
    df = a.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_orderkey / 2.0D AS fuse_size",
        "CAST(o_orderkey AS DECIMAL(17,0)) * 0.5 AS account_nr",
        "o_totalprice / 8 AS serie_value",
        "o_orderdate AS date_id",
    )
    spec = struct(
        o_orderkey=INT,
        fuse_size=INT,
        account_nr=INT,
        serie_value=SERIE_VALUE_TYPE,
        date_id=DATE,
        status_id=INT,
    )
    return cast_present(df, spec)


def p5_insert_flag(spark, sf_dir):
    return _resolved_contracts(spark, sf_dir).select("facility_id", "date_id", "to_insert")


# --- aggregations ----------------------------------------------------------------------------


def a1_duplicates_over_all_columns(spark, sf_dir):
    return checks.duplicate_rows(a.event_drop(spark, sf_dir), count_col="n")


def a2_import_interval(spark, sf_dir):
    return checks.import_interval(a.raw_contract_drop(spark, sf_dir))


def a3_drop_profile(spark, sf_dir):
    return checks.drop_profile(a.raw_meter_drop(spark, sf_dir), checks.METER_RULES)


# --- checks ----------------------------------------------------------------------------------


def v2_missing_values(spark, sf_dir):
    rules = checks.CONTRACT_RULES
    drop = a.raw_contract_drop(spark, sf_dir)
    return checks.missing_values(drop, rules.required, rules.order_by)


def v3_duplicate_rows(spark, sf_dir):
    key = checks.CONTRACT_RULES.unique[0]
    return checks.duplicate_rows(a.raw_contract_drop(spark, sf_dir), key.cols, order_by=key.order_by)


def v3_duplicate_rows_without_nulls(spark, sf_dir):
    key = checks.FACILITY_RULES.unique[1]
    drop = a.raw_facility_drop(spark, sf_dir)
    return checks.duplicate_rows(
        drop, key.cols, exclude_nulls=key.exclude_nulls, order_by=key.order_by
    )


def v4_not_at_start_of_month(spark, sf_dir):
    rules = checks.CONTRACT_RULES
    drop = a.raw_contract_drop(spark, sf_dir)
    return checks.not_at_start_of_month(drop, "date_id", rules.required, rules.order_by)


def v5_product_drop_report(spark, sf_dir):
    return checks.drop_report(a.raw_product_drop(spark, sf_dir), checks.PRODUCT_RULES)


def v6_facility_drop_report(spark, sf_dir):
    return checks.drop_report(a.raw_facility_drop(spark, sf_dir), checks.FACILITY_RULES)


def v7_contract_drop_report(spark, sf_dir):
    return checks.drop_report(a.raw_contract_drop(spark, sf_dir), checks.CONTRACT_RULES)


def v8_meter_drop_report(spark, sf_dir):
    return checks.drop_report(a.raw_meter_drop(spark, sf_dir), checks.METER_RULES)


def v9_invalid_facility_type(spark, sf_dir):
    resolved = resolve.resolve_facilities(
        a.raw_facility_drop(spark, sf_dir),
        a.stored_facilities(spark, sf_dir),
        seed_table(spark, "facility_type"),
    )
    return resolve.split_facilities(resolved).invalid


def _resolved_contracts(spark, sf_dir, drop=None):
    return resolve.resolve_contracts(
        a.contract_drop(spark, sf_dir) if drop is None else drop,
        a.facilities(spark, sf_dir),
        seed_table(spark, "customer_type"),
        a.products(spark, sf_dir),
        a.stored_contracts(spark, sf_dir),
    )


def v10_invalid_customer_type(spark, sf_dir):
    resolved = _resolved_contracts(spark, sf_dir, a.raw_contract_drop(spark, sf_dir))
    return resolve.contracts_with_unknown_customer_type(resolved)


def v10_unknown_ean(spark, sf_dir):
    resolved = _resolved_contracts(spark, sf_dir, a.raw_contract_drop(spark, sf_dir))
    return resolve.contracts_with_unknown_ean(resolved)


def _resolved_meter_rows(spark, sf_dir):
    return resolve.resolve_meter_rows(
        a.raw_meter_drop(spark, sf_dir),
        a.facilities(spark, sf_dir),
        seed_table(spark, "serie_type"),
    )


def v11_unresolved_meter_rows(spark, sf_dir):
    return resolve.unresolved_meter_rows(_resolved_meter_rows(spark, sf_dir))


def v11_unresolved_meter_row_count(spark, sf_dir):
    return resolve.count_unresolved_meter_rows(
        a.raw_meter_drop(spark, sf_dir),
        a.facilities(spark, sf_dir),
        seed_table(spark, "serie_type"),
    )


def _assigned(spark, sf_dir):
    rules = grouping.prepare_rules(a.customer_groups(spark)).rules
    return grouping.assign_groups(a.contracts_with_type(spark, sf_dir), rules)


def d7_many_rules(spark, sf_dir):
    """A rule per part: contracts meet them by the segments their values lie in."""
    rules = grouping.prepare_rules(a.part_groups(spark, sf_dir)).rules
    assigned = grouping.assign_groups(a.contracts_with_type(spark, sf_dir), rules, max_direct_rules=100)
    return assigned.selectExpr("facility_id", "date_id", "CAST(customer_group_id AS LONG) AS customer_group_id")


def v13_unmapped_contracts(spark, sf_dir):
    return grouping.unmapped_of(_assigned(spark, sf_dir))


def v14_duplicate_links(spark, sf_dir):
    return grouping.duplicate_links(grouping.links_of(_assigned(spark, sf_dir)))


def d6_contracts_without_link(spark, sf_dir):
    return grouping.contracts_without_link(
        a.contracts(spark, sf_dir), a.stored_links(spark, sf_dir)
    ).select("facility_id", "date_id", "fuse_size")


# --- key resolution and mapping --------------------------------------------------------------


def _product_split(spark, sf_dir):
    return resolve.split_products(
        resolve.resolve_products(a.product_drop(spark, sf_dir), a.stored_products(spark, sf_dir))
    )


def m1_product_insert(spark, sf_dir):
    return _product_split(spark, sf_dir).insert


def m1_product_update(spark, sf_dir):
    return _product_split(spark, sf_dir).update


def m2_facility_insert(spark, sf_dir):
    return _facility_split(spark, sf_dir).insert


def m2_facility_update(spark, sf_dir):
    return _facility_split(spark, sf_dir).update


def m3_contract_insert(spark, sf_dir):
    return resolve.split_contracts(_resolved_contracts(spark, sf_dir)).insert


def m3_contract_update(spark, sf_dir):
    return resolve.split_contracts(_resolved_contracts(spark, sf_dir)).update


def d1_product_resolution(spark, sf_dir):
    return resolve.resolve_products(a.product_drop(spark, sf_dir), a.stored_products(spark, sf_dir))


def d2_facility_resolution(spark, sf_dir):
    return resolve.resolve_facilities(
        a.raw_facility_drop(spark, sf_dir),
        a.stored_facilities(spark, sf_dir),
        seed_table(spark, "facility_type"),
    )


def d3_contract_resolution(spark, sf_dir):
    return _resolved_contracts(spark, sf_dir, a.raw_contract_drop(spark, sf_dir))


def d4_meter_resolution(spark, sf_dir):
    return _resolved_meter_rows(spark, sf_dir)


def m4_serie_values(spark, sf_dir):
    return resolve.serie_values(_resolved_meter_rows(spark, sf_dir))


def _by_strategy(strategy: str) -> Query:
    def query(spark, sf_dir):
        return grouping.map_by_strategy(
            a.contracts_with_type(spark, sf_dir), a.customer_groups(spark), strategy
        )

    return query


def m10_map_all(spark, sf_dir):
    return grouping.links_of(_assigned(spark, sf_dir))


def _link_split(spark, sf_dir) -> Upsert:
    return grouping.split_links(
        grouping.links_of(_assigned(spark, sf_dir)), a.stored_links(spark, sf_dir)
    )


def m11_link_insert(spark, sf_dir):
    return _link_split(spark, sf_dir).insert


def m11_link_update(spark, sf_dir):
    return _link_split(spark, sf_dir).update


def m12_interval_months(spark, sf_dir):
    return filter_interval(a.contracts(spark, sf_dir), "date_id", "CM-6M..CM", NOW).select(
        "facility_id", "date_id"
    )


def m12_interval_timestamps(spark, sf_dir):
    df = a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    rows = filter_interval(df, "l_shipdate", "CY-1Y..now-1M", NOW)
    return rows.selectExpr("l_orderkey", "l_linenumber", "CAST(l_shipdate AS DATE) AS l_shipdate")


# --- constraints -----------------------------------------------------------------------------


def c1_unique_violations(spark, sf_dir):
    both = a.stored_facilities(spark, sf_dir).select("ean").unionByName(
        a.raw_facility_drop(spark, sf_dir).select("ean")
    )
    return constraints.unique_violations(both, ("ean",))


def c1_conflicts_with_stored(spark, sf_dir):
    return constraints.conflicts_with_stored(
        a.facility_drop(spark, sf_dir), a.stored_facilities(spark, sf_dir), ("ean",)
    )


def c2_foreign_key_violations(spark, sf_dir):
    return constraints.foreign_key_violations(
        a.contracts(spark, sf_dir), "facility_id", a.stored_facilities(spark, sf_dir), "facility_id"
    )


def _raw_contract_table(spark, sf_dir):
    resolved = _resolved_contracts(spark, sf_dir, a.raw_contract_drop(spark, sf_dir))
    return resolve.contract_rows(resolved)


def c3_c4_table_violations(spark, sf_dir):
    """Every constraint of the contract table over unchecked contracts."""
    return constraints.table_violations(
        _raw_contract_table(spark, sf_dir),
        schemas.FACILITY_CONTRACT,
        {
            "facility": a.stored_facilities(spark, sf_dir),
            "customer_type": seed_table(spark, "customer_type"),
            "product": a.products(spark, sf_dir),
        },
    )


# --- streaming -------------------------------------------------------------------------------


def _seeded(spark, label: str, *code_tables: str) -> tuple[TableStore, Staging]:
    staging = Staging(spark, label)
    store = TableStore(spark, staging.path("store"))
    for name in code_tables:
        store.commit(name, seed_table(spark, name))
    return store, staging


def _streamed_store(spark, sf_dir, label: str, drops: list[Callable]) -> DataFrame:
    """Each drop arrives in one directory and is followed by a run of the incremental import."""
    store, staging = _seeded(spark, label, "serie_type")
    store.commit("facility", a.facilities(spark, sf_dir))
    source, root = staging.path("drops"), staging.path("meter_data")
    for drop in drops:
        drop(spark, sf_dir).write.mode("append").parquet(source)
        (report,) = import_new_meter_drops(store, source, root, staging.path("checkpoint"))
        assert report.ok, report.result
    return read_meter_store(spark, root)


def t1_rejected_then_fixed(spark, sf_dir):
    """A drop with unknown facilities is rejected, and imported once they exist: no new file arrives."""
    store, staging = _seeded(spark, "t1-fixed", "serie_type")
    store.commit("facility", a.stored_facilities(spark, sf_dir))
    source, root = _drop(a.meter_drop(spark, sf_dir), staging), staging.path("meter_data")
    (report,) = import_new_meter_drops(store, source, root, staging.path("checkpoint"))
    assert not report.ok
    store.commit("facility", a.facilities(spark, sf_dir))
    (report,) = import_new_meter_drops(store, source, root, staging.path("checkpoint"))
    assert report.ok, report.result
    return read_meter_store(spark, root)


def _months(drop: Callable, condition: str) -> Callable:
    return lambda spark, sf_dir: drop(spark, sf_dir).where(condition)


def t1_incremental_import(spark, sf_dir):
    """The older and the newer readings as two drops."""
    split = f"date_id < DATE'{a.STORED_UNTIL}'"
    drops = [_months(a.meter_drop, split), _months(a.meter_drop, f"NOT ({split})")]
    return _streamed_store(spark, sf_dir, "t1", drops)


def t2_month_correction(spark, sf_dir):
    return _streamed_store(spark, sf_dir, "t2", [a.meter_drop, a.meter_correction])


# --- jobs ------------------------------------------------------------------------------------


def _drop(df: DataFrame, staging: Staging, name: str = "drop") -> str:
    path = staging.path(name)
    df.write.mode("append").parquet(path)
    return path


def _checked(report: JobReport) -> None:
    assert report.ok, report.result


def j1_product_import(spark, sf_dir):
    store, staging = _seeded(spark, "j1")
    store.commit("product", a.stored_products(spark, sf_dir))
    _checked(jobs.import_products(store, _drop(a.product_drop(spark, sf_dir), staging)))
    return store.read("product")


def j2_facility_import(spark, sf_dir):
    store, staging = _seeded(spark, "j2", "facility_type")
    store.commit("facility", a.stored_facilities(spark, sf_dir))
    _checked(jobs.import_facilities(store, _drop(a.facility_drop(spark, sf_dir), staging)))
    return store.read("facility")


def j3_contract_import(spark, sf_dir):
    store, staging = _seeded(spark, "j3", "customer_type")
    store.commit("product", a.products(spark, sf_dir))
    store.commit("facility", a.facilities(spark, sf_dir))
    store.commit("facility_contract", a.stored_contracts(spark, sf_dir))
    _checked(jobs.import_contracts(store, _drop(a.contract_drop(spark, sf_dir), staging)))
    return store.read("facility_contract")


def k9_contract_correction(spark, sf_dir):
    """Older contracts first, then all of them as one more file of the same directory: only the new
    file is imported, and a third run finds none."""
    store, staging = _seeded(spark, "k9", "customer_type")
    store.commit("product", a.products(spark, sf_dir))
    store.commit("facility", a.facilities(spark, sf_dir))
    drop = a.contract_drop(spark, sf_dir)
    older = drop.where(F.col("date_id") < F.lit(a.STORED_UNTIL).cast("date"))
    path = _drop(older.withColumn("fuse_size", F.lit(10)), staging)
    _checked(jobs.import_contracts(store, path))
    _drop(drop, staging)
    _checked(jobs.import_contracts(store, path))
    assert not jobs.import_contracts(store, path).ok
    return store.read("facility_contract")


def j4_meter_import(spark, sf_dir):
    """Two sources that pass and one, with unknown facilities and days inside the month, that does not."""
    store, staging = _seeded(spark, "j4", "serie_type")
    store.commit("facility", a.facilities(spark, sf_dir))
    root, drop = staging.path("meter_data"), staging.write(a.meter_drop(spark, sf_dir))
    paths = {
        source: _drop(drop.where(F.col("serie_type_code") == source), staging, source)
        for source in ("active_energy_cons", "max_active_power_cons")
    }
    paths["active_energy_prod"] = _drop(a.raw_meter_drop(spark, sf_dir), staging, "raw")
    report = jobs.import_meter_data(store, root, paths)
    assert report.ok, report.result
    assert not report.sources["active_energy_prod"].ok
    return read_meter_store(spark, root)


def _mapping(spark, sf_dir, groups: DataFrame) -> tuple[TableStore, JobReport]:
    store, _ = _seeded(spark, "j5", "facility_type", "customer_group_mapping_strategy")
    store.commit("facility", a.facilities(spark, sf_dir))
    store.commit("facility_contract", a.contracts(spark, sf_dir))
    store.commit("facility_customer_group_link", a.stored_links(spark, sf_dir))
    store.commit("customer_group", groups)
    return store, jobs.map_facilities(store, f"{RANGE_FIRST}..{date(1998, 1, 1)}")


def j5_map_facilities(spark, sf_dir):
    """Rules that exclude one another, so that the job does not refuse."""
    store, report = _mapping(spark, sf_dir, a.customer_groups(spark, a.DISJOINT_GROUPS))
    _checked(report)
    return store.read("facility_customer_group_link")


def j5_mapping_refused(spark, sf_dir):
    """Rules that overlap: nothing is stored, and the double links are handed out."""
    store, report = _mapping(spark, sf_dir, a.customer_groups(spark))
    assert not report.ok
    stored = store.read("facility_customer_group_link")
    assert stored.where(F.col("customer_group_id") != 99).isEmpty()
    return report.violations


def flagship(spark, sf_dir):
    """Which customer group does each facility belong to each month, and what is left over?"""
    return _assigned(spark, sf_dir)


# --- tariff costs ----------------------------------------------------------------------------


def _tariff_months(spark, sf_dir):
    span = a.contracts(spark, sf_dir).agg(F.min("date_id"), F.max("date_id")).first()
    return tariffs.tariff_months(a.tariffs(spark, sf_dir), *span)


def x4_tariff_months(spark, sf_dir):
    return _tariff_months(spark, sf_dir)


def _price_sheet(spark, sf_dir):
    return tariffs.price_sheet(
        _tariff_months(spark, sf_dir),
        a.tariff_cost_groups(spark, sf_dir),
        a.cost_group_links(spark, sf_dir),
        a.tariff_components(spark, sf_dir),
        a.component_types(spark),
        seed_table(spark, "calc_strategy"),
        seed_table(spark, "periodize_strategy"),
        seed_table(spark, "serie_type"),
    )


def x3_price_sheet(spark, sf_dir):
    return _price_sheet(spark, sf_dir)


def _priced(spark, sf_dir):
    rules = grouping.prepare_rules(a.customer_groups(spark, a.DISJOINT_GROUPS)).rules
    links = grouping.links_of(grouping.assign_groups(a.contracts_with_type(spark, sf_dir), rules))
    return tariffs.priced_contracts(
        a.contracts(spark, sf_dir), links, a.meter_rows(spark, sf_dir), _price_sheet(spark, sf_dir)
    )


def x6_priced_contracts(spark, sf_dir):
    return _priced(spark, sf_dir).select(
        *tariffs.COMPONENT_KEY, "customer_group_id", "tariff_cost_group_id", "tariff_id"
    )


def x1_calculated_quantity(spark, sf_dir):
    calculated = tariffs.with_quantity(_priced(spark, sf_dir))
    return calculated.select(*tariffs.COMPONENT_KEY, "calc_strategy", "quantity")


def _amounts(spark, sf_dir):
    return tariffs.with_amounts(tariffs.with_quantity(_priced(spark, sf_dir)))


def x2_periodized_cost(spark, sf_dir):
    return _amounts(spark, sf_dir).select(
        *tariffs.COMPONENT_KEY, "periodize_strategy", "amount", "fee_amount"
    )


def x5_monthly_totals(spark, sf_dir):
    return tariffs.monthly_totals(_amounts(spark, sf_dir))


def x6_unavailable_components(spark, sf_dir):
    return tariffs.unavailable_components(
        a.tariff_components(spark, sf_dir),
        a.tariff_cost_groups(spark, sf_dir),
        a.component_type_links(spark, sf_dir),
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        s1_parquet_scan,
        s3_typed_scan,
        s4_facility_keys,
        s4_product_keys,
        s5_contract_keys_between,
        s6_contracts_extended,
        s6_contracts_extended_open,
        s8_links_between,
        s9_meter_store_read,
        k1_meter_partition_overwrite,
        k2_insert_rows,
        k3_update_by_key,
        k6_assigned_ids,
        k7_contract_upsert,
        u1_union_of_strategies,
        p3_cast_present,
        p5_insert_flag,
        a1_duplicates_over_all_columns,
        a2_import_interval,
        a3_drop_profile,
        v2_missing_values,
        v3_duplicate_rows,
        v3_duplicate_rows_without_nulls,
        v4_not_at_start_of_month,
        v5_product_drop_report,
        v6_facility_drop_report,
        v7_contract_drop_report,
        v8_meter_drop_report,
        v9_invalid_facility_type,
        v10_invalid_customer_type,
        v10_unknown_ean,
        v11_unresolved_meter_rows,
        v11_unresolved_meter_row_count,
        v13_unmapped_contracts,
        v14_duplicate_links,
        d1_product_resolution,
        d2_facility_resolution,
        d3_contract_resolution,
        d4_meter_resolution,
        d6_contracts_without_link,
        d7_many_rules,
        m1_product_insert,
        m1_product_update,
        m2_facility_insert,
        m2_facility_update,
        m3_contract_insert,
        m3_contract_update,
        m4_serie_values,
        m10_map_all,
        m11_link_insert,
        m11_link_update,
        m12_interval_months,
        m12_interval_timestamps,
        c1_unique_violations,
        c1_conflicts_with_stored,
        c2_foreign_key_violations,
        c3_c4_table_violations,
        t1_incremental_import,
        t1_rejected_then_fixed,
        t2_month_correction,
        j1_product_import,
        j2_facility_import,
        j3_contract_import,
        j4_meter_import,
        j5_map_facilities,
        j5_mapping_refused,
        k9_contract_correction,
        x1_calculated_quantity,
        x2_periodized_cost,
        x3_price_sheet,
        x4_tariff_months,
        x5_monthly_totals,
        x6_priced_contracts,
        x6_unavailable_components,
    )
} | {
    "m6_map_by_product": _by_strategy("product"),
    "m8_map_by_fuse_size": _by_strategy("fuse_size"),
    "m8_map_by_subscribed_power": _by_strategy("subscribed_power"),
    "m8_map_by_connection_power": _by_strategy("connection_power"),
}
