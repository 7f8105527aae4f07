"""Domain tables as projections of customer, part, orders, lineitem and events.

Customers are facilities, orders are contracts (one per customer and month once cleaned), lineitems
and events are meter readings. The raw drops carry unknown codes, nulls, repeated keys and dates
inside the month, so every check has something to find. ``oracles.py`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltledger.schemas import CUSTOMER_GROUP, STRING, TARIFF_COMPONENT_TYPE, struct
from voltledger.seeds import local_table

EAN_BASE = 123456000000000000
EAN_PROD_BASE = 123456789000000000
UNKNOWN_EAN_SHIFT = 900000000
PRODUCT_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
FUSE_SIZES = (16, 20, 25, 35, 50, 63, 80, 125)

# What was stored before the drop arrives: all contracts and links up to a month, facilities of some
# market segments, products up to a size.
STORED_UNTIL = "1997-01-01"
STORED_SEGMENTS = ("BUILDING", "FURNITURE", "MACHINERY")
STORED_MAX_SIZE = 20
# The month whose readings arrive again with other values.
CORRECTED_FROM, CORRECTED_TO = "1996-03-01", "1996-06-01"

# id, code, min/max fuse, min/max subscribed, min/max connection, bounds included, facility type,
# customer type, product, not product, strategy id, strategy code
CUSTOMER_GROUPS = (
    (1, "economy", None, None, None, None, None, None, True, True, 1, None, 1, None, 4, "product"),
    (2, "16_A", 16, 16, None, None, None, None, True, True, 1, None, None, 1, 1, "fuse_size"),
    (3, "20_A", 20, 20, None, None, None, None, True, True, 1, None, None, None, 1, "fuse_size"),
    (4, "25_A", 25, 25, None, None, None, None, True, True, 1, None, None, None, 1, "fuse_size"),
    (5, "35_A", 35, 35, None, None, None, None, True, True, 1, None, None, 1, 1, "fuse_size"),
    (6, "50_A_63_A", 50, 63, None, None, None, None, True, False, 1, None, None, None, 1, "fuse_size"),
    (7, "63_A", 50, 63, None, None, None, None, False, True, 1, 2, None, None, 1, "fuse_size"),
    (8, "80_A_125_A", 80, 125, None, None, None, None, True, False, 1, None, None, 3, 1, "fuse_size"),
    (9, "ge_125_A", 125, None, None, None, None, None, True, True, 1, None, None, None, 1, "fuse_size"),
    (10, "80_300_kW", None, None, 80.0, 300.0, None, None, True, True, 1, 2, None, None, 2, "subscribed_power"),
    (11, "300_500_kW", None, None, 300.0, 500.0, None, None, False, True, 1, None, None, None, 2, "subscribed_power"),
    (12, "500_1000_kW", None, None, 500.0, 1000.0, None, None, False, True, 1, None, None, None, 2, "subscribed_power"),
    (13, "gt_1000_kW", None, None, 1000.0, None, None, None, False, True, 1, 1, None, None, 2, "subscribed_power"),
    (14, "production_lt_1000_kW", None, None, None, None, 0.0, 1000.0, True, False, 2, None, None, None, 3, "connection_power"),
    (15, "production_ge_1000_kW", None, None, None, None, 1000.0, None, True, True, 2, None, None, None, 3, "connection_power"),
    (16, "production_promo", None, None, None, None, None, None, True, True, 2, None, 4, None, 4, "product"),
    (17, "no_product", None, None, None, None, None, None, True, True, 1, None, None, None, 4, "product"),
    (18, "no_minimum", None, 100, None, None, None, None, True, True, 1, None, None, None, 1, "fuse_size"),
)
# A rule table whose conditions exclude one another; two rules lack a parameter. A contract has either a
# fuse or a subscribed power.
DISJOINT_GROUPS = (
    (1, "economy", None, None, None, None, None, None, True, True, 1, None, 1, None, 4, "product"),
    (2, "16_A", 16, 16, None, None, None, None, True, True, 1, None, None, 1, 1, "fuse_size"),
    (3, "20_A_25_A", 20, 25, None, None, None, None, True, True, 1, None, None, 1, 1, "fuse_size"),
    (4, "35_A", 25, 35, None, None, None, None, False, True, 1, None, None, 1, 1, "fuse_size"),
    (5, "50_A", 50, 63, None, None, None, None, True, False, 1, None, None, 1, 1, "fuse_size"),
    (6, "63_A_private", 63, 80, None, None, None, None, True, False, 1, 1, None, 1, 1, "fuse_size"),
    (7, "63_A_company", 50, 63, None, None, None, None, False, True, 1, 2, None, 1, 1, "fuse_size"),
    (8, "80_A", 63, 125, None, None, None, None, False, False, 1, None, None, 1, 1, "fuse_size"),
    (9, "ge_125_A", 125, None, None, None, None, None, True, True, 1, None, None, 1, 1, "fuse_size"),
    (10, "80_300_kW", None, None, 80.0, 300.0, None, None, True, True, 1, None, None, 1, 2, "subscribed_power"),
    (11, "300_1000_kW", None, None, 300.0, 1000.0, None, None, False, False, 1, None, None, 1, 2, "subscribed_power"),
    (12, "ge_1000_kW", None, None, 1000.0, None, None, None, True, True, 1, None, None, 1, 2, "subscribed_power"),
    (13, "production_lt_1000_kW", None, None, None, None, 0.0, 1000.0, True, False, 2, None, None, 4, 3, "connection_power"),
    (14, "production_ge_1000_kW", None, None, None, None, 1000.0, None, True, True, 2, None, None, 4, 3, "connection_power"),
    (15, "production_promo", None, None, None, None, None, None, True, True, 2, None, 4, None, 4, "product"),
    (16, "no_product", None, None, None, None, None, None, True, True, 1, None, None, None, 4, "product"),
    (17, "no_minimum", None, 100, None, None, None, None, True, True, 1, None, None, None, 1, "fuse_size"),
)
# name, calculation strategy, periodize strategy, serie type, comparison serie type (all by id), revenue
COMPONENT_TYPES = (
    ("fixed fee", 1, 2, None, None, True),
    ("energy", 2, 1, 1, None, True),
    ("subscribed power", 3, 3, None, None, True),
    ("connection power", 4, 2, None, None, True),
    ("beyond subscribed power", 5, 1, 13, None, True),
    ("beyond connection power", 6, 3, 13, None, True),
    ("energy beyond peaks", 7, 1, 1, 13, True),
    ("compensation", 2, 3, 13, None, False),
    ("yearly fee", 1, 3, None, None, True),
    ("discount", 1, 1, None, None, False),
    ("reactive energy", 2, 1, 3, None, True),
)
GROUP_COLUMNS = (
    "customer_group_id",
    "code",
    "min_fuse_size",
    "max_fuse_size",
    "min_subscribed_power",
    "max_subscribed_power",
    "min_connection_power",
    "max_connection_power",
    "min_bound_included",
    "max_bound_included",
    "facility_type_id",
    "customer_type_id",
    "product_id",
    "not_product_id",
    "mapping_strategy_id",
    "mapping_strategy_code",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_groups(spark: SparkSession, groups: tuple[tuple, ...] = CUSTOMER_GROUPS) -> DataFrame:
    """The rule table with strategy codes; the name repeats the code."""
    rows = [dict(zip(GROUP_COLUMNS, values, strict=True)) for values in groups]
    rows = [{**row, "name": row["code"]} for row in rows]
    columns = {f.name: f.dataType for f in CUSTOMER_GROUP.schema.fields}
    return local_table(spark, rows, struct(**columns, mapping_strategy_code=STRING))


# A rule per part: by product, or by an interval of subscribed power (consumption) or connection power.
PART_GROUP_VALUES = (
    "CASE WHEN p_partkey % 97 = 0 THEN 'product' WHEN p_partkey % 2 = 0 THEN 'subscribed_power'"
    " ELSE 'connection_power' END AS mapping_strategy_code",
    "p_partkey * 37 % 1500 + p_size / 8 AS lower",
    "CASE WHEN p_partkey % 501 > 0 THEN p_partkey * 37 % 1500 + p_size / 2 END AS upper",
    "p_partkey % 3 = 0 AS min_bound_included",
    "p_partkey % 5 < 3 AS max_bound_included",
    "CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS facility_type_id",
    "CASE WHEN p_partkey % 11 < 4 THEN p_partkey % 11 % 2 + 1 END AS customer_type_id",
    "CASE WHEN p_partkey % 97 = 0 OR p_partkey % 7 < 2 THEN p_size % 6 + 1 END AS product_id",
    "CASE WHEN p_partkey % 13 = 1 THEN 2 END AS not_product_id",
)


def part_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many customer groups as parts, with narrow intervals and some without an end."""
    values = table(spark, sf_dir, "part").selectExpr("p_partkey + 1 AS customer_group_id", *PART_GROUP_VALUES)
    bounds = [
        f"CASE WHEN mapping_strategy_code = '{name}' THEN {side} END AS {bound}_{name}"
        for name in ("fuse_size", "subscribed_power", "connection_power")
        for bound, side in (("min", "lower"), ("max", "upper"))
    ]
    return values.selectExpr("*", *bounds)


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey + 1 AS facility_id",
        f"{EAN_BASE} + c_custkey AS ean",
        f"CASE WHEN c_custkey % 7 = 0 THEN {EAN_PROD_BASE} + c_custkey END AS ean_prod",
        "CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS facility_type_id",
        "c_name AS name",
        "c_mktsegment AS description",
    )


def stored_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facilities of the older market segments, with what the drop is going to change."""
    return (
        facilities(spark, sf_dir)
        .where(F.col("description").isin(*STORED_SEGMENTS))
        .withColumn("ean_prod", F.lit(123).cast("long"))
        .withColumn("name", F.concat(F.lit("old "), F.col("name")))
    )


def facility_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities(spark, sf_dir).selectExpr(
        "ean",
        "ean_prod",
        "CASE WHEN facility_type_id = 2 THEN 'production' ELSE 'consumption' END"
        " AS facility_type_code",
        "name",
        "description",
    )


def raw_facility_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and unknown codes in the type, repeated EAN codes on both sides."""
    return table(spark, sf_dir, "customer").selectExpr(
        f"CASE WHEN c_custkey % 40 = 1 THEN {EAN_BASE} + c_custkey - 1"
        f" WHEN c_custkey % 43 = 2 THEN NULL ELSE {EAN_BASE} + c_custkey END AS ean",
        "CASE WHEN c_custkey % 7 = 0"
        f" THEN {EAN_PROD_BASE} + c_custkey - c_custkey % 14 END AS ean_prod",
        "CASE WHEN c_custkey % 61 = 3 THEN 'storage' WHEN c_custkey % 67 = 4 THEN NULL"
        " WHEN c_custkey % 5 = 0 THEN 'production' ELSE 'consumption' END AS facility_type_code",
        "c_name AS name",
        "c_mktsegment AS description",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per part type, numbered in the order of the types."""
    types = ", ".join(f"'{t}'" for t in PRODUCT_TYPES)
    return (
        table(spark, sf_dir, "part")
        .select("p_type")
        .distinct()
        .selectExpr(
            f"CAST(array_position(array({types}), p_type) AS INT) AS product_id",
            "p_type AS external_id",
            "concat('Product ', p_type) AS name",
        )
    )


def product_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per part."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('P', p_partkey) AS external_id",
        "concat(p_name, ' ', p_partkey) AS name",
        "concat(p_type, ' ', p_size) AS description",
    )


def stored_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .where(F.col("p_size") <= STORED_MAX_SIZE)
        .selectExpr(
            "CAST(p_partkey + 1 AS INT) AS product_id",
            "concat('P', p_partkey) AS external_id",
            "concat('old ', p_name, ' ', p_partkey) AS name",
            "p_brand AS description",
        )
    )


def raw_product_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE concat(p_brand, '-', p_size) END"
        " AS external_id",
        "CASE WHEN p_partkey % 89 = 0 THEN NULL ELSE concat(p_name, ' ', p_type) END AS name",
        "p_brand AS description",
    )


def _contract_values() -> list[str]:
    """What a contract derives from its order: o_orderkey, o_custkey and o_totalprice."""
    fuse = " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(FUSE_SIZES))
    types = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(PRODUCT_TYPES))
    return [
        f"CASE o_orderkey % 9 {fuse} END AS fuse_size",
        "CASE WHEN o_orderkey % 9 = 8 THEN o_totalprice / 300 END AS subscribed_power",
        "CASE WHEN o_custkey % 5 = 0 THEN o_totalprice / 250 END AS connection_power",
        "CAST(1000 + (o_orderkey % 5) * 111 AS INT) AS account_nr",
        f"CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'LEGACY'"
        f" ELSE CASE o_orderkey % 6 {types} END END AS ext_product_id",
    ]


def _first_order_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and month: the order with the smallest key. ``min_by`` aggregates before
    the shuffle, a window would not."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            "o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date_id")
        )
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("o_totalprice"),
            F.min("o_orderkey").alias("o_orderkey"),
        )
    )


def contract_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valid drop: one contract per facility and month."""
    return _first_order_of_month(spark, sf_dir).selectExpr(
        f"{EAN_BASE} + o_custkey AS ean",
        "date_id",
        "CASE WHEN o_custkey % 4 = 0 THEN 'company' ELSE 'private_person' END"
        " AS customer_type_code",
        *_contract_values(),
    )


def raw_contract_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a contract: days inside the month, nulls, unknown codes, repeated keys."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 101 = 0"
        f" THEN {EAN_BASE + UNKNOWN_EAN_SHIFT} + o_custkey ELSE {EAN_BASE} + o_custkey END AS ean",
        "CASE WHEN o_orderkey % 107 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date_id",
        "CASE WHEN o_orderkey % 97 = 0 THEN 'municipality' WHEN o_orderkey % 89 = 0 THEN NULL"
        " WHEN o_custkey % 4 = 0 THEN 'company' ELSE 'private_person' END AS customer_type_code",
        *_contract_values(),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract table that the valid drop leads to."""
    types = ", ".join(f"'{t}'" for t in PRODUCT_TYPES)
    return contract_drop(spark, sf_dir).selectExpr(
        f"ean - {EAN_BASE} + 1 AS facility_id",
        "date_id",
        "fuse_size",
        "subscribed_power",
        "connection_power",
        "account_nr",
        "CASE WHEN customer_type_code = 'company' THEN 2 ELSE 1 END AS customer_type_id",
        f"CAST(nullif(array_position(array({types}), ext_product_id), 0) AS INT) AS product_id",
    )


def stored_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts of the older months, with other values in the columns the drop changes."""
    return (
        contracts(spark, sf_dir)
        .where(F.col("date_id") < F.lit(STORED_UNTIL).cast("date"))
        .withColumn("fuse_size", F.lit(10))
        .withColumn("product_id", F.lit(6))
    )


def contracts_with_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with the facility type, which follows from the facility id."""
    return contracts(spark, sf_dir).withColumn(
        "facility_type_id", F.when(F.col("facility_id") % 5 == 1, 2).otherwise(1)
    )


def stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        contracts(spark, sf_dir)
        .where(F.col("date_id") < F.lit(STORED_UNTIL).cast("date"))
        .select("facility_id", "date_id", F.lit(99).alias("customer_group_id"))
    )


def raw_meter_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem as a reading of the facility with the number of its part. There are more parts
    than customers, return flag R is no serie type, and dates lie inside the month."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CASE l_returnflag WHEN 'A' THEN 'active_energy_cons' WHEN 'N' THEN 'active_energy_prod'"
        " ELSE 'gas_volume' END AS serie_type_code",
        f"CASE WHEN l_orderkey % 113 = 0 THEN NULL ELSE {EAN_BASE} + l_partkey END AS ean",
        "CAST(l_shipdate AS DATE) AS date_id",
        "CASE WHEN l_orderkey % 127 = 0 THEN NULL ELSE l_extendedprice / 8 END AS serie_value",
        "l_linestatus AS status_id",
    )


def event_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a reading of the facility with the number of its user."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('events_', event_type) AS serie_type_code",
        f"{EAN_BASE} + user_id AS ean",
        "CAST(ts AS DATE) AS date_id",
    )


def meter_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valid drop: per customer and month of shipping, the sum and the maximum of the quantities.

    Orders are two numbers each and hashed where the shuffle puts them: lineitems need no sort."""
    readings = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("shuffle_hash"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    quantity = F.col("l_quantity").cast("decimal(18,3)")
    monthly = readings.groupBy(
        "o_custkey", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date_id")
    ).agg(
        F.sum(quantity).cast("double").alias("active_energy_cons"),
        F.max(quantity).cast("double").alias("max_active_power_cons"),
    )
    return (
        monthly.unpivot(
            ["o_custkey", "date_id"],
            ["active_energy_cons", "max_active_power_cons"],
            "serie_type_code",
            "serie_value",
        )
        .selectExpr(
            "serie_type_code",
            f"{EAN_BASE} + o_custkey AS ean",
            "date_id",
            "serie_value",
            "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'ok' END AS status_id",
        )
    )


def meter_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active energy of some months once more, only for facilities that used a lot."""
    return (
        meter_drop(spark, sf_dir)
        .where(F.col("serie_type_code") == "active_energy_cons")
        .where(F.col("date_id") >= F.lit(CORRECTED_FROM).cast("date"))
        .where(F.col("date_id") < F.lit(CORRECTED_TO).cast("date"))
        .where(F.col("serie_value") > 30)
        .withColumn("serie_value", F.col("serie_value") + 0.5)
        .withColumn("status_id", F.lit("corrected"))
    )


def tariffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per region: the first has no start, the last no end, others begin inside a month."""
    return table(spark, sf_dir, "region").selectExpr(
        "CAST(r_regionkey + 1 AS INT) AS tariff_id",
        "r_name AS name",
        "1 AS currency_id",
        "CASE WHEN r_regionkey > 0 THEN make_date(CAST(1992 + r_regionkey AS INT), 3,"
        " CAST(1 + 7 * (r_regionkey - 1) AS INT)) END AS validity_start",
        "CASE WHEN r_regionkey < 4 THEN make_date(CAST(1995 + r_regionkey AS INT), 8,"
        " CAST(1 + 9 * r_regionkey AS INT)) END AS validity_end",
    )


def tariff_cost_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per nation, in the tariff of its region."""
    return table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey + 1 AS INT) AS tariff_cost_group_id",
        "CAST(n_regionkey + 1 AS INT) AS tariff_id",
        "n_name AS name",
    )


def cost_group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cost group prices three customer groups, each customer group several cost groups."""
    groups = ("n_nationkey % 17", "(n_nationkey * 3 + 5) % 17", "(n_nationkey * 5 + 11) % 17")
    return table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey + 1 AS INT) AS tariff_cost_group_id",
        f"explode(array_distinct(array({', '.join(f'CAST({g} + 1 AS INT)' for g in groups)})))"
        " AS customer_group_id",
    )


def component_types(spark: SparkSession) -> DataFrame:
    names = ("name", "calc_strategy_id", "periodize_strategy_id", "serie_type_id", "comparison_serie_type_id",
             "is_revenue")
    rows = [
        {"tariff_component_type_id": i, "unit_id": 1, **dict(zip(names, row, strict=True))}
        for i, row in enumerate(COMPONENT_TYPES, start=1)
    ]
    return local_table(spark, rows, TARIFF_COMPONENT_TYPE.schema)


def tariff_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced like parts: part n is the component of type n % 11 in the cost group n div 11. Validity months
    follow from the size, half of them wrap."""
    n = len(COMPONENT_TYPES)
    return table(spark, sf_dir, "part").where(f"p_partkey < 25 * {n}").selectExpr(
        "CAST(p_partkey + 1 AS INT) AS tariff_component_id",
        f"CAST(p_partkey % {n} + 1 AS INT) AS tariff_component_type_id",
        f"CAST(p_partkey div {n} + 1 AS INT) AS tariff_cost_group_id",
        "CAST(p_retailprice / 7 AS DECIMAL(20,6)) AS price",
        "CAST(p_retailprice / 70 AS DECIMAL(20,6)) AS authority_fee",
        "CAST(CASE WHEN p_partkey % 4 > 0 THEN p_retailprice / 9 END AS DECIMAL(20,6)) AS price_outside_validity",
        "CAST(CASE WHEN p_partkey % 4 > 1 THEN p_retailprice / 90 END AS DECIMAL(20,6))"
        " AS authority_fee_outside_validity",
        "CAST(CASE WHEN p_partkey % 3 > 0 THEN 0.05 * (p_partkey % 3) END AS DECIMAL(9,6)) AS overshoot_limit",
        "CAST(p_size % 12 + 1 AS INT) AS validity_start",
        "CAST(p_size * 5 % 12 + 1 AS INT) AS validity_end",
    )


def component_type_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tariffs offer all component types but one each."""
    kinds = ", ".join(str(i) for i in range(1, len(COMPONENT_TYPES) + 1))
    return (
        tariffs(spark, sf_dir)
        .selectExpr("tariff_id", f"explode(array({kinds})) AS tariff_component_type_id")
        .where("tariff_component_type_id != 2 * tariff_id")
    )


def meter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meter store that the valid drop leads to."""
    return meter_drop(spark, sf_dir).selectExpr(
        f"ean - {EAN_BASE} + 1 AS facility_id",
        "date_id",
        "serie_type_code",
        "CAST(serie_value AS DECIMAL(18,3)) AS serie_value",
    )
