"""The registered queries in SQL, over views named like the benchmark tables."""

from __future__ import annotations

from voltledger.demo import adapters as a
from voltledger.demo.queries import RANGE_FIRST, RANGE_LAST
from voltledger.seeds import (
    CALC_STRATEGIES,
    CUSTOMER_TYPES,
    FACILITY_TYPES,
    PERIODIZE_STRATEGIES,
    SERIE_TYPES,
)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"'{value}'" if isinstance(value, str) else str(value)


def _values(rows) -> str:
    return ", ".join(f"({', '.join(_literal(v) for v in row)})" for row in rows)


def _code_table(codes, id_col: str) -> str:
    rows = _values((i, row[0]) for i, row in enumerate(codes, start=1))
    return f"SELECT * FROM (VALUES {rows}) AS t({id_col}, code)"


_FUSE = " ".join(f"WHEN {i} THEN {size}" for i, size in enumerate(a.FUSE_SIZES))
_TYPES = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(a.PRODUCT_TYPES))
_TYPE_IDS = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(a.PRODUCT_TYPES, start=1))

_CONTRACT_VALUES = f"""
    CASE o_orderkey % 9 {_FUSE} END AS fuse_size,
    CASE WHEN o_orderkey % 9 = 8 THEN o_totalprice / 300 END AS subscribed_power,
    CASE WHEN o_custkey % 5 = 0 THEN o_totalprice / 250 END AS connection_power,
    CAST(1000 + (o_orderkey % 5) * 111 AS INTEGER) AS account_nr,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'LEGACY'
         ELSE CASE o_orderkey % 6 {_TYPES} END END AS ext_product_id"""

# Domain tables by name; a table may use those above it.
_TABLES = {
    "facility_type": _code_table(FACILITY_TYPES, "facility_type_id"),
    "customer_type": _code_table(CUSTOMER_TYPES, "customer_type_id"),
    "serie_type": _code_table(SERIE_TYPES, "serie_type_id"),
    "customer_group": f"""
        SELECT * FROM (VALUES {_values(a.CUSTOMER_GROUPS)}) AS t({', '.join(a.GROUP_COLUMNS)})""",
    "disjoint_group": f"""
        SELECT * FROM (VALUES {_values(a.DISJOINT_GROUPS)}) AS t({', '.join(a.GROUP_COLUMNS)})""",
    "facility": f"""
        SELECT c_custkey + 1 AS facility_id, {a.EAN_BASE} + c_custkey AS ean,
               CASE WHEN c_custkey % 7 = 0 THEN {a.EAN_PROD_BASE} + c_custkey END AS ean_prod,
               CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS facility_type_id,
               c_name AS name, c_mktsegment AS description
        FROM customer""",
    "stored_facility": f"""
        SELECT facility_id, ean, CAST(123 AS BIGINT) AS ean_prod, facility_type_id,
               'old ' || name AS name, description
        FROM facility WHERE description IN {a.STORED_SEGMENTS}""",
    "facility_drop": """
        SELECT ean, ean_prod,
               CASE WHEN facility_type_id = 2 THEN 'production' ELSE 'consumption' END
                   AS facility_type_code,
               name, description
        FROM facility""",
    "raw_facility_drop": f"""
        SELECT CASE WHEN c_custkey % 40 = 1 THEN {a.EAN_BASE} + c_custkey - 1
                    WHEN c_custkey % 43 = 2 THEN NULL ELSE {a.EAN_BASE} + c_custkey END AS ean,
               CASE WHEN c_custkey % 7 = 0
                    THEN {a.EAN_PROD_BASE} + c_custkey - c_custkey % 14 END AS ean_prod,
               CASE WHEN c_custkey % 61 = 3 THEN 'storage' WHEN c_custkey % 67 = 4 THEN NULL
                    WHEN c_custkey % 5 = 0 THEN 'production' ELSE 'consumption' END
                   AS facility_type_code,
               c_name AS name, c_mktsegment AS description
        FROM customer""",
    "product": f"""
        SELECT DISTINCT CASE p_type {_TYPE_IDS} END AS product_id, p_type AS external_id
        FROM part""",
    "product_drop": """
        SELECT 'P' || p_partkey AS external_id, p_name || ' ' || p_partkey AS name,
               p_type || ' ' || p_size AS description
        FROM part""",
    "stored_product": f"""
        SELECT CAST(p_partkey + 1 AS INTEGER) AS product_id, 'P' || p_partkey AS external_id,
               'old ' || p_name || ' ' || p_partkey AS name, p_brand AS description
        FROM part WHERE p_size <= {a.STORED_MAX_SIZE}""",
    "raw_product_drop": """
        SELECT CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_brand || '-' || p_size END
                   AS external_id,
               CASE WHEN p_partkey % 89 = 0 THEN NULL ELSE p_name || ' ' || p_type END AS name
        FROM part""",
    "first_order": """
        SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS date_id,
               o_orderkey, o_totalprice
        FROM orders
        QUALIFY row_number() OVER (
            PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderkey) = 1""",
    "contract_drop": f"""
        SELECT {a.EAN_BASE} + o_custkey AS ean, date_id,
               CASE WHEN o_custkey % 4 = 0 THEN 'company' ELSE 'private_person' END
                   AS customer_type_code,
               {_CONTRACT_VALUES}
        FROM first_order""",
    "raw_contract_drop": f"""
        SELECT CASE WHEN o_orderkey % 103 = 0 THEN NULL
                    WHEN o_orderkey % 101 = 0
                    THEN {a.EAN_BASE + a.UNKNOWN_EAN_SHIFT} + o_custkey
                    ELSE {a.EAN_BASE} + o_custkey END AS ean,
               CASE WHEN o_orderkey % 107 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) END AS date_id,
               CASE WHEN o_orderkey % 97 = 0 THEN 'municipality'
                    WHEN o_orderkey % 89 = 0 THEN NULL
                    WHEN o_custkey % 4 = 0 THEN 'company' ELSE 'private_person' END
                   AS customer_type_code,
               {_CONTRACT_VALUES}
        FROM orders""",
    "contract": f"""
        SELECT ean - {a.EAN_BASE} + 1 AS facility_id, date_id, fuse_size, subscribed_power,
               connection_power, account_nr,
               CASE WHEN customer_type_code = 'company' THEN 2 ELSE 1 END AS customer_type_id,
               CASE ext_product_id {_TYPE_IDS} END AS product_id,
               CASE WHEN (ean - {a.EAN_BASE}) % 5 = 0 THEN 2 ELSE 1 END AS facility_type_id
        FROM contract_drop""",
    "stored_contract": f"""
        SELECT * REPLACE (10 AS fuse_size, 6 AS product_id) FROM contract
        WHERE date_id < DATE '{a.STORED_UNTIL}'""",
    "stored_link": f"""
        SELECT facility_id, date_id, 99 AS customer_group_id FROM contract
        WHERE date_id < DATE '{a.STORED_UNTIL}'""",
    "resolved_contract": """
        SELECT f.facility_id, CAST(ct.customer_type_id AS SMALLINT) AS customer_type_id,
               p.product_id,
               s.facility_id IS NULL AND s.date_id IS NULL AS to_insert, i.*
        FROM contract_drop i
        LEFT JOIN facility f ON f.ean = i.ean
        LEFT JOIN customer_type ct ON ct.code = i.customer_type_code
        LEFT JOIN product p ON p.external_id = i.ext_product_id
        LEFT JOIN stored_contract s ON s.facility_id = f.facility_id AND s.date_id = i.date_id""",
    "raw_resolved_contract": """
        SELECT f.facility_id, CAST(ct.customer_type_id AS SMALLINT) AS customer_type_id,
               p.product_id,
               s.facility_id IS NULL AND s.date_id IS NULL AS to_insert, i.*
        FROM raw_contract_drop i
        LEFT JOIN facility f ON f.ean = i.ean
        LEFT JOIN customer_type ct ON ct.code = i.customer_type_code
        LEFT JOIN product p ON p.external_id = i.ext_product_id
        LEFT JOIN stored_contract s ON s.facility_id = f.facility_id AND s.date_id = i.date_id""",
    "raw_resolved_facility": """
        SELECT s.facility_id, CAST(ft.facility_type_id AS TINYINT) AS facility_type_id, i.*
        FROM raw_facility_drop i
        LEFT JOIN stored_facility s ON s.ean = i.ean
        LEFT JOIN facility_type ft ON ft.code = i.facility_type_code""",
    "resolved_facility": """
        SELECT s.facility_id, CAST(ft.facility_type_id AS TINYINT) AS facility_type_id, i.*
        FROM facility_drop i
        LEFT JOIN stored_facility s ON s.ean = i.ean
        LEFT JOIN facility_type ft ON ft.code = i.facility_type_code""",
    "raw_meter_drop": f"""
        SELECT CASE l_returnflag WHEN 'A' THEN 'active_energy_cons'
                    WHEN 'N' THEN 'active_energy_prod' ELSE 'gas_volume' END AS serie_type_code,
               CASE WHEN l_orderkey % 113 = 0 THEN NULL ELSE {a.EAN_BASE} + l_partkey END AS ean,
               CAST(l_shipdate AS DATE) AS date_id,
               CASE WHEN l_orderkey % 127 = 0 THEN NULL ELSE l_extendedprice / 8 END
                   AS serie_value,
               l_linestatus AS status_id
        FROM lineitem""",
    "resolved_meter": """
        SELECT f.facility_id, st.serie_type_id, i.serie_type_code, i.ean, i.date_id,
               CAST(i.serie_value AS DECIMAL(18,3)) AS serie_value, i.status_id
        FROM raw_meter_drop i
        LEFT JOIN facility f ON f.ean = i.ean
        LEFT JOIN serie_type st ON st.code = i.serie_type_code""",
    "monthly": """
        SELECT o_custkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date_id,
               sum(CAST(l_quantity AS DECIMAL(18,3))) AS total,
               max(CAST(l_quantity AS DECIMAL(18,3))) AS highest
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "meter": f"""
        SELECT o_custkey + 1 AS facility_id, {a.EAN_BASE} + o_custkey AS ean,
               CAST(serie_value AS DECIMAL(18,3)) AS serie_value,
               CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'ok' END AS status_id,
               serie_type_code, date_id
        FROM (
            SELECT o_custkey, date_id, total AS serie_value,
                   'active_energy_cons' AS serie_type_code FROM monthly
            UNION ALL
            SELECT o_custkey, date_id, highest, 'max_active_power_cons' FROM monthly
        )""",
    "correction": f"""
        SELECT * REPLACE (CAST(serie_value + 0.5 AS DECIMAL(18,3)) AS serie_value,
                          'corrected' AS status_id)
        FROM meter
        WHERE serie_type_code = 'active_energy_cons' AND serie_value > 30
          AND date_id >= DATE '{a.CORRECTED_FROM}' AND date_id < DATE '{a.CORRECTED_TO}'""",
    "assigned": """
        SELECT c.*, g.customer_group_id
        FROM contract c
        LEFT JOIN customer_group g
          ON g.facility_type_id = c.facility_type_id
         AND (g.customer_type_id IS NULL OR c.customer_type_id = g.customer_type_id)
         AND (g.product_id IS NULL OR c.product_id = g.product_id)
         AND (g.not_product_id IS NULL OR c.product_id != g.not_product_id)
         AND CASE g.mapping_strategy_code
             WHEN 'product' THEN g.product_id IS NOT NULL
             WHEN 'fuse_size' THEN
                 CASE WHEN g.min_bound_included THEN c.fuse_size >= g.min_fuse_size
                      ELSE c.fuse_size > g.min_fuse_size END
                 AND (g.max_fuse_size IS NULL OR
                      CASE WHEN g.max_bound_included THEN c.fuse_size <= g.max_fuse_size
                           ELSE c.fuse_size < g.max_fuse_size END)
             WHEN 'subscribed_power' THEN
                 CASE WHEN g.min_bound_included THEN c.subscribed_power >= g.min_subscribed_power
                      ELSE c.subscribed_power > g.min_subscribed_power END
                 AND (g.max_subscribed_power IS NULL OR
                      CASE WHEN g.max_bound_included
                           THEN c.subscribed_power <= g.max_subscribed_power
                           ELSE c.subscribed_power < g.max_subscribed_power END)
             WHEN 'connection_power' THEN
                 CASE WHEN g.min_bound_included THEN c.connection_power >= g.min_connection_power
                      ELSE c.connection_power > g.min_connection_power END
                 AND (g.max_connection_power IS NULL OR
                      CASE WHEN g.max_bound_included
                           THEN c.connection_power <= g.max_connection_power
                           ELSE c.connection_power < g.max_connection_power END)
             END""",
}
_TABLES["disjointly_assigned"] = _TABLES["assigned"].replace("customer_group g", "disjoint_group g")
_TABLES["part_group"] = f"""
    SELECT *, lower AS min_subscribed_power, upper AS max_subscribed_power, lower AS min_connection_power,
           upper AS max_connection_power, lower AS min_fuse_size, upper AS max_fuse_size
    FROM (SELECT CAST(p_partkey + 1 AS BIGINT) AS customer_group_id, {', '.join(a.PART_GROUP_VALUES)} FROM part)"""
_TABLES["assigned_by_part"] = _TABLES["assigned"].replace("customer_group g", "part_group g")
_KINDS = len(a.COMPONENT_TYPES)
_TABLES |= {
    "calc_strategy": _code_table(CALC_STRATEGIES, "calc_strategy_id"),
    "periodize_strategy": _code_table(PERIODIZE_STRATEGIES, "periodize_strategy_id"),
    "tariff": """
        SELECT CAST(r_regionkey + 1 AS INTEGER) AS tariff_id,
               CASE WHEN r_regionkey > 0
                    THEN make_date(1992 + r_regionkey, 3, 1 + 7 * (r_regionkey - 1)) END AS validity_start,
               CASE WHEN r_regionkey < 4
                    THEN make_date(1995 + r_regionkey, 8, 1 + 9 * r_regionkey) END AS validity_end
        FROM region""",
    "cost_group": """
        SELECT CAST(n_nationkey + 1 AS INTEGER) AS tariff_cost_group_id,
               CAST(n_regionkey + 1 AS INTEGER) AS tariff_id
        FROM nation""",
    "cost_group_link": """
        SELECT DISTINCT CAST(n_nationkey + 1 AS INTEGER) AS tariff_cost_group_id,
               CAST(unnest([n_nationkey % 17, (n_nationkey * 3 + 5) % 17, (n_nationkey * 5 + 11) % 17]) + 1
                    AS INTEGER) AS customer_group_id
        FROM nation""",
    "component_type": f"""
        SELECT * FROM (VALUES {_values((i, *row) for i, row in enumerate(a.COMPONENT_TYPES, start=1))})
            AS t(tariff_component_type_id, name, calc_strategy_id, periodize_strategy_id, serie_type_id,
                 comparison_serie_type_id, is_revenue)""",
    "component": f"""
        SELECT CAST(p_partkey + 1 AS INTEGER) AS tariff_component_id,
               CAST(p_partkey % {_KINDS} + 1 AS INTEGER) AS tariff_component_type_id,
               CAST(p_partkey // {_KINDS} + 1 AS INTEGER) AS tariff_cost_group_id,
               CAST(p_retailprice / 7 AS DECIMAL(20,6)) AS price,
               CAST(p_retailprice / 70 AS DECIMAL(20,6)) AS authority_fee,
               CAST(CASE WHEN p_partkey % 4 > 0 THEN p_retailprice / 9 END AS DECIMAL(20,6))
                   AS price_outside_validity,
               CAST(CASE WHEN p_partkey % 4 > 1 THEN p_retailprice / 90 END AS DECIMAL(20,6))
                   AS authority_fee_outside_validity,
               CAST(CASE p_partkey % 3 WHEN 1 THEN 0.05 WHEN 2 THEN 0.1 END AS DECIMAL(9,6)) AS overshoot_limit,
               p_size % 12 + 1 AS validity_start,
               p_size * 5 % 12 + 1 AS validity_end
        FROM part WHERE p_partkey < 25 * {_KINDS}""",
    "contract_month": "SELECT DISTINCT date_id FROM first_order",
    "all_month": """
        SELECT CAST(unnest(generate_series((SELECT min(date_id) FROM contract_month),
                                           (SELECT max(date_id) FROM contract_month),
                                           INTERVAL 1 MONTH)) AS DATE) AS date_id""",
    "tariff_month": """
        SELECT tariff_id, date_id FROM tariff, all_month
        WHERE (validity_start IS NULL OR date_id >= validity_start)
          AND (validity_end IS NULL OR date_id < validity_end)""",
    "price_sheet": """
        SELECT l.customer_group_id, m.date_id, m.tariff_id, l.tariff_cost_group_id, c.tariff_component_id,
               cs.code AS calc_strategy, ps.code AS periodize_strategy, st.code AS serie_type_code,
               xt.code AS comparison_serie_type_code,
               coalesce(c.overshoot_limit, CAST(1 AS DECIMAL(9,6))) AS overshoot_limit, t.is_revenue,
               coalesce(CASE WHEN inside THEN price ELSE price_outside_validity END, 0) AS price,
               coalesce(CASE WHEN inside THEN authority_fee ELSE authority_fee_outside_validity END, 0)
                   AS authority_fee
        FROM cost_group_link l
        JOIN cost_group g USING (tariff_cost_group_id)
        JOIN tariff_month m ON m.tariff_id = g.tariff_id
        JOIN component c ON c.tariff_cost_group_id = l.tariff_cost_group_id
        JOIN component_type t ON t.tariff_component_type_id = c.tariff_component_type_id
        JOIN calc_strategy cs ON cs.calc_strategy_id = t.calc_strategy_id
        JOIN periodize_strategy ps ON ps.periodize_strategy_id = t.periodize_strategy_id
        LEFT JOIN serie_type st ON st.serie_type_id = t.serie_type_id
        LEFT JOIN serie_type xt ON xt.serie_type_id = t.comparison_serie_type_id,
        LATERAL (SELECT CASE WHEN validity_start <= validity_end
                             THEN month(m.date_id) BETWEEN validity_start AND validity_end
                             ELSE month(m.date_id) >= validity_start OR month(m.date_id) <= validity_end
                        END AS inside)""",
    "priced": """
        SELECT a.facility_id, a.date_id, a.subscribed_power, a.connection_power, s.* EXCLUDE (date_id),
               r.serie_value, x.serie_value AS comparison_value
        FROM disjointly_assigned a
        JOIN price_sheet s ON s.customer_group_id = a.customer_group_id AND s.date_id = a.date_id
        LEFT JOIN meter r ON r.facility_id = a.facility_id AND r.date_id = a.date_id
                         AND r.serie_type_code = s.serie_type_code
        LEFT JOIN meter x ON x.facility_id = a.facility_id AND x.date_id = a.date_id
                         AND x.serie_type_code = s.comparison_serie_type_code""",
    "calculated": """
        SELECT *, CAST(CASE calc_strategy
            WHEN 'fixed' THEN 1
            WHEN 'per_unit' THEN serie_value
            WHEN 'subscribed_power' THEN CAST(subscribed_power AS DECIMAL(17,6))
            WHEN 'connection_power' THEN CAST(connection_power AS DECIMAL(17,6))
            ELSE CASE WHEN excess > 0 THEN excess WHEN excess <= 0 THEN 0 END END AS DECIMAL(17,6)) AS quantity
        FROM (SELECT *, CAST(serie_value - overshoot_limit * CASE calc_strategy
                  WHEN 'overshoot_subscribed_power' THEN CAST(subscribed_power AS DECIMAL(17,6))
                  WHEN 'overshoot_connection_power' THEN CAST(connection_power AS DECIMAL(17,6))
                  WHEN 'overshoot_comparison_meter_data_serie' THEN comparison_value END
                  AS DECIMAL(30,12)) AS excess
              FROM priced)""",
    "share": """
        SELECT *,
               CASE periodize_strategy WHEN 'per_year_periodize_over_month_length'
                    THEN day(last_day(date_id)) ELSE 1 END AS part,
               CASE periodize_strategy WHEN 'per_year_periodize_over_month_length'
                    THEN CASE WHEN year(date_id) % 4 = 0 AND (year(date_id) % 100 != 0 OR year(date_id) % 400 = 0)
                              THEN 366 ELSE 365 END
                    WHEN 'per_year_divide_by_12' THEN 12 ELSE 1 END AS whole,
               -- Products in units of 10^-12 as whole numbers, so that rounding is exact.
               CAST(replace(CAST(quantity * price AS VARCHAR), '.', '') AS HUGEINT) AS units,
               CAST(replace(CAST(quantity * authority_fee AS VARCHAR), '.', '') AS HUGEINT) AS fee_units
        FROM calculated""",
    "amount": """
        SELECT *,
               CAST(CAST((2 * units * part + whole * 1000000) // (2 * whole * 1000000) AS DECIMAL(20,0))
                    * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(20,6)) * CASE WHEN is_revenue THEN 1 ELSE -1 END
                   AS amount,
               CAST(CAST((2 * fee_units * part + whole * 1000000) // (2 * whole * 1000000) AS DECIMAL(20,0))
                    * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(20,6)) * CASE WHEN is_revenue THEN 1 ELSE -1 END
                   AS fee_amount
        FROM share""",
}


def _sql(body: str) -> str:
    """The query with all domain tables as common table expressions; DuckDB drops unused ones."""
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in _TABLES.items())
    return f"WITH {ctes}\n{body}"


_FIRST, _LAST = f"DATE '{RANGE_FIRST}'", f"DATE '{RANGE_LAST}'"
_CONTRACT = (
    "facility_id, date_id, fuse_size, subscribed_power, connection_power, account_nr, "
    "customer_type_id, product_id"
)
_ALL_CONTRACTS = f"""
    SELECT * REPLACE (CAST(customer_type_id AS INTEGER) AS customer_type_id)
    FROM (SELECT {_CONTRACT} FROM resolved_contract)"""
_METER = "facility_id, ean, serie_value, status_id, serie_type_code, date_id"
_LINK_SPLIT = """
    SELECT CAST(l.facility_id AS INTEGER) AS facility_id, l.date_id, l.customer_group_id
    FROM assigned l
    LEFT JOIN stored_link s ON s.facility_id = l.facility_id AND s.date_id = l.date_id
    WHERE l.customer_group_id IS NOT NULL AND s.facility_id IS {}"""


def _missing(table: str, cols: tuple[str, ...]) -> str:
    nulls = " OR ".join(f"{c} IS NULL" for c in cols)
    return f"SELECT 'missing_values' AS \"check\", count(*) AS nr_violations FROM {table} WHERE {nulls}"


def _duplicate(table: str, cols: tuple[str, ...], where: str = "true") -> str:
    keys = ", ".join(cols)
    return (
        f"SELECT 'duplicate_{'_'.join(cols)}', count(*) FROM (SELECT {keys} FROM {table} "
        f"WHERE {where} GROUP BY ALL HAVING count(*) > 1)"
    )


def _not_month_start(table: str) -> str:
    return f"SELECT 'not_at_start_of_month', count(*) FROM {table} WHERE day(date_id) != 1"


def _report(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


def _by_strategy(strategy: str) -> str:
    return f"""
        SELECT facility_id, date_id, customer_group_id FROM assigned
        JOIN customer_group USING (customer_group_id) WHERE mapping_strategy_code = '{strategy}'"""


_FACILITY_MERGED = """
    SELECT coalesce(s.facility_id, (SELECT max(facility_id) FROM stored_facility)
               + count(*) FILTER (s.facility_id IS NULL) OVER (ORDER BY i.ean)) AS facility_id,
           i.ean, i.ean_prod, ft.facility_type_id, i.name, i.description
    FROM facility_drop i
    LEFT JOIN stored_facility s ON s.ean = i.ean
    JOIN facility_type ft ON ft.code = i.facility_type_code"""
_CORRECTED_STORE = f"""
    SELECT {_METER} FROM correction
    UNION ALL
    SELECT {_METER} FROM meter m
    WHERE NOT EXISTS (SELECT 1 FROM correction c
                      WHERE c.serie_type_code = m.serie_type_code AND c.date_id = m.date_id)"""
_J5_RANGE = f"date_id >= {_FIRST} AND date_id < DATE '1998-01-01'"

_BODIES = {
    "s1_parquet_scan": "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date_id FROM orders",
    "s3_typed_scan": "SELECT * FROM facility",
    "s4_facility_keys": "SELECT ean, facility_id FROM facility",
    "s4_product_keys": "SELECT external_id, product_id FROM product",
    "s5_contract_keys_between": f"""
        SELECT facility_id, date_id FROM contract WHERE date_id BETWEEN {_FIRST} AND {_LAST}""",
    "s6_contracts_extended": f"""
        SELECT c.* FROM contract c
        JOIN facility f ON f.facility_id = c.facility_id
        JOIN facility_type ft ON ft.facility_type_id = f.facility_type_id
        WHERE date_id >= {_FIRST} AND date_id < {_LAST}""",
    "s6_contracts_extended_open": f"""
        SELECT c.* FROM contract c
        JOIN facility f ON f.facility_id = c.facility_id
        JOIN facility_type ft ON ft.facility_type_id = f.facility_type_id
        WHERE date_id >= {_FIRST}""",
    "s8_links_between": f"""
        SELECT * FROM stored_link WHERE date_id >= {_FIRST} AND date_id < {_LAST}""",
    "s9_meter_store_read": f"""
        SELECT {_METER} FROM meter
        WHERE serie_type_code = 'max_active_power_cons' AND date_id BETWEEN {_FIRST} AND {_LAST}""",
    "k1_meter_partition_overwrite": _CORRECTED_STORE,
    "k2_insert_rows": """
        SELECT * FROM stored_facility
        UNION ALL BY NAME
        SELECT CAST(NULL AS BIGINT) AS facility_id, ean, ean_prod, facility_type_id, name,
               description
        FROM resolved_facility WHERE facility_id IS NULL""",
    "k3_update_by_key": """
        SELECT s.facility_id, r.ean, r.ean_prod,
               CAST(r.facility_type_id AS INTEGER) AS facility_type_id, r.name, s.description
        FROM stored_facility s JOIN resolved_facility r ON r.facility_id = s.facility_id""",
    "k6_assigned_ids": """
        SELECT (SELECT max(facility_id) FROM stored_facility) + row_number() OVER (ORDER BY ean)
                   AS facility_id, ean, name
        FROM resolved_facility WHERE facility_id IS NULL""",
    "k7_contract_upsert": """
        SELECT r.facility_id, r.date_id, r.fuse_size, r.subscribed_power, r.connection_power,
               s.account_nr, CAST(r.customer_type_id AS INTEGER) AS customer_type_id, r.product_id
        FROM resolved_contract r
        LEFT JOIN stored_contract s ON s.facility_id = r.facility_id AND s.date_id = r.date_id""",
    "u1_union_of_strategies": """
        SELECT facility_id, date_id, customer_group_id FROM assigned
        WHERE customer_group_id IS NOT NULL""",
    "p3_cast_present": """
        SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey,
               CAST(o_orderkey / 2.0::DOUBLE AS INTEGER) AS fuse_size,
               CAST(CAST(o_orderkey AS DECIMAL(17,0)) * 0.5 AS INTEGER) AS account_nr,
               CAST(o_totalprice / 8 AS DECIMAL(18,3)) AS serie_value,
               CAST(o_orderdate AS DATE) AS date_id
        FROM orders""",
    "p5_insert_flag": "SELECT facility_id, date_id, to_insert FROM resolved_contract",
    "a1_duplicates_over_all_columns": f"""
        SELECT 'events_' || event_type AS serie_type_code, {a.EAN_BASE} + user_id AS ean,
               CAST(ts AS DATE) AS date_id, count(*) AS n
        FROM events GROUP BY ALL HAVING count(*) > 1""",
    "a2_import_interval": """
        SELECT min(date_id) AS start_date, max(date_id) AS end_date FROM raw_contract_drop""",
    "a3_drop_profile": """
        SELECT count(*) AS nr_rows,
               count(*) FILTER (serie_type_code IS NULL OR ean IS NULL OR date_id IS NULL
                                OR serie_value IS NULL) AS nr_missing,
               count(*) FILTER (day(date_id) != 1) AS nr_not_month_start,
               min(date_id) AS first_date, max(date_id) AS last_date
        FROM raw_meter_drop""",
    "v2_missing_values": """
        SELECT ean, date_id, customer_type_code FROM raw_contract_drop
        WHERE ean IS NULL OR date_id IS NULL OR customer_type_code IS NULL""",
    "v3_duplicate_rows": """
        SELECT ean, date_id, count(*) AS nr_duplicates FROM raw_contract_drop
        GROUP BY ALL HAVING count(*) > 1""",
    "v3_duplicate_rows_without_nulls": """
        SELECT ean_prod, count(*) AS nr_duplicates FROM raw_facility_drop
        WHERE ean_prod IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "v4_not_at_start_of_month": """
        SELECT ean, date_id, customer_type_code FROM raw_contract_drop WHERE day(date_id) != 1""",
    "v5_product_drop_report": _report(
        _missing("raw_product_drop", ("external_id", "name")),
        _duplicate("raw_product_drop", ("external_id",)),
        _duplicate("raw_product_drop", ("name",)),
    ),
    "v6_facility_drop_report": _report(
        _missing("raw_facility_drop", ("ean", "facility_type_code")),
        _duplicate("raw_facility_drop", ("ean",)),
        _duplicate("raw_facility_drop", ("ean_prod",), "ean_prod IS NOT NULL"),
    ),
    "v7_contract_drop_report": _report(
        _missing("raw_contract_drop", ("ean", "date_id", "customer_type_code")),
        _duplicate("raw_contract_drop", ("ean", "date_id")),
        _not_month_start("raw_contract_drop"),
    ),
    "v8_meter_drop_report": _report(
        _missing("raw_meter_drop", ("serie_type_code", "ean", "date_id", "serie_value")),
        _duplicate("raw_meter_drop", ("serie_type_code", "ean", "date_id")),
        _not_month_start("raw_meter_drop"),
    ),
    "v9_invalid_facility_type": """
        SELECT facility_id, ean, facility_type_id, facility_type_code FROM raw_resolved_facility
        WHERE facility_type_id IS NULL""",
    "v10_invalid_customer_type": """
        SELECT facility_id, ean, date_id, customer_type_id, customer_type_code
        FROM raw_resolved_contract WHERE customer_type_id IS NULL""",
    "v10_unknown_ean": """
        SELECT * EXCLUDE (to_insert) FROM raw_resolved_contract WHERE facility_id IS NULL""",
    "v11_unresolved_meter_rows": """
        SELECT * FROM resolved_meter WHERE facility_id IS NULL OR serie_type_id IS NULL""",
    "v11_unresolved_meter_row_count": """
        SELECT count(*) AS nr_invalid FROM resolved_meter
        WHERE facility_id IS NULL OR serie_type_id IS NULL""",
    "v13_unmapped_contracts": """
        SELECT * EXCLUDE (customer_group_id) FROM assigned WHERE customer_group_id IS NULL""",
    "v14_duplicate_links": """
        SELECT facility_id, date_id, count(*) AS nr_duplicates FROM assigned
        WHERE customer_group_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "d1_product_resolution": """
        SELECT s.product_id, i.* FROM product_drop i
        LEFT JOIN stored_product s ON s.external_id = i.external_id""",
    "d2_facility_resolution": "SELECT * FROM raw_resolved_facility",
    "d3_contract_resolution": "SELECT * FROM raw_resolved_contract",
    "d4_meter_resolution": "SELECT * FROM resolved_meter",
    "d6_contracts_without_link": """
        SELECT c.facility_id, c.date_id, c.fuse_size FROM contract c
        LEFT JOIN stored_link l ON l.facility_id = c.facility_id AND l.date_id = c.date_id
        WHERE l.facility_id IS NULL""",
    "m1_product_insert": """
        SELECT i.* FROM product_drop i LEFT JOIN stored_product s USING (external_id)
        WHERE s.product_id IS NULL""",
    "m1_product_update": """
        SELECT s.product_id, i.* FROM product_drop i
        JOIN stored_product s ON s.external_id = i.external_id""",
    "m2_facility_insert": """
        SELECT * EXCLUDE (facility_id, facility_type_code) FROM resolved_facility
        WHERE facility_id IS NULL""",
    "m2_facility_update": """
        SELECT * EXCLUDE (facility_type_code) FROM resolved_facility
        WHERE facility_id IS NOT NULL""",
    "m3_contract_insert": f"SELECT {_CONTRACT} FROM resolved_contract WHERE to_insert",
    "m3_contract_update": f"SELECT {_CONTRACT} FROM resolved_contract WHERE NOT to_insert",
    "m4_serie_values": "SELECT * EXCLUDE (serie_type_id) FROM resolved_meter",
    "m6_map_by_product": _by_strategy("product"),
    "m8_map_by_fuse_size": _by_strategy("fuse_size"),
    "m8_map_by_subscribed_power": _by_strategy("subscribed_power"),
    "m8_map_by_connection_power": _by_strategy("connection_power"),
    "m10_map_all": """
        SELECT facility_id, date_id, customer_group_id FROM assigned
        WHERE customer_group_id IS NOT NULL""",
    "m11_link_insert": _LINK_SPLIT.format("NULL"),
    "m11_link_update": _LINK_SPLIT.format("NOT NULL"),
    "m12_interval_months": """
        SELECT facility_id, date_id FROM contract
        WHERE date_id >= date_trunc('month', TIMESTAMP '1997-10-20 13:37:37') - INTERVAL 6 MONTH
          AND date_id < date_trunc('month', TIMESTAMP '1997-10-20 13:37:37')""",
    "m12_interval_timestamps": """
        SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'
          AND l_shipdate < TIMESTAMP '1997-10-01 13:37:37'""",
    "c1_unique_violations": """
        SELECT ean, count(*) AS nr_duplicates
        FROM (SELECT ean FROM stored_facility UNION ALL SELECT ean FROM raw_facility_drop)
        WHERE ean IS NOT NULL GROUP BY ean HAVING count(*) > 1""",
    "c1_conflicts_with_stored": """
        SELECT * FROM facility_drop WHERE ean IN (SELECT ean FROM stored_facility)""",
    "c2_foreign_key_violations": """
        SELECT facility_id, count(*) AS nr_rows FROM contract
        WHERE facility_id NOT IN (SELECT facility_id FROM stored_facility) GROUP BY facility_id""",
    "c3_c4_table_violations": """
        SELECT * FROM (
            SELECT 'facility_id_not_null' AS "constraint",
                   count(*) FILTER (facility_id IS NULL) AS nr_violations
            FROM raw_resolved_contract
            UNION ALL
            SELECT 'date_id_not_null', count(*) FILTER (date_id IS NULL)
            FROM raw_resolved_contract
            UNION ALL
            SELECT 'customer_type_id_not_null', count(*) FILTER (customer_type_id IS NULL)
            FROM raw_resolved_contract
            UNION ALL
            SELECT 'date_id_month_start', count(*) FILTER (day(date_id) != 1)
            FROM raw_resolved_contract
            UNION ALL
            SELECT 'facility_id_date_id_unique', count(*) FROM (
                SELECT facility_id, date_id FROM raw_resolved_contract
                WHERE facility_id IS NOT NULL AND date_id IS NOT NULL
                GROUP BY ALL HAVING count(*) > 1)
            UNION ALL
            SELECT 'facility_id_fk', count(*) FROM raw_resolved_contract
            WHERE facility_id NOT IN (SELECT facility_id FROM stored_facility)
            UNION ALL
            SELECT 'customer_type_id_fk', count(*) FROM raw_resolved_contract
            WHERE customer_type_id NOT IN (SELECT customer_type_id FROM customer_type)
            UNION ALL
            SELECT 'product_id_fk', count(*) FROM raw_resolved_contract
            WHERE product_id NOT IN (SELECT product_id FROM product)
        ) WHERE nr_violations > 0""",
    "t1_incremental_import": f"SELECT {_METER} FROM meter",
    "t1_rejected_then_fixed": f"SELECT {_METER} FROM meter",
    "t2_month_correction": _CORRECTED_STORE,
    "j1_product_import": """
        SELECT CAST(coalesce(s.product_id, (SELECT max(product_id) FROM stored_product)
                   + count(*) FILTER (s.product_id IS NULL) OVER (ORDER BY i.external_id))
                   AS INTEGER) AS product_id,
               i.external_id, i.name, i.description
        FROM product_drop i LEFT JOIN stored_product s ON s.external_id = i.external_id""",
    "j2_facility_import": _FACILITY_MERGED,
    "j3_contract_import": _ALL_CONTRACTS,
    "k9_contract_correction": _ALL_CONTRACTS,
    "j5_mapping_refused": f"""
        SELECT facility_id, date_id, count(*) AS nr_duplicates FROM assigned
        WHERE customer_group_id IS NOT NULL AND {_J5_RANGE} GROUP BY ALL HAVING count(*) > 1""",
    "j4_meter_import": f"SELECT {_METER} FROM meter",
    "x1_calculated_quantity": """
        SELECT facility_id, date_id, tariff_component_id, calc_strategy, quantity FROM calculated""",
    "x2_periodized_cost": """
        SELECT facility_id, date_id, tariff_component_id, periodize_strategy,
               CAST(amount AS DECIMAL(20,6)) AS amount, CAST(fee_amount AS DECIMAL(20,6)) AS fee_amount
        FROM amount""",
    "d7_many_rules": "SELECT facility_id, date_id, customer_group_id FROM assigned_by_part",
    "x3_price_sheet": "SELECT * FROM price_sheet",
    "x4_tariff_months": "SELECT * FROM tariff_month",
    "x5_monthly_totals": """
        SELECT facility_id, date_id,
               CAST(coalesce(sum(amount) FILTER (is_revenue), 0) AS DECIMAL(20,3)) AS revenue,
               CAST(coalesce(sum(amount) FILTER (NOT is_revenue), 0) AS DECIMAL(20,3)) AS cost,
               CAST(coalesce(sum(amount), 0) AS DECIMAL(20,3)) AS balance,
               CAST(coalesce(sum(fee_amount), 0) AS DECIMAL(20,3)) AS authority_fee,
               count(*) AS nr_components, count(*) FILTER (amount IS NULL) AS nr_without_value
        FROM amount GROUP BY facility_id, date_id""",
    "x6_priced_contracts": """
        SELECT facility_id, date_id, tariff_component_id, customer_group_id, tariff_cost_group_id, tariff_id
        FROM priced""",
    "x6_unavailable_components": """
        SELECT tariff_component_id, tariff_component_type_id, tariff_cost_group_id, tariff_id
        FROM component JOIN cost_group USING (tariff_cost_group_id)
        WHERE tariff_component_type_id = 2 * tariff_id""",
    "j5_map_facilities": f"""
        SELECT coalesce(l.facility_id, s.facility_id) AS facility_id,
               coalesce(l.date_id, s.date_id) AS date_id,
               coalesce(l.customer_group_id, s.customer_group_id) AS customer_group_id
        FROM (
            SELECT facility_id, date_id, customer_group_id FROM disjointly_assigned
            WHERE customer_group_id IS NOT NULL AND {_J5_RANGE}
        ) l
        FULL JOIN stored_link s ON s.facility_id = l.facility_id AND s.date_id = l.date_id""",
}

ORACLES: dict[str, str] = {name: _sql(body) for name, body in _BODIES.items()}
