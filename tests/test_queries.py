"""Every registered query against its SQL, and the shape of the plans at scale."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from tests.compare import connect, differences
from voltledger.demo import adapters, queries
from voltledger.demo.queries import QUERIES
from voltledger.operators import joins, resolve
from voltledger.seeds import seed_table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the benchmark tables")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    assert differences(df, oracle, entry_module.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[-1] == "customer_group_id" and not df.isEmpty()


def test_skewed_lookup_is_split(spark, monkeypatch):
    """Most rows carry one EAN and the facilities are too large to broadcast: the adaptive join cuts
    the hot partition, and the result is that of the plain join."""
    monkeypatch.setattr(joins, "FACILITY_BROADCAST_MAX_ROWS", 10)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        drop = spark.range(0, 60_000, 1, 8).selectExpr(
            "'active_energy_cons' AS serie_type_code",
            f"{adapters.EAN_BASE} + IF(id % 3 < 2, 5, id % 900) AS ean",
            "date_add(DATE'2025-01-01', CAST(id AS INT)) AS date_id",
            "CAST(id AS DOUBLE) AS serie_value",
        )
        resolved = resolve.resolve_meter_rows(
            drop, adapters.facilities(spark, SF_DIR), seed_table(spark, "serie_type")
        )
        rows = resolved.collect()
        plan = resolved._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "skew=true" in plan
    nr_facilities = adapters.facilities(spark, SF_DIR).count()
    assert len(rows) == 60_000
    for row in rows:
        number = row.ean - adapters.EAN_BASE
        assert row.facility_id == (number + 1 if number < nr_facilities else None)


def test_a_meter_import_computes_its_drop_once(spark, monkeypatch, tmp_path):
    """The sources of j4 are parts of one staged drop, which no lineitem is sorted for."""
    rows = {
        "orders": "SELECT id AS o_orderkey, id % 3 AS o_custkey FROM range(9)",
        "customer": "SELECT id AS c_custkey, 'name' AS c_name, 'BUILDING' AS c_mktsegment FROM range(3)",
        "lineitem": "SELECT id % 9 AS l_orderkey, 500 AS l_partkey, CAST(id AS DOUBLE) AS l_quantity, 'A' AS l_returnflag,"
        " 'O' AS l_linestatus, 8.0D AS l_extendedprice, DATE'1996-03-02' AS l_shipdate FROM range(40)",
    }
    for name, sql in rows.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    dropped, given = [], queries._drop

    def drop_of(df, staging, name="drop"):
        dropped.append((name, any("lineitem" in file for file in df.inputFiles())))
        return given(df, staging, name)

    monkeypatch.setattr(queries, "_drop", drop_of)
    assert QUERIES["j4_meter_import"](spark, str(tmp_path)).count() == 6
    assert dropped == [("active_energy_cons", False), ("max_active_power_cons", False), ("raw", True)]
    plan = adapters.meter_drop(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
