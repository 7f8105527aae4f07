"""Loading drops, the table store, table scans and the meter store."""

from __future__ import annotations

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests import golden
from tests.golden import DEC, NOV
from voltledger import schemas
from voltledger.operators import resolve
from voltledger.seeds import seed_table
from voltledger.sinks.meter_store import write_meter_store, write_parquet
from voltledger.sources import tables
from voltledger.sources.drops import load_drop
from voltledger.sources.meter_store import read_meter_store
from voltledger.sources.staging import Staging, shared_folder


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


class TestDrops:
    def test_methods(self, spark, write_drop):
        path = write_drop(golden.product_drop())
        assert load_drop(spark, path)[1].ok
        assert load_drop(spark, path, "plugin")[1].short_msg == (
            "Data import through plugins is not implemented yet!"
        )
        assert load_drop(spark, path, "mail")[1].short_msg == (
            "Invalid import method \"mail\"! Valid methods are: ('file', 'plugin')"
        )

    def test_files_with_different_columns(self, spark, write_drop):
        rows = golden.product_drop()
        path = write_drop(rows[:2], columns=["external_id", "name"])
        write_drop(rows[2:], path=path)
        df, _ = load_drop(spark, path)
        assert sorted(df.columns) == ["description", "external_id", "name"]
        assert df.where("description IS NULL").count() == 2


class TestStore:
    def test_newest_version_per_month(self, store, fill):
        row = {"facility_id": 1, "date_id": NOV, "customer_group_id": 1}
        name = "facility_customer_group_link"
        fill(store, name, [row, {**row, "date_id": DEC}])
        fill(store, name, [{**row, "date_id": DEC, "customer_group_id": 2}])
        read = {r.date_id: r.customer_group_id for r in store.read(name).collect()}
        assert read == {NOV: 1, DEC: 2}
        assert [r.date_id for r in store.read(name, [DEC]).collect()] == [DEC]
        assert store.read(name, []).collect() == []

    def test_unfinished_version_is_invisible(self, store, fill):
        fill(store, "product", golden.rows(golden.PRODUCTS))
        fill(store, "product", golden.rows(golden.PRODUCTS)[:1])
        assert store.read("product").count() == 1
        os.remove(f"{store.root}/product/version=2/_SUCCESS")
        assert store.read("product").count() == 5

    def test_month_filter_prunes_directories(self, full_store):
        df = full_store.read("facility_contract").where(F.col("date_id") == DEC)
        assert "PartitionFilters: [isnotnull(date_id" in plan_of(df)
        assert df.count() == 1

    def test_keys_read_two_columns(self, full_store):
        df = tables.key_mapping(full_store.read("facility"), "ean", "facility_id")
        assert "ReadSchema: struct<facility_id:bigint,ean:bigint>" in plan_of(df)


class TestScans:
    def test_ranges(self, full_store):
        contracts = full_store.read("facility_contract")
        assert tables.contract_keys_between(contracts, NOV, DEC).count() == 11
        args = (contracts, full_store.read("facility"), full_store.read("facility_type"))
        assert tables.contracts_extended(*args, NOV, DEC).count() == 10
        extended = tables.contracts_extended(*args, NOV)
        assert extended.columns[-1] == "facility_type_id"
        assert {r.facility_type_id for r in extended.where("facility_id > 7").collect()} == {2}
        links = full_store.read("facility_customer_group_link")
        assert tables.links_between(links, NOV, DEC).count() == 0

    def test_groups_with_strategy(self, full_store):
        groups = tables.customer_groups_with_strategy(
            full_store.read("customer_group"), full_store.read("customer_group_mapping_strategy")
        )
        assert {(r.customer_group_id, r.mapping_strategy_code) for r in groups.collect()} == {
            (r["customer_group_id"], r["mapping_strategy_code"])
            for r in golden.rows(golden.CUSTOMER_GROUPS)
        }

    def test_typed_scan(self, spark):
        df = spark.sql("SELECT 1 AS x, '7' AS customer_group_id, '2025-11-01' AS date_id, 3 AS facility_id")
        typed, result = tables.typed_scan(df, schemas.LINK.schema)
        assert result.ok
        assert [tuple(r) for r in typed.collect()] == [(3, NOV, 7)]
        _, result = tables.typed_scan(df.drop("date_id"), schemas.LINK.schema, "Not loaded!")
        assert result.short_msg == "Not loaded!" and "date_id" in result.long_msg


class TestMeterStore:
    @pytest.fixture
    def root(self, spark, tmp_path):
        root = str(tmp_path / "meter")
        for text in (golden.ACTIVE_ENERGY, golden.REACTIVE_POWER):
            facilities = golden.frame(spark, golden.rows(golden.FACILITIES))
            resolved = resolve.resolve_meter_rows(
                golden.frame(spark, golden.meter_drop(text)),
                facilities,
                seed_table(spark, "serie_type"),
            )
            assert write_meter_store(resolve.serie_values(resolved), root).ok
        return root

    def test_round_trip_and_pruning(self, spark, root):
        df = read_meter_store(spark, root)
        assert df.schema == schemas.SERIE_VALUE
        assert df.count() == 22
        one = df.where((F.col("serie_type_code") == "max_reactive_power_cons") & (F.col("date_id") == DEC))
        assert "PartitionFilters: [isnotnull(serie_type_code" in plan_of(one)
        assert one.count() == 2
        assert one.select("_metadata.file_path").distinct().count() == 1

    def test_plain_readers_see_the_same_types(self, spark, root):
        inferred = spark.read.parquet(root)
        assert inferred.schema["date_id"].dataType.simpleString() == "date"
        assert inferred.schema["serie_type_code"].dataType.simpleString() == "string"

    def test_one_large_partition_is_split(self, spark, tmp_path):
        """Nearly all rows belong to one partition; rebalancing writes it with several tasks."""
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        try:
            df = spark.range(0, 200_000, 1, 8).selectExpr(
                "id AS ean",
                "xxhash64(id) AS serie_value",
                "IF(id % 1000 = 0, 'b', 'a') AS serie_type_code",
                "DATE'2025-11-01' AS date_id",
            )
            root = str(tmp_path / "hot")
            assert write_parquet(df, root, ("serie_type_code", "date_id"), overwrite=True).ok
        finally:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        hot = f"{root}/serie_type_code=a/date_id=2025-11-01"
        assert len([f for f in os.listdir(hot) if f.endswith(".parquet")]) > 1
        assert spark.read.parquet(root).count() == 200_000

    def test_existing_path_is_an_error_result(self, spark, root):
        result = write_parquet(spark.range(1), root)
        assert not result.ok and root in result.short_msg


def test_staging_uses_the_shared_folder(spark):
    staging = Staging(spark, "test")
    assert staging.root.startswith(shared_folder(spark))
    df = staging.write(spark.range(5))
    assert df.count() == 5
    assert os.path.exists(staging.root.removeprefix("file:"))
    staging.drop()
    assert not os.path.exists(staging.root.removeprefix("file:"))


class FakeSession:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})


def test_local_folder_only_where_spark_is_local():
    folder = shared_folder(FakeSession("local[4]"))
    assert os.path.isdir(folder) and shared_folder(FakeSession("local[4]")) == folder
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession("yarn"))


def test_mixed_date_types_join_as_dates(spark):
    drop = spark.sql("SELECT 123456000000000001 AS ean, TIMESTAMP_NTZ'2025-11-01 00:00:00' AS date_id, 'company' AS customer_type_code")
    existing = spark.createDataFrame([(1, date(2025, 11, 1))], "facility_id bigint, date_id date")
    facilities = golden.frame(spark, golden.rows(golden.FACILITIES))
    products = golden.frame(spark, golden.rows(golden.PRODUCTS))
    resolved = resolve.resolve_contracts(
        drop, facilities, seed_table(spark, "customer_type"), products, existing
    )
    row = resolved.first()
    assert (row.facility_id, row.customer_type_id, row.to_insert) == (1, 2, False)
    assert "product_id" not in resolved.columns
