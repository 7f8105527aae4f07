"""The jobs against the golden tables, with empty, partly filled and full targets."""

from __future__ import annotations

import os
from datetime import date

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests import golden
from tests.golden import DEC, NOV
from voltledger.plans import jobs
from voltledger.seeds import init_tables
from voltledger.sources.meter_store import read_meter_store


def stored(store, name: str, *order_by: str) -> list[dict]:
    return [r.asDict() for r in store.read(name).orderBy(*order_by).collect()]


def by_keys(dicts: list[dict], *keys: str) -> list[dict]:
    return sorted(dicts, key=lambda r: tuple(r[k] for k in keys))


def golden_contracts() -> list[dict]:
    return by_keys(
        golden.rows(golden.CONTRACTS, "ean", "customer_type_code", "ext_product_id"),
        "date_id",
        "facility_id",
    )


class TestProducts:
    @pytest.mark.parametrize(("present", "new", "known"), [(0, 5, 0), (2, 3, 2), (5, 0, 5)])
    def test_counts_and_rows(self, store, fill, write_drop, present, new, known):
        # Stored rows carry other names, the drop must overwrite them.
        old = [{**r, "name": f"old {r['name']}"} for r in golden.rows(golden.PRODUCTS)[:present]]
        if old:
            fill(store, "product", old)
        report = jobs.import_products(store, write_drop(golden.product_drop()))
        assert report.ok
        assert (report.inserted, report.updated) == (new, known)
        assert report.result.short_msg == (
            f"Successfully imported {new} new products and updated {known} existing products!"
        )
        assert stored(store, "product", "product_id") == golden.rows(golden.PRODUCTS)

    def test_missing_values(self, store, write_drop):
        drop = golden.product_drop()
        drop[3]["external_id"] = None
        drop[4]["name"] = None
        report = jobs.import_products(store, write_drop(drop))
        assert not report.ok
        assert report.result.short_msg == (
            "Found rows (2) with missing values in required columns ('external_id', 'name')!"
        )
        assert {tuple(r) for r in report.violations.collect()} == {
            (None, "Capacity 400 V"),
            ("9001", None),
        }
        assert store.read("product").isEmpty()

    @pytest.mark.parametrize("col", ["external_id", "name"])
    def test_duplicates(self, store, write_drop, col):
        drop = golden.product_drop()
        drop[1][col] = drop[3][col]
        report = jobs.import_products(store, write_drop(drop))
        assert report.result.short_msg == f"Found duplicate rows (1) over columns: ('{col}',)!"
        assert [tuple(r) for r in report.violations.collect()] == [(drop[3][col], 2)]

    def test_name_taken_by_stored_product(self, store, fill, write_drop):
        fill(store, "product", golden.rows(golden.PRODUCTS)[:1])
        drop = [{"external_id": "77", "name": "Flat", "description": None}]
        report = jobs.import_products(store, write_drop(drop))
        assert not report.ok and "not unique" in report.result.short_msg
        assert [r.name for r in report.violations.collect()] == ["Flat"]
        assert store.read("product").count() == 1

    def test_absent_description_is_kept(self, store, fill, write_drop):
        fill(store, "product", golden.rows(golden.PRODUCTS))
        drop = write_drop(golden.product_drop(), columns=["external_id", "name"])
        assert jobs.import_products(store, drop).updated == 5
        assert stored(store, "product", "product_id") == golden.rows(golden.PRODUCTS)


class TestFacilities:
    @pytest.mark.parametrize(("present", "new", "known"), [(0, 10, 0), (2, 8, 2), (10, 0, 10)])
    def test_counts_and_rows(self, store, fill, write_drop, present, new, known):
        expected = golden.rows(golden.FACILITIES, "facility_type_code")
        if present:
            # A null in the drop overwrites the stored value.
            old = [{**r, "ean_prod": 123} for r in expected[:present]]
            fill(store, "facility", old)
        report = jobs.import_facilities(store, write_drop(golden.facility_drop()))
        assert report.ok, report.result
        assert (report.inserted, report.updated) == (new, known)
        assert report.result.short_msg == (
            f"Successfully imported {new} new facilities and updated {known} existing facilities!"
        )
        assert stored(store, "facility", "facility_id") == expected

    def test_missing_values(self, store, write_drop):
        drop = golden.facility_drop()
        drop[1]["facility_type_code"] = None
        drop[2]["ean"] = drop[2]["facility_type_code"] = None
        drop[3]["ean"] = None
        report = jobs.import_facilities(store, write_drop(drop))
        assert report.result.short_msg == (
            "Found rows (3) with missing values in required columns ('ean', 'facility_type_code')!"
        )
        assert report.violations.count() == 3

    def test_duplicate_ean(self, store, write_drop):
        drop = golden.facility_drop()
        drop.append(dict(drop[6]))
        report = jobs.import_facilities(store, write_drop(drop))
        assert report.result.short_msg == "Found duplicate rows (1) over columns: ('ean',)!"

    def test_duplicate_ean_prod_ignores_nulls(self, store, write_drop):
        drop = golden.facility_drop()
        drop.append({**drop[2], "ean": 1})
        drop.append({**drop[5], "ean": 2})
        report = jobs.import_facilities(store, write_drop(drop))
        assert report.result.short_msg == "Found duplicate rows (2) over columns: ('ean_prod',)!"
        assert [tuple(r) for r in report.violations.collect()] == [
            (123456789000000001, 2),
            (123456789000000002, 2),
        ]

    def test_ean_prod_is_optional(self, store, write_drop):
        drop = write_drop(golden.facility_drop(), columns=["ean", "facility_type_code"])
        assert jobs.import_facilities(store, drop).inserted == 10

    def test_unknown_type(self, store, write_drop):
        drop = golden.facility_drop()
        drop[1]["facility_type_code"] = drop[3]["facility_type_code"] = "storage"
        report = jobs.import_facilities(store, write_drop(drop))
        assert report.result.short_msg == (
            'Found facilities (2) with invalid values for column "facility_type_code"!'
        )
        assert report.violations.count() == 2
        assert store.read("facility").isEmpty()


class TestContracts:
    @pytest.fixture
    def ready(self, store, fill):
        fill(store, "product", golden.rows(golden.PRODUCTS))
        fill(store, "facility", golden.rows(golden.FACILITIES, "facility_type_code"))
        return store

    @pytest.mark.parametrize(("present", "new", "known"), [(0, 11, 0), (2, 9, 2), (11, 0, 11)])
    def test_counts_and_rows(self, ready, fill, write_drop, present, new, known):
        if present:
            old = [{**r, "fuse_size": 999, "product_id": None} for r in golden_contracts()[:present]]
            fill(ready, "facility_contract", old)
        report = jobs.import_contracts(ready, write_drop(golden.contract_drop()))
        assert report.ok, report.result
        assert (report.inserted, report.updated) == (new, known)
        assert report.result.short_msg == (
            f"Successfully imported {new} new facility contracts and updated {known} existing "
            "facility contracts in interval 2025-11-01 - 2025-12-01!"
        )
        assert stored(ready, "facility_contract", "date_id", "facility_id") == golden_contracts()

    def test_other_months_are_left_alone(self, full_store, write_drop):
        december = [r for r in golden.contract_drop() if r["date_id"] == DEC]
        december[0]["connection_power"] = 99.0
        path = write_drop(december)
        assert jobs.import_contracts(full_store, path).updated == 1
        rows = stored(full_store, "facility_contract", "date_id", "facility_id")
        assert rows[:10] == golden_contracts()[:10]
        assert rows[10]["connection_power"] == 99.0
        root = f"{full_store.root}/facility_contract/version=2"
        assert sorted(n for n in os.listdir(root) if "=" in n) == ["date_id=2025-12-01"]

    def test_missing_values(self, ready, write_drop):
        drop = golden.contract_drop()
        drop[3]["date_id"] = drop[4]["customer_type_code"] = drop[5]["ean"] = None
        report = jobs.import_contracts(ready, write_drop(drop))
        assert report.result.short_msg == (
            "Found rows (3) with missing values in required columns "
            "('ean', 'date_id', 'customer_type_code')!"
        )

    def test_duplicates(self, ready, write_drop):
        drop = golden.contract_drop()
        drop.append(dict(drop[3]))
        report = jobs.import_contracts(ready, write_drop(drop))
        assert report.result.short_msg == (
            "Found duplicate rows (1) over columns: ('ean', 'date_id')!"
        )

    def test_not_month_start(self, ready, write_drop):
        drop = golden.contract_drop()
        drop[3]["date_id"], drop[5]["date_id"] = date(2025, 11, 11), date(2025, 11, 12)
        report = jobs.import_contracts(ready, write_drop(drop))
        assert report.result.short_msg == "Found rows (2) not at start of month!"
        assert report.violations.columns == ["ean", "date_id", "customer_type_code"]

    def test_unknown_customer_type(self, ready, write_drop):
        drop = golden.contract_drop()
        drop[2]["customer_type_code"] = drop[4]["customer_type_code"] = "municipality"
        report = jobs.import_contracts(ready, write_drop(drop))
        assert report.result.short_msg == (
            'Found facility contracts (2) with invalid values for column "customer_type_code"!'
        )
        assert [r.ean for r in report.violations.collect()] == [drop[2]["ean"], drop[4]["ean"]]

    def test_unknown_ean(self, ready, write_drop):
        drop = golden.contract_drop()
        drop[3]["ean"] = 1
        report = jobs.import_contracts(ready, write_drop(drop))
        assert report.result.short_msg == (
            'Found facility contracts (1) with unknown EAN codes in column "ean"!'
        )
        assert report.violations.count() == 1
        assert ready.read("facility_contract").isEmpty()

    def test_unknown_product_is_allowed(self, ready, write_drop):
        drop = golden.contract_drop()
        drop[0]["ext_product_id"] = "unknown"
        assert jobs.import_contracts(ready, write_drop(drop)).ok
        assert stored(ready, "facility_contract", "date_id", "facility_id")[0]["product_id"] is None

    def test_empty_drop_has_no_interval(self, ready, write_drop):
        path = write_drop([], columns=list(golden.contract_drop()[0]))
        report = jobs.import_contracts(ready, path)
        assert report.result.short_msg == "Could not compute facility contract interval!"


class TestMeterData:
    @pytest.fixture
    def ready(self, store, fill):
        fill(store, "facility", golden.rows(golden.FACILITIES, "facility_type_code"))
        return store

    @staticmethod
    def read(spark, root) -> list[tuple]:
        df = read_meter_store(spark, root).select(
            "serie_type_code", "date_id", "facility_id", "ean", "serie_value", "status_id"
        )
        return sorted(tuple(r) for r in df.collect())

    def test_two_sources(self, spark, ready, write_drop, tmp_path):
        root = str(tmp_path / "meter_data")
        paths = {
            "active_energy_cons": write_drop(golden.meter_drop(golden.ACTIVE_ENERGY)),
            "max_reactive_power_cons": write_drop(golden.meter_drop(golden.REACTIVE_POWER)),
        }
        report = jobs.import_meter_data(ready, root, paths)
        assert report.result.short_msg == (
            "Successfully processed meter data for sources: "
            "('active_energy_cons', 'max_reactive_power_cons')"
        )
        assert len(report.sources) == 8
        assert sorted(n for n in os.listdir(root) if "=" in n) == [
            "serie_type_code=active_energy_cons",
            "serie_type_code=max_reactive_power_cons",
        ]
        assert self.read(spark, root) == golden.stored_meter_rows(
            golden.ACTIVE_ENERGY, golden.REACTIVE_POWER
        )

    def test_later_drop_replaces_its_months_only(self, spark, ready, write_drop, tmp_path):
        root = str(tmp_path / "meter_data")
        source = "max_reactive_power_cons"
        first = golden.meter_drop(golden.REACTIVE_POWER)
        jobs.import_meter_data(ready, root, {source: write_drop(first)})
        correction = [{**first[10], "serie_value": 1.5}]
        assert correction[0]["date_id"] == DEC
        jobs.import_meter_data(ready, root, {source: write_drop(correction)})
        rows = self.read(spark, root)
        assert [r for r in rows if r[1] == NOV] == [
            r for r in golden.stored_meter_rows(golden.REACTIVE_POWER) if r[1] == NOV
        ]
        assert [(r[2], float(r[4])) for r in rows if r[1] == DEC] == [(1, 1.5)]

    def test_failing_source_does_not_stop_the_others(self, spark, ready, write_drop, tmp_path):
        root = str(tmp_path / "meter_data")
        bad = golden.meter_drop(golden.REACTIVE_POWER)
        bad[3]["date_id"], bad[5]["date_id"] = date(2025, 11, 11), date(2025, 11, 12)
        paths = {
            "active_energy_cons": write_drop(golden.meter_drop(golden.ACTIVE_ENERGY)),
            "max_reactive_power_cons": write_drop(bad),
        }
        report = jobs.import_meter_data(ready, root, paths, sources=list(paths))
        assert report.ok
        failed = report.sources["max_reactive_power_cons"]
        assert failed.result.short_msg == "Found rows (2) not at start of month!"
        assert self.read(spark, root) == golden.stored_meter_rows(golden.ACTIVE_ENERGY)

    @staticmethod
    def nulls(drop):
        for i, col in enumerate(("serie_type_code", "ean", "date_id", "serie_value"), start=1):
            drop[i][col] = None

    @staticmethod
    def duplicate(drop):
        drop.append({**drop[7], "serie_value": 1.0})

    @staticmethod
    def unknown(drop):
        drop[2]["serie_type_code"], drop[2]["ean"] = "nope", 7
        drop[4]["serie_type_code"] = "nope"

    @pytest.mark.parametrize(
        ("mutate", "message", "n"),
        [
            (
                nulls,
                "Found rows (4) with missing values in required columns "
                "('serie_type_code', 'ean', 'date_id', 'serie_value')!",
                4,
            ),
            (
                duplicate,
                "Found duplicate rows (1) over columns: ('serie_type_code', 'ean', 'date_id')!",
                1,
            ),
            (
                unknown,
                'Found rows (2) with invalid values for columns "serie_type_code" or "ean"!',
                2,
            ),
        ],
    )
    def test_rejected(self, ready, write_drop, tmp_path, mutate, message, n):
        root = str(tmp_path / "meter_data")
        drop = golden.meter_drop(golden.ACTIVE_ENERGY)
        mutate(drop)
        report = jobs.import_meter_data(ready, root, {"active_energy_cons": write_drop(drop)})
        assert not report.ok
        assert report.sources["active_energy_cons"].result.short_msg == message
        assert report.sources["active_energy_cons"].violations.count() == n
        assert not os.path.exists(root)

    def test_missing_columns(self, ready, write_drop, tmp_path):
        drop = golden.meter_drop(golden.ACTIVE_ENERGY)
        path = write_drop(drop, columns=["serie_type_code", "serie_value", "status_id"])
        report = jobs.import_meter_data(ready, str(tmp_path / "m"), {"active_energy_cons": path})
        assert report.sources["active_energy_cons"].result.short_msg == (
            "Missing the required columns!\n"
            "Missing required columns : ('date_id', 'ean')\n"
            "Required columns         : ('date_id', 'ean', 'serie_type_code', 'serie_value')\n"
            "Available columns        : ('serie_type_code', 'serie_value', 'status_id')"
        )

    def test_no_file_and_no_columns(self, ready, tmp_path):
        empty = tmp_path / "empty"
        empty.mkdir()
        hollow = tmp_path / "hollow"
        hollow.mkdir()
        pq.write_table(pa.table({}), hollow / "x.parquet")
        broken = tmp_path / "broken"
        broken.mkdir()
        (broken / "x.parquet").write_text("junk")
        paths = {
            "active_energy_cons": str(empty),
            "active_energy_prod": str(hollow),
            "max_active_power_cons": str(broken),
            "max_active_power_prod": str(tmp_path / "absent"),
        }
        report = jobs.import_meter_data(ready, str(tmp_path / "m"), paths, sources=list(paths))
        assert not report.ok
        for source, path in paths.items():
            assert path in report.sources[source].result.short_msg

    @pytest.mark.parametrize("unit", ["us", "ns"])
    def test_unsigned_ean_and_timestamps(self, spark, ready, tmp_path, unit):
        drop = golden.meter_drop(golden.ACTIVE_ENERGY)
        columns = {name: [r[name] for r in drop] for name in drop[0]}
        directory = tmp_path / "unsigned"
        directory.mkdir()
        table = pa.table(
            {
                **columns,
                "ean": pa.array(columns["ean"], pa.uint64()),
                "date_id": pa.array(columns["date_id"], pa.date32()).cast(pa.timestamp(unit)),
            }
        )
        pq.write_table(table, directory / "x.parquet")
        (directory / "success").mkdir()
        pq.write_table(table, directory / "success" / "old.parquet")
        root = str(tmp_path / "m")
        assert jobs.import_meter_data(ready, root, {"active_energy_cons": str(directory)}).ok
        assert self.read(spark, root) == golden.stored_meter_rows(golden.ACTIVE_ENERGY)


class TestMapFacilities:
    INTERVAL = "2025-11-01..2025-12-01"

    @staticmethod
    def links(store) -> dict[int, int]:
        rows = store.read("facility_customer_group_link").collect()
        assert {r.date_id for r in rows} <= {NOV}
        return {r.facility_id: r.customer_group_id for r in rows}

    @pytest.mark.parametrize(("present", "new", "known"), [(0, 10, 0), (2, 8, 2), (10, 0, 10)])
    def test_counts_and_rows(self, full_store, fill, present, new, known):
        old = [
            {"facility_id": f, "date_id": NOV, "customer_group_id": 9}
            for f in list(golden.LINKS)[:present]
        ]
        if old:
            fill(full_store, "facility_customer_group_link", old)
        report = jobs.map_facilities(full_store, self.INTERVAL)
        assert report.ok and report.warnings == ()
        assert report.result.short_msg == (
            f"Successfully imported {new} new facility customer group links and updated {known} "
            "existing facility customer group links in interval 2025-11-01 - 2025-12-01!"
        )
        assert self.links(full_store) == golden.LINKS

    def test_open_interval_takes_later_months(self, full_store):
        report = jobs.map_facilities(full_store, "2025-11-01")
        assert report.inserted == 11
        assert report.result.short_msg.endswith("in interval 2025-11-01 - None!")

    def change_group(self, store, fill, index, **values):
        groups = golden.rows(golden.CUSTOMER_GROUPS, "mapping_strategy_code")
        groups[index].update(values)
        fill(store, "customer_group", groups)

    def test_unmapped_contract_is_a_warning(self, full_store, fill):
        contracts = golden_contracts()
        contracts[1]["fuse_size"] = 15
        fill(full_store, "facility_contract", contracts)
        report = jobs.map_facilities(full_store, self.INTERVAL)
        assert report.ok and report.inserted == 9
        assert report.warnings == (
            "Facility contracts (1) could not be mapped to a customer group!",
        )
        assert [r.facility_id for r in report.violations.collect()] == [2]
        assert self.links(full_store) == {k: v for k, v in golden.LINKS.items() if k != 2}

    def test_group_without_product_is_skipped(self, full_store, fill):
        self.change_group(full_store, fill, 0, product_id=None)
        report = jobs.map_facilities(full_store, self.INTERVAL)
        assert report.ok and report.inserted == 9
        assert report.warnings == (
            "Required product_id param is None for customer_group_id=1\n"
            "Facility contracts (1) could not be mapped to a customer group!",
        )

    def test_group_without_minimum_is_skipped(self, full_store, fill):
        self.change_group(full_store, fill, 3, min_fuse_size=None)
        report = jobs.map_facilities(full_store, self.INTERVAL)
        assert report.warnings[0].startswith(
            "Required min_value param is None for customer_group_id=4\n"
        )

    def test_double_mapping_is_fatal(self, full_store, fill):
        self.change_group(full_store, fill, 1, not_product_id=None)
        report = jobs.map_facilities(full_store, self.INTERVAL)
        assert report.result.short_msg == "Found duplicate facility customer group links (1)!"
        assert [tuple(r) for r in report.violations.collect()] == [(1, NOV, 2)]
        assert self.links(full_store) == {}

    def test_all_groups_skipped(self, full_store, fill):
        groups = golden.rows(golden.CUSTOMER_GROUPS, "mapping_strategy_code")[:1]
        groups[0]["product_id"] = None
        fill(full_store, "customer_group", groups)
        report = jobs.map_facilities(full_store, self.INTERVAL)
        assert report.ok and (report.inserted, report.updated) == (0, 0)
        assert report.warnings[0].endswith("(10) could not be mapped to a customer group!")

    def test_no_input(self, store, fill, full_store):
        report = jobs.map_facilities(full_store, "2030-01-01..2030-02-01")
        assert report.result.short_msg == "No facility contracts exist!"

    def test_no_groups(self, store):
        assert jobs.map_facilities(store).result.short_msg == "No customer groups exist!"


def test_seeds_are_written_once(store):
    result = init_tables(store)
    assert not result.ok
    assert store.read("serie_type").count() == 20
    assert store.read("unit").count() == 33
    assert store.read("currency").count() == 2
    assert [r.code for r in store.read("customer_type").orderBy("customer_type_id").collect()] == [
        "private_person",
        "company",
    ]
