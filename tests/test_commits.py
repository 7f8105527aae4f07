"""What a commit looks at: the changes, the stored values they meet, and the parents they refer to."""

from __future__ import annotations

from datetime import date

import pytest

from tests import golden
from voltledger import schemas
from voltledger.operators import constraints
from voltledger.plans import jobs
from voltledger.sources.tables import TableStore

STORED = [(1, 10, "a"), (2, 20, "b"), (3, 30, None), (4, 40, None)]
SCHEMA = "id int, code int, name string"


@pytest.mark.parametrize("changes,codes,names", [
    ([(5, 50, "e")], [], []),
    ([(5, 20, "a")], [20], ["a"]),
    ([(2, 20, "b")], [], []),  # itself
    ([(2, 25, "x"), (5, 20, "b")], [], []),  # 2 gives its values up
    ([(1, 20, "b"), (2, 10, "a")], [], []),  # they swap
    ([(1, 20, "b")], [20], ["b"]),
    ([(5, 50, "e"), (6, 50, "e")], [50], ["e"]),
    ([(5, None, None), (6, None, None)], [], []),
    ([], [], []),
])
def test_changes_are_checked_like_the_whole_table(spark, changes, codes, names):
    stored, new = spark.createDataFrame(STORED, SCHEMA), spark.createDataFrame(changes, SCHEMA)
    merged = {row[0]: row for row in [*STORED, *changes]}.values()
    for col, at, wanted in (("code", 1, codes), ("name", 2, names)):
        found = constraints.unique_violations_of_changes(new, stored, ("id",), (col,)).collect()
        assert sorted(r[col] for r in found) == wanted
        values = [row[at] for row in merged if row[at] is not None]
        assert sorted({v for v in values if values.count(v) > 1}) == wanted


def test_the_stored_table_is_not_grouped(spark, tmp_path):
    path = str(tmp_path / "stored")
    spark.createDataFrame(STORED * 100, SCHEMA).write.parquet(path)
    new = spark.createDataFrame([(5, 50, "e")], SCHEMA)
    found = constraints.unique_violations_of_changes(new, spark.read.parquet(path), ("id",), ("code",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    semi, scan = plan.index("LeftSemi"), plan.rindex("parquet")
    assert plan.count("parquet") == 1 and "Aggregate" not in plan[semi:scan]


def test_only_a_table_written_by_hand_is_checked_whole(store, fill, write_drop, monkeypatch):
    """The first import finds rows that nobody checked; the next one knows that they are unique."""
    fill(store, "product", golden.rows(golden.PRODUCTS)[:2])
    whole = []
    original = constraints.unique_violations
    monkeypatch.setattr(constraints, "unique_violations", lambda df, cols: whole.append(len(df.columns)) or original(df, cols))
    assert not store.is_checked("product")
    assert jobs.import_products(store, write_drop([{"external_id": "x1", "name": "One", "description": None}])).ok
    assert store.is_checked("product")
    columns = len(schemas.PRODUCT.schema)
    assert whole == [columns] * 3
    whole.clear()
    assert jobs.import_products(store, write_drop([{"external_id": "x2", "name": "Two", "description": None}])).ok
    assert columns not in whole[1:]
    report = jobs.import_products(store, write_drop([{"external_id": "x3", "name": "One", "description": None}]))
    assert "names are not unique" in report.result.short_msg
    assert [r.name for r in report.violations.collect()] == ["One"]
    assert store.read("product").count() == 4


def contract(spark, facility_id: int, **other):
    row = dict(facility_id=facility_id, date_id=date(2025, 11, 1), customer_type_id=1, product_id=None, fuse_size=16)
    row |= other
    schema = schemas.struct(facility_id=schemas.LONG, date_id=schemas.DATE, customer_type_id=schemas.INT,
                            product_id=schemas.INT, fuse_size=schemas.INT)
    return spark.createDataFrame([tuple(row.values())], schema)


def test_an_orphan_contract_is_refused_with_its_key(full_store):
    spark, before = full_store.spark, full_store.read("facility_contract").count()
    report = jobs.save_rows(full_store, "facility_contract", contract(spark, 999).unionByName(contract(spark, 1)))
    assert not report.ok and "do not exist" in report.result.short_msg
    assert [tuple(r) for r in report.violations.collect()] == [("facility_id_fk", "999", 1)]
    report = jobs.save_rows(full_store, "facility_contract", contract(spark, 1, product_id=4711))
    assert [tuple(r) for r in report.violations.collect()] == [("product_id_fk", "4711", 1)]
    assert full_store.read("facility_contract").count() == before


def test_rows_are_saved_by_key(full_store):
    spark = full_store.spark
    stored = {(r.facility_id, r.date_id): r for r in full_store.read("facility_contract").collect()}
    changed = contract(spark, 1, fuse_size=63).unionByName(contract(spark, 1, date_id=date(2031, 1, 1)))
    report = jobs.save_rows(full_store, "facility_contract", changed)
    assert (report.ok, report.inserted, report.updated) == (True, 1, 1)
    now = {(r.facility_id, r.date_id): r for r in full_store.read("facility_contract").collect()}
    key = (1, date(2025, 11, 1))
    assert now[key].fuse_size == 63 and now[key].account_nr == stored[key].account_nr
    assert {k: v for k, v in now.items() if k != key and k[1].year < 2031} == {k: v for k, v in stored.items() if k != key}


@pytest.mark.parametrize("name,row,broken", [
    ("facility_contract", dict(date_id=date(2025, 11, 2)), "date_id_month_start (1)"),
    ("facility_contract", dict(customer_type_id=None), "customer_type_id_not_null (1)"),
])
def test_rows_that_break_a_constraint(full_store, name, row, broken):
    report = jobs.save_rows(full_store, name, contract(full_store.spark, 1, **row))
    assert not report.ok and broken in report.result.short_msg


def test_tariffs_can_be_saved(store: TableStore):
    spark = store.spark
    tariff = spark.createDataFrame([(1, "t", 1), (2, "u", 2)], "tariff_id int, name string, currency_id int")
    assert jobs.save_rows(store, "tariff", tariff).ok
    twice = spark.createDataFrame([(3, "u", 1)], "tariff_id int, name string, currency_id int")
    report = jobs.save_rows(store, "tariff", twice)
    assert "names are not unique" in report.result.short_msg
    groups = spark.createDataFrame([(1, 1, "g"), (2, 7, "h")], "tariff_cost_group_id int, tariff_id int, name string")
    report = jobs.save_rows(store, "tariff_cost_group", groups)
    assert [tuple(r) for r in report.violations.collect()] == [("tariff_id_fk", "7", 1)]
    assert jobs.save_rows(store, "tariff_cost_group", groups.where("tariff_id = 1")).inserted == 1
    without_name = groups.drop("name")
    assert not jobs.save_rows(store, "tariff_cost_group", without_name).ok


def test_all_constraints_take_two_scans(spark, tmp_path):
    path = str(tmp_path / "facilities")
    rows = [(1, 5, None, 1, "a", None), (2, 5, None, 9, "b", None), (2, 6, None, 9, None, None), (3, None, None, None, "", None)]
    spark.createDataFrame(rows, schemas.FACILITY.schema).write.parquet(path)
    parents = {"facility_type": spark.createDataFrame([(1,), (2,), (2,)], "facility_type_id int")}
    found = constraints.table_violations(spark.read.parquet(path), schemas.FACILITY, parents)
    assert {r.constraint: r.nr_violations for r in found.collect()} == {
        "facility_id_unique": 1, "ean_unique": 1, "facility_type_id_fk": 2, "ean_not_null": 1,
        "facility_type_id_not_null": 1}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
