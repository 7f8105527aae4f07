"""Drops that must be refused although they look right before their values are cast."""

from __future__ import annotations

from datetime import date, datetime
from zoneinfo import ZoneInfo

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from voltledger.plans import jobs

EAN = 123456000000000001


def contract(**changes) -> dict:
    row = {"ean": EAN, "date_id": date(2026, 1, 1), "customer_type_code": "private_person"}
    return row | changes


def write(tmp_path, rows: list[dict], name: str = "drop") -> str:
    folder = tmp_path / name
    folder.mkdir(parents=True)
    pq.write_table(pa.Table.from_pylist(rows), folder / "a.parquet")
    return str(folder)


@pytest.mark.parametrize("month", [20251101, 1_761_955_200_000_000_000])
def test_plain_numbers_are_no_months(full_store, tmp_path, month):
    before = full_store.read("facility_contract").count()
    report = jobs.import_contracts(full_store, write(tmp_path, [contract(date_id=month)]))
    assert not report.result.ok and "not a number" in f"{report.result.short_msg}{report.result.long_msg}"
    assert full_store.read("facility_contract").count() == before


def test_two_times_of_a_day_are_one_month(full_store, tmp_path):
    rows = [contract(date_id=datetime(2026, 1, 1, hour)) for hour in (0, 12)]
    report = jobs.import_contracts(full_store, write(tmp_path, rows))
    assert not report.result.ok and "duplicate rows (1)" in report.result.short_msg


def test_codes_that_round_to_one_are_repeated(store, tmp_path):
    rows = [{"ean": e, "facility_type_code": "consumption"} for e in (900.0, 900.4)]
    report = jobs.import_facilities(store, write(tmp_path, rows))
    assert not report.result.ok and "duplicate rows (1)" in report.result.short_msg


def meter(value=1.5, ean=EAN) -> dict:
    return {"serie_type_code": "active_energy_cons", "ean": ean, "date_id": date(2025, 11, 1), "serie_value": value}


@pytest.mark.parametrize("value", [float("nan"), float("inf")])
def test_values_must_be_finite(full_store, tmp_path, value):
    path = write(tmp_path, [meter(value)])
    report = jobs.import_meter_data(full_store, str(tmp_path / "out"), {"active_energy_cons": path}, ["active_energy_cons"])
    assert not report.ok and not (tmp_path / "out").exists()


def test_a_source_with_texts_for_numbers_leaves_the_others_alone(full_store, tmp_path):
    bad, good = "active_energy_cons", "active_energy_prod"
    paths = {bad: write(tmp_path, [meter(ean="no number")], "bad"), good: write(tmp_path, [meter()], "good")}
    report = jobs.import_meter_data(full_store, str(tmp_path / "out"), paths, [bad, good])
    assert report.ok and not report.sources[bad].ok and report.sources[good].ok


def nano_months(tmp_path, name: str, zone: str | None, month: datetime) -> str:
    """A contract drop whose months are in nanoseconds."""
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    moment = month if zone is None else month.replace(tzinfo=ZoneInfo(zone))
    months = pa.array([moment], pa.timestamp("ns", tz=zone))
    table = pa.table({"ean": [EAN], "date_id": months, "customer_type_code": ["private_person"]})
    pq.write_table(table, folder / f"{zone is None}.parquet")
    return str(folder)


@pytest.mark.parametrize("zone", [None, "Europe/Stockholm"])
@pytest.mark.parametrize("session_zone", ["Europe/Stockholm", "UTC"])
def test_nanosecond_months_are_wall_time_or_moments_as_the_file_says(full_store, tmp_path, zone, session_zone):
    spark = full_store.spark
    path = nano_months(tmp_path, "drop", zone, datetime(2026, 7, 1))
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        report = jobs.import_contracts(full_store, path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert report.result.ok == (zone in (None, session_zone))
    if report.result.ok:
        assert full_store.read("facility_contract", [date(2026, 7, 1)]).count() == 1


def test_nanosecond_months_of_two_kinds_are_refused(full_store, tmp_path):
    for zone in (None, "UTC"):
        path = nano_months(tmp_path, "drop", zone, datetime(2026, 7, 1))
    report = jobs.import_contracts(full_store, path)
    assert not report.result.ok and "wall time in others" in f"{report.result.short_msg}{report.result.long_msg}"
