"""Drops that arrive one after the other in one directory, and what a job leaves behind."""

from __future__ import annotations

import os
from datetime import date
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from voltledger.plans import jobs
from voltledger.sources.staging import shared_folder

EAN = 123456000000000001


def put(folder: Path, name: str, rows: list[dict]) -> str:
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.Table.from_pylist(rows), folder / name)
    return str(folder)


def contract(fuse_size: int, ean=EAN, code: str = "private_person") -> dict:
    return {"ean": ean, "date_id": date(2026, 1, 1), "customer_type_code": code, "fuse_size": fuse_size}


def fuse_sizes(store) -> list[int]:
    return [r.fuse_size for r in store.read("facility_contract").where("date_id = '2026-01-01'").collect()]


def staged(spark) -> set[str]:
    root = f"{shared_folder(spark)}/voltledger"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_correction_in_the_same_directory(full_store, tmp_path):
    path = put(tmp_path / "drops", "a.parquet", [contract(16)])
    assert jobs.import_contracts(full_store, path).inserted == 1
    put(tmp_path / "drops", "b.parquet", [contract(25)])
    assert jobs.import_contracts(full_store, path).updated == 1
    assert fuse_sizes(full_store) == [25]
    assert "No new parquet files" in jobs.import_contracts(full_store, path).result.short_msg


def test_a_rejected_file_is_offered_again(full_store, tmp_path):
    path = put(tmp_path / "drops", "a.parquet", [contract(16, code="municipality")])
    for _ in range(2):
        assert not jobs.import_contracts(full_store, path).ok
        assert fuse_sizes(full_store) == []
    put(tmp_path / "drops", "a.parquet", [contract(16)])
    assert jobs.import_contracts(full_store, path).ok
    assert fuse_sizes(full_store) == [16]


def test_names_with_pattern_characters(full_store, tmp_path):
    path = put(tmp_path / "in{1}", "d[1].parquet", [contract(16)])
    assert jobs.import_contracts(full_store, path).ok
    single = f"{put(tmp_path / 'other', 'e[1].parquet', [contract(20)])}/e[1].parquet"
    assert jobs.import_contracts(full_store, single).ok
    assert fuse_sizes(full_store) == [20]


@pytest.mark.parametrize("rows", [[contract(16)], [contract(16, ean="text")], [contract(16, ean=4)]])
def test_nothing_stays_staged(spark, full_store, tmp_path, rows):
    """After success, after an error of Spark, and after a rejection once its report is closed."""
    before = staged(spark)
    with jobs.import_contracts(full_store, put(tmp_path / "drops", "a.parquet", rows)) as report:
        if report.violations is not None:
            assert report.violations.count() == 1
    assert staged(spark) == before


def test_an_exception_leaves_nothing_staged(spark, full_store):
    before = staged(spark)
    with pytest.raises(ValueError):
        jobs.map_facilities(full_store, "no interval")
    assert staged(spark) == before


def test_stored_codes_stay_unique(store, fill, tmp_path):
    """The commit refuses a table in which a unique column repeats, whatever the drop looks like."""
    row = {"facility_type_id": 1, "ean_prod": None, "name": None, "description": None}
    fill(store, "facility", [{**row, "facility_id": i, "ean": 5} for i in (1, 2)])
    drop = [{"ean": 6, "facility_type_code": "consumption"}]
    report = jobs.import_facilities(store, put(tmp_path / "drops", "a.parquet", drop))
    assert not report.ok and "not unique" in report.result.short_msg
    assert store.read("facility").count() == 2
