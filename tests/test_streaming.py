"""Incremental import: unseen files only, whole drops, corrections by month."""

from __future__ import annotations

import os

import pytest

from tests import golden
from tests.golden import DEC, NOV
from voltledger.sources.meter_store import read_meter_store
from voltledger.streaming.meter_drops import import_new_meter_drops


@pytest.fixture
def run(store, fill, tmp_path):
    fill(store, "facility", golden.rows(golden.FACILITIES, "facility_type_code"))
    source = str(tmp_path / "incoming drops")
    root = str(tmp_path / "meter_data")

    def run(archive_dir=None):
        return import_new_meter_drops(
            store, source, root, str(tmp_path / "checkpoint"), archive_dir
        )

    run.source, run.root = source, root
    return run


def stored(spark, root):
    df = read_meter_store(spark, root).select(
        "serie_type_code", "date_id", "facility_id", "ean", "serie_value", "status_id"
    )
    return sorted(tuple(r) for r in df.collect())


def test_new_files_only(spark, run, write_drop):
    write_drop(golden.meter_drop(golden.ACTIVE_ENERGY), path=run.source)
    (first,) = run()
    assert first.ok and first.inserted == 10
    assert run() == []
    write_drop(golden.meter_drop(golden.REACTIVE_POWER), path=run.source)
    (second,) = run()
    assert second.inserted == 12
    assert stored(spark, run.root) == golden.stored_meter_rows(
        golden.ACTIVE_ENERGY, golden.REACTIVE_POWER
    )


def test_files_of_one_run_are_one_drop(run, write_drop):
    """The same key in two files is a duplicate."""
    rows = golden.meter_drop(golden.ACTIVE_ENERGY)
    write_drop(rows, path=run.source)
    write_drop(rows[:2], path=run.source)
    (report,) = run()
    assert report.result.short_msg == (
        "Found duplicate rows (2) over columns: ('serie_type_code', 'ean', 'date_id')!"
    )
    assert report.violations.count() == 2
    assert not os.path.exists(run.root)


def test_rejected_drop_does_not_block_its_correction(spark, run, write_drop):
    rows = golden.meter_drop(golden.ACTIVE_ENERGY)
    bad = [dict(r) for r in rows]
    bad[0]["ean"] = 1
    write_drop(bad, path=run.source)
    (report,) = run()
    assert not report.ok
    assert [r.ean for r in report.violations.collect()] == [1]
    write_drop(rows, path=run.source)
    (report,) = run()
    assert report.ok
    assert stored(spark, run.root) == golden.stored_meter_rows(golden.ACTIVE_ENERGY)


def test_correction_replaces_a_month(spark, run, write_drop):
    rows = golden.meter_drop(golden.REACTIVE_POWER)
    write_drop(rows, path=run.source)
    run()
    write_drop([{**rows[11], "serie_value": 2.25}], path=run.source)
    run()
    kept = stored(spark, run.root)
    assert [(r[2], float(r[4])) for r in kept if r[1] == DEC] == [(2, 2.25)]
    assert len([r for r in kept if r[1] == NOV]) == 10


def test_archived_files_are_not_needed_again(spark, run, write_drop, tmp_path):
    archive = str(tmp_path / "archive")
    write_drop(golden.meter_drop(golden.ACTIVE_ENERGY), path=run.source)
    run(archive)
    write_drop(golden.meter_drop(golden.REACTIVE_POWER), path=run.source)
    (report,) = run(archive)
    assert report.ok
    assert len(stored(spark, run.root)) == 22


def test_no_files(run):
    (report,) = run()
    assert not report.ok and run.source in report.result.short_msg


def test_rejected_drop_passes_once_its_facility_exists(spark, run, store, fill, write_drop):
    """The good file of the drop is not lost either, and no new file is needed."""
    rows = golden.meter_drop(golden.ACTIVE_ENERGY)
    known = store.read("facility").where("facility_id > 1").collect()
    everyone = golden.rows(golden.FACILITIES, "facility_type_code")
    fill(store, "facility", [row.asDict() for row in known])
    write_drop(rows[:1], path=run.source)
    write_drop(rows[1:], path=run.source)
    assert [report.ok for report in run()] == [False]
    assert [report.ok for report in run()] == [False]
    fill(store, "facility", everyone)
    assert [report.ok for report in run()] == [True]
    assert stored(spark, run.root) == golden.stored_meter_rows(golden.ACTIVE_ENERGY)
    assert run() == []


def test_rejected_drop_never_overwrites_a_newer_one(spark, run, store, fill, write_drop):
    rows = golden.meter_drop(golden.ACTIVE_ENERGY)
    everyone = golden.rows(golden.FACILITIES, "facility_type_code")
    old = [{**rows[0], "serie_value": 77.0}, {**rows[1], "ean": 1}]
    write_drop(old, path=run.source)
    run()
    write_drop(rows, path=run.source)
    (report,) = run()
    assert report.ok and "not tried again" in report.warnings[0]
    fill(store, "facility", [*everyone, {**everyone[0], "facility_id": 99, "ean": 1}])
    assert run() == []
    assert stored(spark, run.root) == golden.stored_meter_rows(golden.ACTIVE_ENERGY)


def test_rejected_drop_gives_way_by_month_only(spark, run, store, fill, write_drop):
    """Two months are rejected, then the second one is corrected: the first one still arrives."""
    rows = golden.meter_drop(golden.REACTIVE_POWER)
    everyone = golden.rows(golden.FACILITIES, "facility_type_code")
    november, december = ([r for r in rows if r["date_id"] == m] for m in (NOV, DEC))
    old = [{**r, "serie_value": 77.0} for r in november + december] + [{**november[0], "ean": 1, "serie_value": 5.0}]
    write_drop(old, path=run.source)
    assert [report.ok for report in run()] == [False]
    write_drop(december, path=run.source)
    new, again = run()
    assert new.ok and "tried again without max_reactive_power_cons 2025-12-01" in new.warnings[0]
    assert not again.ok
    assert not run()[0].ok, "remembered over runs"
    fill(store, "facility", [*everyone, {**everyone[0], "facility_id": 99, "ean": 1}])
    assert [report.ok for report in run()] == [True]
    kept = stored(spark, run.root)
    assert {float(r[4]) for r in kept if r[1] == NOV} == {77.0, 5.0}
    assert [r for r in kept if r[1] == DEC] == [r for r in golden.stored_meter_rows(golden.REACTIVE_POWER) if r[1] == DEC]
    assert run() == []
