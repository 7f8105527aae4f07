"""Interval texts: the table of valid and invalid ones, calendar rules, and the filter they become."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest

from voltledger.functions.intervals import (
    BUSINESS_TIMEZONE,
    Interval,
    IntervalError,
    filter_interval,
    resolve_interval,
)

ZONE = ZoneInfo(BUSINESS_TIMEZONE)
NOW = datetime(2025, 10, 20, 13, 37, 37, tzinfo=ZONE)


def at(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=ZONE)


# Texts and the bounds they stand for at NOW.
VALID = {
    "CY": (at(2025, 1, 1), None),
    "CM": (at(2025, 10, 1), None),
    "CD": (at(2025, 10, 20), None),
    "now": (NOW, None),
    "CM..CM": (at(2025, 10, 1), at(2025, 10, 1)),
    "CM-1M..CM+1M": (at(2025, 9, 1), at(2025, 11, 1)),
    "CM+1D..CD+1h": (at(2025, 10, 2), at(2025, 10, 20, 1)),
    "now-1s..now+1min": (at(2025, 10, 20, 13, 37, 36), at(2025, 10, 20, 13, 38, 37)),
    "2025-11-29": (at(2025, 11, 29), None),
    "2025-11-29T20:10": (at(2025, 11, 29, 20, 10), None),
    "2025-11-29 20:10:14": (at(2025, 11, 29, 20, 10, 14), None),
    "2025-11-29T20:11:15Z": (datetime(2025, 11, 29, 20, 11, 15, tzinfo=UTC), None),
    "2025-11-29..2025-11-30T14:35:24+01:00": (
        at(2025, 11, 29),
        datetime(2025, 11, 30, 14, 35, 24, tzinfo=timezone(timedelta(hours=1))),
    ),
}
INVALID = {
    "X": '"X" is not a valid relative or iso-formatted datetime!',
    "CX/b..CM+1D": '"CX/b" is not a valid relative or iso-formatted datetime!',
    "CM-1M..CM+1D..CM": 'Invalid date range expression: "CM-1M..CM+1D..CM"!',
    "CM-1h..CM-2h": (
        "end (2025-09-30 22:00:00+02:00) must be >= to start (2025-09-30 23:00:00+02:00)!"
    ),
    "2025-2-2": '"2025-2-2" is not a valid relative or iso-formatted datetime!',
    "2025/02/12 13.12": '"2025/02/12 13.12" is not a valid relative or iso-formatted datetime!',
    "CM+0M": '"CM+0M" is not a valid relative date point expression',
    "CM+1": '"CM+1" is not a valid relative date point expression',
}


@pytest.mark.parametrize("text", VALID)
def test_valid(spark, text):
    assert resolve_interval(spark, text, NOW) == Interval(*VALID[text])


@pytest.mark.parametrize("text", INVALID)
def test_invalid(spark, text):
    with pytest.raises(IntervalError) as error:
        resolve_interval(spark, text, NOW)
    assert str(error.value) == INVALID[text]


def test_offsets_agree_with_calendar_starts(spark):
    """pandas steps along calendar starts in the same way. The clock goes back on 26 October."""
    frequencies = {"Y": "YS", "M": "MS", "D": "D", "h": "h", "m": "min", "s": "s"}
    for now in (NOW, at(2025, 10, 26, 0, 30), at(2025, 3, 1), at(2024, 1, 1)):
        for unit, freq in frequencies.items():
            for amount in ("+1", "-1", "+5"):
                expected = pd.date_range(now, periods=2, freq=f"{amount}{freq}")[1]
                actual = resolve_interval(spark, f"now{amount}{unit}", now).start
                assert actual == expected.to_pydatetime(), (now, amount, unit)


def test_filters(spark):
    days = [date(2025, 9, 30), date(2025, 10, 1), date(2025, 10, 31), date(2025, 11, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date").selectExpr(
        "d", "CAST(d AS TIMESTAMP_NTZ) AS t"
    )
    for col in ("d", "t"):
        rows = filter_interval(df, col, "CM..CM+1M", NOW).collect()
        assert sorted(r.d for r in rows) == days[1:3]
        assert filter_interval(df, col, "CM", NOW).count() == 3


def test_timestamps_compare_as_instants(spark):
    df = spark.createDataFrame([("2025-09-30T21:59:59Z",), ("2025-09-30T22:00:00Z",)], "s string")
    df = df.selectExpr("CAST(s AS TIMESTAMP) AS t")
    assert filter_interval(df, "t", "CM", NOW).count() == 1


def test_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).selectExpr("id", "DATE'2025-10-01' AS d").write.parquet(path)
    plan = filter_interval(spark.read.parquet(path), "d", "CM-1M..CM", NOW)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,2025-09-01)" in text and "LessThan(d,2025-10-01)" in text
