"""Date intervals written as text, applied to tables as range filters.

An interval is ``start`` or ``start..end``, end exclusive. A point is an ISO date or timestamp, or a
base with an optional offset: ``now``, ``CY``, ``CM`` and ``CD`` (start of the current year, month
and day), then ``+`` or ``-``, a number and a unit out of ``Y M D h m s``. Example: ``CM-1M..CM``.

Years and months count calendar starts: a base that is not one is first moved on to the next, so
``now+1M`` on 20 October is 1 December at the same time of day. Days are calendar days; hours,
minutes and seconds are elapsed time, which matters on the days the clock changes.
"""

from __future__ import annotations

from datetime import UTC, datetime
from typing import NamedTuple
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltledger import messages

BUSINESS_TIMEZONE = "Europe/Stockholm"
MONTHS_PER_UNIT = {"M": 1, "Y": 12}
ELAPSED_UNITS = {"h": "hours", "m": "mins", "s": "secs"}
BASES = ("now", "CY", "CM", "CD")


class IntervalError(ValueError):
    """The text is not an interval."""


class Interval(NamedTuple):
    """Half-open interval of zone-aware timestamps; no end means open."""

    start: datetime
    end: datetime | None = None


def _wall_literal(moment: datetime) -> Column:
    return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def _shift_months(base: Column, months: int, unit: str) -> Column:
    """Move to the next month (or year) start unless already on one, then by whole months."""
    day = F.to_date(base)
    period = "month" if unit == "M" else "year"
    this_start = F.trunc(day, period)
    anchor = F.when(day == this_start, day).otherwise(
        F.add_months(this_start, MONTHS_PER_UNIT[unit])
    )
    time_of_day = base - day.cast("timestamp_ntz")
    return F.add_months(anchor, months).cast("timestamp_ntz") + time_of_day


def _shift_elapsed(base: Column, amount: int, unit: str, tz: str) -> Column:
    """Add elapsed time: by way of UTC, so a clock change in between does not count."""
    zone, utc = F.lit(tz), F.lit("UTC")
    moved = F.convert_timezone(zone, utc, base) + F.make_dt_interval(
        **{ELAPSED_UNITS[unit]: F.lit(amount)}
    )
    return F.convert_timezone(utc, zone, moved)


def _read_offset(rest: str) -> tuple[str, str, str] | None:
    """Sign, number and unit of what follows a base, each empty where it is not there. Text after
    the unit is ignored ("now+1min" is one minute); None when nothing of an offset follows."""
    sign = rest[:1] if rest[:1] in ("+", "-") else ""
    rest = rest[len(sign) :]
    number = rest[: len(rest) - len(rest.lstrip("0123456789"))]
    unit = rest[len(number) :][:1]
    if unit not in (*MONTHS_PER_UNIT, "D", *ELAPSED_UNITS):
        unit = ""
    return (sign, number, unit) if sign or number or unit else None


def _relative_point(text: str, now: datetime, tz: str) -> Column | None:
    """Wall-clock timestamp in ``tz`` as a foldable expression, or None when not relative."""
    base = next((b for b in BASES if text.startswith(b)), None)
    if base is None:
        return None
    offset = _read_offset(text[len(base) :])
    wall = _wall_literal(now)
    point = {
        "now": wall,
        "CY": F.trunc(F.to_date(wall), "year").cast("timestamp_ntz"),
        "CM": F.trunc(F.to_date(wall), "month").cast("timestamp_ntz"),
        "CD": F.to_date(wall).cast("timestamp_ntz"),
    }[base]
    if offset is None:
        return point
    sign, number, unit = offset
    if not (sign and number and unit and int(number)):
        raise IntervalError(messages.INVALID_RELATIVE_POINT.format(text=text))
    amount = int(sign + number)
    if unit in MONTHS_PER_UNIT:
        return _shift_months(point, amount * MONTHS_PER_UNIT[unit], unit)
    if unit == "D":
        return point + F.make_dt_interval(days=F.lit(amount))
    return _shift_elapsed(point, amount, unit, tz)


def resolve_interval(
    spark: SparkSession, text: str, now: datetime | None = None, tz: str = BUSINESS_TIMEZONE
) -> Interval:
    """Evaluate an interval text to its two bounds with a one-row query."""
    zone = ZoneInfo(tz)
    if now is None:
        now = datetime.now(zone)
    # A time without a zone is business time.
    now = now.astimezone(zone) if now.tzinfo else now.replace(tzinfo=zone)
    points = text.split("..")
    if len(points) > 2:
        raise IntervalError(messages.INVALID_INTERVAL.format(text=text))

    bounds: list[datetime | None] = [None] * len(points)
    relative: dict[int, Column] = {}
    for i, point in enumerate(points):
        wall = _relative_point(point, now, tz)
        if wall is not None:
            relative[i] = F.convert_timezone(F.lit(tz), F.lit("UTC"), wall).alias(f"p{i}")
            continue
        try:
            moment = datetime.fromisoformat(point)
        except ValueError:
            raise IntervalError(messages.INVALID_POINT.format(text=point)) from None
        bounds[i] = moment if moment.tzinfo else moment.replace(tzinfo=zone)
    if relative:
        row = spark.range(1).select(*relative.values()).first()
        for i in relative:
            bounds[i] = row[f"p{i}"].replace(tzinfo=UTC).astimezone(zone)

    interval = Interval(*bounds)
    if interval.end is not None and interval.end < interval.start:
        raise IntervalError(
            messages.END_BEFORE_START.format(end=interval.end, start=interval.start)
        )
    return interval


def _bound_literal(moment: datetime, dtype: T.DataType, tz: str) -> Column:
    if isinstance(dtype, T.DateType):
        return F.lit(moment.date())
    if isinstance(dtype, T.TimestampNTZType):
        return _wall_literal(moment.astimezone(ZoneInfo(tz)))
    return F.lit(moment)


def in_interval(df: DataFrame, col: str, interval: Interval, tz: str = BUSINESS_TIMEZONE) -> Column:
    """``start <= col < end`` with literal bounds of the column's own type, so it reaches the scan."""
    dtype = df.schema[col].dataType
    condition = F.col(col) >= _bound_literal(interval.start, dtype, tz)
    if interval.end is not None:
        condition &= F.col(col) < _bound_literal(interval.end, dtype, tz)
    return condition


def filter_interval(
    df: DataFrame,
    col: str,
    text: str,
    now: datetime | None = None,
    tz: str = BUSINESS_TIMEZONE,
) -> DataFrame:
    """Rows of ``df`` whose date or timestamp column lies in the interval."""
    interval = resolve_interval(df.sparkSession, text, now, tz)
    return df.where(in_interval(df, col, interval, tz))
