"""Checks over import drops: missing values, duplicate keys, dates that are not month starts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from voltledger import messages
from voltledger.functions.conversion import has_required_columns
from voltledger.functions.ordering import Order, ordered
from voltledger.results import Checked, OperationResult


def any_null(cols: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in cols])


def missing_values(df: DataFrame, cols: Sequence[str], order_by: Order | None = None) -> DataFrame:
    """Rows with a null in any of ``cols``, showing those columns."""
    return ordered(df.where(any_null(cols)).select(*cols), order_by)


def duplicate_rows(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    count_col: str = "nr_duplicates",
    exclude_nulls: Sequence[str] | None = None,
    order_by: Order | None = None,
) -> DataFrame:
    """Keys that occur more than once, with their count. Nulls are equal to each other here.

    ``exclude_nulls`` leaves out keys in which all of the listed columns are null. The count is
    aggregated before the shuffle, so a key with very many rows costs one row per task.
    """
    cols = list(cols or df.columns)
    if exclude_nulls:
        df = df.where(reduce(or_, [F.col(c).isNotNull() for c in exclude_nulls]))
    counted = df.groupBy(*cols).agg(F.count("*").alias(count_col))
    return ordered(counted.where(F.col(count_col) > 1), order_by)


def not_at_start_of_month(
    df: DataFrame,
    date_col: str,
    display_cols: Sequence[str] | None = None,
    order_by: Order | None = None,
) -> DataFrame:
    """Rows whose date is not the first of a month. A null date is not reported."""
    rows = df.where(F.dayofmonth(date_col) != 1)
    return ordered(rows.select(*display_cols) if display_cols else rows, order_by)


def _outcome(violations: DataFrame, message: str, cols: Sequence[str] = ()) -> Checked:
    n = violations.count()
    if n == 0:
        return Checked(OperationResult())
    return Checked(OperationResult.failed(message.format(n=n, cols=tuple(cols))), violations)


def validate_missing_values(
    df: DataFrame, cols: Sequence[str], order_by: Order | None = None
) -> Checked:
    return _outcome(missing_values(df, cols, order_by), messages.MISSING_VALUES, cols)


def validate_duplicate_rows(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    count_col: str = "nr_duplicates",
    exclude_nulls: Sequence[str] | None = None,
    order_by: Order | None = None,
) -> Checked:
    duplicates = duplicate_rows(df, cols, count_col, exclude_nulls, order_by)
    return _outcome(duplicates, messages.DUPLICATE_ROWS, cols or df.columns)


def validate_at_start_of_month(
    df: DataFrame,
    date_col: str,
    display_cols: Sequence[str] | None = None,
    order_by: Order | None = None,
) -> Checked:
    rows = not_at_start_of_month(df, date_col, display_cols, order_by)
    return _outcome(rows, messages.NOT_AT_START_OF_MONTH)


@dataclass(frozen=True)
class UniqueKey:
    """Columns that must not repeat; all-null keys may be exempt and the columns may be absent."""

    cols: tuple[str, ...]
    order_by: tuple[tuple[str, str], ...] = ()
    exclude_nulls: tuple[str, ...] = ()
    optional: bool = False


@dataclass(frozen=True)
class DropRules:
    """What a drop must satisfy as a whole before any row of it is used."""

    required: tuple[str, ...]
    unique: tuple[UniqueKey, ...]
    order_by: tuple[tuple[str, str], ...] = field(default=())
    month_start: str | None = None


PRODUCT_RULES = DropRules(
    required=("external_id", "name"),
    unique=(
        UniqueKey(("external_id",), (("external_id", "ASC"),)),
        UniqueKey(("name",), (("name", "ASC"),)),
    ),
    order_by=(("external_id", "ASC"),),
)
FACILITY_RULES = DropRules(
    required=("ean", "facility_type_code"),
    unique=(
        UniqueKey(("ean",), (("ean", "ASC"),)),
        UniqueKey(("ean_prod",), (("ean_prod", "ASC"),), exclude_nulls=("ean_prod",), optional=True),
    ),
    order_by=(("ean", "ASC"), ("facility_type_code", "ASC")),
)
CONTRACT_RULES = DropRules(
    required=("ean", "date_id", "customer_type_code"),
    unique=(UniqueKey(("ean", "date_id"), (("ean", "ASC"), ("date_id", "ASC"))),),
    order_by=(("ean", "ASC"), ("date_id", "ASC")),
    month_start="date_id",
)
METER_RULES = DropRules(
    required=("serie_type_code", "ean", "date_id", "serie_value"),
    unique=(UniqueKey(("serie_type_code", "ean", "date_id"), (("ean", "ASC"), ("date_id", "ASC"))),),
    order_by=(("ean", "ASC"), ("date_id", "ASC")),
    month_start="date_id",
)


def drop_profile(df: DataFrame, rules: DropRules) -> DataFrame:
    """Everything that needs no grouping, in one pass: row count, rows with missing values, rows not
    at the start of a month, first and last date."""
    aggregates = [
        F.count("*").alias("nr_rows"),
        F.count_if(any_null(rules.required)).alias("nr_missing"),
    ]
    if rules.month_start is not None:
        date = F.col(rules.month_start)
        aggregates += [
            F.count_if(F.dayofmonth(date) != 1).alias("nr_not_month_start"),
            F.min(date).cast("date").alias("first_date"),
            F.max(date).cast("date").alias("last_date"),
        ]
    return df.agg(*aggregates)


def check_name(key: UniqueKey) -> str:
    return f"duplicate_{'_'.join(key.cols)}"


def duplicate_counts(df: DataFrame, rules: DropRules) -> DataFrame:
    """One row per unique key whose columns are there: check name and number of repeated keys."""
    counts = []
    for key in rules.unique:
        if key.optional and not set(key.cols) <= set(df.columns):
            continue
        duplicates = duplicate_rows(df, key.cols, exclude_nulls=key.exclude_nulls)
        n = duplicates.agg(F.count("*").alias("nr_violations"))
        counts.append(n.select(F.lit(check_name(key)).alias("check"), "nr_violations"))
    return reduce(DataFrame.unionByName, counts)


class CheckedDrop(NamedTuple):
    """The first failing check of a drop, and its profile when the columns were there."""

    result: OperationResult
    violations: DataFrame | None = None
    profile: Row | None = None


def check_drop(df: DataFrame, rules: DropRules) -> CheckedDrop:
    """Required columns, missing values, duplicates, month starts: stop at the first that fails.

    One scan serves the counts and one aggregation each key, the keys together in one job; the frame
    of violations is built only for the check that failed and stays lazy.
    """
    result = has_required_columns(df.columns, rules.required)
    if not result.ok:
        return CheckedDrop(result)

    profile = drop_profile(df, rules).first()
    if profile.nr_missing > 0:
        return judge_drop(df, rules, profile, {})
    repeated = {row.check: row.nr_violations for row in duplicate_counts(df, rules).collect()}
    return judge_drop(df, rules, profile, repeated)


def judge_drop(
    df: DataFrame, rules: DropRules, profile: Row, repeated: Mapping[str, int]
) -> CheckedDrop:
    """The first failing check, given the profile of a drop and how many keys repeat by check."""
    if profile.nr_missing > 0:
        message = messages.MISSING_VALUES.format(n=profile.nr_missing, cols=rules.required)
        rows = missing_values(df, rules.required, rules.order_by)
        return CheckedDrop(OperationResult.failed(message), rows, profile)

    for key in rules.unique:
        n = repeated.get(check_name(key), 0)
        if n > 0:
            message = messages.DUPLICATE_ROWS.format(n=n, cols=key.cols)
            rows = duplicate_rows(
                df, key.cols, exclude_nulls=key.exclude_nulls, order_by=key.order_by
            )
            return CheckedDrop(OperationResult.failed(message), rows, profile)

    if rules.month_start is not None and profile.nr_not_month_start > 0:
        message = messages.NOT_AT_START_OF_MONTH.format(n=profile.nr_not_month_start)
        rows = not_at_start_of_month(df, rules.month_start, rules.required, rules.order_by)
        return CheckedDrop(OperationResult.failed(message), rows, profile)

    return CheckedDrop(OperationResult(), None, profile)


def import_interval(df: DataFrame, date_col: str = "date_id") -> DataFrame:
    """First and last month of a contract drop, one row; nulls for an empty drop."""
    return df.agg(
        F.min(date_col).cast("date").alias("start_date"),
        F.max(date_col).cast("date").alias("end_date"),
    )


def drop_report(df: DataFrame, rules: DropRules) -> DataFrame:
    """All checks of a drop side by side, without stopping: check name and number of violations."""
    names = {"nr_missing": "missing_values", "nr_not_month_start": "not_at_start_of_month"}
    profile = drop_profile(df, rules)
    counted = [c for c in names if c in profile.columns]
    report = (
        profile.select(*[F.col(c).alias(names[c]) for c in counted])
        .unpivot([], [names[c] for c in counted], "check", "nr_violations")
    )
    return report.unionByName(duplicate_counts(df, rules))
