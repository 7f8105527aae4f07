"""The five jobs: import products, facilities, contracts and meter data, and map facilities.

A job checks its whole input before it writes anything. Frames that are used more than once are
written to the staging folder and read back, so no result hangs on a cached block of an executor.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import wraps
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltledger import messages, schemas
from voltledger.functions.conversion import cast_in_place, conform, has_required_columns
from voltledger.functions.intervals import BUSINESS_TIMEZONE, resolve_interval
from voltledger.functions.ordering import ordered
from voltledger.operators import checks, constraints, grouping, resolve, upsert
from voltledger.results import SPARK_ERRORS, JobReport, OperationResult
from voltledger.schemas import FACILITY, FACILITY_CONTRACT, LINK, PRODUCT
from voltledger.sinks.meter_store import write_meter_store
from voltledger.sources import tables
from voltledger.sources.drops import load_drop
from voltledger.sources.ledger import DropLedger
from voltledger.sources.staging import Staging
from voltledger.sources.tables import TableStore

# The names of the meter data sources.
METER_SOURCES = (
    "active_energy_cons",
    "active_energy_prod",
    "max_active_power_cons",
    "max_active_power_prod",
    "max_reactive_power_cons",
    "max_reactive_power_prod",
    "max_deb_active_power_cons_high_load",
    "max_deb_active_power_cons_low_load",
)

BY_EAN = (("ean", "ASC"), ("date_id", "ASC"))
BY_MONTH = (("date_id", "ASC"), ("facility_id", "ASC"))


def _failed(message: str, violations: DataFrame | None = None) -> JobReport:
    return JobReport(OperationResult.failed(message), violations=violations)


def _rejected(checked: checks.CheckedDrop) -> JobReport:
    return JobReport(checked.result, violations=checked.violations)


class Drop(NamedTuple):
    """The rows of a drop that were not imported before, and the files they come from."""

    rows: DataFrame | None
    result: OperationResult
    ledger: DropLedger
    files: list[Row] | None = None

    def done(self) -> None:
        self.ledger.enter(self.files)


def _open(store: TableStore, path: str, method: str, job: str) -> Drop:
    """Of a directory the files that ``job`` has not imported yet; a path that names a file, that file."""
    ledger, files = DropLedger(store, job), None
    if method == "file":
        try:
            files = ledger.unseen(path)
        except SPARK_ERRORS as e:
            text = f'Could not read parquet files from "{path}"!'
            return Drop(None, OperationResult.from_error(text, e), ledger)
        if files == []:
            return Drop(None, OperationResult.failed(f'No new parquet files in "{path}"!'), ledger)
    names = None if files is None else [file.file for file in files]
    rows, result = load_drop(store.spark, path, method, names)
    return Drop(rows, result, ledger, files)


def _load(
    store: TableStore, path: str, method: str, rules: checks.DropRules, schema: T.StructType, job: str
) -> tuple[Drop, checks.CheckedDrop]:
    """The drop in the types it is stored in, and its checks: what becomes equal or null by the cast
    counts as such."""
    drop = _open(store, path, method, job)
    if not drop.result.ok:
        return drop, checks.CheckedDrop(drop.result)
    drop = drop._replace(rows=cast_in_place(drop.rows, schema))
    return drop, checks.check_drop(drop.rows, rules)


def _reported(job):
    """A job whose data make Spark fail (a text where a number must be) ends with a failed result."""

    @wraps(job)
    def run(*args, **kwargs) -> JobReport:
        try:
            return job(*args, **kwargs)
        except SPARK_ERRORS as e:
            return JobReport(OperationResult.from_error("Could not process the data!", e))

    return run


def _staged(label: str):
    """Give a job a staging folder. It is gone when the job ends, by an error too, unless the report
    hands out rows: then closing the report removes it."""

    def wrap(job):
        reported = _reported(job)

        @wraps(job)
        def run(store: TableStore, *args, **kwargs) -> JobReport:
            staging, report = Staging(store.spark, label), None
            try:
                report = reported(store, *args, staging=staging, **kwargs)
                return report
            finally:
                if report is None or report.violations is None:
                    staging.drop()
                else:
                    report.on_close = staging.drop

        return run

    return wrap


def _lacking(name: str, new: DataFrame, known: DataFrame) -> JobReport | None:
    """A failed report if columns are missing that inserts or updates of the table need."""
    for result in (upsert.check_insert_columns(name, new), upsert.check_update_columns(name, known)):
        if not result.ok:
            return JobReport(result)
    return None


def _not_unique(table: schemas.Table, cols: tuple[str, ...], repeated: DataFrame) -> JobReport:
    what = "names" if cols == ("name",) else f"values of {cols}"
    return _failed(f'Unable to save to table "{table.name}", {what} are not unique!', repeated)


def _commit_unique(
    store: TableStore, table: schemas.Table, stored: DataFrame, changes: DataFrame, staging: Staging
) -> JobReport | None:
    """Publish a table with its changes if its unique columns stay unique, else a failed report with what
    repeats. Of a version that was checked when it was written only the changes are looked at; another
    one (written by hand) is checked whole once."""
    merged = upsert.upsert_by_key(stored, changes, table.key)
    whole = not store.is_checked(table.name)
    if whole:
        merged = staging.write(merged)
    for cols in (table.key, *table.unique):
        if whole:
            repeated = constraints.unique_violations(merged, cols)
        elif cols == table.key:
            repeated = constraints.unique_violations(changes, cols)
        elif set(cols) <= set(changes.columns):
            repeated = constraints.unique_violations_of_changes(changes, stored, table.key, cols)
        else:
            continue  # values that the changes do not bring stay as they are
        if not repeated.isEmpty():
            return _not_unique(table, cols, repeated)
    store.commit(table.name, merged, checked=True)
    return None


@_staged("products")
def import_products(
    store: TableStore, path: str, method: str = "file", *, staging: Staging
) -> JobReport:
    """Insert new products and update the known ones."""
    drop, checked = _load(
        store, path, method, checks.PRODUCT_RULES, schemas.PRODUCT_DROP, "product"
    )
    if not checked.result.ok:
        return _rejected(checked)

    stored = store.read("product")
    resolved = staging.write(resolve.resolve_products(drop.rows, stored))
    new, known = resolve.split_products(resolved)[:2]
    if (lacking := _lacking("product", new, known)) is not None:
        return lacking
    nr_new = new.count()
    numbered = upsert.assign_ids(
        new, "external_id", "product_id", upsert.max_id(stored, "product_id") + 1, staging
    )
    changes = known.unionByName(numbered)
    if (refused := _commit_unique(store, PRODUCT, stored, changes, staging)) is not None:
        return refused
    drop.done()
    return _imported(nr_new, checked, "products")


def _imported(nr_new: int, checked: checks.CheckedDrop, noun: str) -> JobReport:
    nr_known = checked.profile.nr_rows - nr_new
    text = messages.IMPORTED.format(new=nr_new, known=nr_known, noun=noun)
    return JobReport(OperationResult(short_msg=text), nr_new, nr_known)


@_staged("facilities")
def import_facilities(
    store: TableStore, path: str, method: str = "file", *, staging: Staging
) -> JobReport:
    """Insert new facilities and update the known ones."""
    drop, checked = _load(
        store, path, method, checks.FACILITY_RULES, schemas.FACILITY_DROP, "facility"
    )
    if not checked.result.ok:
        return _rejected(checked)

    stored = store.read("facility")
    resolved = staging.write(
        resolve.resolve_facilities(drop.rows, stored, store.read("facility_type"))
    )
    new, known, invalid = resolve.split_facilities(resolved)
    if (lacking := _lacking("facility", new, known)) is not None:
        return lacking
    counts = resolved.agg(
        F.count_if(F.col("facility_id").isNull()).alias("new"),
        F.count_if(F.col("facility_type_id").isNull()).alias("invalid"),
    ).first()
    if counts.invalid > 0:
        return _failed(messages.INVALID_FACILITY_TYPE.format(n=counts.invalid), invalid)

    numbered = upsert.assign_ids(
        new, "ean", "facility_id", upsert.max_id(stored, "facility_id") + 1, staging
    )
    changes = known.unionByName(numbered)
    if (refused := _commit_unique(store, FACILITY, stored, changes, staging)) is not None:
        return refused
    drop.done()
    return _imported(counts.new, checked, "facilities")


def _months(df: DataFrame) -> list[date]:
    """The months of checked rows: at most one value per calendar month they span."""
    return [row.date_id for row in df.select("date_id").distinct().collect()]


def _merge_months(
    store: TableStore, name: str, changes: DataFrame, key: tuple[str, ...], nr_changes: int
) -> tuple[int, int]:
    """Merge rows into the months they belong to; other months are neither read nor written."""
    months = _months(changes)
    if not months:
        return 0, 0
    stored = store.read(name, months)
    before = stored.count()
    store.commit(name, upsert.upsert_by_key(stored, changes, key))
    inserted = store.read(name, months).count() - before
    return inserted, nr_changes - inserted


@_staged("rows")
def save_rows(store: TableStore, name: str, rows: DataFrame, *, staging: Staging) -> JobReport:
    """Insert or update rows of any table by primary key, for instance customer groups and tariffs.

    Nothing is written unless all constraints of the table hold for the rows: required values, first days of
    months, checks, unique columns and foreign keys, whose parents are looked up in the store. Columns that the
    rows lack stay as they are, and are null in new rows.
    """
    table = schemas.TABLES[name]
    required = has_required_columns(rows.columns, (*table.key, *table.not_null))
    if not required.ok:
        return JobReport(required)
    known = [c for c in rows.columns if c in table.schema.names]
    rows = staging.write(cast_in_place(rows.select(*known), table.schema))
    broken = constraints.row_violations(conform(rows, table.schema), table)
    counts = {c: n for c, n in broken.first().asDict().items() if n > 0}
    if counts:
        listed = ", ".join(f"{c} ({n})" for c, n in counts.items())
        return _failed(f'Unable to save to table "{name}", rows break: {listed}!')
    lacking = constraints.orphans(rows, table, store.read)
    if not lacking.isEmpty():
        return _failed(f'Unable to save to table "{name}", rows refer to keys that do not exist!', lacking)
    nr_rows = rows.count()
    if table.partition_by is not None:
        for cols in (table.key, *table.unique):
            repeated = constraints.unique_violations(rows, cols)
            if not repeated.isEmpty():
                return _not_unique(table, cols, repeated)
        inserted, updated = _merge_months(store, name, rows, table.key, nr_rows)
    else:
        stored = store.read(name)
        before = stored.count()
        if (refused := _commit_unique(store, table, stored, rows, staging)) is not None:
            return refused
        inserted = store.read(name).count() - before
        updated = nr_rows - inserted
    text = messages.IMPORTED.format(new=inserted, known=updated, noun=f'rows of "{name}"')
    return JobReport(OperationResult(short_msg=text), inserted, updated)


@_staged("contracts")
def import_contracts(
    store: TableStore, path: str, method: str = "file", *, staging: Staging
) -> JobReport:
    """Insert new facility contracts and update the known ones of the same facility and month."""
    drop, checked = _load(
        store, path, method, checks.CONTRACT_RULES, schemas.CONTRACT_DROP, "facility_contract"
    )
    if not checked.result.ok:
        return _rejected(checked)
    first, last = checked.profile.first_date, checked.profile.last_date
    if first is None:
        return _failed(messages.NO_IMPORT_INTERVAL)

    resolved = staging.write(
        resolve.resolve_contracts(
            drop.rows, store.read("facility"), store.read("customer_type"), store.read("product")
        )
    )
    counts = resolved.agg(
        F.count_if(F.col("customer_type_id").isNull()).alias("customer_type"),
        F.count_if(F.col("facility_id").isNull()).alias("ean"),
    ).first()
    if counts.customer_type > 0:
        rows = ordered(resolve.contracts_with_unknown_customer_type(resolved), BY_EAN)
        return _failed(messages.INVALID_CUSTOMER_TYPE.format(n=counts.customer_type), rows)
    if counts.ean > 0:
        rows = ordered(resolve.contracts_with_unknown_ean(resolved), BY_EAN)
        return _failed(messages.UNKNOWN_EAN.format(n=counts.ean), rows)

    rows = resolve.contract_rows(resolved)
    if (lacking := _lacking("facility_contract", rows, rows)) is not None:
        return lacking
    inserted, updated = _merge_months(
        store, "facility_contract", rows, FACILITY_CONTRACT.key, checked.profile.nr_rows
    )
    drop.done()
    text = messages.IMPORTED_IN_INTERVAL.format(
        new=inserted, known=updated, noun="facility contracts", start=first, end=last
    )
    return JobReport(OperationResult(short_msg=text), inserted, updated)


@_reported
def import_meter_rows(
    drop: DataFrame, facilities: DataFrame, serie_types: DataFrame, root: str
) -> JobReport:
    """Check one meter drop and replace the partitions it covers.

    The drop is read twice: once for all that is checked, counted by key, and once to be resolved and
    written. Nothing is staged.
    """
    rules = checks.METER_RULES
    drop = cast_in_place(drop, schemas.METER_DROP)
    complete = has_required_columns(drop.columns, rules.required)
    if not complete.ok:
        return JobReport(complete)
    profile = resolve.meter_profile(drop, facilities, serie_types).first()
    repeated = {checks.check_name(key): profile.nr_repeated for key in rules.unique}
    checked = checks.judge_drop(drop, rules, profile, repeated)
    if not checked.result.ok:
        return _rejected(checked)
    resolved = resolve.resolve_meter_rows(drop, facilities, serie_types)
    if profile.nr_unresolved > 0:
        rows = ordered(resolve.unresolved_meter_rows(resolved), BY_EAN)
        return _failed(messages.UNRESOLVED_METER_ROWS.format(n=profile.nr_unresolved), rows)
    result = write_meter_store(resolve.serie_values(resolved), root)
    return JobReport(result, inserted=checked.profile.nr_rows if result.ok else 0)


@dataclass
class MeterImportReport:
    """The overall result and one report per source that was tried."""

    result: OperationResult
    sources: dict[str, JobReport] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.result.ok


def import_meter_data(
    store: TableStore,
    root: str,
    paths: Mapping[str, str],
    sources: Iterable[str] = METER_SOURCES,
    method: str = "file",
) -> MeterImportReport:
    """Import the drops of several sources. A source that fails is reported and the others go on;
    the job fails only when none succeeds."""
    facilities, serie_types = store.read("facility"), store.read("serie_type")
    reports: dict[str, JobReport] = {}
    for source in sources:
        if source not in METER_SOURCES:
            raise ValueError(f'Unknown meter data source "{source}"!')
        if source not in paths:
            text = f'No path is configured for the meter data source "{source}"!'
            reports[source] = _failed(text)
            continue
        drop = _open(store, paths[source], method, f"meter_data/{source}")
        if not drop.result.ok:
            reports[source] = JobReport(drop.result)
            continue
        reports[source] = import_meter_rows(drop.rows, facilities, serie_types, root)
        if reports[source].ok:
            drop.done()
    done = tuple(name for name, report in reports.items() if report.ok)
    if not done:
        return MeterImportReport(OperationResult.failed("No meter data was imported!"), reports)
    text = messages.METER_DATA_PROCESSED.format(sources=done)
    return MeterImportReport(OperationResult(short_msg=text), reports)


@_staged("mapping")
def map_facilities(
    store: TableStore,
    interval: str = "CM-1M..CM",
    now: datetime | None = None,
    tz: str = BUSINESS_TIMEZONE,
    *,
    staging: Staging,
) -> JobReport:
    """Map the contracts of an interval to customer groups and store the links.

    Unmapped contracts and groups without parameters are warnings; a facility with two groups in a
    month is fatal and nothing is written. The unmapped contracts are handed out as violations.
    """
    spark = store.spark
    bounds = resolve_interval(spark, interval, now, tz)
    start = bounds.start.date()
    end = None if bounds.end is None else bounds.end.date()

    groups = tables.customer_groups_with_strategy(
        store.read("customer_group"), store.read("customer_group_mapping_strategy")
    )
    contracts = tables.contracts_extended(
        store.read("facility_contract"),
        store.read("facility"),
        store.read("facility_type"),
        start,
        end,
    )
    if groups.isEmpty():
        return _failed(messages.NO_CUSTOMER_GROUPS)

    rule_set = grouping.prepare_rules(groups)
    assigned = staging.write(grouping.assign_groups(contracts, rule_set.rules, staging=staging))
    # Every contract has a row here, mapped or not: no separate join to see whether there are any.
    is_unmapped = F.col("customer_group_id").isNull()
    counts = assigned.agg(
        F.count_if(is_unmapped).alias("unmapped"), F.count_if(~is_unmapped).alias("links")
    ).first()
    if counts.unmapped + counts.links == 0:
        return _failed(messages.NO_CONTRACTS)
    links = grouping.links_of(assigned)
    unmapped = grouping.unmapped_of(assigned)
    mapped = grouping.mapping_result(rule_set.skipped, counts.unmapped)
    warnings = () if mapped.ok else (mapped.short_msg,)

    duplicates = grouping.duplicate_links(links)
    nr_duplicates = duplicates.count()
    if nr_duplicates > 0:
        result = OperationResult.failed(messages.DUPLICATE_LINKS.format(n=nr_duplicates))
        rows = ordered(duplicates, BY_MONTH)
        return JobReport(result, warnings=warnings, violations=rows)

    inserted, updated = _merge_months(
        store, "facility_customer_group_link", links, LINK.key, counts.links
    )
    text = messages.IMPORTED_IN_INTERVAL.format(
        new=inserted, known=updated, noun="facility customer group links", start=start, end=end
    )
    return JobReport(
        OperationResult(short_msg=text),
        inserted,
        updated,
        warnings,
        ordered(unmapped, BY_MONTH) if counts.unmapped > 0 else None,
    )
