"""Incremental import of meter drops: only files that were not seen before, and rejected ones again."""

from __future__ import annotations

from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger import messages
from voltledger.functions.conversion import cast_in_place
from voltledger.plans.jobs import import_meter_rows
from voltledger.results import SPARK_ERRORS, JobReport, OperationResult
from voltledger.schemas import DATE, METER_DROP, REJECTED_FILE, STRING, TAKEN_PARTITION, Table, struct
from voltledger.seeds import local_table
from voltledger.sources.drops import MonthTypeError, literal_path, scan_files
from voltledger.sources.staging import hadoop_path
from voltledger.sources.tables import TableStore

PARTITION = ["serie_type_code", "date_id"]


class RejectedDrops:
    """The files of rejected drops, oldest drop first, and which of their partitions newer drops wrote, kept
    in the table store. Only file names, serie types and months go through the driver."""

    def __init__(self, store: TableStore, source_dir: str):
        self.store = store
        self.source_dir = source_dir

    def _of(self, here: bool, table: Table = REJECTED_FILE) -> DataFrame:
        same = F.col("source_dir") == self.source_dir
        return self.store.read(table.name).where(same if here else ~same)

    def all(self) -> list[list[str]]:
        """The drops whose files are still in place."""
        drops: dict[int, list[str]] = {}
        for row in self._of(True).orderBy("drop_nr", "file").collect():
            file_system, path = hadoop_path(self.store.spark, row.file)
            if file_system.exists(path):
                drops.setdefault(row.drop_nr, []).append(row.file)
        return list(drops.values())

    def taken(self) -> dict[str, set[tuple[str, date]]]:
        """Partitions that newer drops wrote, by the first file of the rejected drop."""
        found: dict[str, set[tuple[str, date]]] = {}
        for row in self._of(True, TAKEN_PARTITION).collect():
            found.setdefault(row.file, set()).add((row.serie_type_code, row.date_id))
        return found

    def replace(self, drops: list[list[str]], taken: dict[str, set[tuple[str, date]]]) -> None:
        """Taken partitions first: they hold for a drop that still waits whatever happens next."""
        first = {files[0] for files in drops}
        lost = [
            {"source_dir": self.source_dir, "file": file, "serie_type_code": code, "date_id": month}
            for file, parts in taken.items()
            for code, month in parts
            if file in first
        ]
        if lost or not self._of(True, TAKEN_PARTITION).isEmpty():
            mine = local_table(self.store.spark, lost, TAKEN_PARTITION.schema)
            others = self._of(False, TAKEN_PARTITION)
            self.store.commit(TAKEN_PARTITION.name, others.unionByName(mine))
        rows = [
            {"source_dir": self.source_dir, "drop_nr": nr, "file": file}
            for nr, files in enumerate(drops)
            for file in files
        ]
        mine = local_table(self.store.spark, rows, REJECTED_FILE.schema)
        self.store.commit(REJECTED_FILE.name, self._of(False).unionByName(mine))


def import_new_meter_drops(
    store: TableStore,
    source_dir: str,
    root: str,
    checkpoint: str,
    archive_dir: str | None = None,
) -> list[JobReport]:
    """Import the parquet files that arrived in ``source_dir`` since the last run.

    The files of one run are one drop: checked as a whole, resolved, and written over the (serie
    type, month) partitions they cover, so a later drop corrects a month by replacing it. The
    checkpoint, not the directory, remembers what was read; a batch that was interrupted is repeated
    and gives the same partitions. With ``archive_dir`` Spark moves files there some time after they
    were read; the newest drop stays in place, and what was rejected before it cannot be tried again.

    A rejected drop is remembered with all its files and tried again by the next runs, oldest first
    and after what is new, until it passes or its files are gone. Partitions that a newer imported drop wrote
    are left out of it from then on, so that old rows never overwrite newer ones; a drop of which nothing is
    left is given up. The report of the newer drop warns of both. There is no report when there is nothing
    to import.
    """
    spark = store.spark
    file_system, directory = hadoop_path(spark, source_dir)
    if not file_system.exists(directory):
        text = messages.PATH_NOT_FOUND.format(path=source_dir)
        return [JobReport(OperationResult.failed(text))]
    facilities, serie_types = store.read("facility"), store.read("serie_type")
    memory = RejectedDrops(store, source_dir)
    waiting, taken = memory.all(), memory.taken()
    reports: list[JobReport] = []

    def scan(files: list[str]) -> DataFrame:
        return scan_files(spark, *map(literal_path, files))

    def partitions(files: list[str]) -> set[tuple[str, date]]:
        """The serie types and months of a drop: one pair per partition it would write."""
        try:
            found = cast_in_place(scan(files), METER_DROP).select(*PARTITION).distinct().collect()
        except (*SPARK_ERRORS, MonthTypeError):
            return set()  # it cannot even be read
        return {(row.serie_type_code, row.date_id) for row in found}

    def attempt(files: list[str]) -> JobReport:
        try:
            rows, gone = scan(files), taken.get(files[0])
            if gone:
                left_out = local_table(
                    spark,
                    [dict(zip(PARTITION, pair)) for pair in gone],
                    struct(serie_type_code=STRING, date_id=DATE),
                )
                rows = cast_in_place(rows, METER_DROP)
                rows = rows.join(F.broadcast(left_out), PARTITION, "left_anti")
            return import_meter_rows(rows, facilities, serie_types, root)
        except MonthTypeError as e:
            return JobReport(OperationResult.failed(str(e)))

    def give_way(older: list[str], written: set[tuple[str, date]]) -> str | None:
        """Leave out of an older drop what a newer one wrote; the warning, if anything is."""
        own = partitions(older)
        common = own & written
        if not common:
            return None
        taken[older[0]] = taken.get(older[0], set()) | common
        if own <= taken[older[0]]:
            waiting.remove(older)
            return f"Rejected files {tuple(older)} are not tried again: a newer drop has their months!"
        listed = ", ".join(f"{code} {month}" for code, month in sorted(common, key=str))
        return f"Rejected files {tuple(older)} are tried again without {listed}: a newer drop has them!"

    def settle(files: list[str], report: JobReport) -> None:
        """Remember a rejected drop; forget an imported one, and let older ones give way to it."""
        at = waiting.index(files) if files in waiting else len(waiting)
        if not report.ok:
            if at == len(waiting):
                waiting.append(files)
        else:
            older = waiting[:at]
            waiting[:] = [drop for drop in waiting if drop != files]
            written = (partitions(files) - taken.get(files[0], set())) if older else set()
            warnings = [give_way(drop, written) for drop in older]
            report.warnings += tuple(w for w in warnings if w is not None)
        memory.replace(waiting, taken)
        reports.append(report)

    def import_files(batch: DataFrame, _batch_id: int) -> None:
        # The rows of a batch come without column pruning, and every action would read them in
        # full. The stream only tells which files are new; they are then scanned like any drop.
        files = sorted(unquote(row.file) for row in batch.distinct().collect())
        if not files:
            return
        report = attempt(files)
        if report.result.code is not None:
            # Spark failed, not the drop: let the stream fail too, so that the batch is repeated.
            raise RuntimeError(f"{report.result.short_msg}\n{report.result.long_msg}")
        settle(files, report)

    before = list(waiting)
    reader = spark.readStream.schema(METER_DROP)
    if archive_dir is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    query = (
        reader.parquet(f"{literal_path(source_dir.rstrip('/'))}/*.parquet")
        .select(F.col("_metadata.file_path").alias("file"))
        .writeStream.foreachBatch(import_files)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    for files in before:
        if files in waiting:
            settle(files, attempt(files))
    return reports
