"""Which files of the drop directories were imported already, kept in the table store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from voltledger.schemas import IMPORTED_FILE
from voltledger.seeds import local_table
from voltledger.sources.drops import literal_path
from voltledger.sources.staging import hadoop_path
from voltledger.sources.tables import TableStore

_IDENTITY = ("file", "modified", "nr_bytes")


class DropLedger:
    """The imported files of one job. A file counts as imported by its path, its time of change and its
    size, so a file that is replaced is read again; a file of a rejected drop is never entered, so the
    next run offers it again."""

    def __init__(self, store: TableStore, job: str):
        self.store = store
        self.job = job

    def _entered(self) -> DataFrame:
        return self.store.read(IMPORTED_FILE.name).where(F.col("job") == self.job).select(*_IDENTITY)

    def unseen(self, path: str) -> list[Row] | None:
        """The files directly inside a directory that were not imported; None if it is no directory.

        Only names, times and sizes are read. The names go through the driver: the scan takes them.
        """
        spark = self.store.spark
        file_system, hadoop = hadoop_path(spark, path)
        if not file_system.exists(hadoop) or not file_system.getFileStatus(hadoop).isDirectory():
            return None
        present = (
            spark.read.format("binaryFile")
            .load(f"{literal_path(path.rstrip('/'))}/*.parquet")
            .selectExpr("path AS file", "unix_micros(modificationTime) AS modified", "length AS nr_bytes")
        )
        return present.join(self._entered(), list(_IDENTITY), "left_anti").collect()

    def enter(self, files: list[Row] | None) -> None:
        """Remember files once their rows are stored. A run that ends before this imports them again,
        which gives the same rows."""
        if not files:
            return
        rows = [{"job": self.job, **file.asDict()} for file in files]
        known = self.store.read(IMPORTED_FILE.name)
        new = local_table(self.store.spark, rows, IMPORTED_FILE.schema)
        self.store.commit(IMPORTED_FILE.name, known.unionByName(new))
