"""Loading import drops."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltledger import messages
from voltledger.results import SPARK_ERRORS, OperationResult
from voltledger.sources.staging import hadoop_path

IMPORT_METHODS = ("file", "plugin")
MONTH_COLUMN = "date_id"
NANOS_AS_LONG = "spark.sql.legacy.parquet.nanosAsLong"


def literal_path(path: str) -> str:
    """The path with the characters escaped that a glob pattern would interpret."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


class MonthTypeError(ValueError):
    """The months of a drop do not say which moments they are."""


def _nano_months_are_zoned(spark: SparkSession, files: Sequence[str]) -> bool:
    """Whether nanosecond months count from the epoch in UTC or are wall time, as the footers state."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader
    no_rows = jvm.org.apache.parquet.format.converter.ParquetMetadataConverter.SKIP_ROW_GROUPS
    zoned = set()
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        schema = reader.readFooter(conf, path, no_rows).getFileMetaData().getSchema()
        if not schema.containsField(MONTH_COLUMN):
            continue
        kind = schema.getType(schema.getFieldIndex(MONTH_COLUMN)).getLogicalTypeAnnotation()
        if kind is None or not kind.toString().startswith("TIMESTAMP(NANOS"):
            raise MonthTypeError(f'"{MONTH_COLUMN}" must be a date or a timestamp, not a number!')
        zoned.add(kind.isAdjustedToUTC())
    if len(zoned) > 1:
        raise MonthTypeError(f'"{MONTH_COLUMN}" is zoned in some files and wall time in others!')
    return zoned == {True}


def scan_files(spark: SparkSession, *paths: str) -> DataFrame:
    """The parquet files of a drop as one frame.

    The files may differ in their optional columns, so their schemas are merged. Timestamps in
    nanoseconds, which Spark refuses, are read as numbers; a month column of them is turned back
    into timestamps, zoned or wall time as the files have it. A month column that is a number in the
    file itself is an error.
    """
    reader = spark.read.option("mergeSchema", True)
    spark.conf.set(NANOS_AS_LONG, "false")
    try:
        df, nanos = reader.parquet(*paths), False
    except SPARK_ERRORS:
        nanos = True
    finally:
        spark.conf.set(NANOS_AS_LONG, "true")
    if nanos:
        df = reader.parquet(*paths)
    if MONTH_COLUMN not in df.columns:
        return df
    kind = df.schema[MONTH_COLUMN].dataType
    if isinstance(kind, T.NumericType) and not (nanos and isinstance(kind, T.LongType)):
        raise MonthTypeError(f'"{MONTH_COLUMN}" must be a date or a timestamp, not a number!')
    if nanos and isinstance(kind, T.LongType):
        micros = f"{MONTH_COLUMN} DIV 1000"
        if _nano_months_are_zoned(spark, df.inputFiles()):
            moment = F.expr(f"timestamp_micros({micros})")
        else:
            moment = F.expr(f"timestampadd(MICROSECOND, {micros}, TIMESTAMP_NTZ'1970-01-01')")
        df = df.withColumn(MONTH_COLUMN, moment)
    return df


def read_drop(
    spark: SparkSession, path: str, files: Sequence[str] | None = None
) -> tuple[DataFrame | None, OperationResult]:
    """Read one parquet file, or the parquet files directly inside a directory.

    Sub-directories are left out. ``files`` are the only ones of the directory to read. A missing
    path, no matching file, an unreadable file or a file without columns gives a failed result.
    """
    file_system, hadoop = hadoop_path(spark, path)
    if not file_system.exists(hadoop):
        return None, OperationResult.failed(messages.PATH_NOT_FOUND.format(path=path))
    directory = file_system.getFileStatus(hadoop).isDirectory()
    pattern = f"{literal_path(path.rstrip('/'))}/*.parquet" if directory else literal_path(path)
    try:
        df = scan_files(spark, *([pattern] if files is None else map(literal_path, files)))
    except MonthTypeError as e:
        return None, OperationResult.failed(f'Could not read parquet files from "{pattern}"!', str(e))
    except SPARK_ERRORS as e:
        return None, OperationResult.from_error(f'Could not read parquet files from "{pattern}"!', e)
    if not df.columns:
        return None, OperationResult.failed(f'The parquet files in "{pattern}" have no columns!')
    return df, OperationResult()


def load_drop(
    spark: SparkSession, path: str, method: str = "file", files: Sequence[str] | None = None
) -> tuple[DataFrame | None, OperationResult]:
    """Load a drop by import method; only files are implemented."""
    if method == "file":
        return read_drop(spark, path, files)
    if method == "plugin":
        return None, OperationResult.failed(messages.PLUGIN_IMPORT)
    return None, OperationResult.failed(
        messages.INVALID_METHOD.format(method=method, methods=IMPORT_METHODS)
    )
