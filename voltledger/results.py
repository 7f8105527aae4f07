"""Outcomes handed back next to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

# What a failing read or write raises in a classic Spark session.
SPARK_ERRORS = (PySparkException, Py4JJavaError)


class OperationResult(NamedTuple):
    """Whether a step succeeded, with a text for the user and an optional machine code."""

    ok: bool = True
    short_msg: str = ""
    long_msg: str = ""
    code: str | None = None

    @classmethod
    def failed(cls, short_msg: str, long_msg: str = "", code: str | None = None) -> OperationResult:
        return cls(ok=False, short_msg=short_msg, long_msg=long_msg, code=code)

    @classmethod
    def from_error(cls, short_msg: str, error: Exception) -> OperationResult:
        if isinstance(error, Py4JJavaError):
            java = error.java_exception
            return cls.failed(short_msg, str(java), java.getClass().getName())
        return cls.failed(short_msg, str(error), error.getCondition())


class Checked(NamedTuple):
    """A check outcome and the lazy frame of the rows that broke it (None when it passed)."""

    result: OperationResult
    violations: DataFrame | None = None


class Upsert(NamedTuple):
    """New rows, rows that replace stored ones, and rows that resolve to nothing. All lazy."""

    insert: DataFrame
    update: DataFrame
    invalid: DataFrame | None = None


@dataclass
class JobReport:
    """What a job did: the final result, the counts, and warnings that did not stop it."""

    result: OperationResult
    inserted: int = 0
    updated: int = 0
    warnings: tuple[str, ...] = ()
    violations: DataFrame | None = None
    on_close: Callable[[], None] | None = None

    @property
    def ok(self) -> bool:
        return self.result.ok

    def close(self) -> None:
        """Remove what the job staged for the rows in violation, which cannot be read any more."""
        if self.on_close is not None:
            self.on_close()
            self.on_close = None

    def __enter__(self) -> JobReport:
        return self

    def __exit__(self, *_error) -> None:
        self.close()
