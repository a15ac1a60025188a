"""A library of several tables in folders, brought from version to version by steps, all or none."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalogue import dangling

Tables = dict[str, DataFrame]
#: From the tables of one version to those of the next.
Step = Callable[[Tables], Tables]


class Reference(NamedTuple):
    """A column whose values, but for nulls, must be found in another table."""

    table: str
    column: str
    to: str
    key: str = "id"


class NewerLibraryError(ValueError):
    """Written by a later release."""


class UpgradeError(ValueError):
    """The steps leave rows that refer to nothing; the library is as it was."""


def upgrade(tables: Tables, version: int, steps: list[Step]) -> Tables:
    """The tables after the steps that they haven't had; version i + 1 is what step i makes."""
    if version > len(steps):
        raise NewerLibraryError(f"version {version}, known are {len(steps)}")
    for step in steps[version:]:
        tables = step(dict(tables))
    return tables


def broken(tables: Tables, references: list[Reference]) -> dict[Reference, int]:
    """How many rows of each reference point nowhere, where any do; references of tables or columns that aren't there don't count."""
    found = {}
    for r in references:
        if r.table in tables and r.to in tables and r.column in tables[r.table].columns:
            n = dangling(tables[r.table].select(r.column), r.column, tables[r.to], r.key).count()
            if n:
                found[r] = n
    return found


class Library:
    """Tables under a folder. A ledger of small files says which set of tables counts: the newest line; a set without a line was never finished."""

    LEDGER = "version int, folder string, names array<string>, at_ms long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _ledger(self) -> DataFrame:
        return self.spark.read.schema(self.LEDGER).json(f"{self.path}/ledger")

    def current(self) -> tuple[int, Tables]:
        """Version and tables; version 0 without tables where nothing has been written yet."""
        try:
            lines = self._ledger()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        row = lines.orderBy(F.desc("version"), F.desc("at_ms")).first()
        return row.version, {n: self.spark.read.parquet(f"{self.path}/{row.folder}/{n}") for n in row.names}

    def commit(self, tables: Tables, version: int) -> None:
        """Write all tables beside the old ones, then the line that makes them count."""
        folder = f"tables/{version:05d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        line = [(version, folder, sorted(tables), int(time.time() * 1000))]
        self.spark.createDataFrame(line, self.LEDGER).coalesce(1).write.mode("append").json(f"{self.path}/ledger")

    def open(self, steps: list[Step], references: list[Reference]) -> Tables:
        """The tables at the newest version; missing steps run first. If one fails or leaves a broken reference, nothing has changed."""
        version, tables = self.current()
        if version == len(steps):
            return tables
        new = upgrade(tables, version, steps)
        if bad := broken(new, references):
            raise UpgradeError(", ".join(f"{r.table}.{r.column}: {n} rows" for r, n in bad.items()))
        self.commit(new, len(steps))
        return self.current()[1]
