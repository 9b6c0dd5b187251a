"""Versions of derived rows under one folder: a numbered log of commits, and rows kept as a base with small deltas.

An entry of the log is a file named by its number that is created only if it is absent, so of two writers that saw the
same head one fails with :class:`Conflict`; an entry names the head it was made on as its parent. No clock takes part. The
state of the folder is what its entries say, failures included, whoever reads them.

A version's rows are a base, written whole, and deltas on it: identifiers that are gone and rows that stand in for others.
Reading joins them; nothing of the base is written again until :func:`merged` rows are written as a new base.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

READY, FAILED, DISCARDED, HANDLES = "ready", "failed", "discarded", "handles"
HISTORY = "number bigint, parent bigint, state string, path string, version string, base string, deltas array<string>, fingerprint string, reason string"


class Conflict(RuntimeError):
    """Another session has committed since the head was read."""


@dataclass(frozen=True)
class Entry:
    number: int
    parent: int
    state: str
    path: str | None = None
    version: str | None = None
    base: str | None = None
    deltas: list[str] = field(default_factory=list)
    fingerprint: str | None = None
    reason: str | None = None


class CommitLog:
    """The entries under ``folder``; one small file each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def history(self) -> DataFrame:
        """All entries in order; none if nothing was committed."""
        fs, path = self._file("")
        if not fs.exists(path):
            return self.spark.createDataFrame([], HISTORY)
        return self.spark.read.schema(HISTORY).json(self.folder).where("number IS NOT NULL").orderBy("number")

    def entries(self) -> list[Entry]:
        return [Entry(**{**r.asDict(), "deltas": list(r["deltas"] or [])}) for r in self.history().collect()]

    def head(self) -> int:
        return max((e.number for e in self.entries()), default=0)

    def append(self, parent: int, state: str, **facts) -> Entry:
        """Commits the entry after ``parent``; raises :class:`Conflict` if somebody else has."""
        entry = Entry(parent + 1, parent, state, **facts)
        fs, path = self._file(f"{entry.number:012d}.json")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise Conflict(f"entry {entry.number} was committed by another session") from e
            raise
        try:
            out.write(bytearray(json.dumps(asdict(entry)).encode()))
        finally:
            out.close()
        return entry


def delta(derived: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identifiers that go, rows that stand in for those of the same identifier): survivors with the provenance of all they
    stand for. Both are as large as the actions, not as the rows."""
    gone = actions.select(F.explode("affected_derived_ids").alias("derived_id"))
    unions = actions.select(F.col("survivor").alias("derived_id"), F.col("source_occurrence_ids").alias("__union"))
    rows = derived.join(unions, "derived_id").withColumn("source_occurrence_ids", F.coalesce("__union", "source_occurrence_ids")).select(*derived.columns)
    return gone, rows


def merged(base: DataFrame, deltas: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The rows of a version: each delta takes its identifiers and those of its rows out, then adds its rows."""
    rows = base
    for gone, new in deltas:
        rows = rows.join(gone.select("derived_id").unionByName(new.select("derived_id")).distinct(), "derived_id", "left_anti").select(*base.columns).unionByName(new.select(*base.columns))
    return rows


def read(spark: SparkSession, base: str, deltas: list[str]) -> DataFrame:
    parts = [(spark.read.parquet(f"{d}/gone"), spark.read.parquet(f"{d}/rows")) for d in deltas]
    return merged(spark.read.parquet(base), parts)
