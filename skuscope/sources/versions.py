"""Versioned publication of stage tables.

A run of a stage writes a folder of its own, ``<root>/<stage>/<run_id>``, and appends to the run
log when it is complete: a reader finds a version only by its entry of success, so a failed or
abandoned run leaves what was readable before. Readers pin the versions of one moment and keep
them until they pin anew. Old versions are deleted by ``collect``.

Row counts come from the write itself (observed metrics), not from a second read. A stage built
from other stages names the versions it read, so its lineage is in the log.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, stage string, status string, started_at timestamp, finished_at timestamp, metadata string, row_counts string, error_message string"
MANIFEST = "_runs"


class NotPublished(LookupError):
    """The stage has no version that may be read."""


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def clustered(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """A layout with rows of near keys side by side: readers of a key skip files and row groups by their statistics."""
    return lambda df: df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def blooms(*columns: str) -> dict[str, str]:
    """Writer options for Bloom filters, which rule out row groups that a column's range doesn't."""
    return {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}


def delete(spark: SparkSession, path: str) -> None:
    place, fs = filesystem(spark, path)
    fs.delete(place, True)


def fingerprint(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """Changes whenever a file below ``path`` is added, removed or rewritten; only names, sizes and times are read."""
    place, fs = filesystem(spark, path)
    if not fs.exists(place):
        return "none"
    found, todo = [], [place]
    for at in todo:
        for entry in fs.listStatus(at):
            if entry.isDirectory():
                todo.append(entry.getPath())
            else:
                found.append(f"{entry.getPath()} {entry.getLen()} {entry.getModificationTime()}")
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(sorted(found))))


class Warehouse:
    """Stage tables below a shared folder. Entries of the log are small files, one for each start and end of a run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------------ log
    def _append(self, *entry) -> None:
        self.spark.createDataFrame([entry], RUNS).coalesce(1).write.mode("append").parquet(f"{self.root}/{MANIFEST}")

    def log(self) -> DataFrame:
        """All entries, oldest first to be read; empty before the first run."""
        place, fs = filesystem(self.spark, f"{self.root}/{MANIFEST}")
        if not fs.exists(place):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(f"{self.root}/{MANIFEST}")

    def runs(self) -> DataFrame:
        """A row for each run: its last entry, with the metadata of its first where the last has none."""
        ended = F.struct(F.col("finished_at").isNotNull(), F.col("finished_at"))
        fields = ["stage", "status", "started_at", "finished_at", "row_counts", "error_message"]
        last = F.max_by(F.struct(*fields, "metadata"), ended).alias("x")
        grouped = self.log().groupBy("run_id").agg(last, F.max("metadata").alias("given"))
        return grouped.select("run_id", *[f"x.{f}" for f in fields], F.coalesce("x.metadata", "given").alias("metadata"))

    # ------------------------------------------------------------------ writing
    def publish(self, stage: str, build: Callable[[Pin], DataFrame], partition: str | None = None, metadata: dict | None = None, layout: Callable[[DataFrame], DataFrame] | None = None, options: dict | None = None, counters: dict[str, Column] | None = None) -> str:
        """Runs ``build`` on the versions of this moment and publishes its rows; returns the run's id.

        ``layout`` orders or deals the rows before they are written, ``options`` are the writer's,
        ``counters`` are aggregates of the rows as they are written (columns that begin with ``__``
        serve these alone) and stand beside the row count in the log.
        Any error is logged, what was written is deleted, and the error goes on.
        """
        pin, started, run_id = self.pin(), now(), f"{stage}-{uuid.uuid4().hex[:12]}"
        self._append(run_id, stage, "running", started, None, json.dumps(metadata or {}, default=str), None, None)
        seen = Observation(run_id)
        try:
            rows = build(pin)
            rows = (layout(rows) if layout else rows).observe(seen, F.count(F.lit(1)).alias(stage), *[c.alias(n) for n, c in (counters or {}).items()])
            rows = rows.drop(*[c for c in rows.columns if c.startswith("__")])
            writer = rows.write.mode("errorifexists").options(**(options or {}))
            (writer.partitionBy(partition) if partition else writer).parquet(self.path(stage, run_id))
        except Exception as error:
            delete(self.spark, self.path(stage, run_id))
            self._append(run_id, stage, "failed", started, now(), None, None, str(error)[:500])
            raise
        given = json.dumps((metadata or {}) | {"inputs": pin.used}, default=str)
        self._append(run_id, stage, "success", started, now(), given, json.dumps(seen.get), None)
        return run_id

    def path(self, stage: str, run_id: str) -> str:
        return f"{self.root}/{stage}/{run_id}"

    # ------------------------------------------------------------------ reading
    def pin(self) -> Pin:
        """The newest complete version of each stage as of now."""
        return Pin(self, {r["stage"]: r["run_id"] for r in self._complete().groupBy("stage").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id")).collect()})

    def _complete(self) -> DataFrame:
        return self.runs().filter("status = 'success'")

    def rows_of(self, run_id: str) -> dict[str, int]:
        """Rows that a run has written, by table, and its counters."""
        got = self.runs().filter(F.col("run_id") == run_id).first()
        return json.loads(got["row_counts"] or "{}") if got else {}

    # ------------------------------------------------------------------ clean-up
    def collect(self, keep: int = 2, held: list[Pin] = (), grace: dt.timedelta = dt.timedelta(days=1)) -> list[str]:
        """Deletes all but the ``keep`` newest complete versions of each stage, and what runs older than
        ``grace`` left without an end; versions that a pin of ``held`` reads stay. Returns the deleted run ids."""
        chosen = {v for p in held for v in p.versions.values()}
        by_stage: dict[str, list] = {}
        gone = []
        for run in self.runs().orderBy(F.desc("started_at"), F.desc("run_id")).collect():  # a row a run
            own = by_stage.setdefault(run["stage"], [])
            if run["status"] == "success":
                own.append(run["run_id"])
                old = len(own) > keep
            else:
                old = run["status"] == "running" and run["started_at"] < now() - grace
            if old and run["run_id"] not in chosen:
                place, fs = filesystem(self.spark, self.path(run["stage"], run["run_id"]))
                if fs.delete(place, True):
                    gone.append(run["run_id"])
        self.compact()
        return gone

    def compact(self) -> int:
        """Puts the log's small files into one; returns how many there were.

        The one is written before the others are deleted. Readers between the two meet entries
        twice, which changes nothing, since a run counts by its last entry; entries that are appended
        meanwhile stay in files of their own.
        """
        place, fs = filesystem(self.spark, f"{self.root}/{MANIFEST}")
        old = [entry.getPath() for entry in fs.listStatus(place) if entry.getPath().getName().startswith("part-")]
        if len(old) < 2:
            return len(old)
        entries = self.spark.read.schema(RUNS).parquet(*[p.toString() for p in old]).distinct()
        entries.coalesce(1).sortWithinPartitions("started_at", "run_id").write.mode("append").parquet(f"{self.root}/{MANIFEST}")
        for p in old:
            fs.delete(p, False)
        return len(old)


class Pin:
    """One version of each stage; ``used`` names those that were read."""

    def __init__(self, warehouse: Warehouse, versions: dict[str, str]):
        self.warehouse, self.versions, self.used = warehouse, versions, {}

    def read(self, stage: str) -> DataFrame:
        if stage not in self.versions:
            raise NotPublished(stage)
        self.used[stage] = self.versions[stage]
        return self.warehouse.spark.read.parquet(self.warehouse.path(stage, self.versions[stage]))
