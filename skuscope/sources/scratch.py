"""Places for tables that a plan writes once and reads again; all are deleted when the driver exits."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .versions import Warehouse, delete, fingerprint

_made: dict[str, SparkSession] = {}
_stages: dict[tuple, Warehouse] = {}
_current: dict[tuple, tuple] = {}


def shared(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stages-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """``df`` written and read back: its lineage ends here."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(spark: SparkSession, data: str, name: str, build, partition: str | None = None, layout=None) -> DataFrame:
    """A stage table of a data folder, published by the first plan of the application that needs it.

    It is published anew once a file of the folder has changed; a run that fails leaves the
    version before it to its readers.
    """
    key, state = (spark.sparkContext.applicationId, data), fingerprint(spark, data)
    if key not in _stages:
        _stages[key] = Warehouse(spark, folder(spark, "stages"))
    warehouse = _stages[key]
    if _current.get((*key, name), (None,))[0] != state:
        run = warehouse.publish(name, lambda pin: build(), partition, {"data": data, "state": state}, layout)
        _current[(*key, name)] = state, run
    return spark.read.parquet(warehouse.path(name, _current[(*key, name)][1]))


@atexit.register
def _sweep() -> None:
    for path, spark in _made.items():
        try:
            if spark._jsc.sc().isStopped():
                return
            delete(spark, path)
        except Exception:  # the gateway may be gone; the folder's owner clears what is left
            return
