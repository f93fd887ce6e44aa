"""Tables that a plan writes and reads again: they cut lineage, outlive executors, and go when the driver ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local one is made only where none is named and all tasks run here."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # without a session there are no means to delete
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plan-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of each file under a path."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(there, True)
    out = []
    while listed.hasNext():
        f = listed.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def once(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s table, written when an application first asks for this name over this source, and read from then on. It is made again
    when a file of the source is another one, or is longer, shorter or newer, and after a failure."""
    key, seen = (spark.sparkContext.applicationId, name, source), _files(spark, source)
    if key not in _KEPT or _KEPT[key][0] != seen:
        _KEPT[key] = (seen, written(make()))
    return _KEPT[key][1]
