"""What several training-data operators share: scratch tables, checked broadcasts, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one or two longs that may be broadcast (about 16 MB); beyond it, the joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch of texts, one text at least.
BATCH_BYTES = 2_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. One is set only where there is none and all tasks run on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: scratch tables need a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


_tables: dict[str, Callable[[], None]] = {}
_in_use: list[str] = []


def use_table(name: str, clear: Callable[[], None]) -> None:
    """Workers outlive a job: when another operator's table of known words is about to grow, clear the ones before."""
    _tables[name] = clear
    if _in_use != [name]:
        for other in set(_tables) - {name}:
            _tables.pop(other)()
        _in_use[:] = [name]
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # what was freed goes back to the system, where its library can
            ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Tables in the shared folder. They cut lineage, outlive executors, and go when the driver ends or on drop()."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/tidemark-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._clean, self.root)

    def table(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._clean(df._scratch_path)

    def _clean(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone, and with it the means to delete
            pass


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if a count shows that it has at most so many rows; else leave the join to a shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have about most_bytes together (one text at least, never a part of one)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def small_batches(spark: SparkSession) -> None:
    """Have the session cut Arrow batches by their bytes: Spark's own bound lets a batch of long texts take many times as much,
    in the JVM and again in the worker. A smaller bound that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).removesuffix("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_text(
    df: DataFrame, columns: list, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, text: int = 1
) -> DataFrame:
    """Apply step to Arrow batches of the named columns, of which number `text` sizes the batches."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield step(part)

    return df.select(*columns).mapInArrow(run, schema)


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of edges (a long, b long).

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is an aggregation with map-side combine and
    an equi-join whose hot keys AQE splits. Returns node, component for every node with an edge; loops and nulls are
    ignored. Each round is written to the shared folder, so a lost executor costs one round.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = scratch.table(
        edges.where("a is not null and b is not null and a <> b").select(hi.alias("u"), lo.alias("v")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            break
        seen = sign
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.table(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
        )
        after = scratch.table(small.distinct())
        scratch.drop(large)
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.union(now.select("v", "v").distinct())
