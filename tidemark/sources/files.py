"""Readers, writers and keyed caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERSONA = T.StructType([T.StructField("action", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("reasoning", T.StringType())])
DECISION = T.StructType([T.StructField("date", T.StringType()), T.StructField("ticker", T.StringType()), *PERSONA.fields, T.StructField("personalities", T.MapType(T.StringType(), PERSONA))])
BARS = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()), *[T.StructField(n, T.DoubleType()) for n in ("Open", "High", "Low", "Close")], T.StructField("Volume", T.LongType())])


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars, NaN turned to null, missing volume to 0; fails if there are none."""
    df = spark.read.schema(BARS).parquet(path)
    if df.isEmpty():
        raise RuntimeError(f"no bars in {path}")
    prices = {c: F.when(~F.isnan(c), F.col(c)) for c in ("Open", "High", "Low", "Close")}
    return df.withColumns(prices | {"Volume": F.coalesce("Volume", F.lit(0).cast("long"))})


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a decision; date as a date."""
    return spark.read.schema(DECISION).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("date", F.to_date("date"))


DISTRIBUTION = T.StructType([T.StructField(f"p{p}", T.DoubleType()) for p in (50, 75, 90, 95, 99)] + [T.StructField("max", T.DoubleType())])
THRESHOLDS = T.StructType([
    T.StructField(d, T.StructType([T.StructField("score_distribution", DISTRIBUTION), T.StructField("flag_percentile", T.IntegerType())])) for d in ("ram", "psa", "gso")
])


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """detector, low, medium, high of a calibration file: 95, 99 and the largest score; of ram 75, its flag percentile (90), and the
    larger of that and 99. Detectors that the file lacks give no row; a file that cannot be read, or has none, fails."""
    whole = spark.read.schema(THRESHOLDS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    d = F.col("x.score_distribution")
    flag = F.element_at(F.create_map(*[v for p in (50, 75, 90, 95, 99) for v in (F.lit(p), d[f"p{p}"])]), F.coalesce("x.flag_percentile", F.lit(90)))
    is_ram = F.col("detector") == "ram"
    rows = whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.col(n).alias("x")) for n in ("ram", "psa", "gso")])).alias("e")).select("e.*")
    out = rows.where("x.score_distribution is not null").select(
        "detector", F.when(is_ram, d["p75"]).otherwise(d["p95"]).alias("low"), F.when(is_ram, flag).otherwise(d["p99"]).alias("medium"),
        F.when(is_ram, F.greatest(d["p99"], flag)).otherwise(d["max"]).alias("high"),
    )
    if out.isEmpty():
        raise ValueError(f"no thresholds in {path}")
    return out


def latest(spark: SparkSession, pattern: str) -> str:
    """The last path, in lexicographic order, of those that a pattern matches. Names are listed; contents are not read."""
    found = spark.read.format("binaryFile").load(pattern).agg(F.max("path")).first()[0]
    if found is None:
        raise FileNotFoundError(pattern)
    return found


def read_through(spark: SparkSession, path: str, produce: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and kept there first if there is none; an empty one is not kept, and fails."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        made = produce()
        if made.isEmpty():
            raise RuntimeError(f"nothing to keep in {path}")
        made.write.parquet(path)
    return spark.read.parquet(path)


def aligned(left: DataFrame, right: DataFrame, names: tuple[str, str], column: str = "Close") -> DataFrame:
    """date and the column of both series on the dates that both have a value for."""
    one, two = (df.select("date", F.when(~F.isnan(column), F.col(column)).alias(n)) for df, n in zip((left, right), names, strict=True))
    return one.join(two, "date").dropna()


class AnswerCache:
    """Answers by the content address of their request, one table a folder. A later answer to a request replaces the earlier one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("key string, answer string, at long").parquet(self.path)

    def update(self, answers: DataFrame) -> None:
        """Add answers (key, answer), counted as later than what is there."""
        self.spark.createDataFrame([], "key string, answer string, at long").write.mode("append").parquet(self.path)
        at = (self._rows().agg(F.max("at")).first()[0] or 0) + 1
        answers.select("key", "answer", F.lit(at).cast("long").alias("at")).write.mode("append").parquet(self.path)

    def lookup(self, requests: DataFrame) -> DataFrame:
        """requests with answer, null for a miss."""
        last = self._rows().groupBy("key").agg(F.max_by("answer", "at").alias("answer"))
        return requests.join(last, "key", "left")

    def clear(self) -> None:
        self.spark.createDataFrame([], "key string, answer string, at long").write.mode("overwrite").parquet(self.path)


def cache_name(ticker: Column, start: Column, end: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(ticker, r"\^", ""), "/", "_"), F.lit("_"), start, F.lit("_"), end, F.lit(".parquet"))


def prompt_key(model: Column, prompt: Column) -> Column:
    """Content address of a request."""
    return F.sha2(F.concat(model, F.lit("\n----\n"), prompt), 256)


def missing(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key the cache has not."""
    return requests.join(cache.select("key"), "key", "left_anti")


def folder_print(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint of a folder of small files: the first 16 digits of the SHA-256 of their names and contents, in order of names.
    The folder's bytes meet in one row."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    ordered = F.array_sort(F.collect_list(F.struct("name", "content")))
    whole = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["name"].cast("binary"), x["content"]))
    return files.agg(F.substring(F.sha2(whole, 256), 1, 16).alias("fingerprint"))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
