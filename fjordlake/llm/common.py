"""What the operators of this folder share: reading tables, the shared folder, Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text, under fixed names, whatever else the table holds. Arrow batches
    are set to at most BATCH_ROWS texts, so that a worker holds a few MB of them at a time."""
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def with_mark(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with `mark`, so that (doc_id, mark) tells rows with different texts apart: a hash of the
    text where some id stands in several rows, else 0 (the id is enough, and shuffled rows stay small)."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    return docs.withColumn("mark", F.lit(0).cast("long") if again.isEmpty() else F.xxhash64("text"))


def bound_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


_kept: dict[str, list[dict]] = {}


def worker_cache(owner: str) -> dict:
    """A dict that a Python worker keeps from one task of an operator to the next."""
    _kept.setdefault(owner, []).append(cache := {})
    return cache


def begin(owner: str = "") -> None:
    """At a task's start: what other operators keep in this worker goes, and free memory goes back to the system.
    Spark hands its workers on from stage to stage, so one would gather the caches of all operators it has served."""
    others = [cache for name, caches in _kept.items() if name != owner for cache in caches if cache]
    for cache in others:
        cache.clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


class Scratch:
    """Tables written to the shared folder to cut lineage: each stage is computed once, survives the
    loss of executors, and can be dropped as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Without names, everything."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names or ("",):
            at = path(f"{self.root}/{name}" if name else self.root)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _end(self) -> None:
        try:
            self.drop()
        except Exception:  # noqa: BLE001  the session may be gone at exit; its folder goes with it
            pass


def texts(batch: pa.RecordBatch, col: int = 1) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(col).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, col: int = 1) -> list[str]:
    return [x or "" for x in batch.column(col).to_pylist()]


def hot_keys(left: DataFrame, key: str, per: int = 2000, least: int = 1000) -> DataFrame:
    """Keys with over max(least, rows / per) rows: fewer than `per` of them, whatever the table."""
    n = left.count()
    return left.groupBy(key).count().where(F.col("count") > max(least, n // per)).select(key)


def hot_of(counts: DataFrame, key: str, n: str, per: int = 2000, least: int = 1000) -> list:
    """The hot keys (see hot_keys) by a table of counts (key, n), one row a key."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return [r[0] for r in counts.where(F.col(n) > max(least, total // per)).select(key).collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join of many rows with one small row a key: the given hot keys (fewer than 2,000) by broadcast of
    their right rows, the rest by a shuffle."""
    few = left.where(left[key].isin(hot)).join(F.broadcast(right.where(right[key].isin(hot))), key)
    return few.unionByName(left.where(~left[key].isin(hot)).join(right, key))


def skew_join(left: DataFrame, right: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """Inner join of many rows with one small row a key. Hot keys (fewer than 2,000, see hot_keys) are
    joined by broadcast of their right rows, the rest by a shuffle, so no task gets a hot key whole. Where
    `right` has a column with the number of left rows of each key, `count` names it."""
    if count:
        return split_join(left, right.drop(count), key, hot_of(right, key, count))
    return split_join(left, right, key, [r[0] for r in hot_keys(left, key).collect()])
