"""What the training-data operators share: the shared work folder, staged tables, bounded
Arrow batches, deterministic range shards and atomic publishing of files."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space splits words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Work folders of this process that are still there.
_MADE: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run below ``spark.checkpoint.dir``, which driver and executors share,
    as a qualified path, so that Spark and pyarrow mean the same place by it. It is deleted when the
    process ends, or with ``released``.

    Only where that setting is missing and Spark runs in one process a temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    base = re.sub(r"^file:/+", "file:///", base)
    _MADE.append(f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


@atexit.register
def _clear() -> None:
    for folder in _MADE:
        with suppress(Exception):  # never made, or the store is gone
            fs, path = file_system(folder)
            fs.delete_dir(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Work folders made inside are deleted at the end: for what has been written elsewhere by then."""
    kept = len(_MADE)
    try:
        yield
    finally:
        for folder in _MADE[kept:]:
            remove(spark, folder)
        del _MADE[kept:]


def stage(df: DataFrame, path: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: the lineage ends here, so a lost
    executor costs the tasks that are running and nothing before them. ``narrow`` gathers the few
    bytes that each of many tasks has made into files of a sensible size."""
    (gathered(df) if narrow else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """``df`` after a shuffle whose partitions adaptive execution sizes: what runs before it keeps the
    width of its scan, and few files come out of many small tasks."""
    return df.hint("rebalance")


def in_files(df: DataFrame, like: DataFrame, least: int = 16 << 20) -> DataFrame:
    """``df``, whose rows are as wide as those of ``like``, for writing: as it is where the tasks of
    ``like`` read ``least`` bytes or more, gathered where they are so small that files would be too."""
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return gathered(df) if size < least * like.rdd.getNumPartitions() else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most ``rows`` rows, so that what is made of one at a time stays small.
    The batches themselves are bounded in bytes by spark.sql.execution.arrow.maxBytesPerBatch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


MOST_SHARDS, PER_SHARD = 1 << 16, 64


def range_shards(df: DataFrame, key: str, tie: Column, weight: Column, shard_weight: int, least: int) -> tuple[Column, int]:
    """Deterministic range shards over (key, tie): the column of the shard and a bound of their number.

    ``key`` is an integer column of any values, null first; ``tie`` a hash of the rest of the row, so
    that rows which repeat a key may be cut apart. There are ``least`` shards or more and as many as
    ``shard_weight`` asks for, up to MOST_SHARDS; beyond that they grow. Borders are quantiles, by weight, of the
    (key, tie) whose hash falls in a class chosen so that about PER_SHARD of them belong to each shard:
    unlike those of a random sample they are the same in each run, and neither far ids nor dense ones
    matter. What reaches the driver is one row for each shard."""
    rows = df.select(F.col(key).cast("long").alias("k"), tie.cast("long").alias("t"), weight.cast("double").alias("w"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    shards = max(1, min(MOST_SHARDS, max(least, -(-int(total) // shard_weight))))
    picked = rows.where(F.pmod(F.xxhash64("k", "t", F.lit(17)), F.lit(max(1, n // (PER_SHARD * shards)))) == 0)
    picked = picked.groupBy("k", "t").agg(F.sum("w").alias("w"))
    order = Window.orderBy(F.col("k").asc_nulls_first(), "t")  # over about PER_SHARD rows a shard
    part = (F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")) * shards / F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cut = picked.withColumn("part", F.floor(part)).withColumn("before", F.lag("part").over(order)).where("part > before")
    cuts = cut.select("k", "t").orderBy(F.col("k").asc_nulls_first(), "t").collect()
    if not cuts:
        return F.lit(0), 1
    none = np.array([c.t for c in cuts if c.k is None], np.int64)
    keys = np.array([c.k for c in cuts if c.k is not None], np.int64)
    ties = np.array([c.t for c in cuts if c.k is not None], np.int64)
    held = df.sparkSession.sparkContext.broadcast((none, keys, ties))  # MOST_SHARDS numbers at most

    @F.arrow_udf("int")
    def place(k: pa.Array, t: pa.Array) -> pa.Array:
        none, keys, ties = held.value
        null, x, y = k.is_null().to_numpy(False), k.fill_null(0).to_numpy(False), t.to_numpy(False)
        low, high = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
        at = low + len(none)
        for r in np.flatnonzero((high > low) & ~null):  # a key that holds borders of its own
            at[r] += np.searchsorted(ties[low[r] : high[r]], y[r], "right")
        at[null] = np.searchsorted(none, y[null], "right")
        return pa.array(at.astype(np.int32))

    return place(F.col(key).cast("long"), tie.cast("long")), len(cuts) + 1


def file_system(uri: str):
    """pyarrow's file system and the path in it, for file:, hdfs: and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


class Publisher:
    """A file that appears under its name only when it is whole: it is written under a temporary
    name and moved, so a retried or speculative task replaces equal bytes by equal bytes."""

    def __init__(self, folder: str, name: str):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{name}"
        self.temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.size = 0
        self.sink = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.sink.close()
        self.fs.move(self.temporary, self.path)


def read_file(folder: str, name: str) -> bytes:
    fs, root = file_system(folder)
    with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
        return source.read()
