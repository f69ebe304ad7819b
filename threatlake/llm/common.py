"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch, so that batches of very long texts stay small.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Few rows in an Arrow batch, for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table. Only Spark's reader opens the path."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or what setCheckpointDir() was given."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile  # one machine: driver and tasks share all folders

    spark.sparkContext.setCheckpointDir(base := tempfile.mkdtemp(prefix="spark-"))
    return base


#: Where written tables lie, while something refers to them.
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Lets Spark remove a query's shuffle files at its end, instead of when the driver's heap is next collected.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, by: tuple = ()) -> DataFrame:
    """df as a written Parquet table in the shared folder, which cuts its lineage and survives lost executors; a folder for each value of `by`."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that table() wrote and nothing reads any more; other frames are left alone."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Most rows of narrow tables (keys and numbers) that are broadcast, some 20 MB.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has no more than BROADCAST_ROWS rows; rows: how many it has, or a bound of that."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def components(vertices: DataFrame, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component_id) of every vertex: the smallest id reachable over edges (a, b).

    Alternating large-star and small-star rounds; each round is written to the shared folder, and ends when the
    edges no longer change. Vertices without edges are their own component; null ids stay null.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    both = lambda x: x.select("a", "b").union(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cur, before = table(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name), None
    while True:
        sym = both(cur)
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a vertex goes to the smallest of its neighbourhood
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: every smaller neighbour, and the vertex itself, goes to the smallest
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lows.select("a", F.col("m").alias("b")))
            .where("a != b").distinct()
        )
        last, cur = cur, table(small, name)
        drop(last)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = cur.groupBy("a").agg(F.min("b").alias("root"))
    return (
        vertices.select(F.col("id").cast("long").alias("id"))
        .join(roots.withColumnRenamed("a", "id"), "id", "left")
        .select("id", F.coalesce("root", "id").alias("component_id"))
    )


#: Items of a block of an array that tasks add up, and tasks whose blocks are added in the first step.
BLOCK, FAN_IN = 8192, 64


def blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's array as rows (task, block, payload), for sum_arrays; blocks of zeros are left out."""
    from pyspark import TaskContext

    context = TaskContext.get()
    task = context.partitionId() if context else 0
    parts = [(i // BLOCK, total[i : i + BLOCK]) for i in range(0, len(total), BLOCK)]
    parts = [(i, x) for i, x in parts if x.any()]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(parts), pa.int64()), pa.array([i for i, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], ["task", "block", "payload"])


def sum_arrays(parts: DataFrame, dtype, n: int) -> np.ndarray:
    """The sum of the tasks' arrays of n items: FAN_IN tasks at a time, then the rest; only the sum reaches the driver."""

    def add(keys: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in group:
            for x in b.column("payload").to_pylist():
                x = np.frombuffer(x, dtype)
                total = x.astype(np.result_type(dtype, np.float32) if np.dtype(dtype).kind == "f" else np.int64) if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int64()), pa.array([keys[1].as_py()], pa.int32()), pa.array([total.astype(dtype).tobytes()], pa.binary())], ["task", "block", "payload"])

    for by in (F.floor(F.col("task") / FAN_IN), F.lit(0)):
        parts = parts.select(by.cast("long").alias("task"), "block", "payload").groupBy("task", "block").applyInArrow(add, "task long, block int, payload binary")
    out = np.zeros(n, dtype)
    for r in parts.toLocalIterator():
        x = np.frombuffer(bytes(r["payload"]), dtype)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] = x
    return out
