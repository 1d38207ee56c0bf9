"""Shared helpers: tables written to the shared folder, ASCII lower-casing, joins with hot keys, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only up to this many rows of one or two numbers; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: A key is hot if it has more than one in so many of the rows; hence there are fewer hot keys than that.
HOT_SHARE = 1000
#: Up to so many edges, none of a node's neighbourhoods is worth a broadcast.
FEW_EDGES = 100_000
#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: A task that writes or reads a table between steps holds about so much of it.
ROW_GROUP_BYTES = 16 << 20

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> None:
    """Write df in row groups of a size that keeps a task's buffers small beside Python workers."""
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def stash(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors. The table is deleted
    at the end of the scratch() around it; with keep, at the end of the next one further out, if any."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    save(df, path)
    scopes = getattr(_scopes, "open", [])
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is stashed inside, but for what is kept, once the block has ended."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        *_scopes.open, paths = _scopes.open
        for path in paths:
            delete(spark, path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, once the session hands Python workers at most so many rows and bytes at a time: what a worker holds of whole
    texts and of its own results stays bounded (one text is never cut)."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def tidy() -> None:
    """Hand back to the system what this Python worker has freed: workers are used again, one stage after another, and would
    each keep the most that any stage took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Cache(dict):
    """A dictionary that is emptied once its entries hold more than so many bytes; entries over a thousandth of that are not
    kept at all. Sizes are given, and OVERHEAD is added for each entry."""

    OVERHEAD = 200

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, key, value, size: int) -> None:
        size += self.OVERHEAD
        if size > self.most // 1000:
            return
        if self.held + size > self.most:
            self.clear()
        self[key] = value
        self.held += size

    def clear(self) -> None:
        super().clear()
        self.held = 0


class Halves(Cache):
    """A cache of two halves that hold so many bytes together: a full one becomes the older half, and a new one is begun. What
    is found in the older half only should be kept again, so that what is asked for often stays."""

    def __init__(self, most: int):
        super().__init__(most // 2)
        self.older: dict = {}

    def clear(self) -> None:
        self.older = dict(self)
        super().clear()


def lean(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run, for mapInPandas, with freed memory handed back before and after each task."""

    @wraps(run)
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        yield from run(batches)
        tidy()

    return task


def with_long_ids(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """rows through run, with doc_id first: as text while in pandas, which would make floats of longs beside a null."""
    out = rows.mapInPandas(lean(run), f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def row_key() -> Column:
    """A hash of id, text and place of a row: samples drawn by it stay near their size whatever ids or texts repeat."""
    return F.xxhash64(F.col("doc_id").cast("string"), "text", F.monotonically_increasing_id())


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with table (written, one row per key, count says in how many rows it is about): the few hot keys
    are broadcast, the others are shuffled, so that no key brings more than one in HOT_SHARE of the rows to a task.
    rows must have a match for each key; they are read once."""
    values = [c for c in table.columns if c not in (*keys, count)]
    total, most = table.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    bar = max(total / HOT_SHARE, 1000.0)
    if most <= bar:
        return rows.join(table.drop(count), keys)
    hot = table.where(F.col(count) > bar)
    named = lambda df, mark: df.select(*[F.col(k).alias(f"{mark}{k}") for k in keys], F.struct(*values).alias(f"{mark}v"))
    same = lambda mark: [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys]
    met = rows.join(F.broadcast(named(hot, "_h")), same("_h"), "left")
    # Rows with a hot key are done: they go on with a null key, by a hash of row and partition, and meet nothing. A task that
    # runs again deals them the same way.
    spread = F.when(F.col("_hv").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), F.lit(100_000)).cast("int"))
    met = met.withColumn("_spread", spread).withColumns({f"_k{k}": F.when(F.col("_hv").isNull(), F.col(k)) for k in keys})
    rest = named(table.where(F.col(count) <= bar), "_r").withColumn("_zero", F.lit(0))
    out = met.join(rest, [F.col(f"_k{k}") == F.col(f"_r{k}") for k in keys] + [F.col("_spread") == F.col("_zero")], "left")
    value = F.coalesce("_hv", "_rv")
    return out.where(value.isNotNull()).select(*[F.col(c) for c in rows.columns], *[value[c].alias(c) for c in values])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b), by alternating large-star and small-star steps
    (Kiveris et al. 2014). Every step groups by node with partial minima; a node's minimum goes back to its edges by
    hot_join, so neither a neighbourhood nor a hub is gathered in one task. Returns (node, root), root the smallest
    node; nodes without edges are absent.
    """
    e = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    back = lambda rows, low, key: hot_join(rows, stash(low, "lows"), [key], "n") if many else rows.join(low.drop("n"), key)
    seen, many = None, e.count() > FEW_EDGES
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = back(both, low, "a").where("b > a").select(F.col("m").alias("x"), F.col("b").alias("y"))
        large = stash(large.where("x != y").distinct(), "large-star")
        low = large.groupBy("y").agg(F.min("x").alias("m"), F.count("*").alias("n"))
        small_star = back(large, low, "y").select(F.col("m").alias("p"), "x", "y")
        pairs = small_star.select(F.col("p").alias("a"), F.col("x").alias("b")).unionByName(small_star.select(F.col("p").alias("a"), F.col("y").alias("b")))
        e = stash(pairs.where("a != b").distinct(), "small-star")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            out = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
            return stash(out, "components", keep=True)
        seen = now
