"""Pieces that several text operators share: scratch tables, global numbering, components, pre-filters.

Scratch tables lie under ``spark.checkpoint.dir`` (shared by driver and
executors), so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java and RE2 spelling of "a run of non-space bytes" used by several contracts.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_local_dirs: dict[str, str] = {}
_held: list[Callable] = []


def per_worker(make: Callable) -> Callable:
    """``make`` with its last result held in the Python worker for the tasks that follow, until a stage without it begins."""
    out = lru_cache(maxsize=1)(make)
    _held.append(out)
    return out


def give_back(using: str | None = None) -> None:
    """Drops what ``per_worker`` holds, but for that of module ``using``, and returns freed memory to the system."""
    for f in _held:
        if f.__module__ != using:
            f.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def frugal(run: Callable, using: str | None = None) -> Callable:
    """run for mapInArrow, in a worker that holds nothing of other stages.

    Spark reuses Python workers, so what one stage's tables and batches took would
    stand beside those of the next. using is the module whose ``per_worker`` result run looks up.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(using)
        try:
            yield from run(batches)
        finally:
            give_back(using)

    return task


def workspace(spark: SparkSession) -> str:
    """The shared folder for scratch tables: ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local_dirs.get(app) or _local_dirs.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return base.rstrip("/")


class Scratch:
    """Tables written once and read back; ``drop`` frees those that no later plan reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths = spark, f"{workspace(spark)}/starloom-{label}-{uuid.uuid4().hex[:12]}", {}

    def keep(self, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
        """df written and read back, at ``path`` if one is given."""
        path = path or f"{self.root}/{name}-{len(self.paths)}"
        rows = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, "1000")  # whole texts: a batch of the usual 10,000 rows takes tens of megabytes on both sides
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(BATCH, rows)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            self.paths[object()] = (path, None)  # keeps later names unique


def numbered(scratch: Scratch, df: DataFrame, order: list, name: str, within: list[str] | None = None) -> DataFrame:
    """df with ``name`` = 0, 1, 2, ... in the given order, over all rows or within each value of ``within``.

    Rows are range partitioned and sorted, so no task holds more than its
    range; ``within`` must be the leading columns of the order. Only one row
    per (partition, group) is summed to get the offsets.
    """
    within = within or []
    t = scratch.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    heads = t.groupBy(*within, part).agg(F.min("_at").alias("_head"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*within, "_part", "_head", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    on = F.shiftrightunsigned(F.col("t._at"), 33) == F.col("h._part")
    for c in within:
        on = on & F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}"))
    j = t.alias("t").join(heads.alias("h"), on)
    return j.select(*[F.col(f"t.{c}") for c in df.columns], (F.col("t._at") - F.col("h._head") + F.col("h._before")).alias(name))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, how: str = "inner", most: int = 1000) -> DataFrame:
    """left joined with right on ``on``; right has one row per key, with the number of left's rows that have the key in ``rows``.

    Keys of more than 1/``most`` of all rows are at most ``most``: they are
    broadcast, so their rows stay where they lie. The others are shuffled, and
    none of them fills a task. Both tables are read more than once, so they
    should be stored. how is inner or left; ``rows`` is dropped.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    many = F.col(rows) > max(total // most, 1)
    hot, rest = right.where(many).drop(rows), right.where(~many).drop(rows)
    out = left.join(F.broadcast(hot), on)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return out.unionByName(cold.select(*out.columns))


def positions(docs: DataFrame, *columns: str) -> tuple[DataFrame, ...]:
    """docs with its columns named by their places, so that no name of the caller meets one in use here, and the new names of some columns.

    ``toDF(*docs.columns)`` at the end gives the caller's names back.
    """
    return docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))]), *[f"_in{docs.columns.index(c)}" for c in columns]


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores after it as make it differ from the caller's columns."""
    while name in taken:
        name += "_"
    return name


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def occupied(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, slots: int = 1 << 20) -> DataFrame:
    """Rows of df whose key is wanted; a few others may stay. ``wanted`` is a stored table without null keys.

    As long as it has at most ``slots`` / 4 rows, the hash slots that they fall
    in are broadcast (distinct small integers), and rows in other slots are
    pruned before any shuffle. Beyond that the slots would let most rows
    through, and an exact semi join takes their place.
    """
    if wanted.count() > slots // 4:
        return df.join(wanted.select(wanted_key.alias("_wanted")), key == F.col("_wanted"), "left_semi")
    marks = wanted.select(_slot(wanted_key, slots).alias("_slot")).distinct()
    return df.withColumn("_slot", _slot(key, slots)).join(F.broadcast(marks), "_slot", "left_semi").drop("_slot")


def without(df: DataFrame, key: str, gone: DataFrame, gone_key: str, slots: int = 1 << 20) -> DataFrame:
    """Rows of df whose key is not among ``gone``, a stored table; null keys stay.

    While ``gone`` has at most ``slots`` / 4 rows, rows whose hash slot holds no
    such key pass as they are and only the others are shuffled for the exact
    join; beyond that all rows are.
    """
    exact = lambda d: d.join(gone, F.col(key) == F.col(gone_key), "left_anti")
    if gone.count() > slots // 4:
        return exact(df)
    marks = gone.select(_slot(F.col(gone_key), slots).alias("_slot")).distinct()
    slotted = df.withColumn("_slot", _slot(F.col(key), slots))
    clear = slotted.join(F.broadcast(marks), "_slot", "left_anti").drop("_slot")
    return clear.unionAll(exact(slotted.join(F.broadcast(marks), "_slot", "left_semi").drop("_slot")))


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in links(a, b): component_id is the smallest id reachable.

    Alternating large-star and small-star rewrites. Every step counts the links
    of each id with its minimum, and joins the minimum back by ``spread_join``, so
    a hub with a large share of all links stays spread over tasks.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "low")
        large = scratch.keep(spread_join(both, low, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        joined = spread_join(large, least, ["u"], "n")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        new = scratch.keep(small.where("u <> v").distinct(), "small")
        scratch.drop(edges, low, large, least)
        edges = new
        ends = new.select("u", F.lit(1).alias("links"), F.lit(0).alias("below")).unionAll(new.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("u").agg(F.sum("links").alias("links"), F.max("below").alias("below")).where("links > 1 or links = 1 and below = 1").head(1):
            break  # every id has one link, to an id that has none
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
