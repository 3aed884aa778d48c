"""Tables written once and read back, and joins that keep rows of a hot key spread.

A stored table cuts the lineage, so a lost executor costs a re-read; the
planner sees the size of its files, and not the product of the sizes of
everything it was made from, which loops would square in each round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one temporary folder of the application in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local.get(app) or _local.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return base.rstrip("/")


class Stored:
    """Parquet tables of one job under the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/starloom-{label}-{uuid.uuid4().hex[:12]}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def hot_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, how: str = "inner", most: int = 1000, seen: tuple[int, int] | None = None) -> DataFrame:
    """left joined with right, which has one row per key and in ``rows`` the number of left's rows with that key.

    At most ``most`` keys have more than 1/``most`` of all rows each; these are
    broadcast and their rows stay where they lie. The others are shuffled, and none of
    them fills a task. Both tables should be stored; how is inner or left. seen is the
    sum and maximum of ``rows``, where the caller knows them.
    """
    total, largest = seen or right.agg(F.sum(rows), F.max(rows)).first()
    bar = max((total or 0) // most, 1000)
    if (largest or 0) <= bar:
        return left.join(right.drop(rows), on, how)
    many = F.col(rows) > bar
    hot, rest = right.where(many).drop(rows), right.where(~many).drop(rows)
    out = left.join(F.broadcast(hot), on)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return out.unionByName(cold.select(*out.columns))
