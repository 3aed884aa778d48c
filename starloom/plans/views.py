"""The driver's tables as catalogs: readers, and derived positions by integer arithmetic that SQL repeats bit for bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ra(key: str) -> Column:
    return (F.col(key) * 137507 % 360000) / F.lit(1000.0)


def dec(key: str) -> Column:
    return (F.col(key) * 61803 % 50000) / F.lit(1000.0) - F.lit(18.0)


def sky(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("ra", ra(key)).withColumn("dec", dec(key))


def sql_ra(key: str) -> str:
    return f"((({key})::BIGINT * 137507) % 360000) / 1000.0::DOUBLE"


def sql_dec(key: str) -> str:
    return f"(((({key})::BIGINT * 61803) % 50000) / 1000.0::DOUBLE - 18.0::DOUBLE)"


def sql_uniform(key: str, seed: int | str) -> str:
    return f"(('0x' || substr(sha256({key}::VARCHAR || '_{seed}'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a temporary one in local mode."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/starloom-{uuid.uuid4().hex}"
