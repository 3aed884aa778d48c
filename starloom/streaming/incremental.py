"""File-by-file work as Structured Streaming: only new files are read, restarts repeat nothing, and what is kept is merged batch by batch.

A batch's result is folded into the state of the batch before it and written
under its own id. A repeated batch starts from the same earlier state and overwrites its
own, so no file counts twice; states older than the last two are deleted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def _states(spark: SparkSession, target: str) -> dict[int, str]:
    """Finished states by batch id."""
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    out = {}
    for s in fs.listStatus(where):
        m = re.fullmatch(r"batch=(\d+)", s.getPath().getName())
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            out[int(m[1])] = f"{target}/{m[0]}"
    return out


def fold(spark: SparkSession, batch: DataFrame, batch_id: int, target: str, partial: Step, merge: Step) -> None:
    """The state after a batch: its partial result merged with the last state before it."""
    before = {k: p for k, p in _states(spark, target).items() if k < batch_id}
    new = partial(batch)
    if before:
        new = merge(spark.read.parquet(before[max(before)]).unionByName(new))
    new.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    for k in sorted(before)[:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(before[k])
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def incremental(spark: SparkSession, source: str, schema, target: str, checkpoint: str, partial: Step, merge: Step, files: int = 1000) -> DataFrame:
    """The merged state over all files seen so far; without a file, an empty one. ``merge`` gives rows that it takes itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        fold(spark, batch, batch_id, target, partial, merge)

    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    states = _states(spark, target)
    if not states:
        return partial(spark.createDataFrame([], schema))
    return spark.read.parquet(states[max(states)])


def incremental_counts(spark: SparkSession, source: str, schema, by: Sequence[str], target: str, checkpoint: str, files: int = 1000) -> DataFrame:
    """Counts per group over all files seen so far."""
    count = lambda t: t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    add = lambda t: t.groupBy(*by).agg(F.sum("n").alias("n"))
    return incremental(spark, source, schema, target, checkpoint, count, add, files)


def sketch(df: DataFrame, by: Sequence[str], values: Sequence[str], keys: Sequence[str], k: int = 400, lg: int = 14) -> DataFrame:
    """(by, n, q_<value>, d_<key>): a KLL sketch of each value and a theta sketch of each key's distinct values.

    A rank read from a KLL sketch of k = 400 is off by less than 1% of the rows in 99 of
    100 cases; a theta sketch of 2^14 entries counts up to them exactly and is
    off by less than 2.5% beyond. Nulls are in neither; both stay of bounded size and merge with
    others of their kind whatever the order.
    """
    quantiles = [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"q_{c}") for c in values]
    distinct = [F.theta_sketch_agg(F.col(c), lg).alias(f"d_{c}") for c in keys]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *quantiles, *distinct)


def merge_sketches(parts: DataFrame, by: Sequence[str], k: int = 400, lg: int = 14) -> DataFrame:
    """Sketches of parts, such as files or days, as one per group."""
    q = [F.kll_merge_agg_double(c, k).alias(c) for c in parts.columns if c.startswith("q_")]
    d = [F.theta_union_agg(c, lg).alias(c) for c in parts.columns if c.startswith("d_")]
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *q, *d)


def read_sketches(t: DataFrame, by: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(by, n, <value>_p<quantile>, <key>_distinct) read off merged sketches; a group without a value has null quantiles."""
    out: list[Column] = []
    for c in t.columns:
        if c.startswith("q_"):
            some = F.kll_sketch_get_n_double(c) > 0
            out += [F.when(some, F.kll_sketch_get_quantile_double(c, F.lit(float(p)))).alias(f"{c[2:]}_p{100 * p:g}") for p in quantiles]
        elif c.startswith("d_"):
            out.append(F.theta_sketch_estimate(c).alias(f"{c[2:]}_distinct"))
    return t.select(*by, "n", *out)


def incremental_sketches(spark: SparkSession, source: str, schema, by: Sequence[str], values: Sequence[str], keys: Sequence[str], target: str, checkpoint: str, k: int = 400, lg: int = 14, files: int = 1000) -> DataFrame:
    """Merged sketches over all files seen so far, without reading any of them twice."""
    return incremental(spark, source, schema, target, checkpoint, lambda t: sketch(t, by, values, keys, k, lg), lambda t: merge_sketches(t, by, k, lg), files)
