"""Set operations, duplicates and overlaps without collecting keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_named(*frames: DataFrame) -> DataFrame:
    """Union by name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_overlap(df: DataFrame, key: str, split: str) -> DataFrame:
    """(split_a, split_b, n): keys that occur in both of two splits."""
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("n"))


def missing_extra(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row: expected, actual, missing and extra keys and the coverage in percent."""
    j = expected.select(key).distinct().withColumn("_e", F.lit(1)).join(actual.select(key).distinct().withColumn("_a", F.lit(1)), key, "full")
    e, a = F.col("_e").isNotNull(), F.col("_a").isNotNull()
    out = j.agg(F.count_if(e).alias("n_expected"), F.count_if(a).alias("n_actual"), F.count_if(e & ~a).alias("n_missing"), F.count_if(a & ~e).alias("n_extra"))
    return out.withColumn("coverage", F.lit(100.0) * (F.col("n_expected") - F.col("n_missing")) / F.nullif(F.col("n_expected"), F.lit(0)))


def duplicates(df: DataFrame, keys: Sequence[str], sample: str | None = None, most: int = 3) -> DataFrame:
    """Keys that occur more than once, with how often and, if asked for, up to ``most`` of the smallest values of another column."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if sample:
        aggs += [F.min(sample).alias("first"), F.max(sample).alias("last")]
    t = df.groupBy(*keys).agg(*aggs).where("n > 1")
    if not sample:
        return t
    w = Window.partitionBy(*keys).orderBy(sample)
    few = df.join(t.select(*keys), list(keys), "left_semi").withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
    return t.join(few.groupBy(*keys).agg(F.sort_array(F.collect_list(sample)).alias("samples")), list(keys))


def dedup_position(df: DataFrame, size: float, order: Sequence[Column | str], positions: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """One row per cell of ``size`` degrees: the first in the given total order."""
    cell = [F.floor(F.col(c) / size) for c in positions]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where("_n = 1").drop("_n")


def entity_key(ra: str, dec: str, places: int = 6) -> Column:
    """Text of a position rounded to some places: the same for rows of one object."""
    return F.concat_ws("_", F.format_string(f"%.{places}f", F.round(ra, places)), F.format_string(f"%.{places}f", F.round(dec, places)))
