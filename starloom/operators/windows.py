"""Rankings, quotas and running totals with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.columns import hash_uniform
from starloom.operators.sets import union_named
from starloom.operators.stored import Stored


def numbered(df: DataFrame, order: Sequence[str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """df with ``name`` = 1, 2, 3, ... in a unique order, over all rows or within each value of ``within``, the order's leading columns.

    Rows are range partitioned, so no task sorts all of them; the rows before
    each partition come from counts.
    """
    t = Stored(df.sparkSession, "numbered").keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    heads = t.groupBy(*within, part.alias("_part")).agg(F.min("_at").alias("_head"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*within, "_part", "_head", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # one row for each partition and group
    joined = t.withColumn("_part", part).join(F.broadcast(heads), [*within, "_part"])
    return joined.select(*df.columns, (F.col("_at") - F.col("_head") + F.col("_before") + 1).alias(name))


def topk(df: DataFrame, k: int, by: Sequence[str], score: str, key: str, rank: str = "rank") -> DataFrame:
    """The k rows of each group with the highest score, ranked; ties to the smaller key.

    Spark cuts each group to k rows before the shuffle, so a large group stays small (k up to ``spark.sql.optimizer.windowGroupLimitThreshold``).
    """
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def stratified_topk(df: DataFrame, quotas: dict[int, int], by: Sequence[str], bin_: str, score: str, key: str) -> DataFrame:
    """Top rows per group and bin, each bin with its own quota, in one pass."""
    quota = F.lit(0)
    for b, n in quotas.items():
        quota = F.when(F.col(bin_) == b, F.lit(n)).otherwise(quota)
    w = Window.partitionBy(*by, bin_).orderBy(F.desc(score), key)
    ranked = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(quotas.values(), default=0))  # a constant, which cuts groups before they are shuffled
    return ranked.where(F.col("rank") <= quota)


def two_pass_quota(df: DataFrame, inner: Sequence[str], outer: Sequence[str], inner_cap: int, outer_cap: int, key: str, seed: int = 0) -> DataFrame:
    """At most inner_cap rows of each inner cell and then outer_cap of each outer group, in hash order."""
    u = hash_uniform(key, seed)
    a = df.withColumn("_u", u).withColumn("_a", F.row_number().over(Window.partitionBy(*outer, *inner).orderBy("_u", key))).where(F.col("_a") <= inner_cap)
    return a.withColumn("rank", F.row_number().over(Window.partitionBy(*outer).orderBy("_u", key))).where(F.col("rank") <= outer_cap).drop("_u", "_a")


def half_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The first row of each group at which the running sum passes half of the total."""
    w = Window.partitionBy(*by)
    run = F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    t = df.withColumn("running", run).withColumn("_total", F.sum(value).over(w)).where(F.col("running") * 2 >= F.col("_total"))
    return t.withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1").drop("_n", "_total")


def score_counts(df: DataFrame, score: str, label: Column, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(by, score, pos, neg, pos_below, neg_below, pos_all, neg_all): counts, or sums of weights, at each distinct score, below it, and in all."""
    one = F.lit(1) if weight is None else weight
    t = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.when(label, one).otherwise(0)).alias("pos"), F.sum(F.when(label, 0).otherwise(one)).alias("neg"))
    return running_counts(t, score, by)


def running_counts(t: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg) with running sums, as in ``score_counts``.

    Rows meet as counts of distinct scores only. Within a group the sums run
    over score ranges first and then inside each range, so that one very
    large group is not summed by a single task. The counts are stored once.
    """
    t = Stored(t.sparkSession, "counts").keep(t)
    edges = t.groupBy(*by).agg(F.percentile_approx(score, [i / 64 for i in range(1, 64)], 1000).alias("_e"))
    part = F.size(F.filter("_e", lambda x: x <= F.col(score)))
    t = (t.join(edges, list(by)) if by else t.crossJoin(F.broadcast(edges))).withColumn("_part", part).drop("_e")  # one row of edges
    sums = t.groupBy(*by, "_part").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_pb"), F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_qb"), F.sum("_p").over(every).alias("pos_all"), F.sum("_q").over(every).alias("neg_all"))
    own = Window.partitionBy(*by, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    j = t.join(sums, [*by, "_part"])
    below = lambda c, b: (F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(b)).alias(f"{c}_below")
    return j.select(*by, score, "pos", "neg", below("pos", "_pb"), below("neg", "_qb"), "pos_all", "neg_all")


def threshold_at_fpr(df: DataFrame, score: str, label: Column, fpr: float) -> DataFrame:
    """One row: the k-th largest negative score for k = max(1, ceil(fpr * n)), and the rate of negatives at or above it."""
    t = score_counts(df, score, label)
    k = F.greatest(F.ceil(F.col("neg_all") * F.lit(fpr)), F.lit(1))
    above = F.col("neg_all") - F.col("neg_below")
    return t.where((F.col("neg") > 0) & (above >= k)).agg(F.max_by(F.struct(F.col(score).alias("threshold"), (above / F.col("neg_all")).alias("actual_fpr")), score).alias("r")).select("r.*")


def global_topk(df: DataFrame, k: int, score: str, key: str) -> DataFrame:
    """The k highest scores of all rows; ties to the smaller key."""
    return df.orderBy(F.desc(score), key).limit(k)


def ordered_list(df: DataFrame, order: Sequence[Column | str], most: int, name: str = "place") -> DataFrame:
    """The first ``most`` rows in a total order, with their place from 1; only those rows are numbered in one task."""
    return df.orderBy(*order).limit(most).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def candidates(df: DataFrame, score: str, least: float, most: int, key: str, grades: DataFrame, default: str = "ungraded") -> DataFrame:
    """Up to ``most`` rows of the highest scores from ``least`` on, with their grade(key, grade) if they have one."""
    top = global_topk(df.where(F.col(score) >= least), most, score, key)
    return top.join(grades.select(key, "grade"), key, "left").withColumn("grade", F.coalesce("grade", F.lit(default)))


def local_order(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a key in one partition, sorted inside it; for writers and readers that go through neighbours."""
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def boundary_samples(df: DataFrame, value: str, cuts: Sequence[float], within: float, key: str, k: int = 10) -> DataFrame:
    """(sample, rows of df): rows near each cut, and the k with the smallest and the k with the largest values."""
    parts = [df.where(F.abs(F.col(value) - c) <= within).withColumn("sample", F.lit(f"near {c:g}")) for c in cuts]
    parts += [df.orderBy(value, key).limit(k).withColumn("sample", F.lit("smallest")), df.orderBy(F.desc(value), key).limit(k).withColumn("sample", F.lit("largest"))]
    return union_named(*parts)
