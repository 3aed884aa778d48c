"""Leak-free train, validation and test splits from hashes, and their audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.columns import col, hash_uniform
from starloom.operators.stored import Stored

SHARES = (("test", 0.1), ("val", 0.1), ("train", 0.8))


def hash_split(key: str | Column, seed: int = 13, shares: Sequence[tuple[str, float]] = SHARES) -> Column:
    """Split name by cumulative shares of the hash uniform; the last name takes the rest."""
    u, out = hash_uniform(key, seed), F.lit(shares[-1][0])
    edge = sum(s for _, s in shares[:-1])
    for name, share in reversed(shares[:-1]):
        out = F.when(u < F.lit(round(edge, 12)), F.lit(name)).otherwise(out)
        edge -= share
    return out


def exact_split(df: DataFrame, key: str, by: Sequence[str], train: float = 0.8, val: float = 0.1, seed: int = 13) -> DataFrame:
    """df plus ``split`` with exact counts per group: int(n * train), int(n * val), and the rest for test. Groups are numbered by ranges, so a group may be as large as the table."""
    from starloom.operators.windows import numbered

    t = numbered(df.withColumn("_u", hash_uniform(key, seed)), [*by, "_u", key], "_i", by)
    t = t.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), list(by))
    first, second = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(val))
    return t.select(*df.columns, F.when(F.col("_i") <= first, "train").when(F.col("_i") <= first + second, "val").otherwise("test").alias("split"))


def relabel(split: str, key: str, share: float, seed: int = 17) -> Column:
    """Moves a share of val to train; test never changes."""
    return F.when((F.col(split) == "val") & (hash_uniform(key, seed) < share), "train").otherwise(F.col(split))


def fill_missing(split: str | Column, key: str, seed: int = 13) -> Column:
    return F.coalesce(col(split), hash_split(key, seed))


def proportions(df: DataFrame, split: str, expected: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """(split, n, actual, expected, status) for expected and unknown splits: ok, warn beyond half the tolerance, fail beyond it."""
    want = df.sparkSession.createDataFrame(list(expected.items()), "split string, expected double")
    have = df.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    total = have.agg(F.sum("n").alias("_all"))
    j = have.join(F.broadcast(want), "split", "full").crossJoin(F.broadcast(total))  # one row
    j = j.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("actual", F.col("n") / F.col("_all"))
    gap = F.abs(F.col("actual") - F.col("expected"))
    status = F.when(F.col("expected").isNull(), "unknown").when(gap > tolerance, "fail").when(gap > tolerance / 2, "warn").otherwise("ok")
    return j.select("split", "n", "actual", "expected", status.alias("status"))


def ks(df: DataFrame, value: str, group: Column, by: Sequence[str] = ()) -> DataFrame:
    """Exact two-sample Kolmogorov-Smirnov statistic of a value between rows where ``group`` holds and the others."""
    from starloom.operators.windows import score_counts

    t = score_counts(df, value, group, by)
    gap = F.abs((F.col("pos_below") + F.col("pos")) / F.nullif(F.col("pos_all"), F.lit(0)) - (F.col("neg_below") + F.col("neg")) / F.nullif(F.col("neg_all"), F.lit(0)))
    return t.groupBy(*by).agg(F.max(gap).alias("ks"), F.max("pos_all").alias("n1"), F.max("neg_all").alias("n2"))


def ks_p(statistic: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of a KS statistic; null without rows on both sides."""
    x = statistic * F.sqrt(n1 * n2 / F.nullif(n1 + n2, F.lit(0)))
    part = lambda j: F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * j * j * x * x)
    p = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, j: s + part(j))
    return F.when(x.isNotNull(), F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))))  # below 0.2 the series has no meaning and p is 1


def min_separation(test: DataFrame, train: DataFrame, limit: float, key: str, other: str, **on) -> tuple[DataFrame, DataFrame]:
    """(report, violations): smallest and median distance from test rows to their nearest train row at any distance, and the test rows closer than ``limit``.

    ``alone`` counts test rows without a distance: all of them if train is
    empty, and those without a position.
    """
    from starloom.operators.skytree import nearest_in_tree

    near = Stored(test.sparkSession, "separation").keep(nearest_in_tree(test, train, key, other, **on))
    t = test.select(key).join(near, key, "left")
    report = t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sep").isNull()).alias("alone"), F.min("sep").alias("least"), F.percentile("sep", F.lit(0.5)).alias("median"), F.count_if(F.col("sep") < limit).alias("violations"))
    return report, near.where(F.col("sep") < limit)


def balance(df: DataFrame, split: str, columns: Sequence[str], only: Column | None = None) -> DataFrame:
    """(feature, split_a, split_b, mean_a, mean_b, ks, p): KS and means of each column for each pair of splits, of all rows or those where ``only`` holds."""
    from starloom.operators.metrics import unpivot

    long = unpivot(df if only is None else df.where(only), columns, [split]).where("value is not null")
    names = [r[0] for r in df.select(split).where(F.col(split).isNotNull()).distinct().orderBy(split).collect()]  # a handful of splits
    pairs = [F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b")) for i, a in enumerate(names) for b in names[i + 1 :]]
    t = long.withColumn("_p", F.explode(F.filter(F.array(*pairs), lambda p: (p["split_a"] == F.col(split)) | (p["split_b"] == F.col(split))))).select("feature", "value", "_p.*", (F.col("_p.split_a") == F.col(split)).alias("_a"))
    means = t.groupBy("feature", "split_a", "split_b").agg(F.avg(F.when(F.col("_a"), F.col("value"))).alias("mean_a"), F.avg(F.when(~F.col("_a"), F.col("value"))).alias("mean_b"))
    k = ks(t, "value", F.col("_a"), ["feature", "split_a", "split_b"])
    return means.join(k, ["feature", "split_a", "split_b"]).withColumn("p", ks_p(F.col("ks"), F.col("n1"), F.col("n2"))).drop("n1", "n2")
