"""Bootstrap and permutation draws on counts of distinct scores, and permutation tests that refit their model.

Poisson(1) weights of n rows at one score sum to a Poisson(n) draw, and a
shuffle of labels deals each score a hypergeometric share of the positives. So
replicates are drawn per distinct score, and no row is copied. Draws come
from generators keyed by hashes or range numbers, so a lost task draws the same again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.columns import hash_uniform
from starloom.operators.stored import Stored

#: numpy's hypergeometric draws take populations below this; larger ones are drawn as rounded normals of the same mean and variance, whose relative error is below 1e-4.
LARGEST = 10**9


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, drawn: np.ndarray | int) -> np.ndarray:
    """Good ones among ``drawn`` of good + bad, elementwise."""
    good, bad, drawn = np.broadcast_arrays(*(np.asarray(x, np.int64) for x in (good, bad, drawn)))
    all_ = good + bad
    if all_.max(initial=0) < LARGEST:
        return rng.hypergeometric(good, bad, drawn)
    share = good / np.maximum(all_, 1)
    spread = np.sqrt(np.maximum(drawn * share * (1 - share) * (all_ - drawn) / np.maximum(all_ - 1, 1), 0))
    return np.clip(np.rint(drawn * share + spread * rng.standard_normal(good.shape)), np.maximum(0, drawn - bad), np.minimum(drawn, good)).astype(np.int64)


def deal(rng: np.random.Generator, sizes: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """(places, replicates): ``positives`` of each replicate dealt over places of the given sizes, as a shuffle would."""
    left, rest = np.asarray(positives, np.int64).copy(), int(np.sum(sizes))
    out = np.empty((len(sizes), len(left)), np.int64)
    for i, n in enumerate(np.asarray(sizes).tolist()):
        out[i] = hypergeometric(rng, left, rest - left, n)
        left -= out[i]
        rest -= n
    return out


def poisson_counts(df: DataFrame, score: str, label: Column, replicates: int, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(by, score, replicate, pos, neg): the Poisson bootstrap's sums of weights at each distinct score, drawn from its counts."""
    t = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(label).alias("pos"), (F.count(F.lit(1)) - F.count_if(label)).alias("neg"))
    t = t.withColumn("_key", F.xxhash64(*by, score, F.lit(seed)))
    kinds = dict(t.dtypes)
    out = [*by, score]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 18) // replicates)
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                keys, pos, neg = (part.column(part.schema.names.index(c)).to_numpy() for c in ("_key", "pos", "neg"))
                both = np.stack([pos, neg], 1)[:, :, None]
                drawn = np.stack([np.random.Generator(np.random.Philox(key=np.uint64(k))).poisson(n, (2, replicates)) for k, n in zip(keys.view(np.uint64), both, strict=True)])
                at = pa.array(np.repeat(np.arange(part.num_rows), replicates))
                columns = [part.column(part.schema.names.index(c)).take(at) for c in out]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(replicates, dtype=np.int32), part.num_rows)), pa.array(drawn[:, 0].reshape(-1)), pa.array(drawn[:, 1].reshape(-1))], names=[*out, "replicate", "pos", "neg"])

    return t.mapInArrow(draw, ", ".join([*(f"`{c}` {kinds[c]}" for c in out), "replicate int, pos bigint, neg bigint"]))


def permuted_auc(df: DataFrame, score: str, label: Column, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, null): the AUC of fixed scores under shuffled labels, ties halved; null without both labels.

    Positives are dealt to score ranges on the driver, one row of sizes per
    range, and then inside each range as a task passes over its counts in score order.
    """
    spark = df.sparkSession
    stored = Stored(spark, "permuted")
    t = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    t = stored.keep(t.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    parts = t.groupBy("part").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).orderBy("part").collect()
    sizes, positives = np.array([p.n for p in parts], np.int64), sum(p.pos for p in parts)
    dealt = deal(np.random.default_rng([seed, 0]), sizes, np.full(replicates, positives))
    below = np.cumsum(sizes[:, None] - dealt, axis=0) - (sizes[:, None] - dealt)
    plan = {p.part: (int(n), k, b) for p, n, k, b in zip(parts, sizes, dealt, below, strict=True)}

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rng, rest, left, neg, area = None, None, 0, None, None, np.zeros(replicates)
        for batch in batches:
            part_of, n_of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in np.unique(part_of):
                n = n_of[part_of == part]
                if part != now:
                    now, rng = part, np.random.default_rng([seed, 1, int(part)])
                    rest, left, neg = plan[part][0], plan[part][1].copy(), plan[part][2].astype(float)
                here = int(n.sum())
                k = hypergeometric(rng, left, rest - left, here)
                pos = deal(rng, n, k)
                negs = n[:, None] - pos
                under = neg + np.cumsum(negs, axis=0) - negs
                area += (pos * (under + negs / 2)).sum(axis=0)
                left, rest, neg = left - k, rest - here, neg + negs.sum(axis=0)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(area)], names=["replicate", "area"])

    sums = t.repartition("part").sortWithinPartitions("part", "s").select("part", "n").mapInArrow(areas, "replicate int, area double")
    pairs = float(positives) * float(sizes.sum() - positives) or None
    return sums.groupBy("replicate").agg((F.sum("area") / F.lit(pairs).cast("double")).alias("null"))


def permutation_summary(null: DataFrame, auc: float | None, replicates: int) -> DataFrame:
    """One row: auc, mean_null, std_null, n_exceed, p_value = (n_exceed + 1) / (replicates + 1)."""
    real = F.lit(auc).cast("double")
    out = null.agg(real.alias("auc"), F.avg("null").alias("mean_null"), F.stddev("null").alias("std_null"), F.count_if(F.col("null") >= real - 1e-12).alias("n_exceed"))
    return out.withColumn("p_value", (F.col("n_exceed") + 1) / F.lit(replicates + 1.0))


#: Bins of equal mass that a model's scores are counted in for its AUC.
BINS = 4096


def _normal(u: np.ndarray) -> np.ndarray:
    """Share of a standard normal below u, to 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(u))
    tail = np.exp(-u * u / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(u > 0, 1 - tail, tail)


def permutation_refit(df: DataFrame, key: str, label: Column, vector: str, replicates: int, test: float = 0.2, seed: int = 0, l2: float = 1.0, passes: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """(model, auc): AUC on held-out rows of logistic probes, refitted on each shuffle of the labels; model 0 has the real ones.

    Labels of all rows are shuffled, and a fixed share of them, by the key's
    hash, is held out; features are standardised on the rest. A one-sided label set gives 0.5. Rows with a null label or vector, or
    with a null in their vector, are left out.

    All models are fitted together: a pass over the rows gives every model's gradient. The
    matrix of the features' products, one for all, bounds their curvature, so
    accelerated steps against it never diverge; the real labels' model, whose curvature may be
    far below, gets its own matrix and Newton steps. A task returns models x features sums.
    Dealt labels are stored as bits beside each row. AUCs come from counts in 4,096 bins of about equal mass.
    """
    spark = df.sparkSession
    stored = Stored(spark, "refit")
    x = F.col(vector).cast("array<double>")
    t = df.select(key, x.alias("x"), label.alias("y"), (hash_uniform(key, seed) < test).alias("held")).where(F.col("y").isNotNull() & x.isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    t = stored.keep(t.withColumn("part", F.spark_partition_id()))
    parts = t.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos"), F.max(F.size("x")).alias("d"), F.min(F.size("x")).alias("least")).orderBy("part").collect()
    schema = "model int, auc double"
    if not parts:
        return spark.createDataFrame([], schema)
    d, models = parts[0].d, replicates + 1
    if any(p.d != d or p.least != d for p in parts):
        raise ValueError("vectors differ in length")
    dealt = deal(np.random.default_rng([seed, 0]), np.array([p.n for p in parts]), np.full(replicates, sum(p.pos for p in parts)))
    plan = {p.part: (p.n, k) for p, k in zip(parts, dealt, strict=True)}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rng, rest, left = None, None, 0, None
        for batch in batches:
            part_of = batch.column(3).to_numpy()
            for part in np.unique(part_of):
                rows = batch.filter(pa.array(part_of == part))
                if part != now:
                    now, rng = part, np.random.default_rng([seed, 1, int(part)])
                    rest, left = plan[part][0], plan[part][1].copy()
                n = rows.num_rows
                k = hypergeometric(rng, left, rest - left, n)
                left, rest = left - k, rest - n
                order = rng.random((n, replicates)).argsort(axis=0).argsort(axis=0)  # of each replicate, k rows at random
                bits = np.concatenate([rows.column(1).to_numpy(zero_copy_only=False)[:, None], order < k], axis=1)
                packed = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([r.tobytes() for r in packed], pa.binary())], names=["x", "held", "bits"])

    t = stored.keep(t.repartition("part").sortWithinPartitions("part", key).select("x", "y", "held", "part").mapInArrow(mark, "x array<double>, held boolean, bits binary"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048)
                rows = b.column(0).flatten().to_numpy().reshape(-1, d)
                yield rows, np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(rows), -1), axis=1)[:, :models]

    def added(df: DataFrame, task, shape: tuple[int, ...]) -> np.ndarray:
        """Sum over tasks of the array that ``task`` makes of its blocks, by place."""
        size = math.prod(shape)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for rows, labels in blocks(batches):
                total += task(rows, labels).reshape(-1)
            for lo in range(0, size, 1 << 16):
                some = np.flatnonzero(total[lo : lo + (1 << 16)]) + lo
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "v"])

        out = np.zeros(size)
        for r in df.select("x", "bits").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().to_batches():  # models x features numbers
            out[r.column(0).to_numpy()] = r.column(1).to_numpy()
        return out.reshape(shape)

    train, held = t.where("not held"), t.where("held")
    sums = added(train, lambda r, y: np.concatenate([[len(r)], r.sum(0), (r * r).sum(0), y.sum(0)]), (1 + 2 * d + models,))
    n, mean, pos = sums[0], sums[1 : d + 1] / max(sums[0], 1), sums[1 + 2 * d :]
    scale = np.sqrt(np.maximum(sums[d + 1 : 2 * d + 1] / max(n, 1) - mean * mean, 0))
    scale[scale == 0] = 1.0
    whole = lambda r: np.concatenate([(r - mean) / scale, np.ones((len(r), 1))], axis=1)
    products = added(train, lambda r, y: (z := whole(r)).T @ z, (d + 1, d + 1))
    ridge = np.diag([l2] * d + [1e-9])
    bound = np.linalg.inv(products / 4 + ridge)
    w = np.zeros((models, d + 1))
    w[:, d] = np.log(np.maximum(pos, 0.5) / np.maximum(n - pos, 0.5))
    ahead, speed = w.copy(), 1.0
    for _ in range(passes):
        at = ahead.copy()

        def slopes(r: np.ndarray, y: np.ndarray, at=at) -> np.ndarray:
            z = whole(r)
            p = 1 / (1 + np.exp(-np.clip(z @ at.T, -500, 500)))
            own = (z * (p[:, :1] * (1 - p[:, :1]))).T @ z
            return np.concatenate([((p - y).T @ z).reshape(-1), own.reshape(-1)])

        got = added(train, slopes, (models * (d + 1) + (d + 1) ** 2,))
        slope = got[: models * (d + 1)].reshape(models, d + 1) + at @ ridge
        new = at - slope @ bound
        new[0] = at[0] - np.linalg.solve(got[models * (d + 1) :].reshape(d + 1, d + 1) + ridge, slope[0])
        turned = ((slope[1:] * (new[1:] - w[1:])).sum()) > 0  # the speed carried it past the minimum
        faster = 1.0 if turned else (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        moved = float(np.abs(new - w).max())
        ahead = new + (0.0 if turned else (speed - 1) / faster) * (new - w)
        ahead[0] = new[0]
        w, speed = new, faster
        if moved < tolerance:
            break

    spread = np.sqrt(np.maximum(np.einsum("mi,ij,mj->m", w[:, :d], products[:d, :d] / max(n, 1), w[:, :d]), 1e-300))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, models * BINS), np.int64)
        for rows, y in blocks(batches):
            u = _normal((whole(rows)[:, :d] @ w[:, :d].T) / spread)
            place = np.minimum((u * BINS).astype(np.int64), BINS - 1) + np.arange(models) * BINS
            for side in (0, 1):
                total[side] += np.bincount(place[y == side], minlength=models * BINS)
        some = np.flatnonzero(total.any(axis=0))
        for lo in range(0, len(some), 1 << 16):
            k = some[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((k // BINS).astype(np.int32)), pa.array((k % BINS).astype(np.int32)), pa.array(total[1][k]), pa.array(total[0][k])], names=["model", "bin", "pos", "neg"])

    counts = held.select("x", "bits").mapInArrow(count, "model int, bin int, pos bigint, neg bigint").groupBy("model", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = Window.partitionBy("model").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows of each model
    c = counts.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    auc = F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))
    one_sided = [m for m in range(models) if pos[m] in (0, n)]
    fit = c.groupBy("model").agg(F.coalesce(auc, F.lit(0.5)).alias("auc"))
    return stored.keep(fit.withColumn("auc", F.when(F.col("model").isin(one_sided), 0.5).otherwise(F.col("auc"))))


def refit_test(df: DataFrame, key: str, label: Column, vector: str, replicates: int, **how) -> DataFrame:
    """One row as in ``permutation_summary``, with probes refitted on every shuffle."""
    t = permutation_refit(df, key, label, vector, replicates, **how)
    real = t.where("model = 0").first()
    return permutation_summary(t.where("model > 0").select(F.col("auc").alias("null")), real and real.auc, replicates)


