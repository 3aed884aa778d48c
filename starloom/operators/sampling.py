"""Deterministic samples and experiment manifests."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.columns import clean_mask, content_id, content_md5, hash_uniform, healpix_nested, lookup, within
from starloom.operators.joins import away, bin_swap, modulo_assign, near_flag
from starloom.operators.sets import dedup_position, union_named
from starloom.operators.splits import hash_split
from starloom.operators.windows import numbered, topk


def fraction(df: DataFrame, key: str, share: float, seed: int = 3) -> DataFrame:
    return df.where(hash_uniform(key, seed) < share)


def ratio_backfill(positives: DataFrame, pool: DataFrame, strata: Sequence[str], key: str, kind: str, ratio: int, first_share: float = 0.85, seed: int = 7) -> DataFrame:
    """Per stratum ``ratio`` pool rows per positive: int(ratio * p * first_share) of kind 1, the rest of kind 2, and what is missing from the next rows of kind 1."""
    need = positives.groupBy(*strata).agg(F.count(F.lit(1)).alias("_p"))
    have = pool.where(F.col(kind) == 2).groupBy(*strata).agg(F.count(F.lit(1)).alias("_n2"))
    quota = need.join(have, list(strata), "left").select(*strata, F.floor(F.col("_p") * F.lit(ratio * first_share)).alias("_q1"), (F.col("_p") * ratio).alias("_all"), F.coalesce("_n2", F.lit(0)).alias("_n2"))
    quota = quota.withColumn("_q2", F.col("_all") - F.col("_q1")).withColumn("_short", F.greatest(F.col("_q2") - F.col("_n2"), F.lit(0)))
    ranked = numbered(pool.withColumn("_u", hash_uniform(key, seed)), [*strata, kind, "_u", key], "_i", [*strata, kind]).drop("_u").join(quota, list(strata))
    take = F.when(F.col(kind) == 1, F.col("_i") <= F.col("_q1") + F.col("_short")).otherwise(F.col("_i") <= F.col("_q2"))
    return ranked.where(take).withColumn("backfill", (F.col(kind) == 1) & (F.col("_i") > F.col("_q1"))).drop("_i", "_q1", "_q2", "_all", "_n2", "_short")


def waterfall(df: DataFrame, filters: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, name, kept, lost) of ordered filters, in one scan."""
    cond, aggs = F.lit(True), [F.count(F.lit(1)).alias("k0")]
    for i, (_, c) in enumerate(filters, 1):
        cond = cond & F.coalesce(c, F.lit(False))
        aggs.append(F.count_if(cond).alias(f"k{i}"))
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"k{i}").alias("kept"), (F.col(f"k{i - 1}") - F.col(f"k{i}")).alias("lost")) for i, (n, _) in enumerate(filters, 1)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def mine_top(df: DataFrame, bin_: str, score: str, key: str, per_bin: int, total: int, known: DataFrame | None = None, radius: float = 0.0) -> DataFrame:
    """The highest scores of each bin, up to ``per_bin``, and of those at most ``total``; first, rows (ra, dec) within ``radius`` degrees of a known position (ra2, dec2) go."""
    if known is not None:
        df = away(df, known, radius, key)
    a = topk(df, per_bin, [bin_], score, key, "_i").drop("_i")
    return a.orderBy(F.desc(score), key).limit(total)


def pool_filters(kind: str, kinds: Sequence[str], ranges: dict[str, tuple[float | None, float | None]], mask: str, bad_bits: Sequence[int], near: str = "near") -> list[tuple[str, Column]]:
    """The ordered filters of a negative pool, for ``waterfall`` and ``negative_pool`` alike: type, each range, mask bits, distance from known objects."""
    out = [("type", F.upper(F.trim(F.col(kind))).isin(*kinds))]
    out += [(c, within({c: b})) for c, b in ranges.items()]
    return [*out, ("mask", clean_mask(mask, bad_bits)), ("distance", ~F.col(near))]


def negative_pool(df: DataFrame, known: DataFrame, radius: float, filters: Sequence[tuple[str, Column]], key: str, confuser: Column, nside: int = 64, seed: int = 42, positions: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """df without rows that fail a filter or lie within ``radius`` degrees of a known position (ra2, dec2), plus confuser, pool, cell and split.

    Pool N2 holds confusers, N1 the others. All rows of a sky cell are in one split.
    """
    keep = F.lit(True)
    for _, c in filters:
        keep = keep & F.coalesce(c, F.lit(False))
    t = near_flag(df, known, radius, key, left_on=positions).where(keep).drop("near")
    t = t.withColumn("confuser", confuser).withColumn("pool", F.when(F.col("confuser").isNotNull(), "N2").otherwise("N1"))
    return t.withColumn("cell", healpix_nested(*positions, nside)).withColumn("split", hash_split("cell", seed, (("train", 0.7), ("val", 0.15), ("test", 0.15))))


def hard_negatives(scored: DataFrame, key: str, score: str, k: int, catalogs: dict[str, tuple[DataFrame, float]], known: DataFrame, cell: float, top_weight: float = 3.0, cap: int = 1000, seed: int = 11, positions: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """(key, ra, dec, source, weight): the ``k`` highest scores and up to ``cap`` rows of each catalog, less the known keys, one row per position.

    catalogs: name to (rows with key and position, weight). Positions are cells
    of ``cell`` degrees; the heaviest row stays, ties to the smaller key.
    """
    place = [key, *positions]
    parts = [scored.orderBy(F.desc(score), key).limit(k).select(*place, F.lit("scored").alias("source"), F.lit(top_weight).alias("weight"))]
    for name, (rows, weight) in catalogs.items():
        parts.append(rows.orderBy(hash_uniform(key, seed), key).limit(cap).select(*place, F.lit(name).alias("source"), F.lit(float(weight)).alias("weight")))
    both = union_named(*parts).join(known.select(key), key, "left_anti")
    return dedup_position(both, cell, [F.desc("weight"), F.col(key), F.col("source")], positions)


def summary_by(df: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """Rows, their share, and the sum and mean of weights per group."""
    t = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"), F.avg(weight).alias("mean_weight"))
    return t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # one row


def reject_to_log_uniform(df: DataFrame, x: str, low: float, high: float, key: str, seed: int = 23) -> DataFrame:
    """Rows in [low, high], each kept with probability low / x."""
    return df.where(F.col(x).between(low, high) & (hash_uniform(key, seed) < F.lit(low) / F.col(x)))


# The named grids, an axis each of Einstein radius, magnitude difference, source radius, ellipticity and shear.
GRIDS: dict[str, tuple[tuple[float, ...], ...]] = {
    "grid_small": ((0.3, 0.6, 1.0), (1.0, 2.0), (0.08, 0.15), (0.0, 0.3), (0.0, 0.03)),
    "grid_medium": ((0.25, 0.35, 0.5, 0.8, 1.2), (0.5, 1.0, 1.5, 2.0), (0.05, 0.10, 0.20), (0.0, 0.2, 0.4), (0.0, 0.03)),
    "grid_full": ((0.2, 0.25, 0.3, 0.4, 0.6, 0.8, 1.2, 1.6), (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5), (0.04, 0.06, 0.08, 0.12, 0.18, 0.25), (0.0, 0.2, 0.4), (0.0, 0.02, 0.04)),
    "grid_sota": ((0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5), (0.5, 1.0, 1.5, 2.0), (0.06, 0.10, 0.15, 0.20), (0.0, 0.2, 0.4), (0.0, 0.02, 0.04)),
}
AXES = ("theta", "dmag", "reff", "ell", "shear")


def grid(spark: SparkSession, name: str) -> DataFrame:
    """(config_id, theta, dmag, reff, ell, shear) of a named grid; the id holds the row's number in axis order and its values."""
    rows = []
    for i, values in enumerate(itertools.product(*GRIDS[name]), 1):
        label = "_".join(f"{a}{v:g}" for a, v in zip(("te", "dm", "rf", "e", "sh"), values, strict=True))
        rows.append((f"{name}_{i:04d}_{label}", *values))
    return spark.createDataFrame(rows, "config_id string, " + ", ".join(f"{a} double" for a in AXES))


def task_guard(targets: DataFrame, per_target: int, most: int) -> int:
    """The number of tasks; raises above the limit."""
    n = targets.count() * per_target
    if n > most:
        raise ValueError(f"{n} tasks are more than {most}")
    return n


def manifest(targets: DataFrame, config: DataFrame, key: str, control_share: float, replicates: int = 1, seed: int = 31) -> DataFrame:
    """Targets x grid x replicates with a content id; a share of targets are controls, whose parameters are zero."""
    t = targets.withColumn("is_control", hash_uniform(key, seed) < control_share)
    g = config.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    m = t.crossJoin(F.broadcast(g))  # the grid is a parameter table
    m = m.select(*targets.columns, "is_control", "config_id", "replicate", *_zeroed(config))
    return m.withColumn("task_id", content_id([key, "config_id", "replicate"]))


def _zeroed(config: DataFrame) -> list[Column]:
    return [F.when(F.col("is_control"), F.lit(0.0)).otherwise(F.col(a)).alias(a) for a in config.columns if a != "config_id"]


def unpaired_manifest(targets: DataFrame, config: DataFrame, key: str, control_share: float, seed: int = 31) -> DataFrame:
    """One configuration per target, positives and controls being different targets; controls have zero parameters."""
    t = modulo_assign(targets.withColumn("is_control", hash_uniform(key, seed) < control_share), config, key, "config_id", seed + 1)
    return t.select(*targets.columns, "is_control", "config_id", *_zeroed(config))


def paired_rows(positives: DataFrame, payload: DataFrame, on: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """positives with columns of their control's row joined on; those without a control go."""
    return positives.join(payload.select(*on, *[F.col(c).alias(n) for c, n in columns.items()]), list(on))


def sota_manifest(targets: DataFrame, config: DataFrame, key: str, bins: Sequence[str], place: Sequence[str], control_share: float, unpaired_share: float, extra: DataFrame | None = None, seed: int = 31) -> DataFrame:
    """Targets x grid with controls, of which a share stand at another target of the same bins, and a content id.

    ``place`` are the columns that move with a swap. A control is ``paired`` or
    ``unpaired`` (it is paired if its bin is short), other rows have no kind.
    extra rows are targets too; columns that they lack are null.
    """
    t = targets if extra is None else union_named(targets, extra)
    t = t.crossJoin(F.broadcast(config)).withColumn("_row", F.concat_ws("|", F.col(key).cast("string"), "config_id"))  # the grid is a parameter table
    t = t.withColumn("is_control", hash_uniform("_row", seed) < control_share)
    other = targets.select(*bins, *[F.col(c).alias(f"_{c}") for c in dict.fromkeys((key, *place))])
    swapped = bin_swap(t.where("is_control").select("_row", *bins), other.select(*bins, f"_{key}"), bins, "_row", f"_{key}", unpaired_share, seed + 1).select("_row", F.col("swapped").alias(f"_{key}"))
    moved = swapped.where(F.col(f"_{key}").isNotNull()).join(other.drop(*bins), f"_{key}").drop(*([] if key in place else [f"_{key}"]))
    t = t.join(moved.withColumn("_moved", F.lit(True)), "_row", "left")
    kind = F.when(F.col("is_control"), F.when(F.col("_moved"), "unpaired").otherwise("paired"))
    keep = [F.coalesce(f"_{c}", c).alias(c) if c in place else F.col(c) for c in t.columns if c in targets.columns]
    out = t.select(*keep, "is_control", kind.alias("control_kind"), "config_id", *_zeroed(config))
    return out.withColumn("injection_id", content_md5([*dict.fromkeys((key, *place)), "config_id", "is_control"], seed))


def training_manifest(sides: Sequence[tuple[DataFrame, int, dict[str, float]]], paths: DataFrame, key: str, tier: str, default: float = 1.0) -> DataFrame:
    """(key, tier, label, sample_weight, and the columns of paths): labelled sides in one schema, each row's weight from its tier; rows without a path go.

    sides: (rows with key and tier, label, weights by tier).
    """
    parts = [f.select(key, tier, F.lit(y).alias("label"), lookup(tier, w, default).alias("sample_weight")) for f, y, w in sides]
    return union_named(*parts).join(paths, key)


def label_ratio(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """Positives, negatives and negatives per positive of each group."""
    t = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    return t.withColumn("ratio", F.col("negatives") / F.nullif(F.col("positives"), F.lit(0)))
