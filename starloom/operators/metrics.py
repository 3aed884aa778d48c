"""Evaluation of scored tables: ROC, calibration, bootstrap, drift and gates.

Curves come from counts at distinct scores (windows.score_counts), so they are
exact with ties and never need one task to sort all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.columns import hash_uniform
from starloom.operators.windows import score_counts


def confusion(df: DataFrame, score: str, label: Column, threshold: float, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """tp, fp, fn, tn and the rates from them; a rate with an empty denominator is null."""
    hit = F.col(score) > threshold if strict else F.col(score) >= threshold
    t = df.groupBy(*by).agg(F.count_if(hit & label).alias("tp"), F.count_if(hit & ~label).alias("fp"), F.count_if(~hit & label).alias("fn"), F.count_if(~hit & ~label).alias("tn"))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return t.select("*", rate("tp", "fn").alias("recall"), rate("tp", "fp").alias("precision"), rate("fp", "tn").alias("fpr"), rate("tn", "fp").alias("specificity"))


def auc(df: DataFrame, score: str, label: Column, by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """Area under the ROC curve by rank sums, ties averaged; null with fewer than ``least`` rows of a class."""
    t = score_counts(df, score, label, by)
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    out = t.groupBy(*by).agg(area.alias("_a"), F.max("pos_all").alias("n_pos"), F.max("neg_all").alias("n_neg"))
    ok = (F.col("n_pos") >= least) & (F.col("n_neg") >= least)
    return out.withColumn("auc", F.when(ok, F.col("_a") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0)))).drop("_a")


def roc_points(df: DataFrame, score: str, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, fpr, tpr): rates of rows at or above each distinct score."""
    t = score_counts(df, score, label, by)
    rate = lambda k: (F.col(f"{k}_all") - F.col(f"{k}_below")) / F.nullif(F.col(f"{k}_all"), F.lit(0))
    return t.select(*by, F.col(score).alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))


def tpr_at_fpr(df: DataFrame, score: str, label: Column, rates: Sequence[float]) -> DataFrame:
    """(at, tpr): TPR interpolated between the ROC points that enclose each FPR; the curve begins at 0, 0."""
    p = roc_points(df, score, label)
    at = p.sparkSession.createDataFrame([(float(r),) for r in rates], "at double")
    # for every stated rate: the last point at or before it and the first after it
    below = p.crossJoin(F.broadcast(at)).where("fpr <= at").groupBy("at").agg(F.max(F.struct("fpr", "tpr")).alias("lo"))
    above = p.crossJoin(F.broadcast(at)).where("fpr > at").groupBy("at").agg(F.min(F.struct("fpr", "tpr")).alias("hi"))
    j = at.join(below, "at", "left").join(above, "at", "left")
    lf, lt = F.coalesce("lo.fpr", F.lit(0.0)), F.coalesce("lo.tpr", F.lit(0.0))
    slope = (F.col("hi.tpr") - lt) / (F.col("hi.fpr") - lf)
    return j.select("at", F.coalesce(lt + slope * (F.col("at") - lf), lt).alias("tpr"))


def partial_auc(df: DataFrame, score: str, label: Column, most: float) -> DataFrame:
    """One row: area for FPR up to ``most``, the last segment interpolated, and McClish's standardised value.

    Each distinct score is a segment of the curve by its own counts and those
    above it, so no task orders the points.
    """
    t = score_counts(df, score, label)
    rate = lambda k, own: (F.col(f"{k}_all") - F.col(f"{k}_below") - (F.col(k) if own else F.lit(0))) / F.nullif(F.col(f"{k}_all"), F.lit(0))
    seg = t.select(rate("neg", True).alias("f0"), rate("neg", False).alias("f1"), rate("pos", True).alias("y0"), rate("pos", False).alias("y1")).where(F.col("f0") < most)
    end = F.least("f1", F.lit(most))
    y = F.coalesce(F.col("y0") + (F.col("y1") - F.col("y0")) * (end - F.col("f0")) / F.nullif(F.col("f1") - F.col("f0"), F.lit(0.0)), "y1")
    t = seg.agg(F.sum((end - F.col("f0")) * (F.col("y0") + y) / 2).alias("area"))
    low = most * most / 2
    return t.withColumn("standardised", F.lit(0.5) * (1 + (F.col("area") - low) / (most - low)))


def threshold_grid(df: DataFrame, score: str, label: Column, grid: Sequence[float]) -> DataFrame:
    """(threshold, tpr, fpr, precision) on a stated grid, in one scan."""
    aggs = []
    for i, g in enumerate(grid):
        hit = F.col(score) >= g
        aggs += [F.count_if(hit & label).alias(f"t{i}"), F.count_if(hit & ~label).alias(f"f{i}")]
    t = df.agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(float(g)).alias("threshold"), F.col(f"t{i}").alias("tp"), F.col(f"f{i}").alias("fp")) for i, g in enumerate(grid)])
    t = t.select("p", "n", F.explode(rows).alias("r")).select("p", "n", "r.*")
    return t.select("threshold", (F.col("tp") / F.nullif(F.col("p"), F.lit(0))).alias("tpr"), (F.col("fp") / F.nullif(F.col("n"), F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"))


def reliability(df: DataFrame, p: str, label: Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) in bins of equal width."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(label.cast("double")).alias("accuracy"))


def calibration_error(curve: DataFrame) -> DataFrame:
    """Expected and largest calibration error of a reliability curve."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return curve.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def poisson_weight(key: str, replicate: Column) -> Column:
    """Poisson(1) count of a row in a bootstrap replicate, from the hash of both."""
    return poisson_of(hash_uniform([key, replicate], "boot"))


def poisson_of(u: Column) -> Column:
    """The Poisson(1) count of a uniform number."""
    out, edge = F.lit(8), 0.0
    edges = []
    for k in range(8):
        edge += math.exp(-1) / math.factorial(k)
        edges.append(edge)
    for k in range(7, -1, -1):
        out = F.when(u < edges[k], F.lit(k)).otherwise(out)
    return out


def bootstrap_rates(df: DataFrame, key: str, score: str, label: Column, threshold: float, replicates: int) -> DataFrame:
    """(replicate, recall, precision) of Poisson bootstrap replicates; aggregated before anything is shuffled."""
    hit = F.col(score) >= threshold
    r = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    t = df.select(key, label.alias("_y"), hit.alias("_h"), r).withColumn("_w", poisson_weight(key, F.col("replicate")))
    total = lambda c: F.sum(F.when(c, F.col("_w")).otherwise(0))
    t = t.groupBy("replicate").agg(total(F.col("_y") & F.col("_h")).alias("tp"), total(F.col("_y")).alias("p"), total(F.col("_h")).alias("h"))
    return t.select("replicate", (F.col("tp") / F.nullif(F.col("p"), F.lit(0))).alias("recall"), (F.col("tp") / F.nullif(F.col("h"), F.lit(0))).alias("precision"))


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, feature, value): one row per feature."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("f")).select(*keep, "f.*")


def class_balance(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Per feature: means and deviations of both classes and Cohen's d."""
    one = lambda y, x: F.when(F.col(label) == y, F.col("value"))
    t = unpivot(df, features, [label]).groupBy("feature").agg(F.avg(one(1, 0)).alias("mean1"), F.avg(one(0, 0)).alias("mean0"), F.stddev(one(1, 0)).alias("std1"), F.stddev(one(0, 0)).alias("std0"))
    spread = F.sqrt((F.col("std1") * F.col("std1") + F.col("std0") * F.col("std0")) / 2)
    return t.withColumn("cohen_d", (F.col("mean1") - F.col("mean0")) / F.nullif(spread, F.lit(0.0)))


def batch_score(df: DataFrame, model, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep plus ``score`` and ``error``: model(frame) gives scores of a batch; a batch that fails is scored row by row, and rows that fail carry the error."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[list(keep)].copy()
            try:
                out["score"], out["error"] = [float(x) for x in model(f[list(columns)])], None
            except Exception:  # noqa: BLE001  the row's own error is reported below
                score, error = [], []
                for i in range(len(f)):
                    try:
                        score.append(float(next(iter(model(f[list(columns)].iloc[i : i + 1])))))
                        error.append(None)
                    except Exception as e:  # noqa: BLE001
                        score.append(None)
                        error.append(f"{type(e).__name__}: {e}")
                out["score"], out["error"] = score, error
            yield out

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in keep) + ", score double, error string"
    return df.select(*keep, *[c for c in columns if c not in keep]).mapInPandas(run, schema)
