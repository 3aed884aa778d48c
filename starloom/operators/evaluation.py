"""Evaluation reports of scored sets: anchors, contaminants, intervals, permutation tests, shortcut audits, tables and gates.

Long reports have the columns section, subject and a value column for each
measure; they come from aggregates of the scored rows, never from the rows
themselves, except for the stated top rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.columns import hash_uniform
from starloom.operators.metrics import poisson_of, unpivot
from starloom.operators.resampling import permutation_summary, permuted_auc, poisson_counts
from starloom.operators.sets import union_named
from starloom.operators.splits import ks, ks_p
from starloom.operators.windows import numbered, running_counts, score_counts


def _summary(df: DataFrame, section: str, subject: Column, score: str, hit: Column) -> DataFrame:
    t = df.groupBy(subject.alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_hit"), F.avg(score).alias("mean_score"), F.percentile(score, F.lit(0.5)).alias("median_score"), F.max(score).alias("max_score"))
    return t.select(F.lit(section).alias("section"), "subject", "n", "n_hit", (F.col("n_hit") / F.col("n")).alias("rate"), "mean_score", "median_score", "max_score")


def _top(df: DataFrame, section: str, key: str, score: str, k: int) -> DataFrame:
    t = df.orderBy(F.desc(score), key).limit(k)
    return t.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("subject"), F.col(score).alias("max_score"))


def anchor_report(anchors: DataFrame, key: str, tier: str, theta: str, score: str, threshold: float = 0.5, primary: str = "A", reason: str | None = None, edges: Sequence[float] = (1.0, 1.5, 2.0), top: int = 5) -> DataFrame:
    """Recall of known objects; anchors without a tier are excluded (for ``reason``), those without a score are unscored.

    Sections: ``tier`` (each tier and all), ``theta`` (recall of the primary
    tier per bin, open on the left), ``found`` and ``missed`` (its ``top`` best
    scores above, and at or below the threshold), ``excluded`` (rows by reason) and
    ``unscored``. A score counts as found above the threshold.
    """
    graded = anchors.where(F.col(tier).isNotNull())
    seen = graded.where(F.col(score).isNotNull())
    hit = F.col(score) > threshold
    bins = F.lit(f">{edges[-1]:g}")
    for low, high in reversed(list(zip((None, *edges[:-1]), edges, strict=True))):
        bins = F.when(F.col(theta) <= high, F.lit(f"<={high:g}" if low is None else f"{low:g}-{high:g}")).otherwise(bins)
    first = seen.where(F.col(tier) == primary)
    count = lambda df, section, subject: df.groupBy(subject.alias("subject")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "subject", "n")
    parts = [
        _summary(seen, "tier", F.col(tier).cast("string"), score, hit),
        _summary(seen, "tier", F.lit("all"), score, hit),
        _summary(first.where((F.col(theta) > 0) & F.col(theta).isNotNull()), "theta", bins, score, hit),
        _top(first.where(hit), "found", key, score, top),
        _top(first.where(~hit), "missed", key, score, top),
        count(graded.where(F.col(score).isNull()), "unscored", F.lit("all")),
    ]
    if reason:
        parts.append(count(anchors.where(F.col(tier).isNull()), "excluded", F.col(reason)))
    return union_named(*parts)


def contaminant_report(df: DataFrame, key: str, category: str, score: str, prevalence: dict[str, float], threshold: float = 0.5, top: int = 10) -> DataFrame:
    """False positives among known non-members.

    Sections: ``all``, ``category``, ``weighted`` (rates of categories weighted
    by their stated prevalence; the plain rate if none of them has one),
    ``worst`` (highest scores above the threshold) and ``unscored``.
    """
    seen, hit = df.where(F.col(score).isNotNull()), F.col(score) > threshold
    whole, each = _summary(seen, "all", F.lit("all"), score, hit), _summary(seen, "category", F.col(category), score, hit)
    weight = F.lit(0.0)
    for name, w in prevalence.items():
        weight = F.when(F.col("subject") == name, F.lit(float(w))).otherwise(weight)
    mean = each.agg(F.sum("n").alias("n"), F.sum("n_hit").alias("n_hit"), (F.sum(F.col("rate") * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("rate"))
    mean = mean.select(F.lit("weighted").alias("section"), F.lit("all").alias("subject"), F.coalesce("rate", F.col("n_hit") / F.nullif(F.col("n"), F.lit(0))).alias("rate"))
    missing = df.where(F.col(score).isNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unscored").alias("section"), F.lit("all").alias("subject"), "n")
    return union_named(whole, each, mean, _top(seen.where(hit), "worst", key, score, top), missing)


def gate_report(rows: Sequence[tuple[str, DataFrame, str, str, float]]) -> DataFrame:
    """(gate, value, bound, passed) and a last row ``all``: each gate is (name, one-row frame, column, '>=' or '<=', bound); a missing value fails."""
    out = None
    for name, frame, column, sign, bound in rows:
        v = F.col(column).cast("double")
        ok = v >= bound if sign == ">=" else v <= bound
        one = frame.select(F.lit(name).alias("gate"), v.alias("value"), F.lit(float(bound)).alias("bound"), F.coalesce(ok, F.lit(False)).alias("passed"))
        out = one if out is None else out.unionAll(one)
    return out.unionAll(out.agg(F.lit("all"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.every("passed")))


def _weighted_counts(df: DataFrame, key: str, score: str, label: Column, replicates: int, by: Sequence[str]) -> DataFrame:
    """(by, score, replicate, pos, neg): Poisson weights of rows summed at distinct scores, all replicates of a slice in one aggregate; rows are never copied."""
    t, parts = df.where(F.col(score).isNotNull()).withColumn("_y", label), []
    for lo in range(0, replicates, 50):
        some = range(lo, min(lo + 50, replicates))
        # one hash for each row and replicate; the draw then reads it as a number
        draws = t.withColumn("_w", F.transform(F.transform(F.array(*map(F.lit, some)), lambda b: hash_uniform([key, b], "boot")), poisson_of))
        side = lambda i, pos: F.sum(F.when(F.col("_y"), F.col("_w")[i] if pos else 0).otherwise(0 if pos else F.col("_w")[i]))
        sums = draws.groupBy(*by, score).agg(F.array(*[F.struct(F.lit(b).alias("replicate"), side(i, True).alias("pos"), side(i, False).alias("neg")) for i, b in enumerate(some)]).alias("_w"))
        parts.append(sums.select(*by, score, F.explode("_w").alias("_w")).select(*by, score, "_w.*"))
    return union_named(*parts)


def replicate_metrics(df: DataFrame, key: str, score: str, label: Column, threshold: float, replicates: int, by: Sequence[str] = (), draws: str = "rows") -> DataFrame:
    """(by, replicate, auc, recall, precision) of Poisson bootstrap replicates, from weights summed at distinct scores.

    With draws "rows", the hash of a row's key and the replicate is its weight;
    with "counts", each distinct score draws its sum of weights at once, in work
    that follows distinct scores and not rows.
    """
    t = poisson_counts(df, score, label, replicates, by) if draws == "counts" else _weighted_counts(df, key, score, label, replicates, by)
    t = running_counts(t, score, [*by, "replicate"])
    hit = F.col(score) >= threshold
    total = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0))
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    g = t.groupBy(*by, "replicate").agg(area.alias("_a"), F.max("pos_all").alias("_p"), F.max("neg_all").alias("_n"), total("pos").alias("_tp"), total("neg").alias("_fp"))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    return g.select(*by, "replicate", ratio(F.col("_a"), F.col("_p") * F.col("_n")).alias("auc"), ratio(F.col("_tp"), F.col("_p")).alias("recall"), ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("precision"))


def bootstrap_intervals(df: DataFrame, key: str, score: str, label: Column, threshold: float, replicates: int, level: float = 0.95, draws: str = "rows") -> DataFrame:
    """(metric, mean, std, low, high, valid) of AUC, recall and precision over Poisson bootstrap replicates."""
    t = unpivot(replicate_metrics(df, key, score, label, threshold, replicates, draws=draws), ("auc", "recall", "precision"), [])
    q = F.percentile("value", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return t.groupBy(F.col("feature").alias("metric")).agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"), q[0].alias("low"), q[1].alias("high"), F.count("value").alias("valid"))


def permutation_test(df: DataFrame, key: str, score: str, label: Column, replicates: int, seed: str | int = "perm", draws: str = "rows") -> DataFrame:
    """One row: auc, mean and deviation of the AUC under dealt labels, replicates that reach it, and p = (n_exceed + 1) / (replicates + 1).

    With draws "rows", labels are dealt in hash order to rows in key order, both
    numbered by ranges, which sorts all rows for each replicate. With "counts",
    distinct scores are dealt their shares of the positives (seed is then a number).
    ``resampling.refit_test`` refits a model on each shuffle.
    """
    t = df.where(F.col(score).isNotNull()).select(key, F.col(score).alias("_s"), label.alias("_y"))
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / F.nullif(F.max("pos_all") * F.max("neg_all"), F.lit(0))
    real = score_counts(t, "_s", F.col("_y")).agg(area.alias("auc"))
    if draws == "counts":
        return permutation_summary(permuted_auc(t, "_s", F.col("_y"), replicates, seed if isinstance(seed, int) else 0), real.first().auc, replicates)
    rows = numbered(t.select(key, "_s"), [key], "_i").select("_s", "_i")
    dealt = t.select(key, "_y", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("_u", hash_uniform([key, F.col("replicate")], seed))
    dealt = numbered(dealt, ["replicate", "_u", key], "_i", ["replicate"]).select("replicate", "_y", "_i")
    null = score_counts(rows.join(dealt, "_i"), "_s", F.col("_y"), ["replicate"]).groupBy("replicate").agg(area.alias("null"))
    j = null.crossJoin(F.broadcast(real))  # one row
    out = j.agg(F.first("auc").alias("auc"), F.avg("null").alias("mean_null"), F.stddev("null").alias("std_null"), F.count_if(F.col("null") >= F.col("auc")).alias("n_exceed"))
    return out.withColumn("p_value", (F.col("n_exceed") + 1) / F.lit(replicates + 1.0))


def shortcut_audit(df: DataFrame, key: str, label: Column, features: Sequence[str], replicates: int, expected: Sequence[str] = (), red: float = 0.7, yellow: float = 0.6) -> DataFrame:
    """One row per feature: direction-free AUC against the label with its bootstrap interval, and distribution numbers of both classes.

    ``is_red`` and ``is_yellow`` judge the interval's lower bound. Expected
    features are no shortcuts however well they separate. separation is the
    distance of the medians over the sum of the deviations.
    """
    long = unpivot(df.withColumn("_y", label), features, [key, "_y"]).where("value is not null")
    free = lambda c: F.greatest(F.col(c), 1 - F.col(c))
    boot = replicate_metrics(long, key, "value", F.col("_y"), 0.0, replicates, ["feature"])
    q = F.percentile(free("auc"), F.array(F.lit(0.025), F.lit(0.975)))
    boot = boot.groupBy("feature").agg(q[0].alias("auc_low"), q[1].alias("auc_high"))
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / F.nullif(F.max("pos_all") * F.max("neg_all"), F.lit(0))
    point = score_counts(long, "value", F.col("_y"), ["feature"]).groupBy("feature").agg(area.alias("auc"), F.max("pos_all").alias("n_pos"), F.max("neg_all").alias("n_neg"))
    side = lambda y: F.when(F.col("_y") == y, F.col("value"))
    stats = long.groupBy("feature").agg(*[f(side(y)).alias(f"{n}_{name}") for y, n in ((True, "pos"), (False, "neg")) for name, f in (("median", lambda c: F.percentile(c, F.lit(0.5))), ("std", F.stddev_pop))])
    out = point.join(boot, "feature").join(stats, "feature").withColumn("auc", free("auc"))
    out = out.withColumn("separation", F.abs(F.col("pos_median") - F.col("neg_median")) / F.greatest(F.col("pos_std") + F.col("neg_std"), F.lit(1e-10)))
    out = out.withColumn("is_expected", F.col("feature").isin(list(expected))).withColumn("is_red", F.col("auc_low") > red).withColumn("is_yellow", F.col("auc_low") > yellow)
    return out.withColumn("is_shortcut", F.col("is_red") & ~F.col("is_expected"))


def shortcut_gates(audit: DataFrame, core: Sequence[str], signal: str, most_yellow: int = 3, least_signal: float = 0.55) -> DataFrame:
    """(gate, value, bound, passed): no red core feature, a signal that separates, no unexpected red and few unexpected yellow features."""
    strange = ~F.col("is_expected")
    t = audit.agg(F.count_if(F.col("is_red") & F.col("feature").isin(list(core))).alias("core"), F.max(F.when(F.col("feature") == signal, F.col("auc"))).alias("signal"), F.count_if(F.col("is_red") & strange).alias("red"), F.count_if(F.col("is_yellow") & strange).alias("yellow"))
    return gate_report([("no core shortcuts", t, "core", "<=", 0), ("signal separates", t, "signal", ">=", least_signal), ("no shortcuts", t, "red", "<=", 0), ("few yellow flags", t, "yellow", "<=", most_yellow)])


def roc_tables(df: DataFrame, score: str, label: Column, tprs: Sequence[float], fprs: Sequence[float], by: str | None = None, least: int = 1000) -> DataFrame:
    """(stratum, n, kind, given, value, threshold): the lowest FPR at each TPR and the highest TPR at each FPR, over all rows and per stratum.

    A stratum holds its own positives and all negatives; strata of fewer than
    ``least`` rows are left out. Strata meet the negatives as counts of distinct
    scores, never as rows.
    """
    t = df.where(F.col(score).isNotNull())
    pos = t.where(label).select(score, *([F.explode(F.array(F.lit("all"), F.col(by).cast("string"))).alias("stratum")] if by else [F.lit("all").alias("stratum")]))
    pos = pos.groupBy("stratum", score).agg(F.count(F.lit(1)).alias("pos"))
    neg = t.where(~label).groupBy(score).agg(F.count(F.lit(1)).alias("neg"))
    strata = pos.groupBy("stratum").agg(F.sum("pos").alias("_n")).where("stratum is not null")
    sizes = strata.crossJoin(neg.agg(F.sum("neg").alias("_m"))).withColumn("_n", F.col("_n") + F.coalesce("_m", F.lit(0))).where(F.col("_n") >= least).select("stratum", F.col("_n").alias("n"))  # one row of counts
    every = sizes.select("stratum").join(neg.withColumn("_all", F.lit(True)), F.col("_all"))  # one row per stratum and distinct score
    both = every.select("stratum", score, F.lit(0).cast("long").alias("pos"), "neg").unionAll(pos.join(sizes, "stratum", "left_semi").select("stratum", score, "pos", F.lit(0).cast("long")))
    c = running_counts(both.groupBy("stratum", score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), score, ["stratum"])
    rate = lambda k: (F.col(f"{k}_all") - F.col(f"{k}_below")) / F.nullif(F.col(f"{k}_all"), F.lit(0))
    c = c.select("stratum", F.col(score).alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))
    ask = F.explode(F.array(*[F.struct(F.lit("fpr_at_tpr").alias("kind"), F.lit(float(x)).alias("given")) for x in tprs], *[F.struct(F.lit("tpr_at_fpr").alias("kind"), F.lit(float(x)).alias("given")) for x in fprs])).alias("a")
    c = c.select("stratum", "threshold", "fpr", "tpr", ask).select("stratum", "threshold", "fpr", "tpr", "a.*")
    fits = ((F.col("kind") == "fpr_at_tpr") & (F.col("tpr") >= F.col("given"))) | ((F.col("kind") == "tpr_at_fpr") & (F.col("fpr") <= F.col("given")))
    # the highest threshold that reaches a TPR has the lowest FPR, and the lowest one within an FPR the highest TPR
    pick = F.when(F.col("kind") == "fpr_at_tpr", F.col("threshold")).otherwise(-F.col("threshold"))
    value = F.when(F.col("kind") == "fpr_at_tpr", F.col("fpr")).otherwise(F.col("tpr"))
    best = c.where(fits).groupBy("stratum", "kind", "given").agg(F.max_by(F.struct(value.alias("value"), "threshold"), pick).alias("r"))
    return best.join(sizes, "stratum").select("stratum", "n", "kind", "given", "r.*")


def equal_mass_reliability(df: DataFrame, p: str, label: Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) in bins of equal mass, whose edges are exact quantiles with 0 and 1 at the ends."""
    edges = df.agg(F.percentile(p, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_e"))
    b = F.size(F.filter("_e", lambda e: e < F.col(p))).alias("bin")
    t = df.select(p, label.alias("_y")).crossJoin(F.broadcast(edges))  # one row
    return t.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col("_y").cast("double")).alias("accuracy"))


def brier(df: DataFrame, p: str, label: Column, levels: Sequence[float] = (0.9, 0.95, 0.99)) -> DataFrame:
    """One row: mean squared error of probabilities, and for each level the rows at or above it and how many of them are positive."""
    y = label.cast("double")
    aggs = [F.avg(F.pow(F.col(p) - y, F.lit(2.0))).alias("brier")]
    for x in levels:
        aggs += [F.count_if(F.col(p) >= x).alias(f"n_{round(100 * x)}"), F.avg(F.when(F.col(p) >= x, y)).alias(f"above_{round(100 * x)}")]
    return df.agg(*aggs)


def recall_strata(df: DataFrame, by: str, hit: Column, z: float = 1.96) -> DataFrame:
    """(section, subject, n, value, error): recall of each stratum with its normal error, then mean, min, max and spread over strata."""
    t = df.groupBy(F.col(by).cast("string").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("value"))
    t = t.select(F.lit("stratum").alias("section"), "subject", "n", "value", (z * F.sqrt(F.col("value") * (1 - F.col("value")) / F.col("n"))).alias("error"))
    total = t.agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("spread"))
    return union_named(t, unpivot(total, ("mean", "min", "max", "spread"), []).select(F.lit("summary").alias("section"), F.col("feature").alias("subject"), "value"))


def class_separation(df: DataFrame, features: Sequence[str], label: Column, limit: float = 0.2) -> DataFrame:
    """Per feature: means and deviations of both classes, the ratio of the means, Cohen's d, KS with its p, and whether |d| stays below the limit."""
    long = unpivot(df.withColumn("_y", label), features, ["_y"]).where("value is not null")
    side = lambda y: F.when(F.col("_y") == y, F.col("value"))
    t = long.groupBy("feature").agg(F.avg(side(True)).alias("mean1"), F.avg(side(False)).alias("mean0"), F.stddev(side(True)).alias("std1"), F.stddev(side(False)).alias("std0"))
    spread = F.sqrt((F.col("std1") * F.col("std1") + F.col("std0") * F.col("std0")) / 2)
    t = t.withColumn("ratio", F.col("mean1") / F.nullif(F.col("mean0"), F.lit(0.0))).withColumn("cohen_d", (F.col("mean1") - F.col("mean0")) / F.nullif(spread, F.lit(0.0)))
    k = ks(long, "value", F.col("_y"), ["feature"]).withColumn("ks_p", ks_p(F.col("ks"), F.col("n1"), F.col("n2"))).drop("n1", "n2")
    return t.join(k, "feature").withColumn("passed", F.coalesce(F.abs(F.col("cohen_d")) < limit, F.lit(False)))


def pair_stats(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(y, x, n, r, slope, intercept, r2, offset, offset_std) for each pair of columns, in one scan; offset is the mean of y - x."""
    aggs = []
    for y, x in pairs:
        a, b = F.col(y).cast("double"), F.col(x).cast("double")
        both = a.isNotNull() & b.isNotNull()
        aggs.append(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.count_if(both).alias("n"), F.corr(a, b).alias("r"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.avg(a - b).alias("offset"), F.stddev(a - b).alias("offset_std")))
    return df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def compare_variants(table: DataFrame, name: str, metrics: Sequence[str], baseline: str, gates: dict[str, float]) -> DataFrame:
    """(variant, metric, value, delta, best, passed, pass_rate): each metric of each variant against the baseline's, and its least value from gates.

    pass_rate is the share of gated metrics that the variant passes.
    """
    long = unpivot(table, metrics, [name]).select(F.col(name).alias("variant"), F.col("feature").alias("metric"), "value")
    top = long.groupBy("metric").agg(F.max("value").alias("_top"), F.max(F.when(F.col("variant") == baseline, F.col("value"))).alias("_base"))
    bound = F.lit(None).cast("double")
    for m, v in gates.items():
        bound = F.when(F.col("metric") == m, F.lit(float(v))).otherwise(bound)
    t = long.join(top, "metric").withColumn("passed", F.when(bound.isNotNull(), F.coalesce(F.col("value") >= bound, F.lit(False))))
    rate = t.groupBy("variant").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    return t.join(rate, "variant").select("variant", "metric", "value", (F.col("value") - F.col("_base")).alias("delta"), (F.col("value") == F.col("_top")).alias("best"), "passed", "pass_rate")


def score_summary(df: DataFrame, score: str, threshold: float, by: Sequence[str] = (), quantiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99, 0.999), accuracy: int | None = None) -> DataFrame:
    """n, mean, max, flagged share and quantiles of scores, over all rows or per group; approximate quantiles with an accuracy."""
    points = F.array(*map(F.lit, quantiles))
    q = F.percentile(score, points) if accuracy is None else F.percentile_approx(score, list(quantiles), accuracy)
    names = [f"p{f'{100 * x:g}'.replace('.', '')}" for x in quantiles]
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.max(score).alias("most"), F.avg((F.col(score) >= threshold).cast("double")).alias("flagged"), *[q[i].alias(n) for i, n in enumerate(names)])
