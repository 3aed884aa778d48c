"""Data-quality reports as long tables, each from as few scans as possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from starloom.functions.arrays import bad_share, mad
from starloom.operators.sets import union_named


def _long(df: DataFrame, aggs: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    """(subject, name, value): many aggregates of one scan as rows."""
    flat = [(s, n, a) for s, items in aggs.items() for n, a in items]
    t = df.agg(*[a.cast("double").alias(f"a{i}") for i, (_, _, a) in enumerate(flat)])
    return t.select(F.explode(F.array(*[F.struct(F.lit(s).alias("subject"), F.lit(n).alias("name"), F.col(f"a{i}").alias("value")) for i, (s, n, _) in enumerate(flat)])).alias("r")).select("r.*")


def null_nan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null and NaN counts of each column."""
    kinds = dict(df.dtypes)
    nan = lambda c: F.count_if(F.isnan(c)) if kinds[c] in ("double", "float") else F.lit(0)
    return _long(df, {c: [("nulls", F.count_if(F.col(c).isNull())), ("nans", F.max(F.lit(0)) if kinds[c] not in ("double", "float") else nan(c))] for c in columns or df.columns})


def ranges(df: DataFrame, limits: dict[str, tuple[float, float]], quantiles: Sequence[float] = (0.01, 0.5, 0.99), accuracy: int | None = None) -> DataFrame:
    """Least, most, mean, deviation, quantiles, valid rows and rows outside the limits of each column; approximate quantiles with an accuracy."""
    out = {}
    for c, b in limits.items():
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        q = F.percentile(v, F.array(*map(F.lit, quantiles))) if accuracy is None else F.percentile_approx(v, list(quantiles), accuracy)
        out[c] = [("min", F.min(v)), ("max", F.max(v)), ("mean", F.avg(v)), ("std", F.stddev(v)), *[(f"p{100 * x:g}", q[i]) for i, x in enumerate(quantiles)], ("valid", F.count(v)), ("outside", F.count_if(~v.between(*b)))]
    return _long(df, out)


def consistency(df: DataFrame, pairs: dict[str, tuple[Column, Column]], tolerance: float = 0.001) -> DataFrame:
    """Per named pair: rows where a stored value is off the recomputed one by more than the tolerance, rows compared, and the largest gap."""
    gap = {k: F.abs(a.cast("double") - b.cast("double")) for k, (a, b) in pairs.items()}
    return _long(df, {k: [("off", F.count_if(g > tolerance)), ("compared", F.count(g)), ("largest", F.max(g))] for k, g in gap.items()})


def direction(df: DataFrame, raw: str, corrected: str, tolerance: float = 0.001) -> DataFrame:
    """Rows whose corrected value exceeds the raw one by more than the tolerance, and the correction's mean, least, most and deviation."""
    gap = F.col(raw).cast("double") - F.col(corrected).cast("double")
    return _long(df, {corrected: [("wrong", F.count_if(gap < -tolerance)), ("mean", F.avg(gap)), ("min", F.min(gap)), ("max", F.max(gap)), ("std", F.stddev(gap))]})


def coverage(df: DataFrame, split: str, tile: str, region: str, top: int = 20, quantiles: Sequence[float] = (0.1, 0.5, 0.9), accuracy: int | None = None) -> DataFrame:
    """(section, subject, value): rows per split, quantiles of rows per tile and per region, and the fullest tiles."""
    count = lambda c: df.groupBy(F.col(c).cast("string").alias("subject")).agg(F.count(F.lit(1)).cast("double").alias("value"))

    def spread(c: str) -> DataFrame:
        q = F.percentile("value", F.array(*map(F.lit, quantiles))) if accuracy is None else F.percentile_approx("value", list(quantiles), accuracy)
        rows = F.array(*[F.struct(F.lit(f"p{100 * x:g}").alias("subject"), F.col("q")[i].alias("value")) for i, x in enumerate(quantiles)])
        return count(c).agg(q.alias("q")).select(F.explode(rows).alias("r")).select("r.*")

    named = lambda name, t: t.select(F.lit(name).alias("section"), "subject", "value")
    return union_named(named("split", count(split)), named("per tile", spread(tile)), named("per region", spread(region)), named("top", count(tile).orderBy(F.desc("value"), "subject").limit(top)))


def flag_match(df: DataFrame, flags: dict[str, tuple[Column, Column]]) -> DataFrame:
    """tp, tn, fp, fn of stored against recomputed flags."""
    return _long(df, {k: [("tp", F.count_if(a & b)), ("tn", F.count_if(~a & ~b)), ("fp", F.count_if(a & ~b)), ("fn", F.count_if(~a & b))] for k, (a, b) in flags.items()})


def hierarchy(df: DataFrame, chain: Sequence[str]) -> DataFrame:
    """Violations of: a stricter flag implies the next, looser one."""
    return _long(df, {f"{a}=>{b}": [("violations", F.count_if(F.col(a) & ~F.col(b)))] for a, b in zip(chain[:-1], chain[1:], strict=True)})


def gates(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(name, severity, failed, passed): rows that break each rule, in one scan; a null outcome breaks it."""
    t = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, (_, _, c) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.col(f"r{i}").alias("failed")) for i, (n, s, _) in enumerate(rules)])
    return t.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.failed") == 0).alias("passed"))


def integrity(df: DataFrame, keys: Sequence[str], formats: dict[str, str], allowed: dict[str, Sequence], rules: Sequence[tuple[str, str, Column]] = ()) -> DataFrame:
    """(name, severity, failed, passed): rows beyond the first of a key, names off their pattern, values that aren't allowed, and further row rules."""
    rows = [(f"{c} format", "error", F.col(c).rlike(p)) for c, p in formats.items()] + [(f"{c} allowed", "error", F.col(c).isin(list(v))) for c, v in allowed.items()]
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failed"))
    first = twice.select(F.lit(f"{'+'.join(keys)} unique").alias("name"), F.lit("error").alias("severity"), "failed", (F.col("failed") == 0).alias("passed"))
    return first.unionByName(gates(df, [*rows, *rules]))


def gate_list(df: DataFrame, least_rows: int, required: Sequence[str], keys: Sequence[str], allowed: dict[str, Sequence], positions: tuple[str, str], strata: Sequence[str], least_per_stratum: int, provenance: Sequence[str] = ()) -> DataFrame:
    """Severity-tagged checks of a pool: rows, schema, nulls, duplicates, allowed values, coordinates, provenance and strata."""
    missing = [c for c in (*required, *provenance) if c not in df.columns]
    one = lambda name, severity, frame, failed: frame.agg(failed.cast("long").alias("failed")).select(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.coalesce("failed", F.lit(0).cast("long")).alias("failed"))
    parts = [one("rows", "error", df, F.greatest(F.lit(least_rows) - F.count(F.lit(1)), F.lit(0))), one("schema", "error", df, F.max(F.lit(len(missing))))]
    ra, dec = positions
    rules = [(f"{c} present", "error", F.col(c).isNotNull()) for c in required if c not in missing] + [(f"{c} present", "warn", F.col(c).isNotNull()) for c in provenance if c not in missing]
    rules += [("coordinates", "error", F.col(ra).between(0, 360) & F.col(dec).between(-90, 90))]
    small = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    parts.append(one("strata", "warn", small, F.count_if(F.col("n") < least_per_stratum)))
    head = union_named(*parts).withColumn("passed", F.col("failed") == 0)
    return head.unionByName(integrity(df, keys, {}, allowed, rules))


def manifest_report(df: DataFrame, task: str, control: str, value: str, positions: tuple[str, str], split: str, selection: str, tile: str, region: str, config: str, stamp: str, bands: str, required: Sequence[str]) -> DataFrame:
    """(section, subject, value) of a manifest's checks.

    Rows, missing required columns, nulls of the required ones, positions out
    of range, splits, selections, distinct tiles and regions, repeated tasks,
    statistics of a parameter over rows that aren't controls, the control
    share, configurations with their fewest and most rows, stamp sizes and band sets.
    """
    ra, dec = positions
    there, real = [c for c in required if c in df.columns], ~F.col(control)
    nums = [("all", "rows", F.count(F.lit(1))), ("all", "missing columns", F.max(F.lit(len(required) - len(there)))), ("all", "off sky", F.count_if(~(F.col(ra).between(0, 360) & F.col(dec).between(-90, 90)))), ("all", "tiles", F.count_distinct(tile)), ("all", "regions", F.count_distinct(region)), ("all", "repeated tasks", F.count(F.lit(1)) - F.count_distinct(task)), ("all", "control share", F.avg(F.col(control).cast("double")))]
    nums += [("nulls", c, F.count_if(F.col(c).isNull())) for c in there]
    nums += [(value, n, f(F.when(real, F.col(value)))) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev))]
    t = df.agg(*[a.cast("double").alias(f"a{i}") for i, (_, _, a) in enumerate(nums)])
    one = t.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("subject"), F.col(f"a{i}").alias("value")) for i, (s, n, _) in enumerate(nums)])).alias("r")).select("r.*")
    count = lambda c: df.groupBy(F.col(c).cast("string").alias("subject")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(c).alias("section"), "subject", "value")
    per = df.groupBy(config).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("configs"), F.min("n").alias("fewest"), F.max("n").alias("most"))
    per = per.select(F.explode(F.array(*[F.struct(F.lit("configs").alias("section"), F.lit(n).alias("subject"), F.col(n).cast("double").alias("value")) for n in ("configs", "fewest", "most")])).alias("r")).select("r.*")
    return union_named(one, per, *[count(c) for c in (split, selection, stamp, bands)])


def match_report(targets: DataFrame, matches: DataFrame, key: str, sep: str, by: Sequence[str], within: dict[str, float], least: float = 0.9) -> DataFrame:
    """Per group of ``by`` columns and for all (nulls): targets, matched ones, rate, distances, matches within each stated distance, and whether the rate passes.

    matches has at most one row per key.
    """
    t = targets.select(key, *by).join(matches.select(key, sep), key, "left")
    aggs = [F.count(F.lit(1)).alias("n"), F.count(sep).alias("matched"), F.avg(sep).alias("mean_sep"), F.percentile(sep, F.lit(0.5)).alias("median_sep"), F.max(sep).alias("max_sep"), *[F.count_if(F.col(sep) <= x).alias(f"within_{n}") for n, x in within.items()]]
    t = t.groupingSets([list(map(F.col, by)), []], *by).agg(*aggs) if by else t.agg(*aggs)
    return t.withColumn("rate", F.col("matched") / F.col("n")).withColumn("passed", F.col("rate") >= least)


def split_means(df: DataFrame, split: str, limits: dict[str, float]) -> DataFrame:
    """(feature, split_a, split_b, mean_a, mean_b, large): means of each column in each pair of splits; large if they differ by more than its limit."""
    m = df.groupBy(F.col(split).alias("_s")).agg(*[F.avg(c).alias(c) for c in limits])
    long = m.select("_s", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean"), F.lit(float(x)).alias("limit")) for c, x in limits.items()])).alias("r")).select("_s", "r.*")
    a, b = long.select("feature", "limit", F.col("_s").alias("split_a"), F.col("mean").alias("mean_a")), long.select("feature", F.col("_s").alias("split_b"), F.col("mean").alias("mean_b"))
    j = a.join(b, "feature").where("split_a < split_b")  # a row per split
    return j.select("feature", "split_a", "split_b", "mean_a", "mean_b", (F.abs(F.col("mean_a") - F.col("mean_b")) > F.col("limit")).alias("large"))


def stamp_report(df: DataFrame, stamp: str, size: int, by: str) -> DataFrame:
    """Per category: stamps, missing ones, ones of another size, with non-finite pixels, and with a MAD of 0."""
    odd = bad_share(stamp) > 0
    flat = mad(F.transform(stamp, lambda v: v.cast("double"))) == 0
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(stamp).isNull()).alias("missing"), F.count_if(F.size(stamp) != size).alias("off_size"), F.count_if(odd).alias("non_finite"), F.count_if(flat).alias("flat"))


def category_audit(df: DataFrame, by: Sequence[str], value: str, allowed: Sequence, key: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(counts of a category per group with its rows off the allowed values, the first ``most`` of those rows by key)."""
    off = ~F.coalesce(F.col(value).isin(list(allowed)), F.lit(False))
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off")), df.where(off).orderBy(key).limit(most)


def leak_report(df: DataFrame, used: Sequence[str], forbidden: Sequence[str], label: Column, numeric: Sequence[str], strong: float = 0.9) -> DataFrame:
    """(feature, forbidden, auc, leaking) of the columns in use: forbidden by name, or numeric ones whose direction-free AUC against the label reaches ``strong``."""
    from starloom.operators.metrics import auc, unpivot

    scores = auc(unpivot(df.withColumn("_y", label), [c for c in used if c in numeric], ["_y"]), "value", F.col("_y"), ["feature"]).select("feature", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("auc"))
    names = df.sparkSession.createDataFrame([(c, c in set(leaking(used, forbidden))) for c in used], "feature string, forbidden boolean")
    return names.join(scores, "feature", "left").withColumn("leaking", F.col("forbidden") | F.coalesce(F.col("auc") >= strong, F.lit(False)))


def file_layout(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(table, files, bytes, smallest, largest) of the files under a folder, from their metadata alone."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)\.parquet", 1)
    return t.groupBy(name.alias("table")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.min("length").alias("smallest"), F.max("length").alias("largest"))


def write_counted(df: DataFrame, path: str, counters: dict[str, Column]) -> dict[str, int]:
    """Writes df and returns counters that were observed on the way, without another scan."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in counters.items()]).write.parquet(path)
    return seen.get


def contract(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """df with the contracted columns only; raises on missing or repeated names."""
    if len({c.lower() for c in df.columns}) != len(df.columns):
        raise ValueError("column names repeat")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*required, *[c for c in optional if c in df.columns])


def leaking(columns: Sequence[str], forbidden: Sequence[str]) -> list[str]:
    """Columns in use that must not reach a model."""
    return sorted(set(columns) & set(forbidden))
