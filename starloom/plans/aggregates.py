"""Queries for aggregations and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import columns as c
from starloom.operators import aggregates as a
from starloom.operators import splits as sp
from starloom.operators.sets import split_overlap
from starloom.plans.columns import CUTS, SQL_CUTS, part_cuts
from starloom.plans.registry import register
from starloom.plans.views import read, sky, sql_dec, sql_ra, sql_uniform

WILSON = "greatest((k / n + 1.96 * 1.96 / (2.0 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 0) AS ci_low, least((k / n + 1.96 * 1.96 / (2.0 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 1) AS ci_high"


def rounded(df, places=6):
    return df.select(*[F.round(x, places).alias(x) if t == "double" else F.col(x) for x, t in df.dtypes])


@register("agg_tile_counts", f"SELECT p_brand, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {k}) AS n_{k}' for k in CUTS)} FROM (SELECT p_brand, {SQL_CUTS} FROM part) GROUP BY 1")
def _(spark, d):
    return a.tile_counts(part_cuts(read(spark, d, "part")), ["p_brand"], list(CUTS))


@register("agg_region_metrics", "SELECT c_nationkey, count(DISTINCT o_custkey) AS n_tiles, round(sum(w), 6) AS area, sum(one) AS total, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(stddev(o_totalprice), 4) AS o_totalprice_std, round(quantile_cont(o_totalprice, 0.1), 4) AS o_totalprice_p10, round(quantile_cont(o_totalprice, 0.5), 4) AS o_totalprice_p50, round(quantile_cont(o_totalprice, 0.9), 4) AS o_totalprice_p90, round(sum(one) / sum(w), 4) AS density FROM (SELECT *, 1::BIGINT AS one, 0.25::DOUBLE AS w FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1")
def _(spark, d):
    t = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("one", F.lit(1).cast("long")).withColumn("w", F.lit(0.25))
    return rounded(a.region_metrics(t, "c_nationkey", "o_custkey", ["o_totalprice"], "w", "one"), 4)


@register("agg_compactness", f"SELECT o_orderstatus, n * 0.01::DOUBLE AS area, ra_min, ra_max, dec_min, dec_max, round(n * 0.01::DOUBLE / ((ra_max - ra_min) * (dec_max - dec_min) * cos(radians((dec_min + dec_max) / 2))), 6) AS compactness FROM (SELECT o_orderstatus, count(*) AS n, min({sql_ra('o_orderkey')}) AS ra_min, max({sql_ra('o_orderkey')}) AS ra_max, min({sql_dec('o_orderkey')}) AS dec_min, max({sql_dec('o_orderkey')}) AS dec_max FROM orders GROUP BY 1)")
def _(spark, d):
    t = sky(read(spark, d, "orders"), "o_orderkey").withColumn("a", F.lit(0.01))
    out = a.compactness(t, ["o_orderstatus"], "a", "ra", "dec")
    return out.withColumn("area", F.round(F.round("area", 6) * 100) / F.lit(100.0)).withColumn("compactness", F.round("compactness", 6))


@register("agg_weighted_center", f"SELECT o_orderstatus, round(sum(w * {sql_ra('o_orderkey')}) / sum(w), 4) AS ra_center, round(sum(w * {sql_dec('o_orderkey')}) / sum(w), 4) AS dec_center, sum(w) AS weight FROM (SELECT *, (o_custkey % 7 + 1)::DOUBLE AS w FROM orders) GROUP BY 1")
def _(spark, d):
    t = sky(read(spark, d, "orders"), "o_orderkey").withColumn("w", (F.col("o_custkey") % 7 + 1).cast("double"))
    return rounded(a.weighted_center(t, ["o_orderstatus"], "w", ["ra", "dec"]), 4)


@register("agg_variant_stats", f"WITH t AS (SELECT p_brand, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {k}) AS n_{k}' for k in CUTS)} FROM (SELECT p_brand, {SQL_CUTS} FROM part) GROUP BY 1), l AS ({' UNION ALL '.join(f'SELECT {chr(39)}n_{k}{chr(39)} AS variant, n, n_{k} AS k FROM t' for k in CUTS)}) SELECT variant, count(*) AS n_tiles, count(*) FILTER (WHERE k > 0) AS n_nonzero, round(quantile_cont(CASE WHEN k > 0 THEN k / 0.25::DOUBLE END, 0.5), 6) AS median_density, round(quantile_cont(CASE WHEN k > 0 THEN k / 0.25::DOUBLE END, 0.9), 6) AS p90_density, round(quantile_cont(CASE WHEN k > 0 THEN k / 0.25::DOUBLE END, 0.95), 6) AS p95_density, round(quantile_cont(CASE WHEN k > 0 THEN k / 0.25::DOUBLE END, 0.99), 6) AS p99_density, round(avg(k / n), 6) AS mean_frac, round(quantile_cont(k / n, 0.5), 6) AS median_frac FROM l GROUP BY 1")
def _(spark, d):
    t = a.tile_counts(part_cuts(read(spark, d, "part")), ["p_brand"], list(CUTS)).withColumn("area", F.lit(0.25))
    return rounded(a.variant_stats(t, [f"n_{k}" for k in CUTS], "n", "area"))


LATE = "l_shipdate >= TIMESTAMP '1998-01-01'"


@register("agg_completeness", "SELECT l_linestatus, b, n, k AS n_recovered, 0::BIGINT AS n_null, round(m, 4) AS mean_value, md AS median_value, round(k / n, 6) AS completeness, " + WILSON.replace(" AS ci_low", " AS lo").replace(" AS ci_high", " AS hi").replace("greatest(", "round(greatest(").replace(", 0) AS lo", ", 0), 6) AS ci_low").replace("least(", "round(least(").replace(", 1) AS hi", ", 1), 6) AS ci_high") + f" FROM (SELECT l_linestatus, CAST(floor(l_discount * 100 / 4) AS BIGINT) AS b, count(*) AS n, count(*) FILTER (WHERE {LATE}) AS k, avg(l_quantity) AS m, quantile_cont(l_quantity, 0.5) AS md FROM lineitem GROUP BY ALL)")
def _(spark, d):
    t = read(spark, d, "lineitem").withColumn("b", F.floor(F.col("l_discount") * 100 / 4))
    return rounded(a.completeness(t, ["l_linestatus", "b"], F.col("l_shipdate") >= F.to_timestamp(F.lit("1998-01-01")), "l_quantity").withColumn("mean_value", F.round("mean_value", 4)))


@register("agg_pooled_regions", "WITH r AS (SELECT c_nationkey, c_mktsegment, count(*) FILTER (WHERE c_acctbal > 5000) AS k, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT c_mktsegment, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n, count(*) AS regions, avg(k / n) AS mean_ratio, stddev_pop(k / n) AS std_ratio, quantile_cont(k / n, 0.5) AS p50_of_regions FROM r GROUP BY 1) SELECT c_mktsegment, k, n, regions, round(mean_ratio, 6) AS mean_ratio, round(std_ratio, 6) AS std_ratio, round(p50_of_regions, 6) AS p50_of_regions, round(k / n, 6) AS ratio, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM (SELECT *, " + WILSON + " FROM t)")
def _(spark, d):
    r = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 5000).alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(a.pooled(r, ["c_mktsegment"], "k", "n"))


@register("agg_wilson", "SELECT p_size, k, n, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM (SELECT *, " + WILSON + " FROM (SELECT p_size, count(*) FILTER (WHERE p_type = 'ECONOMY') AS k, count(*) AS n FROM part GROUP BY 1))")
def _(spark, d):
    t = read(spark, d, "part").groupBy("p_size").agg(F.count_if(F.col("p_type") == "ECONOMY").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = a.wilson(F.col("k"), F.col("n"))
    return t.withColumn("ci_low", F.round(low, 6)).withColumn("ci_high", F.round(high, 6))


@register("agg_marginals", "SELECT l_linestatus, l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k, grouping_id(l_linestatus, l_linenumber)::BIGINT AS level, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS ratio FROM lineitem GROUP BY CUBE (l_linestatus, l_linenumber)")
def _(spark, d):
    return a.margins(read(spark, d, "lineitem"), ["l_linestatus", "l_linenumber"], F.col("l_returnflag") == "R")


DELTA = "SELECT l_linenumber, l_tax AS a, l_discount AS b FROM lineitem"


@register("agg_paired_delta", f"WITH t AS ({DELTA}), g AS (SELECT l_linenumber, count(*) AS n, round(avg(b - a), 6) AS mean, round(stddev(b - a), 6) AS std, round(quantile_cont(b - a, 0.25), 6) AS p25, round(quantile_cont(b - a, 0.5), 6) AS median, round(quantile_cont(b - a, 0.75), 6) AS p75, count(*) FILTER (WHERE b > a) AS up, count(*) FILTER (WHERE b < a) AS down, count(*) FILTER (WHERE b = a) AS zero, count(*) FILTER (WHERE a < 0.04 AND b >= 0.04) AS gained, count(*) FILTER (WHERE a >= 0.04 AND b < 0.04) AS lost FROM t GROUP BY 1) SELECT *, CASE WHEN gained > 2 * lost THEN 'gain' WHEN lost > 2 * gained THEN 'loss' ELSE 'mixed' END AS mechanism FROM g")
def _(spark, d):
    t = read(spark, d, "lineitem").select("l_linenumber", F.col("l_tax").alias("a"), F.col("l_discount").alias("b"))
    return rounded(a.paired_delta(t, ["l_linenumber"], "a", "b", 0.04))


@register("agg_cell_concentration", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS cells, max(n) AS largest, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, o_custkey LIMIT 5)) / sum(n), 9) AS top_share FROM c")
def _(spark, d):
    t = a.cell_concentration(read(spark, d, "orders"), "o_custkey")
    return t.withColumn("mean", F.round("mean", 6)).withColumn("top_share", F.round("top_share", 9))


@register("agg_catalog_profile", " UNION ALL ".join(f"SELECT '{x}' AS subject, count({x}) AS valid, count(*) - count({x}) AS missing, min({x})::DOUBLE AS least, max({x})::DOUBLE AS most, round(avg({x}), 4) AS mean, quantile_cont({x}::DOUBLE, 0.5) AS median FROM orders" for x in ("o_orderkey", "o_custkey", "o_totalprice")))
def _(spark, d):
    return a.profile(read(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]).withColumn("mean", F.round("mean", 4))


# splits

SPLIT = "CASE WHEN {u} < 0.1::DOUBLE THEN 'test' WHEN {u} < 0.2::DOUBLE THEN 'val' ELSE 'train' END"


def split_sql(key, seed=13):
    return SPLIT.format(u=sql_uniform(key, seed))


@register("spl_hash", f"SELECT o_orderkey, {split_sql('o_orderkey')} AS split FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", sp.hash_split("o_orderkey").alias("split"))


CELL = f"(CAST(floor({sql_ra('o_orderkey')}) AS BIGINT)::VARCHAR || '_' || CAST(floor({sql_dec('o_orderkey')}) AS BIGINT)::VARCHAR)"


@register("spl_cell", f"SELECT o_orderkey, {split_sql(CELL)} AS split FROM orders")
def _(spark, d):
    t = sky(read(spark, d, "orders"), "o_orderkey").withColumn("cell", F.concat_ws("_", F.floor("ra"), F.floor("dec")))
    return t.select("o_orderkey", sp.hash_split("cell").alias("split"))


@register("spl_entity", f"SELECT l_orderkey, l_linenumber, {split_sql('l_orderkey')} AS split, {sql_uniform('l_orderkey', 21)} < 0.5::DOUBLE AS positive_pool FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sp.hash_split("l_orderkey").alias("split"), (c.hash_uniform("l_orderkey", 21) < 0.5).alias("positive_pool"))


@register("spl_exact", f"SELECT doc_id, CASE WHEN i <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {sql_uniform('doc_id', 13)}, doc_id) AS i, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def _(spark, d):
    return sp.exact_split(read(spark, d, "labels"), "doc_id", ["quality"]).select("doc_id", "split")


@register("spl_relabel", f"SELECT o_orderkey, CASE WHEN s = 'val' AND {sql_uniform('o_orderkey', 17)} < 0.3::DOUBLE THEN 'train' ELSE s END AS split FROM (SELECT o_orderkey, {split_sql('o_orderkey')} AS s FROM orders)")
def _(spark, d):
    t = read(spark, d, "orders").select("o_orderkey", sp.hash_split("o_orderkey").alias("s"))
    return t.select("o_orderkey", sp.relabel("s", "o_orderkey", 0.3).alias("split"))


@register("spl_fill_missing", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'given' ELSE {split_sql('o_orderkey')} END AS split FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", sp.fill_missing(F.when(F.col("o_orderkey") % 3 == 0, "given"), "o_orderkey").alias("split"))


@register("spl_merge", f"SELECT o_orderkey, replace({split_sql('o_orderkey')}, 'test', 'val') AS split FROM orders")
def _(spark, d):
    s = sp.hash_split("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", F.when(s == "test", "val").otherwise(s).alias("split"))


@register("spl_proportions", f"WITH s AS (SELECT {split_sql('o_orderkey')} AS split FROM orders), h AS (SELECT split, count(*) AS n FROM s GROUP BY 1), e AS (SELECT * FROM (VALUES ('test', 0.1::DOUBLE), ('val', 0.2::DOUBLE), ('extra', 0.0::DOUBLE)) v(split, expected)), j AS (SELECT coalesce(h.split, e.split) AS split, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT count(*) FROM s) AS actual, expected FROM h FULL JOIN e ON h.split = e.split) SELECT *, CASE WHEN expected IS NULL THEN 'unknown' WHEN abs(actual - expected) > 0.05 THEN 'fail' WHEN abs(actual - expected) > 0.025 THEN 'warn' ELSE 'ok' END AS status FROM j")
def _(spark, d):
    t = read(spark, d, "orders").withColumn("split", sp.hash_split("o_orderkey"))
    return sp.proportions(t, "split", {"test": 0.1, "val": 0.2, "extra": 0.0})


@register("spl_leakage", f"WITH k AS (SELECT DISTINCT md5(text) AS k, {split_sql('doc_id')} AS s FROM documents) SELECT a.s AS split_a, b.s AS split_b, count(*) AS n FROM k a JOIN k b ON a.k = b.k AND a.s < b.s GROUP BY ALL")
def _(spark, d):
    t = read(spark, d, "documents").select(F.md5("text").alias("k"), sp.hash_split("doc_id").alias("s"))
    return split_overlap(t, "k", "s")


SEP = "degrees(2 * asin(least(sqrt(pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2)), 1)))"


KS = "WITH c AS (SELECT v, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS q FROM t GROUP BY 1), r AS (SELECT sum(p) OVER (ORDER BY v) / sum(p) OVER () - sum(q) OVER (ORDER BY v) / sum(q) OVER () AS gap, sum(p) OVER () AS n1, sum(q) OVER () AS n2 FROM c) SELECT round(max(abs(gap)), 9) AS ks, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2 FROM r"
