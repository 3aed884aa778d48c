"""Queries for joins, windows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import joins as j
from starloom.operators import sets as st
from starloom.operators import windows as w
from starloom.plans.registry import register
from starloom.plans.views import dec, ra, read, sky, sql_dec, sql_ra, sql_uniform


@register("join_meta_left", "SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice, c_nationkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(spark, d):
    meta = read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_mktsegment", F.lit(0.0).alias("o_totalprice"))
    fact = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return j.left_meta(fact, meta, ["c_custkey"])


def grid(spark, n=4):
    return spark.range(n).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("config"), (F.col("id") * 0.5).alias("theta"))


@register("join_grid_cross", "SELECT p_partkey, 'g' || g AS config, g * 0.5::DOUBLE AS theta, r::INT AS replicate FROM part, range(4) a(g), range(2) b(r)")
def _(spark, d):
    return j.grid_cross(read(spark, d, "part").select("p_partkey"), grid(spark), 2)


@register("join_modulo_assign", f"SELECT o_orderkey, 'g' || CAST(floor({sql_uniform('o_orderkey', 3)} * 4) AS INT) AS config, floor({sql_uniform('o_orderkey', 3)} * 4) * 0.5::DOUBLE AS theta FROM orders")
def _(spark, d):
    return j.modulo_assign(read(spark, d, "orders").select("o_orderkey"), grid(spark), "o_orderkey", "config", 3)


SEP = "degrees(2 * asin(least(sqrt(pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2)), 1)))"
SKY2 = f"WITH a AS (SELECT c_custkey, {sql_ra('c_custkey')} AS ra, {sql_dec('c_custkey')} AS dec FROM customer), b AS (SELECT s_suppkey, {sql_ra('s_suppkey * 7 + 3')} AS ra, {sql_dec('s_suppkey * 7 + 3')} AS dec FROM supplier), p AS (SELECT c_custkey, s_suppkey, {SEP} AS sep FROM a, b WHERE {SEP} <= 2.0)"


def skies(spark, d):
    a = sky(read(spark, d, "customer"), "c_custkey").select("c_custkey", "ra", "dec")
    b = read(spark, d, "supplier").withColumn("_k", F.col("s_suppkey") * 7 + 3)
    return a, b.select("s_suppkey", ra("_k").alias("ra2"), dec("_k").alias("dec2"))


@register("join_cell_nearest", SKY2 + " SELECT c_custkey, s_suppkey, round(sep, 6) AS sep FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(sep, 9), s_suppkey) AS n FROM p) WHERE n = 1")
def _(spark, d):
    a, b = skies(spark, d)
    return j.nearest(a, b, 2.0, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey", F.round("sep", 6).alias("sep"))


@register("join_best_of_sources", SKY2 + " SELECT c_custkey, s_suppkey, round(sep, 6) AS sep FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(sep, 9), s_suppkey) AS n FROM p) WHERE n = 1")
def _(spark, d):
    a, b = skies(spark, d)
    parts = [j.nearest(a, b.where(F.col("s_suppkey") % 3 == i), 2.0, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey", "sep") for i in range(3)]
    return j.latest(st.union_named(*parts), ["c_custkey"], [F.round("sep", 9), "s_suppkey"]).select("c_custkey", "s_suppkey", F.round("sep", 6).alias("sep"))


@register("join_radius_anti", SKY2 + " SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM p)")
def _(spark, d):
    a, b = skies(spark, d)
    return j.away(a, b, 2.0, "c_custkey").select("c_custkey")


@register("join_radius_flag", SKY2 + " SELECT c_custkey, c_custkey IN (SELECT c_custkey FROM p) AS near FROM customer")
def _(spark, d):
    a, b = skies(spark, d)
    return j.near_flag(a, b, 2.0, "c_custkey").select("c_custkey", "near")


@register("join_bin_swap", f"WITH o AS (SELECT *, {sql_uniform('o_orderkey', 5)} AS u FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY u, o_orderkey) AS n FROM o WHERE o_totalprice < 100000 AND {sql_uniform('o_orderkey', 6)} < 0.3::DOUBLE), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY u, o_orderkey) AS n FROM o WHERE o_totalprice >= 100000) SELECT c.o_orderkey, b.o_orderkey AS swapped FROM orders c LEFT JOIN a USING (o_orderkey) LEFT JOIN b ON a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus AND a.n = b.n WHERE c.o_totalprice < 100000")
def _(spark, d):
    o = read(spark, d, "orders")
    pool = o.where("o_totalprice >= 100000").select("o_orderpriority", "o_orderstatus", F.col("o_orderkey").alias("other"))
    return j.bin_swap(o.where("o_totalprice < 100000"), pool, ["o_orderpriority", "o_orderstatus"], "o_orderkey", "other", 0.3).select("o_orderkey", "swapped")


@register("join_pool_match", f"WITH need AS (SELECT p_size, count(*) AS need FROM part WHERE p_type = 'ECONOMY' GROUP BY 1), pool AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY {sql_uniform('p_partkey', 9)}, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_size) AS size FROM part WHERE p_type = 'PROMO' AND p_partkey % 2 = 0), x AS (SELECT *, unnest(range(0, (need - 1 - i) // size + 1)) AS draw FROM pool JOIN need USING (p_size) WHERE i < need) SELECT p_partkey, p_size, draw::INT AS draw FROM x")
def _(spark, d):
    p = read(spark, d, "part")
    return j.pool_match(p.where("p_type = 'ECONOMY'"), p.where("p_type = 'PROMO' AND p_partkey % 2 = 0").select("p_partkey", "p_size"), ["p_size"], "p_partkey").select("p_partkey", "p_size", "draw")


@register("join_scores", "SELECT doc_id, n_chars AS score, quality FROM documents JOIN labels USING (doc_id)")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score"))
    twice = st.union_named(docs, docs.withColumn("score", F.col("score") - 1))
    return j.latest(twice, ["doc_id"], [F.desc("score")]).join(read(spark, d, "labels"), "doc_id").select("doc_id", "score", "quality")


@register("win_topk_split", "SELECT c_mktsegment, c_custkey, c_acctbal, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 10")
def _(spark, d):
    return w.topk(read(spark, d, "customer"), 10, ["c_mktsegment"], "c_acctbal", "c_custkey").select("c_mktsegment", "c_custkey", "c_acctbal", "rank")


@register("win_stratified_topk", "SELECT c_custkey, b, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, b ORDER BY c_acctbal DESC, c_custkey) AS n FROM (SELECT *, c_nationkey % 4 AS b FROM customer)) WHERE n <= CASE b WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 1 END")
def _(spark, d):
    t = read(spark, d, "customer").withColumn("b", F.col("c_nationkey") % 4)
    return w.stratified_topk(t, {0: 2, 1: 3, 2: 5, 3: 1}, ["c_mktsegment"], "b", "c_acctbal", "c_custkey").select("c_custkey", "b", "rank")


@register("win_quota_two_pass", f"WITH a AS (SELECT *, {sql_uniform('o_orderkey', 0)} AS u, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {sql_uniform('o_orderkey', 0)}, o_orderkey) AS n FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY u, o_orderkey) AS r FROM a WHERE n <= 30) SELECT o_orderkey, r::INT AS rank FROM b WHERE r <= 100")
def _(spark, d):
    return w.two_pass_quota(read(spark, d, "orders"), ["o_orderpriority"], ["o_orderstatus"], 30, 100, "o_orderkey").select("o_orderkey", "rank")


@register("win_first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(spark, d):
    return j.latest(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@register("win_rank_scores", "SELECT DISTINCT l_quantity, (rank() OVER (ORDER BY l_quantity)) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem")
def _(spark, d):
    t = w.score_counts(read(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R")
    n = F.col("pos") + F.col("neg")
    return t.select("l_quantity", (F.col("pos_below") + F.col("neg_below") + 1 + (n - 1) / F.lit(2.0)).alias("rank"))


@register("win_threshold_at_fpr", "WITH n AS (SELECT l_extendedprice AS s, row_number() OVER (ORDER BY l_extendedprice DESC) AS i, count(*) OVER () AS all_ FROM lineitem WHERE l_returnflag <> 'R') SELECT t.s AS threshold, (SELECT count(*) FROM n WHERE s >= t.s) / t.all_ AS actual_fpr FROM n t WHERE i = greatest(CAST(ceil(all_ * 0.01::DOUBLE) AS BIGINT), 1)")
def _(spark, d):
    return w.threshold_at_fpr(read(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R", 0.01)


@register("win_half_total", "WITH r AS (SELECT o_orderkey, p, l_quantity, sum(l_quantity) OVER (PARTITION BY o_orderkey ORDER BY p, l_linenumber ROWS UNBOUNDED PRECEDING) AS run, sum(l_quantity) OVER (PARTITION BY o_orderkey) AS total, row_number() OVER (PARTITION BY o_orderkey ORDER BY p, l_linenumber) AS i FROM (SELECT l_orderkey AS o_orderkey, l_extendedprice AS p, l_linenumber, l_quantity FROM lineitem)) SELECT o_orderkey, min(p) AS half_price FROM r WHERE run * 2 >= total GROUP BY 1")
def _(spark, d):
    t = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("half_price"), "l_linenumber", "l_quantity")
    return w.half_total(t, ["o_orderkey"], ["half_price", "l_linenumber"], "l_quantity").select("o_orderkey", "half_price")


@register("set_union_named", "SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _(spark, d):
    a = read(spark, d, "customer").selectExpr("c_custkey as id", "c_acctbal as bal", "c_mktsegment as seg")
    return st.union_named(a, read(spark, d, "supplier").selectExpr("s_acctbal as bal", "s_suppkey as id"))


@register("set_overlap", "WITH k AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS s FROM orders) SELECT a.s AS split_a, b.s AS split_b, count(*) AS n FROM k a JOIN k b ON a.k = b.k AND a.s < b.s GROUP BY ALL")
def _(spark, d):
    return st.split_overlap(read(spark, d, "orders"), "o_custkey", "o_orderpriority")


@register("set_missing_extra", "WITH e AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), a AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT (SELECT count(*) FROM e) AS n_expected, (SELECT count(*) FROM a) AS n_actual, (SELECT count(*) FROM e ANTI JOIN a USING (k)) AS n_missing, (SELECT count(*) FROM a ANTI JOIN e USING (k)) AS n_extra, 100.0::DOUBLE * (SELECT count(*) FROM e SEMI JOIN a USING (k)) / (SELECT count(*) FROM e) AS coverage")
def _(spark, d):
    e = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return st.missing_extra(e, read(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")
