"""Queries for sources, sinks, samples, manifests, regions, stamps and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from starloom.functions import arrays as a
from starloom.operators import regions as rg
from starloom.operators import sampling as sm
from starloom.operators.joins import grid_cross, left_meta
from starloom.operators.quality import contract
from starloom.operators.sets import union_named
from starloom.operators.stored import Stored
from starloom.plans.aggregates import rounded
from starloom.plans.registry import register
from starloom.plans.views import read, scratch_dir, sql_uniform
from starloom.sources import catalogs as s
from starloom.sources import snapshots as sn
from starloom.streaming.incremental import incremental_counts, incremental_sketches, merge_sketches, read_sketches, sketch


@register("src_catalog", "SELECT p_partkey, p_brand FROM part")
def _(spark, d):
    return s.read_catalog(spark, f"{d}/part.parquet", ["p_partkey", "p_brand"])


@register("src_normalise", "SELECT s_suppkey AS id, s_acctbal AS flux, NULL::VARCHAR AS kind FROM supplier")
def _(spark, d):
    aliases = {"id": (("S_SUPPKEY", "objid"), "bigint"), "flux": (("S_AcctBal",), "double"), "kind": (("type",), "string")}
    return s.normalise(read(spark, d, "supplier"), aliases, ["id"])


@register("src_counts_csv", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    path = scratch_dir(spark)
    read(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n")).write.option("header", True).csv(path)
    return s.read_counts(spark, f"{path}/*.csv", "o_orderpriority string, y int, n bigint").groupBy("o_orderpriority").agg(F.sum("n").alias("n"))


@register("src_text_index", "SELECT n_name AS value FROM nation WHERE n_nationkey % 3 > 0")
def _(spark, d):
    path = scratch_dir(spark)
    line = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("# "), F.col("n_name"))).otherwise(F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")))
    read(spark, d, "nation").select(line.alias("value")).unionAll(spark.sql("SELECT '' AS value")).write.text(path)
    return s.read_index(spark, path, 4)


@register("src_extra_pool", "SELECT c_custkey AS id, c_acctbal AS bal, 'main' AS pool, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'extra', NULL FROM supplier")
def _(spark, d):
    main = read(spark, d, "customer").selectExpr("c_custkey as id", "c_acctbal as bal", "'main' as pool", "c_mktsegment as segment")
    return union_named(main, read(spark, d, "supplier").selectExpr("s_suppkey as id", "s_acctbal as bal", "'extra' as pool"))


@register("src_manifest_status", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    return s.status_table(read(spark, d, "events"), "event_type", "value").select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@register("snk_partitioned", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    path = scratch_dir(spark)
    s.write_partitioned(read(spark, d, "lineitem").select("l_returnflag", "l_orderkey"), path, ["l_returnflag"])
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@register("snk_single_csv", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    path = scratch_dir(spark)
    s.write_csv(read(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")), path)
    return s.read_counts(spark, path, "c_nationkey int, n bigint")


@register("snk_run_record", "SELECT '{\"rows\": ' || count(*)::VARCHAR || ', \"stage\": \"regions\"}' AS value FROM nation")
def _(spark, d):
    path = scratch_dir(spark)
    s.write_record(spark, path, {"stage": "regions", "rows": read(spark, d, "nation").count()})
    return spark.read.text(path)


@register("snk_verify", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 40")
def _(spark, d):
    n = s.write_verified(read(spark, d, "lineitem").where("l_quantity > 40"), scratch_dir(spark))
    return spark.createDataFrame([(n,)], "n bigint")


@register("snk_compact", "SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def _(spark, d):
    raw, out = scratch_dir(spark), scratch_dir(spark)
    read(spark, d, "lineitem").select("l_linestatus", "l_quantity").repartition(24).write.parquet(raw)
    return s.compact(spark, raw, out, "l_linestatus", ["l_quantity"]).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@register("snk_metrics_only", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, d):
    path = scratch_dir(spark)
    read(spark, d, "documents").drop("text", "source").write.parquet(path)
    return spark.read.parquet(path)


@register("src_snapshot", "SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def _(spark, d):
    """Two commits, a half-written run beside them, a compaction and a vacuum; then the catalog is read."""
    path, t = scratch_dir(spark), read(spark, d, "lineitem").select("l_linestatus", "l_quantity", "l_linenumber")
    for half in (0, 1):
        sn.commit(spark, t.where(F.col("l_linenumber") % 2 == half).repartition(6), path, "l_linestatus")
    t.limit(0).withColumn("stray", F.lit(1)).write.parquet(f"{path}/{sn.DATA}/stray")
    sn.compact(spark, path)
    sn.vacuum(spark, path)
    return s.read_catalog(spark, path).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@register("join_meta_bucketed", "SELECT o_orderkey, o_custkey AS c_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    path, name = scratch_dir(spark), f"starloom_{uuid.uuid4().hex[:12]}"
    fact = s.write_bucketed(read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), f"{name}_f", ["c_custkey"], 8, f"{path}/fact")
    meta = s.write_bucketed(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), f"{name}_m", ["c_custkey"], 8, f"{path}/meta")
    return left_meta(fact, meta, ["c_custkey"])


@register("agg_two_phase_sketches", "SELECT event_type, count(*) AS n, true AS median_close, true AS tail_close, true AS users_close FROM events GROUP BY 1")
def _(spark, d):
    """Daily sketches, merged: each estimate is held against the exact rank or count, within the stated errors."""
    t = read(spark, d, "events").select("event_type", "user_id", F.col("value").cast("double").alias("value"), F.to_date("ts").alias("day"))
    parts = Stored(spark, "sketches").keep(sketch(t, ["event_type", "day"], ["value"], ["user_id"]))
    e = read_sketches(merge_sketches(parts.drop("day"), ["event_type"]), ["event_type"], [0.5, 0.95])
    j = t.join(F.broadcast(e), "event_type")  # a row per type
    within = lambda c, p: ((F.count_if(F.col("value") < F.col(c)) / F.count("value") < p + 0.02) & (F.count_if(F.col("value") <= F.col(c)) / F.count("value") > p - 0.02))
    users = F.count_distinct("user_id")
    return j.groupBy("event_type").agg(F.first("n").alias("n"), within("value_p50", 0.5).alias("median_close"), within("value_p95", 0.95).alias("tail_close"), (F.abs(F.first("user_id_distinct") - users) <= 0.025 * users).alias("users_close"))


@register("stm_incremental_sketches", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, d):
    src, out, mark = scratch_dir(spark), scratch_dir(spark), scratch_dir(spark)
    t = read(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("long").alias("user_id"), F.col("value").cast("double").alias("value"))
    for i in range(2):  # new files arrive between two runs; theta sketches count exactly up to 2^20 users
        t.where(F.col("event_id") % 2 == i).repartition(2).write.mode("append").parquet(src)
        state = incremental_sketches(spark, src, t.schema, ["event_type"], ["value"], ["user_id"], out, mark, lg=20)
    return read_sketches(state, ["event_type"], [0.5]).select("event_type", "n", F.col("user_id_distinct").alias("users"))


@register("stm_incremental_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    src, out, mark = scratch_dir(spark), scratch_dir(spark), scratch_dir(spark)
    t = read(spark, d, "events").select("event_id", "event_type")
    for i in range(2):  # new files arrive between two runs
        t.where(F.col("event_id") % 2 == i).repartition(2).write.mode("append").parquet(src)
        counts = incremental_counts(spark, src, t.schema, ["event_type"], out, mark)
    return counts


# samples


@register("smp_fraction", f"SELECT o_orderkey FROM orders WHERE {sql_uniform('o_orderkey', 3)} < 0.2::DOUBLE")
def _(spark, d):
    return sm.fraction(read(spark, d, "orders"), "o_orderkey", 0.2).select("o_orderkey")


@register("smp_ratio_backfill", f"WITH p AS (SELECT p_size, count(*) AS p FROM part WHERE p_type = 'PROMO' GROUP BY 1), x AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS pool FROM part WHERE p_type = 'ECONOMY'), n2 AS (SELECT p_size, count(*) AS n2 FROM x WHERE pool = 2 GROUP BY 1), q AS (SELECT p_size, CAST(floor(p * {2 * 0.85!r}::DOUBLE) AS BIGINT) AS q1, p * 2 AS q, coalesce(n2, 0) AS n2 FROM p LEFT JOIN n2 USING (p_size)), r AS (SELECT x.*, q1, q - q1 AS q2, greatest(q - q1 - n2, 0) AS short, row_number() OVER (PARTITION BY p_size, pool ORDER BY {sql_uniform('p_partkey', 7)}, p_partkey) AS i FROM x JOIN q USING (p_size)) SELECT p_partkey, p_size, pool = 1 AND i > q1 AS backfill FROM r WHERE CASE WHEN pool = 1 THEN i <= q1 + short ELSE i <= q2 END")
def _(spark, d):
    t = read(spark, d, "part")
    pool = t.where("p_type = 'ECONOMY'").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 5 == 0, 2).otherwise(1).alias("pool"))
    return sm.ratio_backfill(t.where("p_type = 'PROMO'"), pool, ["p_size"], "p_partkey", "pool", 2).select("p_partkey", "p_size", "backfill")


STEPS = (("known status", "o_orderstatus <> 'P'"), ("bright", "o_totalprice > 100000"), ("recent", "o_orderdate >= TIMESTAMP '1996-01-01'"))


@register("smp_filter_waterfall", "WITH k AS (SELECT count(*) AS k0, count(*) FILTER (WHERE o_orderstatus <> 'P') AS k1, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_totalprice > 100000) AS k2, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1996-01-01') AS k3 FROM orders) SELECT 1 AS step, 'known status' AS name, k1 AS kept, k0 - k1 AS lost FROM k UNION ALL SELECT 2, 'bright', k2, k1 - k2 FROM k UNION ALL SELECT 3, 'recent', k3, k2 - k3 FROM k")
def _(spark, d):
    return sm.waterfall(read(spark, d, "orders"), [(n, F.expr(x)) for n, x in STEPS])


@register("smp_reject_shape", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 2 AND 30 AND {sql_uniform('l_orderkey', 23)} < 2.0::DOUBLE / l_quantity")
def _(spark, d):
    return sm.reject_to_log_uniform(read(spark, d, "lineitem"), "l_quantity", 2.0, 30.0, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


# manifests


@register("man_task_guard", "SELECT count(*) * 48 AS tasks, true AS refused FROM part")
def _(spark, d):
    t = read(spark, d, "part")
    tasks, refused = sm.task_guard(t, 48, 10**12), False
    try:
        sm.task_guard(t, 48, 10)
    except ValueError:
        refused = True
    return spark.createDataFrame([(tasks, refused)], "tasks bigint, refused boolean")


@register("man_replicates", "SELECT p_partkey, 'g0' AS config, r::INT AS replicate FROM part, range(3) q(r)")
def _(spark, d):
    g = spark.sql("SELECT 'g0' AS config")
    return grid_cross(read(spark, d, "part").select("p_partkey"), g, 3)


@register("man_contract", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, d):
    return contract(read(spark, d, "orders"), ["o_orderkey", "o_totalprice"], ["o_orderstatus", "absent"])


# regions

NATION = "n AS (SELECT c_nationkey AS k, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) * 0.25::DOUBLE AS area FROM customer GROUP BY 1)"


@register("reg_scores", f"WITH {NATION} SELECT k, round(n / area, 6) AS score_density, round(n / area * sqrt(area), 6) AS score_area, round(n / area * greatest(least(exp(-((k / 10.0::DOUBLE) - 1.2) / 0.3), 1.0), 0.0) * (1 / (1 + exp(-((22 + k / 8.0::DOUBLE) - 23.5) / 0.3))) * exp(-(k / 100.0::DOUBLE) / 0.1), 6) AS score_quality FROM n")
def _(spark, d):
    t = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("c_acctbal") > 0) * 0.25).alias("area"))
    t = t.withColumn("density", F.col("n") / F.col("area")).withColumn("psf", F.col("k") / 10).withColumn("depth", F.lit(22.0) + F.col("k") / 8).withColumn("ebv", F.col("k") / 100)
    return rounded(rg.scores(t, "density", "area", "psf", "depth", "ebv").select("k", "score_density", "score_area", "score_quality"))


@register("reg_primary_backup", f"WITH {NATION}, w AS (SELECT k, 'window' AS role FROM n WHERE area BETWEEN 10 AND 14 ORDER BY n / area DESC, k LIMIT 2), l AS (SELECT k, 'largest' AS role FROM n WHERE (SELECT count(*) FROM n WHERE area BETWEEN 10 AND 14) = 0 ORDER BY area DESC, k LIMIT 3) SELECT * FROM w UNION ALL SELECT * FROM l")
def _(spark, d):
    t = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("c_acctbal") > 0) * 0.25).alias("area")).withColumn("density", F.col("n") / F.col("area"))
    return rg.primary_backup(t, "area", "density", "k", 10.0, 14.0).select("k", "role")


# stamps: an embedding's first 64 numbers as 8 x 8 pixels

SIDE = 8
E = "WITH e AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: x::DOUBLE) AS v FROM embeddings) "


def stamps(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 64), lambda x: x.cast("double")).alias("v"))


def sql_pick(mask, v="v"):
    return "[" + ", ".join(f"{v}[{i + 1}]" for i in mask) + "]"


def sql_median(x):
    return f"list_aggregate({x}, 'quantile_cont', 0.5)"


CORE, OUTER = a.ring(SIDE, 0, 2), a.ring(SIDE, 3, 9)


@register("arr_robust_norm", E + f"SELECT vec_id, round(list_max(list_transform(v, lambda x: greatest(least((x - m) / (s * 1.4826), 10.0), -10.0))), 5) AS most, round(list_sum(list_transform(v, lambda x: greatest(least((x - m) / (s * 1.4826), 10.0), -10.0))), 4) AS total FROM (SELECT *, {sql_median('list_transform(o, lambda x: abs(x - m))')} AS s FROM (SELECT *, {sql_median('o')} AS m FROM (SELECT *, {sql_pick(OUTER)} AS o FROM e)))")
def _(spark, d):
    t = stamps(spark, d).select("vec_id", a.robust_norm("v", OUTER).alias("n"))
    return t.select("vec_id", F.round(F.array_max("n"), 5).alias("most"), F.round(a.total(F.col("n")), 4).alias("total"))


INNER = [i for i in range(64) if 0 < i % SIDE < SIDE - 1 and 0 < i // SIDE < SIDE - 1]


@register("arr_laplacian", E + f"SELECT vec_id, round(list_avg([{', '.join(f'abs(4 * v[{i + 1}] - v[{i}] - v[{i + 2}] - v[{i + 1 - SIDE}] - v[{i + 1 + SIDE}])' for i in INNER)}]), 6) AS lap FROM e")
def _(spark, d):
    return rounded(stamps(spark, d).select("vec_id", a.laplacian("v", SIDE, range(64)).alias("lap")))


@register("arr_snr", E + "SELECT vec_id, round(list_max(list_transform(v, lambda x: x / (abs(x) + 0.1))), 6) AS peak, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: (abs(x) + 0.1) * (abs(x) + 0.1)))), 6) AS integrated FROM e")
def _(spark, d):
    t = stamps(spark, d).withColumn("e", F.transform("v", lambda x: F.abs(x) + 0.1)).select("vec_id", a.snr("v", "e").alias("m"))
    return rounded(t.select("vec_id", "m.peak", "m.integrated"))


MID = a.ring(SIDE, 1, 3)


RADII = "[" + ", ".join(f"{(((i % SIDE) - 3.5) ** 2 + ((i // SIDE) - 3.5) ** 2) ** 0.5!r}::DOUBLE" for i in range(64)) + "]"
