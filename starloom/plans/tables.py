"""Queries for joins, aggregates, rankings and split audits that are operators of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import aggregates as a
from starloom.operators import joins as j
from starloom.operators import sets as st
from starloom.operators import splits as sp
from starloom.operators import windows as w
from starloom.plans.aggregates import SEP, rounded, split_sql
from starloom.plans.registry import register
from starloom.plans.reports import ks_p_sql
from starloom.plans.views import read, sky, sql_dec, sql_ra

# joins


def supplier_places(spark, d):
    return (read(spark, d, "supplier"), "s_suppkey", "s_nationkey"), (read(spark, d, "nation"), "n_nationkey", "n_regionkey"), (read(spark, d, "region").where("r_name <> 'AFRICA'"), "r_regionkey", "r_regionkey")


@register(
    "join_region_map",
    """SELECT l_orderkey, l_linenumber, n_name, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'""",
)
def _(spark, d):
    return j.region_map(read(spark, d, "lineitem"), "l_suppkey", *supplier_places(spark, d)).select("l_orderkey", "l_linenumber", "n_name", "r_name")


@register("join_fill_zero", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(n, 0) / greatest(abs(c_acctbal), 1e-6) AS density FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(spark, d):
    counts = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return j.fill_counts(read(spark, d, "customer").withColumn("area", F.abs("c_acctbal")), counts, "c_custkey", "n", "area", one_to_one=True).select("c_custkey", "n", "density")


@register("join_nested_expand", "SELECT l_orderkey, l_linenumber, p_brand, p_size FROM lineitem JOIN (SELECT DISTINCT l_suppkey AS s, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5) ON l_suppkey = s")
def _(spark, d):
    t = read(spark, d, "lineitem")
    lists = j.nested(t.join(read(spark, d, "part").where("p_size < 5"), F.col("l_partkey") == F.col("p_partkey")), ["l_suppkey"], ["p_brand", "p_size"])
    return j.expand(t.select("l_orderkey", "l_linenumber", "l_suppkey"), lists, ["l_suppkey"]).drop("l_suppkey")


SKIES = f"a AS (SELECT c_custkey, {sql_ra('c_custkey')} AS ra, {sql_dec('c_custkey')} AS dec FROM customer), b AS (SELECT s_suppkey, {sql_ra('s_suppkey')} AS ra, {sql_dec('s_suppkey')} AS dec FROM supplier)"


def skies(spark, d):
    left = sky(read(spark, d, "customer"), "c_custkey").select("c_custkey", "ra", "dec")
    return left, sky(read(spark, d, "supplier"), "s_suppkey").select("s_suppkey", F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))


@register("join_footprint", f"WITH {SKIES}, p AS (SELECT c_custkey, s_suppkey, {SEP} AS sep FROM a, b WHERE {SEP} <= 1.5) SELECT c_custkey, count(*) AS n_tiles, min_by(s_suppkey, round(sep, 9)) AS tile, round(min(sep), 6) AS nearest FROM p GROUP BY 1")
def _(spark, d):
    return rounded(j.footprint(*skies(spark, d), 1.5, "c_custkey", "s_suppkey"))


@register("join_footprint_boxes", f"WITH {SKIES} SELECT c_custkey, s_suppkey FROM a JOIN b ON a.ra >= greatest(b.ra - 2, 0) AND a.ra < least(b.ra + 2, 360) AND a.dec >= b.dec - 1 AND a.dec < b.dec + 1")
def _(spark, d):
    points, centres = skies(spark, d)
    boxes = centres.select("s_suppkey", F.greatest(F.col("ra2") - 2, F.lit(0.0)).alias("ra1"), F.least(F.col("ra2") + 2, F.lit(360.0)).alias("ra2"), (F.col("dec2") - 1).alias("dec1"), (F.col("dec2") + 1).alias("dec2"))
    return j.in_boxes(points, boxes, 4.0).select("c_custkey", "s_suppkey")


@register("join_paired_delta", "SELECT o_orderkey, round(sum(l_extendedprice), 4) AS a, round(sum(l_extendedprice * (1 - l_discount)), 4) AS b, round(sum(l_extendedprice * (1 - l_discount)) - sum(l_extendedprice), 4) AS delta FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    t = read(spark, d, "lineitem").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderkey"), "l_orderkey")
    full = t.groupBy("o_orderkey").agg(F.sum("l_extendedprice").alias("score"))
    cut = t.groupBy("o_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"))
    return rounded(j.condition_delta(full, cut, ["o_orderkey"], "score"), 4)


@register(
    "join_cells_common",
    """WITH c AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, o_custkey AS cell, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT * FROM c WHERE y = 1995), b AS (SELECT * FROM c WHERE y = 1996)
    SELECT coalesce(a.p, b.p) AS p, coalesce(a.cell, b.cell) AS cell, a.n AS v1, b.n AS v2, b.n - a.n AS delta, CASE WHEN b.n IS NULL THEN 'first' WHEN a.n IS NULL THEN 'second' ELSE 'common' END AS side
    FROM a FULL JOIN b ON a.cell = b.cell AND a.p = b.p""",
)
def _(spark, d):
    c = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return j.common_cells(c.where("y = 1995"), c.where("y = 1996"), ["p", "cell"], "n")


@register("join_ledger_anti", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 3 = 0)")
def _(spark, d):
    o = read(spark, d, "orders")
    ledger = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "OK").otherwise("FAILED").alias("status"))
    return j.undone(o.select("o_orderkey"), ledger, ["o_orderkey"])


@register("join_blocklist_anti", "SELECT 'rows' AS name, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT 'late', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def _(spark, d):
    t, bad = read(spark, d, "lineitem"), read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    left = j.without_blocked({"rows": t, "late": t.where("l_returnflag = 'R'")}, bad, "l_suppkey")
    return st.union_named(*[f.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, f in left.items()])


@register("join_remove_flagged", "SELECT doc_id, quality, toxic = 1 AS flagged FROM labels")
def _(spark, d):
    t = read(spark, d, "labels")
    clean, bad = j.split_flagged(t, t.where("toxic = 1"), ["doc_id"])
    return st.union_named(clean.withColumn("flagged", F.lit(False)), bad.withColumn("flagged", F.lit(True))).select("doc_id", "quality", "flagged")


@register("join_lookup_hash", f"SELECT c_custkey, hits FROM (SELECT c_custkey, round({sql_ra('c_custkey')} / 2) AS x, round({sql_dec('c_custkey')} / 2) AS y FROM customer) JOIN (SELECT x, y, count(*) AS hits FROM (SELECT round({sql_ra('o_orderkey')} / 2) AS x, round({sql_dec('o_orderkey')} / 2) AS y FROM orders) GROUP BY ALL) USING (x, y)")
def _(spark, d):
    t = sky(read(spark, d, "orders"), "o_orderkey")
    cells = t.groupBy(F.round(F.col("ra") / 2).alias("x"), F.round(F.col("dec") / 2).alias("y")).agg(F.count(F.lit(1)).alias("hits")).select((F.col("x") * 2).alias("ra"), (F.col("y") * 2).alias("dec"), "hits")
    return j.position_lookup(skies(spark, d)[0], cells, 2.0).select("c_custkey", "hits")


@register(
    "join_grid_interpolate",
    """WITH g AS (SELECT CAST(floor(l_discount * 100 / 2) AS BIGINT) AS ix, CAST(floor(l_tax * 100 / 2) AS BIGINT) AS iy, round(avg(l_quantity) * avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL),
    t AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_quantity / 12.5::DOUBLE AS fx, l_linenumber / 2.0::DOUBLE AS fy FROM lineitem),
    q AS (SELECT *, CAST(floor(fx) AS BIGINT) AS x0, CAST(floor(fy) AS BIGINT) AS y0, fx - floor(fx) AS tx, fy - floor(fy) AS ty FROM t)
    SELECT l_orderkey, l_linenumber, round((1 - tx) * (1 - ty) * coalesce(a.v, 0) + (1 - tx) * ty * coalesce(b.v, 0) + tx * (1 - ty) * coalesce(c.v, 0) + tx * ty * coalesce(e.v, 0), 4) AS value
    FROM q LEFT JOIN g a ON a.ix = x0 AND a.iy = y0 LEFT JOIN g b ON b.ix = x0 AND b.iy = y0 + 1 LEFT JOIN g c ON c.ix = x0 + 1 AND c.iy = y0 LEFT JOIN g e ON e.ix = x0 + 1 AND e.iy = y0 + 1""",
)
def _(spark, d):
    t = read(spark, d, "lineitem")
    mean = F.avg("l_quantity")
    g = t.groupBy(F.floor(F.col("l_discount") * 100 / 2).alias("ix"), F.floor(F.col("l_tax") * 100 / 2).alias("iy")).agg(F.round(mean * mean, 6).alias("value"))
    return j.grid_interpolate(t.select("l_orderkey", "l_linenumber", "l_quantity"), g, "l_quantity", "l_linenumber", 0.0, 12.5, 0.0, 2.0).select("l_orderkey", "l_linenumber", F.round("interpolated", 4).alias("value"))


# rankings and samples


@register("win_global_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, d):
    return w.global_topk(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, "o_totalprice", "o_orderkey")


@register("win_candidate_list", "SELECT o_orderkey, o_totalprice, coalesce(g, 'ungraded') AS grade FROM (SELECT * FROM orders WHERE o_totalprice >= 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) LEFT JOIN (SELECT o_orderkey AS k, o_orderstatus AS g FROM orders WHERE o_orderkey % 2 = 0) ON k = o_orderkey")
def _(spark, d):
    o = read(spark, d, "orders")
    grades = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("grade"))
    return w.candidates(o, "o_totalprice", 200000, 100, "o_orderkey", grades).select("o_orderkey", "o_totalprice", "grade")


@register("sort_region_list", "SELECT *, (row_number() OVER (ORDER BY n DESC, bal DESC, n_nationkey))::INT AS place FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY 1) QUALIFY place <= 10")
def _(spark, d):
    t = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))
    return w.ordered_list(t, [F.desc("n"), F.desc("bal"), "n_nationkey"], 10)


@register("sort_local", "SELECT count(*) AS n, 0 AS unsorted, max(1) AS partitions_per_key FROM lineitem")
def _(spark, d):
    from pyspark.sql import Window

    t = w.local_order(read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"])
    t = t.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    before = F.lag(F.struct("l_orderkey", "l_linenumber")).over(Window.partitionBy("l_suppkey").orderBy("at"))
    t = t.withColumn("bad", F.coalesce((before > F.struct("l_orderkey", "l_linenumber")).cast("int"), F.lit(0)))
    per = t.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.count_distinct("part").alias("parts"))
    return per.agg(F.sum("n").alias("n"), F.sum("bad").cast("int").alias("unsorted"), F.max("parts").cast("int").alias("partitions_per_key"))


@register(
    "samp_boundary",
    """SELECT 'near 200000' AS sample, o_orderkey, o_totalprice FROM orders WHERE abs(o_totalprice - 200000) <= 500 UNION ALL SELECT 'near 100000', o_orderkey, o_totalprice FROM orders WHERE abs(o_totalprice - 100000) <= 500
    UNION ALL (SELECT 'smallest', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10) UNION ALL (SELECT 'largest', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)""",
)
def _(spark, d):
    t = w.boundary_samples(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", (200000, 100000), 500, "o_orderkey")
    return t.withColumn("sample", F.regexp_replace(F.regexp_replace("sample", "2e.05", "200000"), "1e.05", "100000"))


@register("set_dedup_exact", "SELECT l_partkey, l_suppkey, count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last, array_to_string(list_sort(list(l_orderkey))[1:3], ',') AS samples FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return st.duplicates(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey").withColumn("samples", F.array_join("samples", ","))


@register("set_dedup_position", f"SELECT min(o_orderkey) AS o_orderkey FROM (SELECT o_orderkey, floor({sql_ra('o_orderkey')} / (7200 / 3600.0::DOUBLE)) AS x, floor({sql_dec('o_orderkey')} / (7200 / 3600.0::DOUBLE)) AS y FROM orders) GROUP BY x, y")
def _(spark, d):
    return st.dedup_position(sky(read(spark, d, "orders"), "o_orderkey"), 7200 / 3600.0, ["o_orderkey"]).select("o_orderkey")


@register("set_entity_key", f"SELECT o_orderkey, printf('%.3f', {sql_ra('o_orderkey')}) || '_' || printf('%.3f', {sql_dec('o_orderkey')}) AS entity FROM orders")
def _(spark, d):
    return sky(read(spark, d, "orders"), "o_orderkey").select("o_orderkey", st.entity_key("ra", "dec", 3).alias("entity"))


# aggregates


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p = f"({k} / nullif({n}, 0))"
    root = f"1.96 * sqrt({p} * (1 - {p}) / nullif({n}, 0) + 1.96 * 1.96 / (4.0 * {n} * {n}))"
    mid, den = f"({p} + 1.96 * 1.96 / (2.0 * nullif({n}, 0)))", f"(1 + 1.96 * 1.96 / nullif({n}, 0))"
    null = f"CASE WHEN {n} > 0 THEN"
    return f"{null} greatest(({mid} - {root}) / {den}, 0) END", f"{null} least(({mid} + {root}) / {den}, 1) END"


@register("agg_two_phase", "SELECT event_type, count(DISTINCT ts::DATE) AS parts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(spark, d):
    return rounded(a.two_phase(read(spark, d, "events"), [F.to_date("ts")], ["event_type"], "value"), 4)


LEVELS = {"attempted": "true", "valid": "l_tax > 0", "clean": "l_tax > 0 AND l_discount < 0.08"}


@register(
    "agg_completeness_scores",
    "WITH t AS (SELECT l_linenumber, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{k}, count(*) FILTER (WHERE {c} AND l_returnflag = 'R') AS k_{k}" for k, c in LEVELS.items())
    + " FROM lineitem GROUP BY 1) SELECT *, " + ", ".join(f"round(k_{k} / nullif(n_{k}, 0), 6) AS of_{k}, round({wilson_sql(f'k_{k}', f'n_{k}')[0]}, 6) AS of_{k}_low, round({wilson_sql(f'k_{k}', f'n_{k}')[1]}, 6) AS of_{k}_high" for k in LEVELS)
    + ", round(n_valid / n_attempted, 6) AS share_valid, round(n_clean / n_attempted, 6) AS share_clean FROM t",
)
def _(spark, d):
    levels = {k: F.expr(c) for k, c in LEVELS.items() if k != "attempted"}
    return rounded(a.completeness_scores(read(spark, d, "lineitem"), ["l_linenumber"], F.col("l_returnflag") == "R", levels))


@register("agg_fpr_surface", f"SELECT *, round(k / n, 6) AS rate, round({wilson_sql('k', 'n')[0]}, 6) AS ci_low, round({wilson_sql('k', 'n')[1]}, 6) AS ci_high FROM (SELECT l_linenumber, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_extendedprice >= 60000) AS k FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)")
def _(spark, d):
    return rounded(a.rate_surface(read(spark, d, "lineitem").where("l_returnflag = 'N'"), ["l_linenumber", "l_linestatus"], F.col("l_extendedprice") >= 60000))


@register("agg_jeffreys")  # DuckDB has no Beta quantile; tests hold known quantiles
def _(spark, d):
    t = read(spark, d, "part").groupBy("p_size").agg(F.count_if(F.col("p_type") == "ECONOMY").alias("k"), F.count(F.lit(1)).alias("n"))
    return a.jeffreys(t, "k", "n")


def bins_sql(axes: dict[str, list[float]]) -> str:
    cells = ", ".join(f"(SELECT unnest(range({len(e) - 1}))::INT AS {c}_bin, unnest([{', '.join(repr((x + y) / 2) for x, y in zip(e[:-1], e[1:], strict=True))}])::DOUBLE AS {c}_centre)" for c, e in axes.items())
    index = ", ".join(f"least(len(list_filter([{', '.join(f'{x!r}::DOUBLE' for x in e)}], lambda e: e <= {c})) - 1, {len(e) - 2})::INT AS {c}_bin" for c, e in axes.items())
    where = " AND ".join(f"{c} BETWEEN {e[0]!r}::DOUBLE AND {e[-1]!r}::DOUBLE" for c, e in axes.items())
    keys = ", ".join(f"{c}_bin" for c in axes)
    return f"""WITH t AS (SELECT {index}, l_tax > 0 AS real, l_returnflag = 'R' AS found FROM lineitem WHERE {where}),
    g AS (SELECT {keys}, count(*) FILTER (WHERE real) AS n_real, count(*) FILTER (WHERE found) AS n_found, count(*) FILTER (WHERE real AND found) AS n_both FROM t GROUP BY ALL),
    u AS (SELECT {', '.join(f'{c}_bin, {c}_centre' for c in axes)}, coalesce(n_real, 0) AS n_real, coalesce(n_found, 0) AS n_found, coalesce(n_both, 0) AS n_both FROM (SELECT * FROM {cells}) LEFT JOIN g USING ({keys}))
    SELECT *, CASE WHEN n_real >= 20 THEN n_both / nullif(n_real, 0) END AS completeness, CASE WHEN n_found >= 20 THEN n_both / nullif(n_found, 0) END AS purity FROM u"""


AXES2, AXES1 = {"l_quantity": [0.0, 10.0, 20.0, 30.0, 50.0], "l_discount": [0.0, 0.025, 0.055, 0.1]}, {"l_quantity": [1.0, 5.0, 15.0, 40.0]}


@register("agg_bins_2d", bins_sql(AXES2))
def _(spark, d):
    return a.binned_rates(read(spark, d, "lineitem"), AXES2, F.col("l_tax") > 0, F.col("l_returnflag") == "R", 20)


@register("agg_bins_1d", bins_sql(AXES1))
def _(spark, d):
    return a.binned_rates(read(spark, d, "lineitem"), AXES1, F.col("l_tax") > 0, F.col("l_returnflag") == "R", 20)


@register("agg_selection_combine", "SELECT s_suppkey, r, CASE WHEN s_acctbal < 0 THEN 0.0 WHEN s_acctbal < 3000 THEN r * 0.5 ELSE r END AS value FROM supplier JOIN (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS r FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def _(spark, d):
    t = a.rate_surface(read(spark, d, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R").select(F.col("l_suppkey").alias("s_suppkey"), F.col("rate").alias("r"))
    classes = read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, "blind").when(F.col("s_acctbal") < 3000, "low").alias("class"))
    return a.selection_combine(t, classes, ["s_suppkey"], "r").select("s_suppkey", "r", "value")


@register("agg_binned_means", "SELECT CAST(least(floor(p_size / 10), 4) AS INT) AS bin, count(*) AS n, round(avg(p_retailprice), 4) AS p_retailprice_mean, round(avg(p_partkey), 4) AS p_partkey_mean FROM part WHERE p_size >= 0 AND p_size < 60 GROUP BY 1 HAVING count(*) >= 6")
def _(spark, d):
    return rounded(a.binned_means(read(spark, d, "part"), "p_size", (0, 10, 20, 30, 40, 60), ["p_retailprice", "p_partkey"]), 4)


@register("agg_delta_summary", "WITH c AS (SELECT l_linestatus, l_linenumber, avg(l_discount) FILTER (WHERE l_returnflag = 'R') - avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS d FROM lineitem GROUP BY ALL) SELECT l_linestatus, count(d) AS cells, round(avg(d), 6) AS mean, round(max(abs(d)), 6) AS largest, round(stddev(d), 6) AS std FROM c GROUP BY 1")
def _(spark, d):
    mean = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_discount")))
    t = read(spark, d, "lineitem").groupBy("l_linestatus", "l_linenumber").agg((mean("R") - mean("A")).alias("d"))
    return rounded(a.delta_summary(t, ["l_linestatus"], "d"))


MCNEMAR = """t AS (SELECT p_size % 5 AS g, count(*) FILTER (WHERE p_type = 'ECONOMY' AND NOT p_retailprice > 1000) AS b,
    count(*) FILTER (WHERE NOT p_type = 'ECONOMY' AND p_retailprice > 1000 AND p_partkey % 9 = 0) AS c FROM part GROUP BY 1)"""
CHI2 = "CASE WHEN b + c > 0 THEN pow(greatest(abs(b - c) - 1, 0), 2) / (b + c) END"
Z = f"sqrt(({CHI2}) / 2)"
#: Abramowitz and Stegun 7.1.26, right to 1.5e-7.
TAIL = f"(1 / (1 + 0.3275911 * {Z})) * (0.254829592 + (1 / (1 + 0.3275911 * {Z})) * (-0.284496736 + (1 / (1 + 0.3275911 * {Z})) * (1.421413741 + (1 / (1 + 0.3275911 * {Z})) * (-1.453152027 + (1 / (1 + 0.3275911 * {Z})) * 1.061405429)))) * exp(-{Z} * {Z})"


def mcnemar(spark, d):
    t = read(spark, d, "part").withColumn("g", F.col("p_size") % 5)
    x, y = F.col("p_type") == "ECONOMY", (F.col("p_retailprice") > 1000)
    t = t.withColumn("x", x).withColumn("y", F.when(x, y).otherwise(y & (F.col("p_partkey") % 9 == 0)))
    return a.mcnemar(t, ["g"], F.col("x"), F.col("y"))


@register(
    "agg_mcnemar",
    f"""WITH {MCNEMAR} SELECT g, b, c, round({CHI2}, 6) AS chi2, round({TAIL}, 5) AS p_chi2, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1)
        - (b + c) * ln(2))) FROM (SELECT unnest(range(0, least(b, c) + 1)) AS k))), 9) END AS p_exact FROM t""",
)
def _(spark, d):
    t = mcnemar(spark, d)
    return t.withColumn("chi2", F.round("chi2", 6)).withColumn("p_chi2", F.round("p_chi2", 5)).withColumn("p_exact", F.round("p_exact", 9))


@register("agg_mcnemar_pooled", f"WITH {MCNEMAR}, u AS (SELECT 'low' AS range, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c FROM t WHERE g <= 1 UNION ALL SELECT 'all', sum(b)::BIGINT, sum(c)::BIGINT FROM t) SELECT range, b, c, round({CHI2}, 6) AS chi2, round({TAIL}, 5) AS p_chi2 FROM u")
def _(spark, d):
    t = a.mcnemar_pooled(mcnemar(spark, d), "g", {"low": (0, 1), "all": (0, 9)})
    return t.withColumn("chi2", F.round("chi2", 6)).withColumn("p_chi2", F.round("p_chi2", 5))


@register("agg_strata_counts", f"SELECT lang, source, split, n, round(n / sum(n) OVER (), 9) AS share, round(n / sum(n) OVER (PARTITION BY split), 9) AS share_within FROM (SELECT lang, source, {split_sql('doc_id')} AS split, count(*) AS n FROM documents GROUP BY ALL)")
def _(spark, d):
    t = read(spark, d, "documents").select("lang", "source", sp.hash_split("doc_id").alias("split"))
    return rounded(a.shares(t, ["lang", "source", "split"], ["split"]), 9)


@register("agg_category_stats", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 20) AS flagged, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) FILTER (WHERE value > 20) / count(*), 6) AS share FROM events GROUP BY 1")
def _(spark, d):
    return rounded(a.category_stats(read(spark, d, "events"), ["event_type"], "value", 20))


@register("agg_prevalence_weighted", "WITH r AS (SELECT event_type, count(*) FILTER (WHERE value > 20) / count(*) AS fpr FROM events GROUP BY 1) SELECT round(sum(fpr * w) / sum(w), 9) AS weighted FROM (SELECT fpr, CASE event_type WHEN 'click' THEN 0.7 WHEN 'view' THEN 0.2 ELSE 0.1 END AS w FROM r)")
def _(spark, d):
    r = a.rate_surface(read(spark, d, "events"), ["event_type"], F.col("value") > 20)
    return rounded(a.prevalence_weighted(r, "event_type", "rate", {"click": 0.7, "view": 0.2}, 0.1), 9)


@register("agg_distinct_tasks", "SELECT DISTINCT l_suppkey, l_linestatus FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def _(spark, d):
    t = read(spark, d, "lineitem")
    return a.distinct_tasks([t.where("l_returnflag = 'R'"), t.where("l_returnflag = 'A'").select("l_linestatus", "l_suppkey")], ["l_suppkey", "l_linestatus"])


# split audits

SEPARATED = f"""t AS (SELECT c_custkey, {sql_ra('c_custkey')} AS ra, {sql_dec('c_custkey')} AS dec, {split_sql('c_custkey')} AS s FROM customer),
    p AS (SELECT a.c_custkey, min({SEP}) AS sep FROM t a, t b WHERE a.s = 'test' AND b.s = 'train' GROUP BY 1)"""


def separation(spark, d):
    t = sky(read(spark, d, "customer"), "c_custkey").withColumn("s", sp.hash_split("c_custkey"))
    train = t.where("s = 'train'").select(F.col("c_custkey").alias("other"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    return sp.min_separation(t.where("s = 'test'").select("c_custkey", "ra", "dec"), train, 1.0, "c_custkey", "other")


@register("spl_min_separation", f"WITH {SEPARATED} SELECT count(*) AS n, count(*) FILTER (WHERE sep IS NULL) AS alone, round(min(sep), 6) AS least, round(quantile_cont(sep, 0.5), 6) AS median, count(*) FILTER (WHERE sep < 1) AS violations FROM t LEFT JOIN p USING (c_custkey) WHERE s = 'test'")
def _(spark, d):
    return rounded(separation(spark, d)[0])


@register("spl_separation_violations", f"WITH {SEPARATED} SELECT c_custkey, round(sep, 6) AS sep FROM p WHERE sep < 1")
def _(spark, d):
    return rounded(separation(spark, d)[1].select("c_custkey", "sep"))


def balance_sql(where: str) -> str:
    return f"""WITH t AS (SELECT o_totalprice, o_custkey::DOUBLE AS o_custkey, {split_sql('o_orderkey')} AS s FROM orders WHERE {where}), l AS (FROM t UNPIVOT (v FOR feature IN (o_totalprice, o_custkey))),
    n AS (SELECT DISTINCT s FROM t), q AS (SELECT a.s AS split_a, b.s AS split_b FROM n a, n b WHERE a.s < b.s), x AS (SELECT feature, split_a, split_b, v, s = split_a AS y FROM l JOIN q ON s IN (split_a, split_b)),
    m AS (SELECT feature, split_a, split_b, avg(v) FILTER (WHERE y) AS mean_a, avg(v) FILTER (WHERE NOT y) AS mean_b, count(*) FILTER (WHERE y) AS n1, count(*) FILTER (WHERE NOT y) AS n2 FROM x GROUP BY ALL),
    c AS (SELECT feature, split_a, split_b, v, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS q FROM x GROUP BY ALL),
    r AS (SELECT feature, split_a, split_b, abs(sum(p) OVER w / sum(p) OVER z - sum(q) OVER w / sum(q) OVER z) AS gap FROM c WINDOW w AS (PARTITION BY feature, split_a, split_b ORDER BY v), z AS (PARTITION BY feature, split_a, split_b)),
    k AS (SELECT feature, split_a, split_b, max(gap) AS ks FROM r GROUP BY ALL)
    SELECT feature, split_a, split_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(ks, 4) AS ks, round({ks_p_sql('ks', 'n1', 'n2')}, 4) AS p FROM m JOIN k USING (feature, split_a, split_b)"""


@register("spl_balance", balance_sql("true"))
def _(spark, d):
    t = read(spark, d, "orders").withColumn("split", sp.hash_split("o_orderkey"))
    return rounded(sp.balance(t, "split", ["o_totalprice", "o_custkey"]), 4)


@register("spl_balance_positives", balance_sql("o_orderstatus = 'F'"))
def _(spark, d):
    t = read(spark, d, "orders").withColumn("split", sp.hash_split("o_orderkey"))
    return rounded(sp.balance(t, "split", ["o_totalprice", "o_custkey"], F.col("o_orderstatus") == "F"), 4)
