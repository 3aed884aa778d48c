"""Queries for stamps and data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import arrays as a
from starloom.operators import joins as j
from starloom.operators import quality as q
from starloom.operators.splits import hash_split
from starloom.plans.aggregates import SEP, rounded, split_sql
from starloom.plans.evaluation import AUC, RANK, S, good, scored
from starloom.plans.pipelines import CORE, OUTER, RADII, SIDE, E, sql_median, sql_pick, stamps
from starloom.plans.registry import register
from starloom.plans.tables import SKIES, skies
from starloom.plans.views import read, scratch_dir, sky, sql_dec, sql_ra

PIXELS = SIDE * SIDE

# stamps: an embedding's numbers as 8 x 8 pixels; a second band is the first one with other weights and gaps

TWO = E + ", b AS (SELECT vec_id, v, list_transform(v, lambda x, i: CASE WHEN vec_id % 7 = 0 AND i % 9 = 1 THEN 'nan'::DOUBLE ELSE x * 0.9 + 0.01 * (i - 1) END) AS w FROM e)"


def two_bands(spark, d):
    t = stamps(spark, d)
    gap = lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i % 9 == 0), F.lit(float("nan"))).otherwise(x * 0.9 + F.lit(0.01) * i)
    return t.withColumn("w", F.transform("v", gap))


def bad_sql(mask: list[int], v: str) -> str:
    return f"len(list_filter({sql_pick(mask, v)}, lambda x: isnan(x) OR isinf(x))) / {len(mask)}"


ALL, CENTRE = list(range(PIXELS)), a.ring(SIDE, 0, 3)


@register(
    "arr_quality",
    f"""{TWO}, s AS (SELECT vec_id, {bad_sql(ALL, 'v')} AS g_bad, {bad_sql(ALL, 'w')} AS r_bad, ({bad_sql(CENTRE, 'v')} + {bad_sql(CENTRE, 'w')}) / 2 AS bad_centre,
    ({bad_sql(CORE, 'v')} + {bad_sql(CORE, 'w')}) / 2 AS bad_core FROM b)
    SELECT vec_id, {PIXELS} AS size, true AS present, round((g_bad + r_bad) / 2, 9) AS bad, round(bad_centre, 9) AS bad_centre, round(bad_core, 9) AS bad_core, round(g_bad, 9) AS g_bad, round(r_bad, 9) AS r_bad,
        (g_bad + r_bad) / 2 <= 0.02 AND bad_centre <= 0.02 AND bad_core <= 0.02 AS ok FROM s""",
)
def _(spark, d):
    return rounded(two_bands(spark, d).select("vec_id", a.quality({"g": "v", "r": "w"}, SIDE, 3, 2).alias("q")).select("vec_id", "q.*"), 9)


MASKS = {"core": CORE, "outer": OUTER, "edge": [i for i in range(PIXELS) if min(i % SIDE, i // SIDE, SIDE - 1 - i % SIDE, SIDE - 1 - i // SIDE) == 0]}


@register("arr_region_stats", E + "SELECT vec_id, " + ", ".join(f"round({sql_median(sql_pick(m))}, 6) AS {n}_median, round(list_max({sql_pick(m)}), 6) AS {n}_max, round(list_stddev_pop({sql_pick(m)}), 6) AS {n}_std" for n, m in MASKS.items()) + " FROM e")
def _(spark, d):
    return rounded(stamps(spark, d).select("vec_id", a.region_stats("v", MASKS).alias("s")).select("vec_id", "s.*"))


EDGES = (0, 1, 2, 3, 4)
WEDGES = [a.wedge(SIDE, 0, 4, k, 4) for k in range(4)]


@register(
    "arr_profile",
    f"""{E}, p AS (SELECT vec_id, [{', '.join(sql_median(sql_pick(a.ring(SIDE, x, x + 1))) for x in EDGES[:-1])}] AS r, [{', '.join(sql_median(sql_pick(m)) for m in WEDGES)}] AS w FROM e)
    SELECT vec_id, {', '.join(f'round(r[{i + 1}], 6) AS r{i}' for i in range(4))}, {', '.join(f'round(w[{i + 1}], 6) AS w{i}' for i in range(4))}, round((r[4] - r[1]) / 3, 6) AS gradient,
        round(list_stddev_pop(w), 6) AS wedge_std, round(least(list_stddev_pop(w) / greatest(abs(list_avg(w)), 1e-10), 10), 5) AS asymmetry FROM p""",
)
def _(spark, d):
    t = stamps(spark, d).select("vec_id", a.profile("v", SIDE, EDGES).alias("p"))
    of = lambda n, k: [F.round(F.get(f"p.{n}", i), 6).alias(f"{k}{i}") for i in range(4)]
    return t.select("vec_id", *of("radial", "r"), *of("wedges", "w"), F.round("p.gradient", 6).alias("gradient"), F.round("p.wedge_std", 6).alias("wedge_std"), F.round("p.asymmetry", 5).alias("asymmetry"))


def color_sql(mask: list[int]) -> str:
    m = lambda v: f"CASE WHEN list_sum({sql_pick(mask, v)}) > 0 THEN 22.5 - 2.5 * log10(list_sum({sql_pick(mask, v)})) END"
    return f"({m('v')}) - ({m('w')})"


RING = a.ring(SIDE, 2, 4)


@register("arr_colors", f"{E}, b AS (SELECT vec_id, v, list_transform(v, lambda x, i: x * 0.5 + 0.05 + 0.001 * (i - 1)) AS w FROM e) SELECT vec_id, round({color_sql(CORE)}, 6) AS core_g_r, round({color_sql(RING)}, 6) AS annulus_g_r, round({color_sql(CORE)} - ({color_sql(RING)}), 6) AS delta_g_r FROM b")
def _(spark, d):
    t = stamps(spark, d).withColumn("w", F.transform("v", lambda x, i: x * 0.5 + 0.05 + F.lit(0.001) * i))
    return rounded(t.select("vec_id", a.band_colors({"g": "v", "r": "w"}, [("g", "r")], CORE, RING).alias("c")).select("vec_id", "c.*"))


@register(
    "arr_norm_stats",
    f"""{E}, m AS (SELECT *, {sql_median('v')} AS m FROM e), s AS (SELECT *, {sql_median('list_transform(v, lambda x: abs(x - m))')} AS s FROM m)
    SELECT vec_id, round(list_aggregate(v, 'quantile_cont', 0.01), 6) AS p1, round(m, 6) AS p50, round(list_aggregate(v, 'quantile_cont', 0.99), 6) AS p99, round(s, 6) AS mad,
        round(len(list_filter(v, lambda x: abs(x - m) > 2 * 1.4826 * s)) / {PIXELS}, 6) AS clip_share, round(abs({sql_median(sql_pick(MASKS['edge']))} - m) / (s * 1.4826), 5) AS edge_score FROM s""",
)
def _(spark, d):
    t = stamps(spark, d).select("vec_id", a.norm_stats("v", SIDE, 2.0).alias("n")).select("vec_id", "n.*")
    return rounded(t.drop("edge_score")).join(t.select("vec_id", F.round("edge_score", 5).alias("edge_score")), "vec_id")


XY = f"[{', '.join(str(i % SIDE - 3.5) for i in range(PIXELS))}]::DOUBLE[] AS xs, [{', '.join(str(i // SIDE - 3.5) for i in range(PIXELS))}]::DOUBLE[] AS ys"
DOT = lambda *x: f"list_sum(list_transform(range(1, {PIXELS + 1}), lambda i: {' * '.join(f'{n}[i]' for n in x)}))"


@register(
    "arr_moments",
    f"""{E}, p AS (SELECT vec_id, list_transform(v, lambda x: greatest(x, 0.0)) AS p, {XY} FROM e), c AS (SELECT *, list_sum(p) AS f, {DOT('p', 'xs')} / list_sum(p) AS x, {DOT('p', 'ys')} / list_sum(p) AS y FROM p),
    m AS (SELECT *, {DOT('p', 'xs', 'xs')} / f - x * x AS xx, {DOT('p', 'ys', 'ys')} / f - y * y AS yy, {DOT('p', 'xs', 'ys')} / f - x * y AS xy FROM c),
    g AS (SELECT vec_id, f, unnest(range({PIXELS})) AS i, p, xs, ys, x, y FROM m), r AS (SELECT vec_id, f, round(sqrt(pow(xs[i + 1] - x, 2) + pow(ys[i + 1] - y, 2)), 9) AS r, p[i + 1] AS v FROM g),
    h AS (SELECT vec_id, min(r) AS half FROM (SELECT *, sum(v) OVER (PARTITION BY vec_id ORDER BY r, v ROWS UNBOUNDED PRECEDING) AS run FROM r) WHERE run >= f / 2 GROUP BY 1)
    SELECT vec_id, round(f, 5) AS flux, round(x, 5) AS x, round(y, 5) AS y, round(sqrt(greatest((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy), 0) / ((xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy))), 5) AS axis_ratio,
        round(degrees(atan2(2 * xy, xx - yy) / 2), 4) AS angle, round(half, 5) AS half_radius, false AS fallback FROM m JOIN h USING (vec_id)""",
)
def _(spark, d):
    t = stamps(spark, d).select("vec_id", a.moments("v", SIDE).alias("m")).select("vec_id", "m.*")
    return t.select("vec_id", *[F.round(c, 5).alias(c) for c in ("flux", "x", "y", "axis_ratio", "half_radius")], F.round("angle", 4).alias("angle"), "fallback")


@register(
    "arr_pair_compare",
    f"""{TWO}, k AS (SELECT vec_id, v, w, list_filter(range(1, {PIXELS + 1}), lambda i: NOT isnan(w[i])) AS pos FROM b), z AS (SELECT *, list_transform(pos, lambda i: v[i]) AS x, list_transform(pos, lambda i: w[i]) AS y FROM k),
    t AS (SELECT vec_id, len(pos) = {PIXELS} AS same_gaps, list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2])) AS d, x, y, list_avg(x) AS mx, list_avg(y) AS my FROM z)
    SELECT vec_id, true AS same_size, same_gaps, round(list_max(d), 6) AS max_diff, round(list_avg(d), 6) AS mean_diff, round(sqrt(list_avg(list_transform(d, lambda v: v * v))), 6) AS rmse,
        round(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - mx) * (p[2] - my))) / sqrt(list_sum(list_transform(x, lambda v: (v - mx) * (v - mx))) * list_sum(list_transform(y, lambda v: (v - my) * (v - my)))), 6) AS correlation,
        same_gaps AND list_max(d) <= 0.6 AS identical FROM t""",
)
def _(spark, d):
    return rounded(two_bands(spark, d).select("vec_id", a.compare("v", "w", 0.6).alias("m")).select("vec_id", "m.*"))


MID = a.ring(SIDE, 1, 3)


@register(
    "arr_annulus_snr",
    f"""{E}, o AS (SELECT *, {sql_pick(OUTER)} AS o FROM e), m AS (SELECT *, {sql_median('o')} AS m FROM o), s AS (SELECT *, {sql_median('list_transform(o, lambda x: abs(x - m))')} AS s FROM m),
    t AS (SELECT *, (list_sum({sql_pick(MID)}) - {len(MID)} * m) / (s * 1.4826 * sqrt({len(MID)}.0)) AS snr FROM s)
    SELECT vec_id, round(snr, 5) AS snr, round(list_avg({sql_pick(CORE)}), 6) AS aperture_mean, round(list_max({sql_pick(CORE)}), 6) AS aperture_max, CASE WHEN snr >= 5 THEN 'A' WHEN snr >= 2 THEN 'B' ELSE 'C' END AS tier FROM t""",
)
def _(spark, d):
    t = stamps(spark, d).select("vec_id", a.annulus_snr("v", SIDE, (1, 3), (3, 9)).alias("m")).select("vec_id", "m.*")
    return t.select("vec_id", F.round("snr", 5).alias("snr"), F.round("aperture_mean", 6).alias("aperture_mean"), F.round("aperture_max", 6).alias("aperture_max"), "tier")


@register(
    "arr_row_masks",
    f"""{E}, k AS (SELECT vec_id, list_transform(list_filter(range(1, {PIXELS + 1}), lambda i: ({RADII})[i] >= vec_id % 3 AND ({RADII})[i] < vec_id % 3 + 2), lambda i: v[i]) AS x FROM e)
    SELECT vec_id, len(x) AS n, round({sql_median('x')}, 6) AS median, round(list_max(x), 6) AS max, round(list_stddev_pop(x), 6) AS std FROM k""",
)
def _(spark, d):
    low = F.col("vec_id") % 3
    return rounded(stamps(spark, d).select("vec_id", a.masked_stats(a.row_ring("v", SIDE, low, low + 2)).alias("s")).select("vec_id", "s.*"))


# data quality

LIMITS = {"l_quantity": (5.0, 45.0), "l_discount": (0.01, 0.09)}
RANGES = "min(x) AS min, max(x) AS max, avg(x) AS mean, stddev(x) AS std, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.99) AS p99, count(x)::DOUBLE AS valid"


@register("dq_range", " UNION ALL ".join(f"SELECT '{c}' AS subject, name, round(value, 4) AS value FROM (FROM (SELECT {RANGES}, (count(*) FILTER (WHERE x < {lo} OR x > {hi}))::DOUBLE AS outside FROM (SELECT {c}::DOUBLE AS x FROM lineitem)) UNPIVOT (value FOR name IN (min, max, mean, std, p1, p50, p99, valid, outside)))" for c, (lo, hi) in LIMITS.items()))
def _(spark, d):
    return rounded(q.ranges(read(spark, d, "lineitem"), LIMITS), 4)


@register("dq_consistency", "SELECT 'chars' AS subject, name, value FROM (FROM (SELECT (count(*) FILTER (WHERE abs(n_chars - length(text)) > 0.001))::DOUBLE AS off, count(abs(n_chars - length(text)))::DOUBLE AS compared, max(abs(n_chars - length(text)))::DOUBLE AS largest FROM documents) UNPIVOT (value FOR name IN (off, compared, largest)))")
def _(spark, d):
    return q.consistency(read(spark, d, "documents"), {"chars": (F.col("n_chars"), F.char_length("text"))})


@register("dq_direction", "SELECT 'net' AS subject, name, round(value, 4) AS value FROM (FROM (SELECT (count(*) FILTER (WHERE g < -0.001))::DOUBLE AS wrong, avg(g) AS mean, min(g) AS min, max(g) AS max, stddev(g) AS std FROM (SELECT l_extendedprice - l_extendedprice * (1 - l_discount) AS g FROM lineitem)) UNPIVOT (value FOR name IN (wrong, mean, min, max, std)))")
def _(spark, d):
    t = read(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(q.direction(t, "l_extendedprice", "net"), 4)


@register(
    "dq_coverage",
    f"""WITH t AS (SELECT o_custkey, c_nationkey, {split_sql('o_orderkey')} AS split FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT o_custkey::VARCHAR AS s, count(*)::DOUBLE AS n FROM t GROUP BY 1), r AS (SELECT c_nationkey, count(*)::DOUBLE AS n FROM t GROUP BY 1)
    SELECT 'split' AS section, split AS subject, count(*)::DOUBLE AS value FROM t GROUP BY ALL
    UNION ALL SELECT 'per tile', unnest(['p10', 'p50', 'p90']), unnest(list_transform(quantile_cont(n, [0.1, 0.5, 0.9]), lambda x: round(x, 6))) FROM c UNION ALL SELECT 'per region', unnest(['p10', 'p50', 'p90']), unnest(list_transform(quantile_cont(n, [0.1, 0.5, 0.9]), lambda x: round(x, 6))) FROM r
    UNION ALL (SELECT 'top', s, n FROM c ORDER BY n DESC, s LIMIT 20)""",
)
def _(spark, d):
    t = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("split", hash_split("o_orderkey"))
    return rounded(q.coverage(t, "split", "o_custkey", "c_nationkey"))


def failed_sql(name: str, severity: str, rule: str, table: str) -> str:
    return f"SELECT '{name}' AS name, '{severity}' AS severity, count(*) FILTER (WHERE NOT coalesce({rule}, false)) AS failed, count(*) FILTER (WHERE NOT coalesce({rule}, false)) = 0 AS passed FROM {table}"


UNIQUE = "SELECT '{k}' AS name, 'error' AS severity, (sum(n) - count(*))::BIGINT AS failed, sum(n) - count(*) = 0 AS passed FROM (SELECT count(*) AS n FROM {t} GROUP BY {g})"
RULES = (("o_orderpriority format", "error", "regexp_matches(o_orderpriority, '^[1-5]-[A-Z]+')"), ("o_orderstatus allowed", "error", "o_orderstatus IN ('F', 'O')"), ("price moderate", "warn", "o_totalprice < 400000"))


@register("dq_integrity", " UNION ALL ".join([UNIQUE.format(k="o_custkey+o_orderdate unique", t="orders", g="o_custkey, o_orderdate"), *[failed_sql(*r, "orders") for r in RULES]]))
def _(spark, d):
    return q.integrity(read(spark, d, "orders"), ["o_custkey", "o_orderdate"], {"o_orderpriority": "^[1-5]-[A-Z]+"}, {"o_orderstatus": ("F", "O")}, [("price moderate", "warn", F.col("o_totalprice") < 400000)])


GATED = f"(SELECT *, {sql_ra('o_orderkey')} AS ra, {sql_dec('o_orderkey')} AS dec, CASE WHEN o_orderkey % 5 > 0 THEN 'v1' END AS version FROM orders)"


@register(
    "dq_gate_list",
    " UNION ALL ".join(
        [
            f"SELECT 'rows' AS name, 'error' AS severity, greatest(100000 - count(*), 0) AS failed, count(*) >= 100000 AS passed FROM {GATED}",
            "SELECT 'schema', 'error', 1, false",
            f"SELECT 'strata', 'warn', count(*) FILTER (WHERE n < 300), count(*) FILTER (WHERE n < 300) = 0 FROM (SELECT count(*) AS n FROM {GATED} GROUP BY o_orderstatus, o_orderpriority)",
            UNIQUE.format(k="o_orderkey unique", t=GATED, g="o_orderkey"),
            failed_sql("o_orderstatus allowed", "error", "o_orderstatus IN ('F', 'O', 'P')", GATED),
            failed_sql("o_orderkey present", "error", "o_orderkey IS NOT NULL", GATED),
            failed_sql("version present", "warn", "version IS NOT NULL", GATED),
            failed_sql("coordinates", "error", "ra BETWEEN 0 AND 360 AND dec BETWEEN -90 AND 90", GATED),
        ]
    ),
)
def _(spark, d):
    t = sky(read(spark, d, "orders"), "o_orderkey").withColumn("version", F.when(F.col("o_orderkey") % 5 > 0, "v1"))
    return q.gate_list(t, 100_000, ["o_orderkey", "absent"], ["o_orderkey"], {"o_orderstatus": ("F", "O", "P")}, ("ra", "dec"), ["o_orderstatus", "o_orderpriority"], 300, ["version"])


TASKS = f"""t AS (SELECT l_orderkey::VARCHAR || '_' || (l_linenumber % 4)::VARCHAR AS task, l_tax = 0 AS is_control, l_quantity AS theta, {sql_ra('l_orderkey')} AS ra, {sql_dec('l_orderkey')} AS dec, {split_sql('l_orderkey')} AS split, l_returnflag AS set_id,
    l_suppkey AS tile, l_suppkey % 7 AS region, l_linenumber AS config, CASE WHEN l_linestatus = 'O' THEN 64 ELSE 128 END AS stamp, CASE WHEN l_discount > 0.05 THEN 'grz' ELSE 'gr' END AS bands FROM lineitem)"""
COUNTS = " UNION ALL ".join(f"SELECT '{x}' AS section, {x}::VARCHAR AS subject, count(*)::DOUBLE AS value FROM t GROUP BY ALL" for x in ("split", "set_id", "stamp", "bands"))


@register(
    "dq_manifest",
    f"""WITH {TASKS}, c AS (SELECT count(*) AS n FROM t GROUP BY config)
    SELECT 'all' AS section, unnest(['rows', 'missing columns', 'off sky', 'tiles', 'regions', 'repeated tasks', 'control share']) AS subject,
        unnest([count(*), 1, count(*) FILTER (WHERE NOT (ra BETWEEN 0 AND 360 AND dec BETWEEN -90 AND 90)), count(DISTINCT tile), count(DISTINCT region), count(*) - count(DISTINCT task), round(avg(is_control::INT), 9)]::DOUBLE[]) AS value FROM t
    UNION ALL SELECT 'nulls', 'theta', count(*) FILTER (WHERE theta IS NULL)::DOUBLE FROM t
    UNION ALL SELECT 'theta', unnest(['min', 'max', 'mean', 'std']), unnest([min(theta), max(theta), round(avg(theta), 9), round(stddev(theta), 9)]) FROM t WHERE NOT is_control
    UNION ALL SELECT 'configs', unnest(['configs', 'fewest', 'most']), unnest([count(*), min(n), max(n)]::DOUBLE[]) FROM c UNION ALL {COUNTS}""",
)
def _(spark, d):
    k = F.col("l_orderkey")
    t = sky(read(spark, d, "lineitem"), "l_orderkey").select(
        F.concat_ws("_", k.cast("string"), (F.col("l_linenumber") % 4).cast("string")).alias("task"), (F.col("l_tax") == 0).alias("is_control"), F.col("l_quantity").alias("theta"), "ra", "dec", hash_split("l_orderkey").alias("split"), F.col("l_returnflag").alias("set_id"),
        F.col("l_suppkey").alias("tile"), (F.col("l_suppkey") % 7).alias("region"), F.col("l_linenumber").alias("config"), F.when(F.col("l_linestatus") == "O", 64).otherwise(128).alias("stamp"), F.when(F.col("l_discount") > 0.05, "grz").otherwise("gr").alias("bands"),
    )
    return rounded(q.manifest_report(t, "task", "is_control", "theta", ("ra", "dec"), "split", "set_id", "tile", "region", "config", "stamp", "bands", ["theta", "absent"]), 9)


MATCHED = f"""WITH {SKIES}, m AS (SELECT c_custkey, min(sep) AS sep FROM (SELECT c_custkey, {SEP} AS sep FROM a, b WHERE {SEP} <= 2) GROUP BY 1), t AS (SELECT c_mktsegment, sep FROM customer LEFT JOIN m USING (c_custkey))"""


@register(
    "dq_match_report",
    MATCHED + """ SELECT c_mktsegment, count(*) AS n, count(sep) AS matched, round(avg(sep), 6) AS mean_sep, round(quantile_cont(sep, 0.5), 6) AS median_sep, round(max(sep), 6) AS max_sep, count(*) FILTER (WHERE sep <= 0.5) AS within_half, count(*) FILTER (WHERE sep <= 1.5) AS within_most,
    round(count(sep) / count(*), 6) AS rate, count(sep) / count(*) >= 0.85 AS passed FROM t GROUP BY GROUPING SETS ((c_mktsegment), ())""",
)
def _(spark, d):
    m = j.nearest(*skies(spark, d), 2.0, "c_custkey", "s_suppkey")
    return rounded(q.match_report(read(spark, d, "customer"), m, "c_custkey", "sep", ["c_mktsegment"], {"half": 0.5, "most": 1.5}, 0.85))


@register(
    "dq_split_stats",
    f"""WITH t AS (SELECT {split_sql('o_orderkey')} AS s, o_totalprice, o_custkey::DOUBLE AS o_custkey FROM orders), m AS (FROM (SELECT s, avg(o_totalprice) AS o_totalprice, avg(o_custkey) AS o_custkey FROM t GROUP BY 1) UNPIVOT (m FOR feature IN (o_totalprice, o_custkey)))
    SELECT feature, a.s AS split_a, b.s AS split_b, round(a.m, 4) AS mean_a, round(b.m, 4) AS mean_b, abs(a.m - b.m) > CASE feature WHEN 'o_totalprice' THEN 2000 ELSE 10 END AS large FROM m a JOIN m b USING (feature) WHERE a.s < b.s""",
)
def _(spark, d):
    return rounded(q.split_means(read(spark, d, "orders").withColumn("s", hash_split("o_orderkey")), "s", {"o_totalprice": 2000, "o_custkey": 10}), 4)


@register("dq_stamp_sample", f"{TWO} SELECT vec_id % 5 AS kind, count(*) AS n, 0 AS missing, 0 AS off_size, count(*) FILTER (WHERE len(list_filter(w, lambda x: isnan(x))) > 0) AS non_finite, 0 AS flat FROM b GROUP BY 1")
def _(spark, d):
    return q.stamp_report(two_bands(spark, d).withColumn("kind", F.col("vec_id") % 5), "w", PIXELS, "kind")


@register("dq_category_audit", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'F') AS off FROM orders GROUP BY ALL")
def _(spark, d):
    return q.category_audit(read(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F"], "o_orderkey")[0]


@register("dq_category_rows", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 20")
def _(spark, d):
    return q.category_audit(read(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F"], "o_orderkey")[1].select("o_orderkey", "o_orderstatus")


@register(
    "dq_leak_columns",
    f"""WITH {S}, f AS (SELECT 'toxic' AS feature, toxic::DOUBLE AS score, quality FROM s UNION ALL SELECT 'n_chars', n_chars::DOUBLE, quality FROM s), t AS (SELECT *, {RANK.format(w='PARTITION BY feature', p='feature, ')} FROM f),
    u AS (SELECT feature, {AUC} AS auc FROM t GROUP BY 1) SELECT feature, feature = 'toxic' AS forbidden, round(greatest(auc, 1 - auc), 9) AS auc, feature = 'toxic' OR coalesce(greatest(auc, 1 - auc) >= 0.9, false) AS leaking
    FROM (SELECT unnest(['n_chars', 'toxic', 'lang']) AS feature) LEFT JOIN u USING (feature)""",
)
def _(spark, d):
    return rounded(q.leak_report(scored(spark, d), ["n_chars", "toxic", "lang"], ["quality", "toxic"], good(), ["n_chars", "toxic"]), 9)


@register("dq_file_layout")  # file sizes are no SQL matter
def _(spark, d):
    return q.file_layout(spark, d)


@register("dq_job_counters", "SELECT count(*) AS processed, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events")
def _(spark, d):
    got = q.write_counted(read(spark, d, "events"), scratch_dir(spark), {"processed": F.count(F.lit(1)), "failed": F.count_if(F.col("event_type") == "error")})
    return spark.createDataFrame([(got["processed"], got["failed"])], "processed bigint, failed bigint")
