"""Queries for object classes, pools, manifests and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import classes as cl
from starloom.functions import columns as c
from starloom.operators import regions as rg
from starloom.operators import sampling as sm
from starloom.operators import windows as w
from starloom.plans.aggregates import rounded
from starloom.plans.columns import healpix_expression
from starloom.plans.registry import register
from starloom.plans.views import read, scratch_dir, sky, sql_dec, sql_ra, sql_uniform
from starloom.sources import catalogs as s

# object classes: parts and orders as objects with a type, fluxes and shapes

OBJECTS = f"""o AS (
    SELECT o_orderkey, o_custkey, o_totalprice / 40000.0::DOUBLE AS flux, CASE o_orderkey % 5 WHEN 0 THEN ' dev ' WHEN 1 THEN 'SER' WHEN 2 THEN 'exp' WHEN 3 THEN 'REX' ELSE 'PSF' END AS kind,
        (o_custkey % 40) / 10.0::DOUBLE AS radius, (o_orderkey % 17) / 10.0::DOUBLE AS gr, 18 + (o_custkey % 60) / 10.0::DOUBLE AS mag,
        CASE WHEN o_custkey % 3 > 0 THEN (o_orderkey % 10) / 10.0::DOUBLE END AS ell, CASE WHEN o_orderkey % 7 > 0 THEN (o_custkey % 60) / 10.0::DOUBLE END AS sersic,
        o_orderkey % 16384 AS mask, {sql_ra('o_orderkey')} AS ra, {sql_dec('o_orderkey')} AS dec
    FROM orders)"""


def objects(spark, d):
    k, q = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*map(F.lit, (" dev ", "SER", "exp", "REX", "PSF")))
    t = read(spark, d, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") / 40000).alias("flux"), F.get(names, (k % 5).cast("int")).alias("kind"), ((q % 40) / 10).alias("radius"), ((k % 17) / 10).alias("gr"),
        (18 + (q % 60) / 10).alias("mag"), F.when(q % 3 > 0, (k % 10) / 10).alias("ell"), F.when(k % 7 > 0, (q % 60) / 10).alias("sersic"), (k % 16384).alias("mask"),
    )
    return sky(t, "o_orderkey")


NAME = "upper(trim(kind))"
CONFUSER = f"""CASE
    WHEN {NAME} IN ('DEV', 'SER') AND flux >= 5 AND ({NAME} = 'DEV' OR sersic >= 4) THEN 'ring_proxy'
    WHEN {NAME} IN ('EXP', 'SER', 'DEV') AND ((ell >= 0.5 AND radius >= 0.6::DOUBLE) OR (ell IS NULL AND radius >= 1.8::DOUBLE)) THEN 'edge_on_proxy'
    WHEN gr <= 0.3::DOUBLE AND mag <= 20.5 THEN 'blue_clumpy' WHEN radius >= 2 AND flux >= 3 THEN 'large_galaxy' END"""


def confuser():
    return cl.confuser_class("kind", "flux", "radius", "gr", "mag", "ell", "sersic", {"blue_clumpy_proxy": {"g_minus_r_max": 0.3}})


@register("col_priority_class", f"WITH {OBJECTS} SELECT o_orderkey, {CONFUSER} AS confuser FROM o")
def _(spark, d):
    return objects(spark, d).select("o_orderkey", confuser().alias("confuser"))


@register(
    "col_rule_reason",
    f"""WITH {OBJECTS} SELECT o_orderkey, CASE WHEN sersic IS NULL THEN 'index missing' WHEN NOT sersic <= 5 THEN 'index=' || sersic::VARCHAR WHEN ell IS NULL THEN 'shape missing'
        WHEN NOT ell < 0.9::DOUBLE THEN 'shape=' || ell::VARCHAR WHEN NOT flux > 2 THEN 'bright' ELSE 'ok' END AS why,
        CASE WHEN sersic IS NULL THEN NULL WHEN NOT sersic <= 5 THEN 'B' WHEN ell IS NULL THEN 'B' WHEN NOT ell < 0.9::DOUBLE THEN 'B' WHEN NOT flux > 2 THEN 'B' ELSE 'A' END AS tier,
        coalesce(sersic <= 5 AND ell < 0.9::DOUBLE AND flux > 2, false) AS passed FROM o""",
)
def _(spark, d):
    checks = [cl.Check("index", F.col("sersic"), F.col("sersic") <= 5), cl.Check("shape", F.col("ell"), F.col("ell") < 0.9, "second"), cl.Check("bright", F.col("flux"), F.col("flux") > 2, "pass")]
    t = objects(spark, d).select("o_orderkey", cl.graded(checks).alias("g")).select("o_orderkey", "g.*")
    why = F.when(F.col("reason").startswith("bright"), "bright").otherwise(F.col("reason"))  # long fractions are written in other ways by SQL
    return t.select("o_orderkey", why.alias("why"), "tier", "passed")


@register("col_content_id", "SELECT l_orderkey, l_linenumber, sha256(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR || '|NULL') AS id, md5(l_orderkey::VARCHAR || '||' || l_linenumber::VARCHAR || '||NULL||42') AS short_id FROM lineitem")
def _(spark, d):
    fields = ["l_orderkey", "l_linenumber", F.lit(None).cast("string")]
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.content_id(fields).alias("id"), c.content_md5(fields, 42).alias("short_id"))


@register("col_compose_id", "SELECT p_brand || '_' || p_partkey::VARCHAR AS id FROM part")
def _(spark, d):
    return read(spark, d, "part").select(c.compose_id("p_brand", "p_partkey").alias("id"))


@register("col_provenance", "SELECT n_nationkey, '1.0' AS version, 'abc' AS commit, 'nation.parquet' AS file FROM nation")
def _(spark, d):
    return c.with_provenance(read(spark, d, "nation").select("n_nationkey", "_metadata"), {"version": "1.0", "commit": "abc"}, "file").drop("_metadata")


@register("src_metadata_only", "SELECT doc_id, lang, source, 'documents.parquet' AS file FROM documents")
def _(spark, d):
    return s.metadata_only(read(spark, d, "documents"), ["doc_id", "lang", "source"], f"{d}/documents.parquet").select("doc_id", "lang", "source", "file")


@register("run_skip_if_done", "SELECT *, 1 AS runs FROM region")
def _(spark, d):
    path, ran = scratch_dir(spark), []
    for _ in range(2):
        if s.run_once(spark, path, lambda: read(spark, d, "region")):
            ran.append(1)
    return spark.read.parquet(path).withColumn("runs", F.lit(len(ran)))


@register("snk_sized", "SELECT greatest(1, least(200, ceil(count(*) / 10000.0)))::BIGINT AS files, count(*) AS n FROM lineitem")
def _(spark, d):
    path = scratch_dir(spark)
    s.write_sized(read(spark, d, "lineitem").select("l_orderkey"), path, "l_orderkey", 10_000)
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).agg(F.count_distinct("f").alias("files"), F.count(F.lit(1)).alias("n"))


# pools

KNOWN = f"k AS (SELECT s_suppkey, {sql_ra('s_suppkey')} AS ra2, {sql_dec('s_suppkey')} AS dec2 FROM supplier)"
NEAR = "degrees(2 * asin(least(sqrt(pow(sin(radians(dec2 - dec) / 2), 2) + cos(radians(dec)) * cos(radians(dec2)) * pow(sin(radians(ra2 - ra) / 2), 2)), 1))) <= 1.5"


def known(spark, d):
    return sky(read(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select(F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))


def filters():
    return sm.pool_filters("kind", ("DEV", "SER", "EXP", "REX"), {"flux": (1.0, None), "mag": (None, 23.0)}, "mask", (1, 2))


POOL = f"""n AS (SELECT o.*, EXISTS (SELECT 1 FROM k WHERE {NEAR}) AS near FROM o),
    p AS (SELECT *, {CONFUSER} AS confuser FROM n WHERE {NAME} IN ('DEV', 'SER', 'EXP', 'REX') AND flux >= 1 AND mag <= 23 AND mask & 6 = 0 AND NOT near)"""


@register(
    "smp_negative_pool",
    f"""WITH {OBJECTS}, {KNOWN}, {POOL}, h AS (SELECT o_orderkey, confuser, {healpix_expression(64)} AS cell FROM p)
    SELECT o_orderkey, confuser, CASE WHEN confuser IS NULL THEN 'N1' ELSE 'N2' END AS pool, cell,
        CASE WHEN {sql_uniform('cell', 42)} < 0.7::DOUBLE THEN 'train' WHEN {sql_uniform('cell', 42)} < 0.85::DOUBLE THEN 'val' ELSE 'test' END AS split FROM h""",
)
def _(spark, d):
    return sm.negative_pool(objects(spark, d), known(spark, d), 1.5, filters(), "o_orderkey", confuser()).select("o_orderkey", "confuser", "pool", "cell", "split")


@register(
    "smp_negative_waterfall",
    f"""WITH {OBJECTS}, {KNOWN}, n AS (SELECT o.*, EXISTS (SELECT 1 FROM k WHERE {NEAR}) AS near FROM o),
    c AS (SELECT count(*) AS c0, count(*) FILTER (WHERE a) AS c1, count(*) FILTER (WHERE a AND b) AS c2, count(*) FILTER (WHERE a AND b AND x) AS c3, count(*) FILTER (WHERE a AND b AND x AND y) AS c4, count(*) FILTER (WHERE a AND b AND x AND y AND z) AS c5
        FROM (SELECT {NAME} IN ('DEV', 'SER', 'EXP', 'REX') AS a, flux >= 1 AS b, mag <= 23 AS x, mask & 6 = 0 AS y, NOT near AS z FROM n))
    SELECT unnest([1, 2, 3, 4, 5]) AS step, unnest(['type', 'flux', 'mag', 'mask', 'distance']) AS name, unnest([c1, c2, c3, c4, c5]) AS kept, unnest([c0 - c1, c1 - c2, c2 - c3, c3 - c4, c4 - c5]) AS lost FROM c""",
)
def _(spark, d):
    from starloom.operators.joins import near_flag

    return sm.waterfall(near_flag(objects(spark, d), known(spark, d), 1.5, "o_orderkey"), filters())


CATALOG = f"SELECT c_custkey AS k, c_acctbal AS score, {sql_ra('c_custkey')} AS ra, {sql_dec('c_custkey')} AS dec FROM customer"
HARD = f"""WITH a AS ({CATALOG}), b AS (
        (SELECT k, ra, dec, 'scored' AS source, 3.0::DOUBLE AS weight FROM a ORDER BY score DESC, k LIMIT 100)
        UNION ALL (SELECT k, ra, dec, 'broke', 2.0 FROM a WHERE score < 0 ORDER BY {sql_uniform('k', 11)}, k LIMIT 60)
        UNION ALL (SELECT k, ra, dec, 'rich', 1.5 FROM a WHERE score > 7000 ORDER BY {sql_uniform('k', 11)}, k LIMIT 60)),
    u AS (SELECT *, row_number() OVER (PARTITION BY floor(ra / 5), floor(dec / 5) ORDER BY weight DESC, k, source) AS i FROM b WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)),
    h AS (SELECT k, ra, dec, source, weight FROM u WHERE i = 1)"""


def hard(spark, d):
    t = sky(read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("score")), "k")
    done = read(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).distinct()
    return sm.hard_negatives(t, "k", "score", 100, {"broke": (t.where("score < 0"), 2.0), "rich": (t.where("score > 7000"), 1.5)}, done, 5.0, cap=60)


@register("smp_hard_negatives", HARD + " SELECT * FROM h")
def _(spark, d):
    return hard(spark, d)


@register("smp_hard_summary", HARD + " SELECT source, count(*) AS n, sum(weight) AS weight, avg(weight) AS mean_weight, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM h GROUP BY 1")
def _(spark, d):
    return rounded(sm.summary_by(hard(spark, d), ["source"], "weight"), 9)


@register(
    "smp_mine_top_bins",
    f"""WITH {OBJECTS}, {KNOWN}, a AS (SELECT o_orderkey, flux, row_number() OVER (PARTITION BY kind ORDER BY flux DESC, o_orderkey) AS i FROM o WHERE NOT EXISTS (SELECT 1 FROM k WHERE {NEAR}))
    SELECT o_orderkey, flux FROM a WHERE i <= 20 ORDER BY flux DESC, o_orderkey LIMIT 60""",
)
def _(spark, d):
    return sm.mine_top(objects(spark, d), "kind", "flux", "o_orderkey", 20, 60, known(spark, d), 1.5).select("o_orderkey", "flux")


# manifests


def grid_sql(name: str) -> str:
    """(config_id and the axes) of a grid as SQL; rows are numbered in axis order."""
    axes = [f"(SELECT unnest([{', '.join(f'{v!r}::DOUBLE' for v in values)}]) AS {a}, generate_subscripts([{', '.join('0' for _ in values)}], 1) AS i{k}) t{k}" for k, (a, values) in enumerate(zip(sm.AXES, sm.GRIDS[name], strict=True))]
    label = " || ".join(f"'_{p}' || printf('%g', {a})" for p, a in zip(("te", "dm", "rf", "e", "sh"), sm.AXES, strict=True))
    return f"SELECT '{name}_' || lpad(row_number() OVER (ORDER BY i0, i1, i2, i3, i4)::VARCHAR, 4, '0') || {label} AS config_id, {', '.join(sm.AXES)} FROM {', '.join(axes)}"


@register("man_grid", f"SELECT s_suppkey, g.* FROM supplier, ({grid_sql('grid_small')}) g")
def _(spark, d):
    from starloom.operators.joins import grid_cross

    return grid_cross(read(spark, d, "supplier").select("s_suppkey"), sm.grid(spark, "grid_small")).drop("replicate")


@register("man_grid_sizes", " UNION ALL ".join(f"SELECT '{g}' AS name, n_regionkey, count(*) AS n, count(DISTINCT config_id) AS ids, round(sum(theta), 6) AS theta FROM ({grid_sql(g)}), nation GROUP BY ALL" for g in sm.GRIDS))
def _(spark, d):
    from starloom.operators.sets import union_named

    t = read(spark, d, "nation").select("n_regionkey")
    parts = [t.crossJoin(F.broadcast(sm.grid(spark, g))).groupBy("n_regionkey").agg(F.lit(g).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct("config_id").alias("ids"), F.round(F.sum("theta"), 6).alias("theta")) for g in sm.GRIDS]  # grids are parameter tables
    return union_named(*parts)


PICKED = f"""q AS (SELECT p_partkey, p_brand, p_size % 4 AS bin, {sql_uniform('p_partkey', 7)} AS u FROM part), q1 AS (SELECT *, row_number() OVER (PARTITION BY p_brand, bin ORDER BY u, p_partkey) AS i FROM q),
    q2 AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY u, p_partkey) AS j FROM q1 WHERE i <= 3), t AS (SELECT p_partkey, {sql_uniform('p_partkey', 31)} < 0.25::DOUBLE AS is_control FROM q2 WHERE j <= 8)"""
ZEROED = ", ".join(f"CASE WHEN is_control THEN 0.0 ELSE {a} END AS {a}" for a in sm.AXES)


@register("man_debug_grid", f"WITH {PICKED}, g AS ({grid_sql('grid_small')}) SELECT p_partkey, is_control, config_id, r::INT AS replicate, {ZEROED}, sha256(p_partkey::VARCHAR || '|' || config_id || '|' || r::VARCHAR) AS task_id FROM t, g, range(2) z(r)")
def _(spark, d):
    t = read(spark, d, "part").withColumn("bin", F.col("p_size") % 4)
    t = w.two_pass_quota(t, ["bin"], ["p_brand"], 3, 8, "p_partkey", 7).select("p_partkey")
    return sm.manifest(t, sm.grid(spark, "grid_small"), "p_partkey", 0.25, 2)


@register("man_train_unpaired", f"WITH g AS (SELECT *, row_number() OVER (ORDER BY config_id) - 1 AS i FROM ({grid_sql('grid_small')})), t AS (SELECT o_orderkey, {sql_uniform('o_orderkey', 31)} < 0.5::DOUBLE AS is_control, CAST(floor({sql_uniform('o_orderkey', 32)} * 48) AS BIGINT) AS i FROM orders) SELECT o_orderkey, is_control, config_id, {ZEROED} FROM t JOIN g USING (i)")
def _(spark, d):
    return sm.unpaired_manifest(read(spark, d, "orders").select("o_orderkey"), sm.grid(spark, "grid_small"), "o_orderkey", 0.5)


@register("man_paired_rows", "SELECT a.doc_id, a.toxic, b.n_chars AS control_chars, b.lang AS control_lang FROM labels a JOIN documents b USING (doc_id) WHERE a.quality = 1")
def _(spark, d):
    return sm.paired_rows(read(spark, d, "labels").where("quality = 1").select("doc_id", "toxic"), read(spark, d, "documents"), ["doc_id"], {"n_chars": "control_chars", "lang": "control_lang"})


SOTA = f"""e AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS place FROM customer UNION ALL SELECT -s_suppkey - 1, NULL, s_nationkey FROM supplier),
    r AS (SELECT e.*, g.*, k::VARCHAR || '|' || config_id AS row FROM e, ({grid_sql('grid_small')}) g), t AS (SELECT *, {sql_uniform('row', 31)} < 0.5::DOUBLE AS is_control FROM r),
    a AS (SELECT row, seg, row_number() OVER (PARTITION BY seg ORDER BY {sql_uniform('row', 32)}, row) AS i FROM t WHERE is_control AND {sql_uniform('row', 33)} < 0.3::DOUBLE),
    b AS (SELECT c_mktsegment AS seg, c_custkey AS other, c_nationkey AS there, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql_uniform('c_custkey', 32)}, c_custkey) AS i FROM customer),
    m AS (SELECT row, other, there FROM a JOIN b USING (seg, i)), j AS (SELECT t.*, m.there, m.row IS NOT NULL AS moved FROM t LEFT JOIN m USING (row))"""


@register("man_sota", f"WITH {SOTA}, f AS (SELECT k, seg, coalesce(there, place) AS place, is_control, CASE WHEN is_control THEN CASE WHEN moved THEN 'unpaired' ELSE 'paired' END END AS control_kind, config_id, {ZEROED} FROM j) SELECT *, md5(k::VARCHAR || '||' || place::VARCHAR || '||' || config_id || '||' || is_control::VARCHAR || '||31') AS injection_id FROM f")
def _(spark, d):
    t = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("place"))
    extra = read(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("k"), F.col("s_nationkey").alias("place"))
    return sm.sota_manifest(t, sm.grid(spark, "grid_small"), "k", ["seg"], ["place"], 0.5, 0.3, extra)


TRAINING = """l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'B' ELSE 'A' END AS tier, quality FROM labels),
    t AS (SELECT doc_id, tier, quality AS label, CASE WHEN quality = 1 THEN CASE tier WHEN 'A' THEN 0.95 WHEN 'B' THEN 0.5 END ELSE CASE tier WHEN 'B' THEN 3.0 ELSE 1.0 END END::DOUBLE AS sample_weight, lang, n_chars
        FROM l JOIN documents USING (doc_id) WHERE n_chars > 100)"""


def training(spark, d):
    lab = read(spark, d, "labels").withColumn("tier", F.when(F.col("toxic") == 1, "B").otherwise("A"))
    side = lambda y: lab.where(F.col("quality") == y)
    paths = read(spark, d, "documents").where("n_chars > 100").select("doc_id", "lang", "n_chars")
    return sm.training_manifest([(side(1), 1, {"A": 0.95, "B": 0.5}), (side(0), 0, {"B": 3.0})], paths, "doc_id", "tier")


@register("man_training", f"WITH {TRAINING} SELECT * FROM t")
def _(spark, d):
    return training(spark, d)


@register("man_training_ratio", f"WITH {TRAINING} SELECT lang, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, round(count(*) FILTER (WHERE label = 0) / nullif(count(*) FILTER (WHERE label = 1), 0), 9) AS ratio FROM t GROUP BY 1")
def _(spark, d):
    return rounded(sm.label_ratio(training(spark, d), ["lang"]), 9)


# regions: customers with orders as tiles of the sky

TILES = f"t AS (SELECT o_custkey AS tile, n, {sql_ra('o_custkey * 11')} AS ra, {sql_dec('o_custkey * 11')} AS dec FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))"
CLOSE = "least(abs(a.ra - b.ra), 360 - abs(a.ra - b.ra)) <= 2 AND abs(a.dec - b.dec) <= 2 AND a.tile <> b.tile"


def tiles(spark, d):
    t = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("tile")).agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.col("tile") * 11)
    return sky(t, "_k").select("tile", "n", "ra", "dec")


def reach_sql(source: str) -> str:
    """CTEs e and m(tile, root): the smallest tile that each one of source reaches."""
    return f"""e AS (SELECT a.tile AS a, b.tile AS b FROM {source} a JOIN {source} b ON {CLOSE}),
    r AS (SELECT tile, tile AS seen FROM {source} UNION SELECT r.tile, e.b FROM r JOIN e ON r.seen = e.a),
    m AS (SELECT tile, min(seen) AS root FROM r GROUP BY 1)"""


@register("reg_adjacency", f"WITH {TILES} SELECT a.tile AS a, b.tile AS b FROM t a JOIN t b ON {CLOSE}")
def _(spark, d):
    return rg.adjacency_within(tiles(spark, d), "tile", "ra", "dec", 2.0)


@register("reg_degree", f"WITH {TILES} SELECT tile, (SELECT count(*) FROM t b WHERE {CLOSE}) AS degree FROM t a")
def _(spark, d):
    t = tiles(spark, d).select("tile", "ra", "dec")
    return rg.degrees(t, rg.adjacency_within(t, "tile", "ra", "dec", 2.0), "tile").select("tile", "degree")


@register("reg_components", f"WITH RECURSIVE {TILES}, {reach_sql('t')} SELECT tile, root, dense_rank() OVER (ORDER BY root) AS region_id FROM m")
def _(spark, d):
    return rg.regions(tiles(spark, d), "tile", "ra", "dec", 2.0)


@register("reg_high_density", f"WITH RECURSIVE {TILES}, h AS (SELECT * FROM t WHERE n >= (SELECT quantile_cont(n, 0.6) FROM t WHERE n > 0)), {reach_sql('h')} SELECT tile, n, root, dense_rank() OVER (ORDER BY root) AS region_id FROM m JOIN h USING (tile)")
def _(spark, d):
    return rg.high_density_regions(tiles(spark, d), "tile", "n", "ra", "dec", 2.0, 0.6)


SETS = """c AS (SELECT c_custkey, c_mktsegment, c_acctbal, c_custkey::DOUBLE AS num, CASE WHEN c_acctbal < 2000 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END AS bin FROM customer),
    s AS (SELECT 'balance' AS mode, *, c_acctbal AS score, 5 AS top, 4 AS strat FROM c UNION ALL SELECT 'number', *, num, 3, 0 FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY mode, c_mktsegment ORDER BY score DESC, c_custkey) AS i, row_number() OVER (PARTITION BY mode, c_mktsegment, bin ORDER BY score DESC, c_custkey) AS j FROM s)"""


@register(
    "reg_select_sets",
    f"""WITH {SETS} SELECT 'topk_' || mode || '_k' || top AS selection_set_id, 'topk' AS selection_strategy, mode AS ranking_mode, c_custkey, c_mktsegment, i AS rank, score FROM k WHERE i <= top
    UNION ALL SELECT 'strat_custom_' || mode || '_k' || strat, 'strat_custom', mode, c_custkey, c_mktsegment, j, score FROM k WHERE strat > 0 AND j <= CASE bin WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END
    UNION ALL SELECT 'strat_balanced_' || mode || '_k' || strat, 'strat_balanced', mode, c_custkey, c_mktsegment, j, score FROM k WHERE strat > 0 AND j <= 2""",
)
def _(spark, d):
    bin_ = F.when(F.col("c_acctbal") < 2000, 0).when(F.col("c_acctbal") < 5000, 1).otherwise(2)
    t = read(spark, d, "customer").withColumn("bin", bin_).withColumn("num", F.col("c_custkey").cast("double"))
    return rg.select_sets(t, "balance:5:4, number:3:0", {"balance": "c_acctbal", "number": "num"}, "c_mktsegment", "c_custkey", "bin", (0.5, 0.3, 0.2))


CHOSEN = "n AS (SELECT c_nationkey AS region, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY 1), x AS ((SELECT 'count' AS set_id, region FROM n ORDER BY n DESC, region LIMIT 5) UNION ALL (SELECT 'balance', region FROM n ORDER BY s DESC, region LIMIT 5))"
FLAGS = "l_extendedprice > 50000 AS is_v1, l_extendedprice > 30000 AS is_v2, l_discount > 0.02 AS is_v3, l_tax > 0.01 AS is_v4, l_quantity > 5 AS is_v5"


def parent(spark, d, per_set):
    n = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    top = lambda name, by: n.orderBy(F.desc(by), "region").limit(5).select(F.lit(name).alias("set_id"), "region")
    flags = {"is_v1": F.col("l_extendedprice") > 50000, "is_v2": F.col("l_extendedprice") > 30000, "is_v3": F.col("l_discount") > 0.02, "is_v4": F.col("l_tax") > 0.01, "is_v5": F.col("l_quantity") > 5}
    place = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("region"))
    t = rg.parent_catalog(read(spark, d, "lineitem"), place, top("count", "n").unionAll(top("balance", "s")), "l_suppkey", "region", flags, per_set, 10**9)
    return t.select(*(["set_id"] if per_set else []), "l_orderkey", "l_linenumber", "region", *flags)


@register("reg_parent", f"WITH {CHOSEN} SELECT l_orderkey, l_linenumber, s_nationkey AS region, {FLAGS} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IN (SELECT region FROM x)")
def _(spark, d):
    return parent(spark, d, False)


@register("reg_parent_sets", f"WITH {CHOSEN} SELECT set_id, l_orderkey, l_linenumber, region, {FLAGS} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN x ON s_nationkey = region")
def _(spark, d):
    return parent(spark, d, True)
