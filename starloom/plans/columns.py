"""Queries for column expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from starloom.functions import columns as c
from starloom.plans.registry import register
from starloom.plans.views import dec, ra, read, sky, sql_dec, sql_ra, sql_uniform

#: Named photometric cuts (faintest z, least r-z, least z-W1).
CUTS = {"v1": (20.0, 0.5, 1.6), "v2": (20.4, 0.4, 1.6), "v3": (20.4, 0.4, 0.8), "v4": (20.8, 0.4, 0.8), "v5": (21.0, 0.3, 0.8)}
#: Mask bits that exclude an object.
BAD_BITS = (1, 5, 6, 7, 11, 12, 13)
QUANTITY_BINS = ((1, 2, "1-2"), (3, 5, "3-5"), (6, 10, "6-10"), (11, None, "11+"))


@register("col_flux_to_mag", "SELECT o_orderkey, round(22.5 - 2.5 * log10(o_totalprice), 6) AS mag FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(c.flux_to_mag("o_totalprice"), 6).alias("mag"))


@register("col_mag_to_flux", "SELECT o_orderkey, round(pow(10, -0.4 * ((22.5 - 2.5 * log10(o_totalprice)) - 22.5)), 4) AS flux FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(c.mag_to_flux(c.flux_to_mag("o_totalprice")), 4).alias("flux"))


@register("col_dereddened", "SELECT l_orderkey, l_linenumber, round(22.5 - 2.5 * log10(l_extendedprice / (1 - l_discount)), 6) AS mag, round((22.5 - 2.5 * log10(l_extendedprice / (1 - l_discount))) - (22.5 - 2.5 * log10(l_extendedprice)), 6) AS correction FROM lineitem")
def _(spark, d):
    flux = c.deredden("l_extendedprice", 1 - F.col("l_discount"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(c.flux_to_mag(flux), 6).alias("mag"), F.round(c.flux_to_mag(flux) - c.flux_to_mag("l_extendedprice"), 6).alias("correction"))


@register("col_color", "SELECT l_orderkey, l_linenumber, round(l_tax - l_discount, 6) AS tax_color, round(l_discount - nullif(l_tax, 0), 6) AS null_color FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(c.color("l_tax", "l_discount"), 6).alias("tax_color"), F.round(c.color("l_discount", F.nullif(F.col("l_tax"), F.lit(0.0))), 6).alias("null_color"))


@register("col_depth_to_mag5", "SELECT l_orderkey, l_linenumber, round(22.5 - 2.5 * log10(5 / sqrt(l_quantity)), 6) AS depth FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(c.depth_to_mag5("l_quantity"), 6).alias("depth"))


def part_cuts(df):
    z, rz, zw = F.lit(18.0) + F.col("p_size") / F.lit(12.5), F.col("p_partkey") % 10 / F.lit(10.0), F.col("p_partkey") % 23 / F.lit(10.0)
    return df.select("*", *c.variant_flags(z, rz, zw, CUTS))


SQL_CUTS = ", ".join(f"(18.0::DOUBLE + p_size / 12.5::DOUBLE < {a}::DOUBLE AND (p_partkey % 10) / 10.0::DOUBLE > {b}::DOUBLE AND (p_partkey % 23) / 10.0::DOUBLE > {w}::DOUBLE) AS {k}" for k, (a, b, w) in CUTS.items())


@register("col_variant_flags", f"SELECT p_partkey, {SQL_CUTS} FROM part")
def _(spark, d):
    return part_cuts(read(spark, d, "part")).select("p_partkey", *CUTS)


@register("col_range_cut", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal <= 8000 AND s_acctbal >= 500 AND s_nationkey <= 20")
def _(spark, d):
    return read(spark, d, "supplier").where(c.within({"s_acctbal": (500.0, 8000.0), "s_nationkey": (None, 20)})).select("s_suppkey", "s_acctbal")


@register("col_footprint_box", f"SELECT o_orderkey, {sql_ra('o_orderkey')} AS ra, {sql_dec('o_orderkey')} AS dec FROM orders WHERE {sql_ra('o_orderkey')} BETWEEN 100 AND 200 AND {sql_dec('o_orderkey')} >= 0")
def _(spark, d):
    return sky(read(spark, d, "orders"), "o_orderkey").where(c.within({"ra": (100.0, 200.0), "dec": (0.0, None)})).select("o_orderkey", "ra", "dec")


@register("col_bitmask_exclude", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey % 16384) & {c.bits(BAD_BITS)} = 0")
def _(spark, d):
    return read(spark, d, "lineitem").where(c.clean_mask(F.col("l_orderkey") % 16384, BAD_BITS)).select("l_orderkey", "l_linenumber")


@register("col_bitmask_fraction", f"SELECT l_orderkey, count(*) FILTER (WHERE l_partkey & {c.bits((0, 3))} <> 0) / count(*) AS masked FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    keys = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("keys"))
    return keys.select("l_orderkey", c.masked_fraction("keys", (0, 3)).alias("masked"))


@register("col_type_clean", "SELECT p_partkey, CASE WHEN upper(trim(p_type)) = 'PROMO' THEN NULL WHEN upper(trim(p_type)) IN ('ECONOMY', 'STANDARD') THEN upper(trim(p_type)) ELSE 'OTHER' END AS kind FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", c.clean_type(F.concat(F.lit(" "), F.lower("p_type")), ("ECONOMY", "STANDARD"), ("PROMO",)).alias("kind"))


@register("col_bin_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN q BETWEEN 1 AND 2 THEN '1-2' WHEN q BETWEEN 3 AND 5 THEN '3-5' WHEN q BETWEEN 6 AND 10 THEN '6-10' WHEN q >= 11 THEN '11+' ELSE 'invalid' END AS bin FROM (SELECT *, l_quantity::BIGINT % 13 AS q FROM lineitem)")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.range_label(F.col("l_quantity").cast("long") % 13, QUANTITY_BINS).alias("bin"))


@register("col_edges_bucket", "SELECT o_orderkey, CASE WHEN o_totalprice >= 0 AND o_totalprice < 100000 THEN 0 WHEN o_totalprice >= 100000 AND o_totalprice < 200000 THEN 1 WHEN o_totalprice >= 200000 AND o_totalprice < 300000 THEN 2 ELSE 3 END AS bin FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", c.edge_bucket("o_totalprice", (0.0, 100000.0, 200000.0, 300000.0, 400000.0)).alias("bin"))


@register("col_round_bin", "SELECT l_orderkey, l_linenumber, round(round(l_discount / 0.025::DOUBLE) * 0.025::DOUBLE, 6) AS bin, CAST(floor(l_tax * 10) AS BIGINT) AS tenth FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(c.round_to("l_discount", 0.025), 6).alias("bin"), F.floor(F.col("l_tax") * 10).alias("tenth"))


@register("col_digitize", "SELECT l_orderkey, l_linenumber, CASE WHEN floor((l_quantity - 2.5::DOUBLE) / 5.0::DOUBLE) BETWEEN 0 AND 7 THEN floor((l_quantity - 2.5::DOUBLE) / 5.0::DOUBLE)::INT ELSE -1 END AS bin, list_sort([{'d': round(abs(l_tax - x), 9), 'x': x} FOR x IN [0.0::DOUBLE, 0.03::DOUBLE, 0.06::DOUBLE]])[1]['x'] AS near FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.digitize("l_quantity", 5.0, 5.0, 8).alias("bin"), c.snap("l_tax", (0.0, 0.03, 0.06)).alias("near"))


@register("col_tier_weight", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0.95 WHEN 'MACHINERY' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM customer")
def _(spark, d):
    return read(spark, d, "customer").select("c_custkey", c.lookup("c_mktsegment", {"BUILDING": 0.95, "MACHINERY": 0.5}, 1.0).alias("weight"))


TILE_SQL = f"lpad(CAST(floor({sql_ra('o_orderkey')} * 10) AS BIGINT)::VARCHAR, 4, '0') || CASE WHEN {sql_dec('o_orderkey')} >= 0 THEN 'p' ELSE 'm' END || lpad(CAST(floor(abs({sql_dec('o_orderkey')}) * 10) AS BIGINT)::VARCHAR, 3, '0')"


@register("col_brick_format", f"SELECT o_orderkey, {TILE_SQL} AS tile, regexp_matches({TILE_SQL}, '^[0-9]{{4}}[pm][0-9]{{3}}$') AS ok, regexp_matches(o_orderpriority, '^[0-9]{{4}}[pm][0-9]{{3}}$') AS bad FROM orders")
def _(spark, d):
    t = read(spark, d, "orders").withColumn("tile", c.tile_name(ra("o_orderkey"), dec("o_orderkey")))
    return t.select("o_orderkey", "tile", c.is_tile_name("tile").alias("ok"), c.is_tile_name("o_orderpriority").alias("bad"))


@register("col_brick_parse", f"SELECT o_orderkey, substr(t, 1, 4)::DOUBLE / 10 AS ra, CASE WHEN substr(t, 5, 1) = 'p' THEN substr(t, 6, 3)::DOUBLE / 10 ELSE -(substr(t, 6, 3)::DOUBLE / 10) END AS dec FROM (SELECT o_orderkey, {TILE_SQL} AS t FROM orders)")
def _(spark, d):
    a, b = c.tile_centre(c.tile_name(ra("o_orderkey"), dec("o_orderkey")))
    return read(spark, d, "orders").select("o_orderkey", a.alias("ra"), b.alias("dec"))


@register("col_bounds_from_name", f"SELECT o_orderkey, CAST(floor({sql_ra('o_orderkey')} / 5) * 5 AS INT) AS ra1, CAST(floor({sql_dec('o_orderkey')} / 5) * 5 AS INT) AS dec1, CAST(floor({sql_ra('o_orderkey')} / 5) * 5 + 5 AS INT) AS ra2, CAST(floor({sql_dec('o_orderkey')} / 5) * 5 + 5 AS INT) AS dec2 FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", *c.block_bounds(c.block_file(ra("o_orderkey"), dec("o_orderkey"))))


@register("col_multi_value", "SELECT event_id, regexp_extract(props, '[0-9]+')::DOUBLE AS number, event_type AS item FROM events")
def _(spark, d):
    packed = F.concat(F.lit("none | "), F.col("event_type"), F.lit(" |"), F.regexp_extract("props", "[0-9]+", 0), F.lit("?|7"))
    return read(spark, d, "events").select("event_id", c.first_number(packed).alias("number"), F.coalesce(*[c.first_with_prefix(packed, p) for p in ("click", "view", "error", "purchase", "signup")], F.col("event_type")).alias("item"))


@register("col_area_deg2", f"SELECT DISTINCT t, round(0.5 * (sin(radians(y + 0.5)) - sin(radians(y))) * 57.29577951308232, 9) AS area FROM (SELECT CAST(floor({sql_dec('o_orderkey')} * 2) AS BIGINT) AS t, floor({sql_dec('o_orderkey')} * 2) / 2 AS y FROM orders)")
def _(spark, d):
    t = sky(read(spark, d, "orders"), "o_orderkey").select(F.floor(F.col("dec") * 2).alias("t")).distinct()
    return t.select("t", F.round(c.box_area(F.lit(359.75), F.lit(0.25), F.col("t") / 2, F.col("t") / 2 + 0.5), 9).alias("area"))


@register("col_hash_uniform", f"SELECT o_orderkey, {sql_uniform('o_orderkey', 42)} AS u FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", c.hash_uniform("o_orderkey", 42).alias("u"))


@register("col_hash_normal", f"SELECT o_orderkey, round(greatest(least(sqrt(-2.0 * ln(greatest({sql_uniform('o_orderkey', 7)}, 1e-12))) * cos({2 * math.pi} * {sql_uniform('o_orderkey', 8)}), 3.0), -3.0), 6) AS z FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(c.hash_normal("o_orderkey", 7), 6).alias("z"))


def _draw_sql():
    u = [sql_uniform("o_orderkey", 101 + i) for i in range(10)]
    v = {"dx": f"sqrt({u[0]}) * cos({2 * math.pi} * {u[1]})", "dy": f"sqrt({u[0]}) * sin({2 * math.pi} * {u[1]})", "angle": f"{u[2]} * {math.pi}", "shear_angle": f"{u[3]} * {math.pi}", "gr": f"0.2 + {u[4]} * 0.6", "rz": f"0.1 + {u[5]} * 0.4", "ellipticity": f"{u[6]} * 0.6", "index": f"0.5 + {u[7]} * 3.5", "size": f"0.1 + {u[8]} * 0.9", "phase": u[9]}
    return "SELECT o_orderkey, " + ", ".join(f'round(CASE WHEN o_orderkey % 5 <> 0 THEN {x} ELSE 0 END, 6) AS "{k}"' for k, x in v.items()) + " FROM orders"


@register("col_frozen_draws", _draw_sql())
def _(spark, d):
    t = read(spark, d, "orders").select("o_orderkey", *c.frozen_draws("o_orderkey", F.col("o_orderkey") % 5 == 0))
    return t.select("o_orderkey", *[F.round(x, 6).alias(x) for x in t.columns[1:]])


def _healpix_sql(nside: int) -> str:
    bits = " + ".join(f"(((ix >> {i}) & 1) << {2 * i}) + (((iy >> {i}) & 1) << {2 * i + 1})" for i in range(nside.bit_length() - 1))
    return f"""WITH p AS (SELECT o_orderkey, sin(radians({sql_dec('o_orderkey')})) AS z, {sql_ra('o_orderkey')} / 90.0::DOUBLE AS t FROM orders),
    e AS (SELECT *, CAST(floor({nside}.0::DOUBLE * (0.5::DOUBLE + t) - {nside}.0::DOUBLE * z * 0.75::DOUBLE) AS BIGINT) AS jp, CAST(floor({nside}.0::DOUBLE * (0.5::DOUBLE + t) + {nside}.0::DOUBLE * z * 0.75::DOUBLE) AS BIGINT) AS jm FROM p),
    f AS (SELECT *, jp // {nside} AS fp, jm // {nside} AS fm FROM e),
    g AS (SELECT o_orderkey, CASE WHEN fp = fm THEN (fp & 3) + 4 WHEN fp < fm THEN fp & 3 ELSE (fm & 3) + 8 END AS face, jm & {nside - 1} AS ix, {nside - 1} - (jp & {nside - 1}) AS iy FROM f)
    SELECT o_orderkey, CAST(face * {nside * nside} + {bits} AS BIGINT) AS cell FROM g"""


def healpix_expression(nside: int, ra: str = "ra", dec: str = "dec") -> str:
    """The cell of a position inside the equatorial belt, as one SQL expression."""
    a, b = f"{nside}.0::DOUBLE * (0.5::DOUBLE + {ra} / 90.0::DOUBLE)", f"{nside}.0::DOUBLE * sin(radians({dec})) * 0.75::DOUBLE"
    jp, jm = f"CAST(floor({a} - {b}) AS BIGINT)", f"CAST(floor({a} + {b}) AS BIGINT)"
    fp, fm, ix, iy = f"({jp} // {nside})", f"({jm} // {nside})", f"({jm} & {nside - 1})", f"({nside - 1} - ({jp} & {nside - 1}))"
    face = f"(CASE WHEN {fp} = {fm} THEN ({fp} & 3) + 4 WHEN {fp} < {fm} THEN {fp} & 3 ELSE ({fm} & 3) + 8 END)"
    bits = " + ".join(f"((({ix} >> {i}) & 1) << {2 * i}) + ((({iy} >> {i}) & 1) << {2 * i + 1})" for i in range(nside.bit_length() - 1))
    return f"CAST({face} * {nside * nside} + {bits} AS BIGINT)"


@register("col_healpix", _healpix_sql(128))  # declinations of the view stay inside the equatorial belt
def _(spark, d):
    return sky(read(spark, d, "orders"), "o_orderkey").select("o_orderkey", c.healpix_nested("ra", "dec", 128).alias("cell"))


@register("col_prevalence", "SELECT l_orderkey, l_linenumber, round(o / (1 + o), 9) AS p FROM (SELECT *, x / (1 - x) * ((0.01 / 0.99) / (0.5 / 0.5)) AS o FROM (SELECT *, greatest(least(l_discount * 9, 1 - 1e-9), 1e-9) AS x FROM lineitem))")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(c.prevalence_shift(F.col("l_discount") * 9, 0.5, 0.01), 9).alias("p"))


@register("col_ang_sep", f"SELECT o_orderkey, round(degrees(2 * asin(least(sqrt(pow(sin((d2 - d1) / 2), 2) + cos(d1) * cos(d2) * pow(sin(radians(ra - 359.5) / 2), 2)), 1))), 6) AS sep FROM (SELECT o_orderkey, radians(10.0) AS d1, radians({sql_dec('o_orderkey')}) AS d2, {sql_ra('o_orderkey')} AS ra FROM orders)")
def _(spark, d):
    return sky(read(spark, d, "orders"), "o_orderkey").select("o_orderkey", F.round(c.ang_sep(F.lit(359.5), F.lit(10.0), "ra", "dec"), 6).alias("sep"))


@register("col_inclination", "SELECT p_partkey, round(degrees(acos(greatest(least(p_size / 50.0, 1.0), 0.01))), 6) AS incl FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(c.inclination(F.col("p_size") / F.lit(50.0)), 6).alias("incl"))


@register("col_sanity_notes", "SELECT l_orderkey, l_linenumber, q = '' AS valid, q AS warnings FROM (SELECT *, concat_ws('; ', CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_discount >= 0.09 THEN 'cheap' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS q FROM lineitem)")
def _(spark, d):
    valid, text = c.notes([("large", F.col("l_quantity") > 45), ("cheap", F.col("l_discount") >= 0.09), ("untaxed", F.col("l_tax") == 0)])
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", valid.alias("valid"), text.alias("warnings"))


@register("col_robust_score", "WITH m AS (SELECT quantile_cont(p_size, 0.5) AS ms, quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) AS qs, quantile_cont(p_retailprice, 0.5) AS mp, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS qp FROM part) SELECT p_partkey, round(1.0 * (p_size - ms) / nullif(qs, 0) + 0.5 * (p_retailprice - mp) / nullif(qp, 0), 6) AS score FROM part, m")
def _(spark, d):
    from starloom.operators.aggregates import robust_score

    return robust_score(read(spark, d, "part"), {"p_size": 1.0, "p_retailprice": 0.5}).select("p_partkey", F.round("score", 6).alias("score"))
