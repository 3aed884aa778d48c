"""Nested sky cells against all pairs, clusters in one radius, and components of long chains and hubs."""

import logging
import math
import random

import pytest
from pyspark.sql import functions as F

from starloom.operators import joins as j
from starloom.operators import regions as rg
from starloom.operators import splits as sp
from starloom.operators.skytree import nearest_in_tree
from starloom.operators.stored import Stored, hot_join
from starloom.operators.windows import numbered


def separation(p, r):
    d1, d2 = math.radians(p[1]), math.radians(r[1])
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin(math.radians(p[0] - r[0]) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h))))


def sky(seed, n):
    rng = random.Random(seed)
    out = [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(n)]
    out += [(10 + rng.gauss(0, 0.5), 20 + rng.gauss(0, 0.5)) for _ in range(n)]  # a cluster
    return out + [(359.9999, 0.0), (0.0001, 0.0), (0.0, 90.0), (123.0, 90.0), (5.0, -90.0), (10.0, 20.0), (10.0, 20.0)]


def frames(spark, left, right):
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(left)], "id int, ra double, dec double")
    return a, spark.createDataFrame([(i, *p) for i, p in enumerate(right)], "other int, ra2 double, dec2 double")


def brute(left, right, radius=1000.0):
    out = {}
    for i, p in enumerate(left):
        s, k = min((round(separation(p, r), 9), k) for k, r in enumerate(right))
        if s <= radius:
            out[i] = (k, s)
    return out


@pytest.mark.parametrize(("leaf", "within"), [(4, None), (16, 0.3)])
def test_nested_cells_find_the_nearest(spark, leaf, within):
    left, right = sky(1, 60), sky(2, 60)
    a, b = frames(spark, left, right)
    got = nearest_in_tree(a, b, "id", "other", within, leaf=leaf).collect()
    want = brute(left, right, within or 1000.0)
    assert len(got) == len(want)
    assert {r.id: (r.other, round(r.sep, 9)) for r in got} == want


def test_nothing_near_nothing(spark):
    a, b = frames(spark, [(1.0, 2.0), (None, 3.0)], [(1.5, 2.5)])
    assert [(r.id, r.other) for r in nearest_in_tree(a, b, "id", "other").collect()] == [(0, 0)]
    none = nearest_in_tree(a, b.where("false"), "id", "other")
    assert none.columns == ["id", "other", "sep"] and none.count() == 0
    assert nearest_in_tree(a.where("false"), b, "id", "other").count() == 0


def test_overfull_cells_give_what_all_pairs_give(spark):
    left, right = sky(3, 40), sky(4, 40)
    a, b = frames(spark, left, right)
    a, b = a.withColumn("more", F.col("id") + 1), b.withColumn("mag", F.col("other") * 2)
    rows = lambda t: sorted(t.collect())
    plain, split = j.nearest(a, b, 2.0, "id", "other"), j.nearest(a, b, 2.0, "id", "other", busy=20)
    assert split.columns == plain.columns and rows(split) == rows(plain)
    assert rows(j.near_flag(a, b, 2.0, "id", busy=20)) == rows(j.near_flag(a, b, 2.0, "id"))
    assert {r.id for r in j.away(a, b, 0.05, "id", busy=20).collect()} == {r.id for r in j.away(a, b, 0.05, "id").collect()}


def test_a_cluster_of_half_of_all_rows_makes_few_pairs(spark):
    n = 8_000  # 64 million pairs lie within the radius
    t = spark.range(2 * n).select("id", F.when(F.col("id") < n, F.lit(40.0) + F.rand(1) * 0.3).otherwise(F.rand(2) * 360).alias("ra"), F.when(F.col("id") < n, F.lit(5.0) + F.rand(3) * 0.3).otherwise(F.rand(4) * 90 - 45).alias("dec"))
    stored = Stored(spark, "test")
    a, b = stored.keep(t), stored.keep(t.select(F.col("id").alias("other"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2")))
    got = j.nearest(a, b, 0.5, "id", "other")
    assert got.where("id = other").count() == 2 * n
    assert j.away(a, b, 0.5, "id").count() == 0


def test_separation_covers_every_test_row(spark):
    left, right = sky(5, 30), sky(6, 30)
    a, b = frames(spark, left, right)
    report, close = sp.min_separation(a, b, 0.2, "id", "other")
    want = sorted(s for _, s in brute(left, right).values())
    r, n = report.first(), len(want)
    assert r.n == n and r.alone == 0 and math.isclose(r.least, want[0], abs_tol=1e-8) and r.violations == sum(s < 0.2 for s in want) == close.count()
    assert math.isclose(r.median, (want[(n - 1) // 2] + want[n // 2]) / 2, abs_tol=1e-8)
    empty = sp.min_separation(a, b.where("false"), 0.02, "id", "other")[0].first()
    assert empty.alone == empty.n == n and empty.least is None


def test_long_chain_and_hub(spark, caplog):
    n = 100_000
    node = (F.col("id") * 7919 % n).alias("node")
    edges = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("a"), ((F.col("id") + 1) * 7919 % n).alias("b")).repartition(8)
    with caplog.at_level(logging.INFO, "starloom.operators.regions"):
        got = rg.components(spark.range(n).select(node), edges, "node", most=30_000)
        assert got.where("root <> 0").isEmpty() and got.count() == n
    assert any("round 1" in r.message for r in caplog.records)
    hub = spark.range(20_000).select(F.lit(7).cast("long").alias("a"), (F.col("id") + 10).alias("b"))
    got = rg.components(spark.range(20_010).select(F.col("id").alias("node")), hub, "node", most=500)
    assert got.where("root = 7").count() == 20_001 and got.where("root = node").count() == 10


def touching(p, q, eps):
    gap = abs(p[0] - q[0])
    return min(gap, 360 - gap) <= eps and abs(p[1] - q[1]) <= eps


def all_pairs_regions(places, eps):
    up = list(range(len(places)))
    for i, p in enumerate(places):
        for k in range(i):
            if up[i] != up[k] and touching(p, places[k], eps):
                new, old = sorted((up[i], up[k]))
                up = [new if r == old else r for r in up]
    ids = {r: n + 1 for n, r in enumerate(sorted(set(up)))}
    return [(i, r, ids[r]) for i, r in enumerate(up)]


def field(kind, eps, rng):
    if kind == "even":
        side = eps * math.sqrt(300)
        out = [(rng.uniform(-side, side) / 2, rng.uniform(-side, side) / 2) for _ in range(300)]
    elif kind == "grid":  # many tiles at eps from each other, which rounding puts on either side
        out = [(rng.randrange(60) * eps / 4, rng.randrange(40) * eps / 4) for _ in range(300)]
    else:  # diagonal clumps, whose corners decide
        out = []
        for _ in range(15):
            x, y, slope = rng.uniform(-8, 8) * eps, rng.uniform(-8, 8) * eps, rng.choice([-1, 1])
            out += [(x + u, y + slope * u + rng.uniform(0, 0.05) * eps) for u in [rng.uniform(-1, 1) * eps for _ in range(20)]]
    return [(round(x, 3) % 360, round(y, 3)) for x, y in out]


@pytest.mark.parametrize(("kind", "eps"), [("even", 2.0), ("even", 0.7), ("grid", 2.0), ("grid", 0.1), ("clumps", 2.0), ("clumps", 30.0), ("even", 100.0)])
def test_regions_are_those_of_all_pairs(spark, kind, eps):
    for seed in range(2):
        places = field(kind, eps, random.Random(f"{kind} {eps} {seed}"))
        t = spark.createDataFrame([(i, *p) for i, p in enumerate([*places, (None, 1.0), (2.0, math.nan)])], "tile long, ra double, dec double")
        want = all_pairs_regions(places, eps)
        n, most = len(places), max(r[2] for r in want)
        got = rg.regions(t, "tile", "ra", "dec", eps)
        assert got.columns == ["tile", "root", "region_id"]
        assert sorted(map(tuple, got.collect())) == [*want, (n, n, most + 1), (n + 1, n + 1, most + 2)]


def test_two_tiles_a_rounding_beyond_eps(spark):
    k = next(k for k in range(100_000) if (k + 2000) / 1000 - k / 1000 > 2)
    t = spark.createDataFrame([(1, k / 1000, 0.0), (2, (k + 2000) / 1000, 0.0)], "tile long, ra double, dec double")
    assert sorted(map(tuple, rg.regions(t, "tile", "ra", "dec", 2.0).collect())) == [(1, 1, 1), (2, 2, 2)]


def test_a_crowd_is_one_region_without_its_pairs(spark):
    n = 100_000  # five billion pairs touch
    t = spark.range(n).select((n - F.col("id")).alias("tile"), (F.col("id") * 7919 % n / n).alias("ra"), (F.col("id") / n).alias("dec"))
    t = t.unionAll(spark.createDataFrame([(0, 359.5, 0.5), (n + 7, 3.5, 0.5)], "tile long, ra double, dec double"))
    got = rg.regions(t, "tile", "ra", "dec", 2.0)
    assert got.where("root = 0 AND region_id = 1").count() == n + 1 and got.where("root <> 0").collect() == [(n + 7, n + 7, 2)]


def test_components_of_texts_and_of_nothing(spark):
    nodes = spark.createDataFrame([("b",), ("a",), ("é",), ("Z",)], "node string")
    edges = spark.createDataFrame([("é", "b"), ("b", "a"), ("a", "a")], "a string, b string")
    assert dict(map(tuple, rg.components(nodes, edges, "node").collect())) == {"a": "a", "b": "a", "é": "a", "Z": "Z"}
    assert dict(map(tuple, rg.components(nodes, edges.where("false"), "node").collect())) == {x: x for x in "baéZ"}


def test_plans_stay_small_over_rounds(spark):
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    t, stored = spark.range(50).withColumnRenamed("id", "k"), Stored(spark, "rounds")
    for _ in range(20):
        t = stored.keep(t.join(t.withColumnRenamed("k", "b"), F.col("k") == F.col("b")).select("k"))
    assert size(t) < 2**63 and t.count() == 50
    chain = spark.range(3_000).select(F.col("id").alias("node"))
    edges = spark.range(2_999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert size(rg.components(chain, edges, "node", most=1_000)) < 2**63
    n = numbered(chain, ["node"], "i")
    assert size(n) < 2**63 and n.where("i <> node + 1").isEmpty()


def test_hot_keys_are_joined_whole(spark):
    stored = Stored(spark, "hot")
    left = stored.keep(spark.range(9_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), "id"))
    right = stored.keep(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2).where("k <> 3"))
    for how in ("inner", "left"):
        got = hot_join(left, right, ["k"], "n", how)
        assert got.columns == ["k", "id", "v"] and sorted(got.collect(), key=str) == sorted(left.join(right.drop("n"), "k", how).collect(), key=str)
    assert "BroadcastHashJoin" in hot_join(left, right, ["k"], "n")._jdf.queryExecution().toString()
