"""Edge cases of joins, windows, metrics, regions, sources and streams."""

import collections
import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from starloom.functions.columns import hash_uniform
from starloom.operators import aggregates as a
from starloom.operators import joins as j
from starloom.operators import metrics as m
from starloom.operators import models as md
from starloom.operators import quality as q
from starloom.operators import regions as rg
from starloom.operators import sampling as sm
from starloom.operators import splits as sp
from starloom.operators import windows as w
from starloom.plans import registry
from starloom.sources import catalogs as s


def separation(p, r):
    d1, d2 = math.radians(p[1]), math.radians(r[1])
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin(math.radians(p[0] - r[0]) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h))))


@pytest.mark.parametrize("radius", [0.05, 0.7, 5.0])
def test_sky_pairs_match_all_pairs(spark, radius):
    points = [(359.9999, 0.0), (0.0001, 0.0), (10.0, 89.99), (190.0, 89.99), (200.0, -89.999), (20.0, -89.5), (180.0, 45.0), (180.6, 45.2), (0.0, 90.0), (5.0, -90.0), (350.0, 89.0), (359.6, 0.3)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, ra double, dec double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "other int, ra2 double, dec2 double")
    got = {(r.id, r.other) for r in j.sky_pairs(left, right, radius).collect()}
    want = {(x, y) for x, y in itertools.product(range(len(points)), repeat=2) if separation(points[x], points[y]) <= radius}
    assert got == want
    assert j.sky_pairs(left, right, radius).count() == len(want)


def test_auc_with_ties_and_limits(spark):
    df = lambda rows: spark.createDataFrame(rows, "s double, y int")
    area = lambda rows: m.auc(df(rows), "s", F.col("y") == 1).first().auc
    assert area([(1.0, 0), (2.0, 1)]) == 1.0 and area([(2.0, 0), (1.0, 1)]) == 0.0 and area([(1.0, 0), (1.0, 1), (1.0, 1)]) == 0.5
    assert area([(1.0, 1), (2.0, 1)]) is None
    rows = [(float(x % 7), int(x % 3 == 0)) for x in range(200)]
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    assert math.isclose(area(rows), sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))


def test_intervals(spark):
    low, high = a.wilson(F.col("k"), F.col("n"))
    t = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10)], "k bigint, n bigint").select(low.alias("lo"), high.alias("hi")).collect()
    assert t[0].lo is None and t[1].lo == 0 and t[2].hi == 1 and t[3].lo < 0.5 < t[3].hi
    r = a.jeffreys(spark.createDataFrame([(0, 0), (0, 10), (5, 10)], "k bigint, n bigint"), "k", "n").collect()
    assert r[0].ci68_low is None and r[1].ci95_low == 0 and math.isclose(r[2].ci95_low + r[2].ci95_high, 1, abs_tol=1e-9) and math.isclose(r[2].ci95_low, 0.2235, abs_tol=2e-3)


def test_components_wrap_and_split(spark):
    tiles = spark.createDataFrame([(0, 0), (59, 0), (58, 1), (30, 0), (31, 1), (10, 5)], "x bigint, y bigint")
    e = rg.adjacency(tiles, "x", "y", 60).select((F.col("x") * 1000 + F.col("y")).alias("a"), (F.col("x2") * 1000 + F.col("y2")).alias("b"))
    got = {r.node: r.root for r in rg.components(tiles.select((F.col("x") * 1000 + F.col("y")).alias("node")), e, "node").collect()}
    assert got == {0: 0, 59000: 0, 58001: 0, 30000: 30000, 31001: 30000, 10005: 10005}
    chain = spark.range(40).select((F.col("id") * 7 % 40).alias("node"))
    e = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in rg.components(chain, e.unionAll(e.select("b", "a")), "node").collect()} == {0}


def test_split_shares_and_relabel(spark):
    t = spark.range(10_000).withColumn("split", sp.hash_split("id"))
    n = {r.split: r["count"] for r in t.groupBy("split").count().collect()}
    assert abs(n["test"] - 1000) < 120 and abs(n["val"] - 1000) < 120
    moved = t.withColumn("new", sp.relabel("split", "id", 0.5))
    assert moved.where("split = 'test' AND new <> 'test'").isEmpty() and moved.where("split = 'train' AND new <> 'train'").isEmpty()
    assert t.repartition(7).exceptAll(t).isEmpty()


def test_backfill_takes_from_the_first_pool(spark):
    pos = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "s string, i int")
    pool = spark.createDataFrame([("a", i, 1 if i < 50 else 2) for i in range(51)] + [("b", i, 1) for i in range(100, 140)], "s string, k int, pool int")
    got = sm.ratio_backfill(pos, pool, ["s"], "k", "pool", 2).collect()
    assert sum(r.s == "a" for r in got) == 20 and sum(r.s == "b" for r in got) == 6
    assert sum(r.backfill for r in got if r.s == "a") == 2


def test_sources(spark, tmp_path):
    t = spark.createDataFrame([(1, "x")], "OBJID int, kind string")
    assert s.normalise(t, {"id": (("objid",), "bigint"), "none": ((), "double")}, ["id"]).first().asDict() == {"id": 1, "none": None}
    with pytest.raises(ValueError, match="missing columns: ra"):
        s.normalise(t, {"ra": ((), "double")}, ["ra"])
    with pytest.raises(ValueError, match="missing columns"):
        q.contract(t, ["absent"])
    with pytest.raises(ValueError, match="more than"):
        sm.task_guard(spark.range(10), 5, 49)
    (tmp_path / "bad.npz").write_bytes(b"no zip")
    assert s.read_arrays(spark, str(tmp_path)).first().error
    assert not s.done(spark, str(tmp_path)) and s.write_verified(spark.range(5), str(tmp_path / "o")) == 5 and s.done(spark, str(tmp_path / "o"))


def test_every_embedding_is_written_and_decoded(spark, tmp_path):
    from starloom.plans import registry

    rows = [(i, i % 2, [float(i)] * (i % 5 + 1) if i != 7 else None) for i in [*range(40), 3, 3]]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.queries()["src_stamps"](spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.label, r.pixels or 0, r.error or "") for r in got) == sorted((i, y, len(v or []), "" if v else "no array") for i, y, v in rows)
    back = s.write_arrays(spark.createDataFrame([(1, [1.5, 2.5])], "k int, v array<float>"), "v", str(tmp_path / "npz")).collect()
    r = s.read_arrays(spark, str(tmp_path / "npz" / "*")).first()
    assert r.data == [1.5, 2.5] and r.shape == [2, 1] and r.path.endswith(back[0].file)


@pytest.mark.parametrize("block", [4, 1000])
def test_mmd_in_blocks_is_that_of_all_pairs(spark, block):
    a, b = ([(i, [math.sin(i * k + s) for k in range(3)]) for i in range(s, 60, 2)] for s in (0, 1))
    k = lambda x, y: math.exp(-0.7 * sum((p - q) ** 2 for p, q in zip(x[1], y[1], strict=True)))
    mean = lambda xs, ys: sum(v := [k(x, y) for x in xs for y in ys if x[0] != y[0]]) / len(v)
    x, y = (spark.createDataFrame(t, "k bigint, v array<double>") for t in (a, b))
    out = md.mmd(x, y, "k", "v", 0.7, block)
    assert math.isclose(out.first().mmd2, mean(a, a) + mean(b, b) - 2 * mean(a, b), abs_tol=1e-12)
    assert "Broadcast" not in out._jdf.queryExecution().toString()
    assert md.mmd(x.limit(1), y, "k", "v", 0.7, block).first().mmd2 is None


def test_mmd_blocks_averages_estimates_of_all_rows(spark):
    rows = [(i, [math.sin(i * k) for k in range(3)]) for i in range(80)]
    t = spark.createDataFrame([*rows, (80, None)], "k bigint, v array<double>")
    x, y = t.where("k % 2 = 0"), t.where("k % 2 = 1")
    whole = md.mmd(x.where("v is not null"), y, "k", "v", 0.7).first().mmd2
    one = md.mmd_blocks(x, y, "k", "v", 0.7).first()
    assert one.blocks == 1 and math.isclose(one.mmd2, whole, abs_tol=1e-12)
    many = md.mmd_blocks(x, y, "k", "v", 0.7, block=10).first()
    at = {r.k: r.b for r in t.select("k", F.floor(hash_uniform("k", 3) * 4).alias("b")).collect()}
    parts = [md.mmd(*(s.where(F.col("v").isNotNull() & F.col("k").isin([k for k in at if at[k] == b])) for s in (x, y)), "k", "v", 0.7).first().mmd2 for b in range(4)]
    assert many.blocks == 4 and math.isclose(many.mmd2, sum(parts) / 4, abs_tol=1e-12)
    empty = md.mmd_blocks(x.limit(0), y.limit(0), "k", "v", 0.7).first()
    assert empty.mmd2 is None and empty.blocks == 0


def test_rankings_cut_groups_before_the_shuffle(spark):
    t = spark.createDataFrame([(i, i % 2, i % 3, float(i)) for i in range(60)], "k int, g int, b int, s double")
    for out in (w.topk(t, 2, ["g"], "s", "k"), w.stratified_topk(t, {0: 1, 1: 2}, ["g"], "b", "s", "k"), w.two_pass_quota(t, ["b"], ["g"], 2, 3, "k")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Partial" in plan and "WindowGroupLimit" in plan
    assert sorted(r.k for r in w.stratified_topk(t, {0: 1, 1: 2}, ["g"], "b", "s", "k").collect()) == [49, 52, 54, 55, 57, 58]


def all_pairs_greedy(x, y, most):
    """x, y: (value, key) sorted; the closest first, then by places."""
    used, out = (set(), set()), []
    for gap, i, j in sorted((abs(p[0] - q[0]), i, j) for i, p in enumerate(x) for j, q in enumerate(y)):
        if gap <= most and i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            out.append((x[i][1], y[j][1], gap))
    return sorted(out)


@pytest.mark.parametrize("rows", [10, 60, 100_000])
def test_greedy_pairs_in_ranges_are_those_of_whole_bins(spark, rows):
    rng = random.Random(3)
    for top, most in ((40, 3.0), (5000, 40.0), (3, 1.0)):
        a, b = ([(g, i, float(rng.randrange(top))) for i in range(120) for g in (1, 2)] for _ in range(2))
        x, y = spark.createDataFrame([*a, (1, 999, None)], "g int, ka bigint, v double"), spark.createDataFrame([*b, (3, 1, 0.0)], "g int, kb bigint, v double")
        got = md.greedy_pairs(x, y, "g", "ka", "kb", "v", most, rows).collect()
        for g in (1, 2):
            one, two = (sorted((v, k) for h, k, v in t if h == g) for t in (a, b))
            assert sorted((r.ka, r.kb, r.gap) for r in got if r.g == g) == all_pairs_greedy(one, two, most)
        assert not [r for r in got if r.g == 3]


def test_mutual_nearest_is_its_sql_with_ties_and_missing_values(spark, tmp_path):
    """Few values, so that many rows are as near; every third bin also has rows without a value or at NaN."""
    rng, db = random.Random(5), duckdb.connect()
    for name, one in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
        rows = [(g, rng.choice([None, math.nan]) if g % 3 == 0 and rng.random() < 0.5 else rng.randrange(-top, top) / 2) for g in range(60) for top in [rng.choice([1, 4, 300])] for _ in range(rng.choice([1, 3, 60]))]
        keys = rng.sample(range(len(rows)), len(rows))
        t = spark.createDataFrame([(g, k, v) for k, (g, v) in zip(keys, rows, strict=True)], f"{name[0]}_nationkey int, {one} long, {name[0]}_acctbal double")
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = registry.queries()["join_greedy_pairs"](spark, str(tmp_path))
    want = db.sql(registry.oracle_sql()["join_greedy_pairs"]).fetchall()
    assert len(want) > 50 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()  # such frames are summed anew for each row of a bin


def test_numbers_run_over_range_partitions(spark):
    t = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(5)
    got = w.numbered(t, ["k"], "i")
    assert all(r.i == r.k + 1 for r in got.collect())
    by = collections.defaultdict(list)
    for r in w.numbered(t, ["g", "k"], "i", ["g"]).collect():
        by[r.g].append((r.k, r.i))
    assert all([i for _, i in sorted(x)] == list(range(1, len(x) + 1)) for x in by.values())


def test_batch_score_reports_bad_rows(spark):
    def model(frame):
        if (frame.x < 0).any():
            raise ValueError("negative")
        return frame.x * 2

    rows = {r.k: (r.score, r.error) for r in m.batch_score(spark.createDataFrame([(1, 1.0), (2, -1.0)], "k int, x double").coalesce(1), model, ["x"], ["k"]).collect()}
    assert rows == {1: (2.0, None), 2: (None, "ValueError: negative")}


def test_frechet_of_diagonal_covariances(spark):
    def cloud(mean, spread):  # points on the axes have a diagonal covariance
        return [([m + (s if i == k else 0.0) * sign for i, (m, s) in enumerate(zip(mean, spread, strict=True))],) for k in range(len(mean)) for s in [spread[k]] for sign in (1, -1)]

    a, b = cloud([0.0, 1.0, -2.0], [1.0, 2.0, 3.0]), cloud([0.5, 1.0, 0.0], [2.0, 2.0, 0.5])
    frame = lambda rows: spark.createDataFrame([([float(x) for x in v],) for (v,) in rows], "v array<double>").repartition(2)
    n = len(a)
    root = lambda s: math.sqrt(2 * s * s / (n - 1))  # noqa: E731  the sample deviation of n points, two of them at +s and -s
    want = 0.25 + 0.0 + 4.0 + sum((root(x) - root(y)) ** 2 for x, y in zip([1.0, 2.0, 3.0], [2.0, 2.0, 0.5], strict=True))
    assert math.isclose(md.frechet(frame(a), frame(b), "v"), want, rel_tol=1e-9)
