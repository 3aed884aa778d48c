"""Snapshots, stamps, buckets, mergeable sketches, states of streams, and folds by entity."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import aggregates as a
from starloom.operators import models as md
from starloom.plans import registry
from starloom.sources import catalogs as s
from starloom.sources import snapshots as sn
from starloom.sources.stamps import read_stamps
from starloom.streaming import incremental as inc


def test_versions_are_read_and_nothing_else(spark, tmp_path):
    path = str(tmp_path / "cat")
    t = spark.range(100).select("id", F.when(F.col("id") < 90, "a+b c/d").otherwise("z").alias("part"), (F.col("id") * 2).alias("v"))
    assert sn.load(spark, path) is None
    sn.commit(spark, t.where("id < 50").repartition(5), path, "part")
    sn.commit(spark, t.where("id >= 50").repartition(5), path, "part")
    t.withColumn("stray", F.lit(1)).write.parquet(f"{path}/{sn.DATA}/half")  # a run that never committed
    rows = lambda x: sorted(map(tuple, x.select("id", "part", "v").collect()))
    assert rows(s.read_catalog(spark, path)) == rows(t) and s.read_catalog(spark, path).columns == t.columns
    assert sn.read(spark, path, 0).count() == 50
    n = len(sn.load(spark, path).files)
    small = sn.compact(spark, path)
    assert n > 4 and len(small.files) == 2 and {f.part for f in small.files} == {"a+b c/d", "z"} and sum(f.rows for f in small.files) == 100
    assert rows(sn.read(spark, path)) == rows(t) and sn.read(spark, path, 1).count() == 100
    assert sn.compact(spark, path) is None
    assert sn.vacuum(spark, path) == 3 and rows(s.read_catalog(spark, path)) == rows(t)
    with pytest.raises(RuntimeError, match="another run"):
        sn._publish(spark, path, small)
    with pytest.raises(ValueError, match="partitioned"):
        sn.commit(spark, t, path, "id")
    sn.commit(spark, t.where("id = 7"), path, "part", replace=True)
    assert sn.read(spark, path).count() == 1


def test_packing_fits_the_target():
    files = [sn.DataFile(f"f{i}", b, 1, None) for i, b in enumerate([60, 50, 40, 30, 20, 10, 200, 95])]
    groups = sn.pack_files(files, 100)
    assert all(sum(f.bytes for f in g) <= 100 and len(g) > 1 for g in groups) and {f.name for g in groups for f in g} <= {f"f{i}" for i in range(6)}


def test_stray_folders_beside_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(path)
    spark.range(5).write.parquet(f"{path}/tmp_left_over")
    got = s.read_catalog(spark, path)
    assert got.count() == 10 and set(got.columns) == {"id", "k"}


def test_compaction_plans_files_from_bytes(spark, tmp_path):
    t = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "big").otherwise("small").alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    t.repartition(12).write.parquet(str(tmp_path / "raw"))
    out = s.compact(spark, str(tmp_path / "raw"), str(tmp_path / "out"), "part", ["v"], file_bytes=300_000)
    files = {p: len(list((tmp_path / "out" / f"part={p}").glob("*.parquet"))) for p in ("big", "small")}
    assert out.count() == 20_000 and files["small"] == 1 and 3 <= files["big"] <= 6


@pytest.mark.parametrize("parts", [0, 3])
def test_light_rows_name_their_table_and_find_their_part(spark, tmp_path, parts):
    """The table is one file, or a folder of part files."""
    path, raw = str(tmp_path / "documents.parquet"), str(tmp_path / "raw")
    t = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    t.repartition(parts or 1).write.parquet(path if parts else raw)
    if not parts:
        next((tmp_path / "raw").glob("*.parquet")).rename(path)
    got = registry.queries()["src_metadata_only"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(i, "en", "web", "documents.parquet") for i in range(40)]
    light = s.metadata_only(spark.read.parquet(path), ["doc_id"], path)
    heavy = spark.read.parquet(path).select("text", F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("row"))
    assert light.select("part").distinct().count() == (parts or 1)
    assert light.join(heavy, ["part", "row"]).where(F.col("text") == F.sha2(F.col("doc_id").cast("string"), 256)).count() == 40


def test_stamps_with_fields(spark, tmp_path):
    rows = [(i, i % 3, [float(i), -1.5], None if i == 4 else f"n{i}") for i in range(30)] + [(99, 0, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, label int, data array<float>, name string").repartition(3)
    named = s.write_arrays(df, "data", str(tmp_path / "npz"), ["vec_id", "label", "name"]).collect()
    (tmp_path / "npz" / "bad.npz").write_bytes(b"not a zip")
    got = read_stamps(spark, str(tmp_path / "npz"), "vec_id bigint, label int, name string", partitionBytes="400000")
    assert got.rdd.getNumPartitions() > 1
    seen = {r.meta_vec_id: (r.meta_label, list(r.data), list(r["shape"]), r.meta_name) for r in got.where("error is null").collect()}
    assert seen == {i: (lab, d, [2, 1], n) for i, lab, d, n in rows if d} and len(named) == 31
    bad = got.where("error is not null").collect()
    assert len(bad) == 1 and bad[0].path.endswith("bad.npz") and bad[0].data is None
    slim = read_stamps(spark, str(tmp_path / "npz"), columns="meta_vec_id bigint")
    assert slim.columns == ["meta_vec_id"] and slim.where("meta_vec_id is not null").count() == 30
    (tmp_path / "none").mkdir()
    assert read_stamps(spark, str(tmp_path / "none")).count() == 0


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    left = s.write_bucketed(spark.range(500).select((F.col("id") % 50).alias("k"), "id"), "b_left", ["k"], 4, str(tmp_path / "l"))
    right = s.write_bucketed(spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")), "b_right", ["k"], 4, str(tmp_path / "r"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = left.join(right, "k", "left").groupBy("k").agg(F.sum("v").alias("v"))
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert {r.k: r.v for r in j.collect()} == {k: 30 * k for k in range(50)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_left"), spark.sql("DROP TABLE b_right")


def test_merged_sketches_keep_their_bounds(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(size=40_000), np.full(10_000, 0.5)])
    t = spark.createDataFrame([(i % 2, i // 5000, float(v), int(i % 30_000)) for i, v in enumerate(values)], "g int, part int, v double, who long").repartition(4)
    parts = inc.sketch(t, ["g", "part"], ["v"], ["who"])
    got = {r.g: r for r in inc.read_sketches(inc.merge_sketches(parts.drop("part"), ["g"]), ["g"], [0.1, 0.5, 0.99]).collect()}
    for g in (0, 1):
        own = np.sort(values[g::2])
        for p, name in ((0.1, "v_p10"), (0.5, "v_p50"), (0.99, "v_p99")):
            assert np.searchsorted(own, got[g][name]) / len(own) <= p + 0.01 and np.searchsorted(own, got[g][name], "right") / len(own) >= p - 0.01
        assert got[g].n == 25_000 and abs(got[g].who_distinct - 15_000) < 0.025 * 15_000
    none = inc.read_sketches(inc.merge_sketches(inc.sketch(t.withColumn("v", F.lit(None).cast("double")), ["g"], ["v"], []), ["g"]), ["g"], [0.5]).first()
    assert none.v_p50 is None


def test_states_are_folded_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    t = spark.range(400).select((F.col("id") % 4).alias("k"), "id")
    for i in range(4):
        t.where(F.col("id") % 4 != i).repartition(2).write.mode("append").parquet(src)
        got = inc.incremental_counts(spark, src, t.schema, ["k"], out, mark)
    assert {r.k: r.n for r in got.collect()} == dict.fromkeys(range(4), 300)
    states = inc._states(spark, out)
    assert len(states) == 2
    last, before = sorted(states)[::-1]
    assert {r.k: r.n for r in spark.read.parquet(states[before]).collect()} != {r.k: r.n for r in got.collect()}
    # a batch that is run again starts from the same state
    count, add = (lambda x: x.groupBy("k").agg(F.count(F.lit(1)).alias("n"))), (lambda x: x.groupBy("k").agg(F.sum("n").alias("n")))
    inc.fold(spark, t.where("id % 4 <> 3"), last, out, count, add)
    assert {r.k: r.n for r in spark.read.parquet(inc._states(spark, out)[last]).collect()} == dict.fromkeys(range(4), 300)
    (tmp_path / "empty").mkdir()
    assert inc.incremental_counts(spark, str(tmp_path / "empty"), t.schema, ["k"], str(tmp_path / "o2"), str(tmp_path / "m2")).count() == 0


def test_no_entity_on_two_sides(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if e == 0 else f"e{e}", float(x), int(x + rng.normal() > 0)) for i, (e, x) in enumerate(zip(rng.zipf(1.6, 900) % 60, rng.normal(size=900), strict=True))]
    t = spark.createDataFrame(rows, "id int, who string, x double, y int").repartition(3)
    f = {r.who: r.fold for r in md.entity_folds(t, "who", 3).collect()}
    sizes = np.bincount([f[r[1]] for r in rows])
    largest = max(np.unique([str(r[1]) for r in rows], return_counts=True)[1])
    assert len(f) == len({r[1] for r in rows}) and sizes.max() - sizes.min() <= largest
    scores = md.cross_validated(t, ["x"], "y", "id", 3, "who").collect()
    assert sorted(r.id for r in scores) == list(range(900)) and all(f[rows[r.id][1]] == r.fold for r in scores)
    report = {r.fold: r for r in md.probe_report(md.cross_validated(t, ["x"], "y", "id", 3, "who"), "y").collect()}
    y, p = np.array([rows[r.id][3] for r in scores]), np.array([r.score for r in scores])
    assert set(report) == {"0", "1", "2", "all"} and math.isclose(report["all"].brier, ((p - y) ** 2).mean(), rel_tol=1e-9)
    assert math.isclose(report["all"].accuracy, ((p >= 0.5) == y).mean()) and 0.6 < report["all"].auc < 0.9


def test_exact_p_of_many_pairs(spark):
    t = spark.createDataFrame([(100_000, 99_000), (0, 0), (7, 3)], "b long, c long")
    rows = t.select(F.explode(F.array(F.struct(F.lit(True).alias("x"), F.col("b").alias("n")), F.struct(F.lit(False).alias("x"), F.col("c").alias("n")))).alias("s"), "b").selectExpr("b as g", "s.x as x", "explode(sequence(1, s.n)) as i").where("g > 0")
    got = {r.g: r.p_exact for r in a.mcnemar(rows, ["g"], F.col("x"), ~F.col("x")).collect()}
    assert math.isclose(got[7], 2 * sum(math.comb(10, k) for k in range(4)) / 2**10, rel_tol=1e-9)
    z = (1000 - 1) / math.sqrt(199_000)
    assert math.isclose(got[100_000], math.erfc(z / math.sqrt(2)), rel_tol=1e-3)
