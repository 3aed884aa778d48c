"""Queries for models, population distances, matching and the remaining manifests and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import columns as c
from starloom.operators import joins as j
from starloom.operators import metrics as m
from starloom.operators import models as md
from starloom.operators import sampling as sm
from starloom.operators.sets import union_named
from starloom.plans.evaluation import scored
from starloom.plans.registry import register
from starloom.plans.relations import SKY2, skies
from starloom.plans.views import read, scratch_dir, sql_uniform
from starloom.sources.catalogs import write_arrays
from starloom.sources.stamps import read_stamps


@register("src_stamps", "SELECT vec_id, label, len(embedding) AS pixels, list_min(embedding)::DOUBLE AS least, list_max(embedding)::DOUBLE AS most, CASE WHEN embedding IS NULL THEN 'no array' END AS error FROM embeddings")
def _(spark, d):
    """Each embedding becomes an NPZ file with its key and label in the shared folder, and all is read back from the files; a row whose file is not read has an error."""
    path = scratch_dir(spark)
    rows = write_arrays(read(spark, d, "embeddings").select("vec_id", "label", "embedding"), "embedding", f"{path}/npz", ["vec_id", "label"])
    rows.select("file", F.col("vec_id").alias("_id"), F.col("label").alias("_label")).write.parquet(f"{path}/rows")
    stamps = read_stamps(spark, f"{path}/npz", columns="path string, data array<float>, meta_vec_id bigint, meta_label int, error string")
    stamps = stamps.select(F.regexp_extract("path", r"([0-9a-f]+\.npz)$", 1).alias("file"), F.col("meta_vec_id").alias("vec_id"), F.col("meta_label").alias("label"), F.size("data").cast("long").alias("pixels"), F.array_min("data").cast("double").alias("least"), F.array_max("data").cast("double").alias("most"), "error")
    rows = spark.read.schema("file string, _id bigint, _label int").parquet(f"{path}/rows")
    lost = F.when(F.col("file").isNull(), "no array").when(F.col("pixels").isNull(), F.coalesce("error", F.lit("no file")))
    return rows.join(stamps, "file", "left").select(F.coalesce("vec_id", "_id").alias("vec_id"), F.coalesce("label", "_label").alias("label"), "pixels", "least", "most", lost.alias("error"))


@register("join_greedy_pairs", "WITH a AS (SELECT s_nationkey AS b, s_suppkey AS k, s_acctbal AS v FROM supplier), b AS (SELECT c_nationkey AS b, c_custkey AS k, c_acctbal AS v FROM customer), x AS (SELECT *, row_number() OVER (PARTITION BY b, k ORDER BY gap, below DESC, ord) AS n FROM (SELECT a.b, a.k, b.k AS o, abs(a.v - b.v) AS gap, (b.v <= a.v)::INT AS below, CASE WHEN b.v < a.v THEN -b.k ELSE b.k END AS ord FROM a JOIN b USING (b))), y AS (SELECT *, row_number() OVER (PARTITION BY b, o ORDER BY gap, below DESC, ord) AS n FROM (SELECT b.b, b.k AS o, a.k, abs(a.v - b.v) AS gap, (a.v <= b.v)::INT AS below, CASE WHEN a.v < b.v THEN -a.k ELSE a.k END AS ord FROM a JOIN b USING (b))) SELECT x.b, x.k AS s_suppkey, x.o AS c_custkey, x.gap FROM x JOIN y ON x.b = y.b AND x.k = y.k AND x.o = y.o WHERE x.n = 1 AND y.n = 1")
def _(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_nationkey").alias("b"), "s_suppkey", F.col("s_acctbal").alias("v"))
    b = read(spark, d, "customer").select(F.col("c_nationkey").alias("b"), "c_custkey", F.col("c_acctbal").alias("v"))
    return md.mutual_nearest(a, b, "b", "s_suppkey", "c_custkey", "v")


@register("join_greedy_pairs_per_bin")  # greedy choice has no SQL form
def _(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_nationkey").alias("b"), "s_suppkey", F.col("s_acctbal").alias("v"))
    b = read(spark, d, "customer").select(F.col("c_nationkey").alias("b"), "c_custkey", F.col("c_acctbal").alias("v"))
    return md.greedy_pairs(a, b, "b", "s_suppkey", "c_custkey", "v", 500.0)


@register("ev_known_recovery", SKY2 + ", m AS (SELECT s_suppkey, min(sep) AS sep FROM p GROUP BY 1) SELECT (SELECT count(*) FROM supplier) AS known, count(*) AS matched, count(*) FILTER (WHERE sep < 1) AS close, count(*) / (SELECT count(*) FROM supplier) AS recovered FROM m")
def _(spark, d):
    a, b = skies(spark, d)
    known = b.select("s_suppkey", F.col("ra2").alias("ra"), F.col("dec2").alias("dec"))
    found = j.nearest(known, a.select("c_custkey", F.col("ra").alias("ra2"), F.col("dec").alias("dec2")), 2.0, "s_suppkey", "c_custkey")
    n = read(spark, d, "supplier").agg(F.count(F.lit(1)).alias("known"))
    t = found.agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("sep") < 1).alias("close"))
    return n.crossJoin(t).withColumn("recovered", F.col("matched") / F.col("known"))  # one row each


def folds(spark, d):
    t = scored(spark, d).withColumn("held", c.hash_uniform("doc_id", 2) < 0.3)
    return t.where("NOT held"), t.where("held")


@register("ev_scalar_baseline")  # an optimiser has no SQL form
def _(spark, d):
    train, test = folds(spark, d)
    s = md.logistic(train, test, ["n_chars", "toxic"], "quality", "doc_id").withColumn("fold", F.lit(0))
    return md.probe_report(s, "quality").where("fold = 'all'").select("n", *[F.round(c, 3).alias(c) for c in ("auc", "accuracy", "brier")])


@register("ev_scalar_baseline_cv")  # an optimiser has no SQL form
def _(spark, d):
    t = scored(spark, d).withColumn("entity", F.concat_ws("/", "source", (F.col("n_chars") % 50).cast("string")))
    s = md.cross_validated(t, ["n_chars", "toxic"], "quality", "doc_id", 3, "entity")
    return md.probe_report(s, "quality").select("fold", "n", *[F.round(c, 3).alias(c) for c in ("auc", "accuracy", "brier")])


@register("ev_linear_probe_grouped")  # an optimiser has no SQL form
def _(spark, d):
    t = read(spark, d, "embeddings").withColumn("y", (F.col("label") % 2).cast("int")).withColumn("entity", F.floor(F.col("vec_id") / 4))
    s = md.cross_validated(t, "embedding", "y", "vec_id", 3, "entity")
    return md.probe_report(s, "y").select("fold", "n", *[F.round(c, 3).alias(c) for c in ("auc", "accuracy", "brier")])


@register("ev_ensemble")  # an optimiser has no SQL form
def _(spark, d):
    train, test = folds(spark, d)
    a, b = (md.logistic(train, test, [x], "quality", "doc_id").withColumnRenamed("score", x) for x in ("n_chars", "toxic"))
    both = a.join(b.drop("quality"), "doc_id").withColumn("half", c.hash_uniform("doc_id", 6) < 0.5)
    s = md.logistic(both.where("half"), both.where("NOT half"), ["n_chars", "toxic"], "quality", "doc_id")
    return s.select("doc_id", "quality", F.round("score", 3).alias("score"))


@register("ev_linear_probe")  # an optimiser has no SQL form
def _(spark, d):
    t = read(spark, d, "embeddings").withColumn("y", (F.col("label") % 2).cast("int"))
    s = md.probe(t, "embedding", "y", "vec_id", 3)
    return m.auc(s, "score", F.col("y") == 1, ["fold"]).select("fold", "n_pos", "n_neg", F.round("auc", 3).alias("auc"))


@register(
    "ev_covariance",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT a.i::INT AS i, b.i::INT AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM v a JOIN v b USING (vec_id) GROUP BY ALL""",
)
def _(spark, d):
    return md.covariance(read(spark, d, "embeddings").select(F.col("embedding").alias("v")), "v").select("i", "j", F.round("cov", 6).alias("cov"))


@register("ev_frechet")  # eigenvalues have no SQL form
def _(spark, d):
    t = read(spark, d, "embeddings")
    f = md.frechet(t.where("vec_id % 2 = 0"), t.where("vec_id % 2 = 1"), "embedding")
    return t.agg(F.count(F.lit(1)).alias("n")).withColumn("frechet", F.lit(round(f, 4)))


def mmd_sql(block: int) -> str:
    return f"""s AS (SELECT vec_id, vec_id % 2 AS side, embedding::DOUBLE[] AS v,
        floor({sql_uniform("vec_id", 3)} * (SELECT ceil(max(n) / {block}.0) FROM (SELECT count(*) AS n FROM embeddings GROUP BY vec_id % 2))) AS block FROM embeddings),
    k AS (SELECT a.block, a.side AS p, b.side AS q, a.vec_id = b.vec_id AS same, exp(-list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS k FROM s a JOIN s b USING (block)),
    e AS (SELECT block, avg(k) FILTER (WHERE p = 0 AND q = 0 AND NOT same) + avg(k) FILTER (WHERE p = 1 AND q = 1 AND NOT same) - 2 * avg(k) FILTER (WHERE p = 0 AND q = 1) AS estimate FROM k GROUP BY block)"""


@register("ev_mmd_blocks", f"WITH {mmd_sql(64)} SELECT round(avg(estimate), 6) AS mmd2, count(estimate) AS blocks FROM e")
def _(spark, d):
    t = read(spark, d, "embeddings")
    return md.mmd_blocks(t.where("vec_id % 2 = 0"), t.where("vec_id % 2 = 1"), "vec_id", "embedding", 1.0, 64).select(F.round("mmd2", 6).alias("mmd2"), "blocks")


@register("ev_mmd", f"WITH {mmd_sql(1024)} SELECT round(avg(estimate), 6) AS mmd2, count(estimate) AS blocks FROM e")
def _(spark, d):
    t = read(spark, d, "embeddings")
    out = md.mmd_blocks(t.where("vec_id % 2 = 0"), t.where("vec_id % 2 = 1"), "vec_id", "embedding", 1.0)
    return out.select(F.round("mmd2", 6).alias("mmd2"), "blocks")


@register("man_train", f"SELECT o_orderkey, 'g' || CAST(floor({sql_uniform('o_orderkey', 3)} * 4) AS INT) AS config, k::INT AS is_control, CASE WHEN k = 1 THEN 0 ELSE floor({sql_uniform('o_orderkey', 3)} * 4) * 0.5::DOUBLE END AS theta FROM orders, range(2) r(k)")
def _(spark, d):
    from starloom.plans.relations import grid

    one = j.modulo_assign(read(spark, d, "orders").select("o_orderkey"), grid(spark), "o_orderkey", "config", 3)
    return union_named(one.withColumn("is_control", F.lit(0)), one.withColumn("is_control", F.lit(1)).withColumn("theta", F.lit(0.0)))
