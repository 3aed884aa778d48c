"""Queries for metrics and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from starloom.functions import columns as c
from starloom.operators import metrics as m
from starloom.operators import quality as q
from starloom.plans.aggregates import rounded
from starloom.plans.columns import CUTS, SQL_CUTS, part_cuts
from starloom.plans.registry import register
from starloom.plans.views import read, sql_uniform


def scored(spark, d):
    """Documents with labels; the score is a bounded function of the length."""
    t = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, d, "labels"), "doc_id")
    return t.withColumn("score", (F.col("n_chars") % 1000) / F.lit(1000.0))


S = "s AS (SELECT doc_id, lang, source, n_chars, quality, toxic, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def good():
    return F.col("quality") == 1


CONF = "count(*) FILTER (WHERE score >= 0.5 AND quality = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND quality = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND quality = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND quality = 0) AS tn"
RATES = "tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision, fp / nullif(fp + tn, 0) AS fpr, tn / nullif(tn + fp, 0) AS specificity"


@register("ev_confusion", f"WITH {S} SELECT *, {RATES} FROM (SELECT {CONF} FROM s)")
def _(spark, d):
    return m.confusion(scored(spark, d), "score", good(), 0.5)


AUC = "(sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0), 0)"
RANK = "rank() OVER ({w} ORDER BY score) + (count(*) OVER (PARTITION BY {p}score) - 1) / 2.0::DOUBLE AS r"


@register("ev_auc", f"WITH {S} SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg, round({AUC}, 9) AS auc FROM (SELECT *, {RANK.format(w='', p='')} FROM s)")
def _(spark, d):
    return rounded(m.auc(scored(spark, d), "score", good()), 9)


@register("ev_stratified_auc", f"WITH {S} SELECT lang, count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg, CASE WHEN count(*) FILTER (WHERE quality = 0) >= 10 AND count(*) FILTER (WHERE quality = 1) >= 10 THEN round({AUC}, 9) END AS auc FROM (SELECT *, {RANK.format(w='PARTITION BY lang', p='lang, ')} FROM s) GROUP BY 1")
def _(spark, d):
    return rounded(m.auc(scored(spark, d), "score", good(), ["lang"], 10), 9)


@register("ev_by_group", f"WITH {S} SELECT *, {RATES} FROM (SELECT source, {CONF} FROM s GROUP BY 1)")
def _(spark, d):
    return m.confusion(scored(spark, d), "score", good(), 0.5, ["source"])


ROC = "c AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM s GROUP BY 1), roc AS (SELECT score AS threshold, sum(n) OVER w / sum(n) OVER () AS fpr, sum(p) OVER w / sum(p) OVER () AS tpr FROM c WINDOW w AS (ORDER BY score DESC))"


@register("ev_roc_points", f"WITH {S}, {ROC} SELECT threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc")
def _(spark, d):
    return m.roc_points(scored(spark, d), "score", good()).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@register("ev_tpr_at_fpr", f"WITH {S}, {ROC}, a AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE]) AS rate), b AS (SELECT rate, (SELECT max(struct_pack(f := fpr, t := tpr)) FROM roc WHERE fpr <= rate) AS lo, (SELECT min(struct_pack(f := fpr, t := tpr)) FROM roc WHERE fpr > rate) AS hi FROM a) SELECT rate, round(coalesce(coalesce(lo.t, 0) + (hi.t - coalesce(lo.t, 0)) / (hi.f - coalesce(lo.f, 0)) * (rate - coalesce(lo.f, 0)), lo.t, 0), 9) AS tpr FROM b")
def _(spark, d):
    return rounded(m.tpr_at_fpr(scored(spark, d), "score", good(), (0.05, 0.1, 0.5)), 9).withColumnRenamed("at", "rate")


@register("ev_partial_auc", f"WITH {S}, {ROC}, x AS (SELECT fpr, min(tpr) AS t0, max(tpr) AS t1 FROM roc GROUP BY 1), y AS (SELECT *, coalesce(lag(fpr) OVER (ORDER BY fpr), 0) AS f0, coalesce(lag(t1) OVER (ORDER BY fpr), 0) AS y0 FROM x), z AS (SELECT sum(CASE WHEN f0 >= 0.2 THEN 0 WHEN fpr <= 0.2 THEN (fpr - f0) * (y0 + t0) / 2 ELSE (0.2::DOUBLE - f0) * (y0 + y0 + (t0 - y0) * (0.2::DOUBLE - f0) / (fpr - f0)) / 2 END) AS area FROM y) SELECT round(area, 9) AS area, round(0.5 * (1 + (area - 0.02) / 0.18), 9) AS standardised FROM z")
def _(spark, d):
    return rounded(m.partial_auc(scored(spark, d), "score", good(), 0.2), 9)


@register("ev_roc_pr", f"WITH {S}, g AS (SELECT unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS threshold) SELECT threshold, count(*) FILTER (WHERE score >= threshold AND quality = 1) / count(*) FILTER (WHERE quality = 1) AS tpr, count(*) FILTER (WHERE score >= threshold AND quality = 0) / count(*) FILTER (WHERE quality = 0) AS fpr, count(*) FILTER (WHERE score >= threshold AND quality = 1) / nullif(count(*) FILTER (WHERE score >= threshold), 0) AS precision FROM s, g GROUP BY 1")
def _(spark, d):
    return m.threshold_grid(scored(spark, d), "score", good(), (0.2, 0.5, 0.8))


BINS = "b AS (SELECT least(CAST(floor(score * 10) AS INT), 9) AS bin, count(*) AS n, avg(score) AS confidence, avg(quality) AS accuracy FROM s GROUP BY 1)"


@register("ev_reliability", f"WITH {S}, {BINS} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def _(spark, d):
    return rounded(m.reliability(scored(spark, d), "score", good()))


@register("ev_bin_balanced_auc", f"WITH {S}, q AS (SELECT lang, count(*) AS k FROM s WHERE quality = 0 GROUP BY 1), x AS (SELECT s.*, row_number() OVER (PARTITION BY lang, quality ORDER BY {sql_uniform('doc_id', 4)}, doc_id) AS i FROM s), y AS (SELECT x.* FROM x JOIN q USING (lang) WHERE i <= k), t AS (SELECT *, {RANK.format(w='PARTITION BY lang', p='lang, ')} FROM y) SELECT lang, count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg, round({AUC}, 9) AS auc FROM t GROUP BY 1")
def _(spark, d):
    t = scored(spark, d)
    quota = t.where("quality = 0").groupBy("lang").agg(F.count(F.lit(1)).alias("k"))
    i = F.row_number().over(Window.partitionBy("lang", "quality").orderBy(c.hash_uniform("doc_id", 4), "doc_id"))
    return rounded(m.auc(t.withColumn("i", i).join(quota, "lang").where("i <= k"), "score", good(), ["lang"]), 9)


@register("ev_batch_score", "SELECT vec_id, round(sum(x), 4) AS score FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def _(spark, d):
    def total(frame):
        return frame["embedding"].map(lambda v: float(v.astype("float64").sum()))

    out = m.batch_score(read(spark, d, "embeddings"), total, ["embedding"], ["vec_id"])
    return out.where("error is null").select("vec_id", F.round("score", 4).alias("score"))


# data quality


@register("dq_null_nan", " UNION ALL ".join(f"SELECT '{x}' AS subject, 'nulls' AS name, count(*) FILTER (WHERE {x} IS NULL)::DOUBLE AS value FROM orders UNION ALL SELECT '{x}', 'nans', {'count(*) FILTER (WHERE isnan(' + x + '))' if x == 'o_totalprice' else '0'}::DOUBLE FROM {'orders' if x == 'o_totalprice' else '(SELECT 1)'}" for x in ("o_orderkey", "o_totalprice", "o_orderpriority")))
def _(spark, d):
    return q.null_nan(read(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderpriority"])


@register("dq_flag_recompute", "WITH t AS (SELECT o_totalprice > 200000 AS a, o_totalprice > 200100 AS b FROM orders) SELECT 'bright' AS subject, name, value::DOUBLE AS value FROM (SELECT count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE NOT a AND NOT b) AS tn, count(*) FILTER (WHERE a AND NOT b) AS fp, count(*) FILTER (WHERE NOT a AND b) AS fn FROM t) UNPIVOT (value FOR name IN (tp, tn, fp, fn))")
def _(spark, d):
    return q.flag_match(read(spark, d, "orders"), {"bright": (F.col("o_totalprice") > 200000, F.col("o_totalprice") > 200100)})


@register("dq_hierarchy", f"WITH t AS (SELECT {SQL_CUTS} FROM part) " + " UNION ALL ".join(f"SELECT '{x}=>{y}' AS subject, 'violations' AS name, count(*) FILTER (WHERE {x} AND NOT {y})::DOUBLE AS value FROM t" for x, y in zip(list(CUTS)[:-1], list(CUTS)[1:], strict=True)))
def _(spark, d):
    return q.hierarchy(part_cuts(read(spark, d, "part")), list(CUTS))


RULES = "SELECT '{n}' AS name, '{s}' AS severity, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS failed, count(*) FILTER (WHERE NOT coalesce({c}, false)) = 0 AS passed FROM orders"
GATES = (("status known", "error", "o_orderstatus IN ('F', 'O', 'P')"), ("price positive", "error", "o_totalprice > 0"), ("price moderate", "warn", "o_totalprice < 400000"))
