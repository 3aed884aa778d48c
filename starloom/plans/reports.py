"""Queries for evaluation reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from starloom.operators import evaluation as e
from starloom.operators import metrics as m
from starloom.operators import splits as sp
from starloom.operators.resampling import refit_test
from starloom.plans.aggregates import KS, rounded
from starloom.plans.evaluation import AUC, BINS, CONF, RANK, RATES, S, good, scored
from starloom.plans.registry import register
from starloom.plans.views import read


def summary_sql(section: str, subject: str, source: str) -> str:
    return f"""
        SELECT '{section}' AS section, {subject} AS subject, count(*) AS n, count(*) FILTER (WHERE score > 0.5) AS n_hit,
            round(count(*) FILTER (WHERE score > 0.5) / count(*), 9) AS rate, round(avg(score), 9) AS mean_score,
            round(quantile_cont(score, 0.5), 9) AS median_score, max(score) AS max_score
        FROM {source} GROUP BY ALL HAVING count(*) > 0"""


def top_sql(section: str, source: str, k: int) -> str:
    return f"""(SELECT '{section}' AS section, doc_id::VARCHAR AS subject, score AS max_score FROM {source} ORDER BY score DESC, doc_id LIMIT {k})"""


def anchors(spark, d):
    """Labelled documents as known objects: good ones in two tiers, the others excluded with a reason, some without a score."""
    t = scored(spark, d)
    tier = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), None).when(F.col("n_chars") % 3 == 0, "B").otherwise("A")
    reason = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor")
    score = F.when(F.col("doc_id") % 11 > 0, F.col("score"))
    return t.select("doc_id", tier.alias("tier"), reason.alias("reason"), ((F.col("n_chars") % 300) / 100).alias("theta"), score.alias("score"))


ANCHORS = """a AS (
    SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN NULL WHEN n_chars % 3 = 0 THEN 'B' ELSE 'A' END AS tier,
        CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' END AS reason,
        (n_chars % 300) / 100.0::DOUBLE AS theta, CASE WHEN doc_id % 11 > 0 THEN score END AS score
    FROM s), g AS (SELECT * FROM a WHERE tier IS NOT NULL AND score IS NOT NULL), f AS (SELECT * FROM g WHERE tier = 'A')"""
THETA = "CASE WHEN theta <= 1 THEN '<=1' WHEN theta <= 1.5 THEN '1-1.5' WHEN theta <= 2 THEN '1.5-2' ELSE '>2' END"


@register(
    "ev_anchor_set",
    f"""WITH {S}, {ANCHORS}
    {summary_sql('tier', 'tier', 'g')} UNION ALL BY NAME {summary_sql('tier', "'all'", 'g')}
    UNION ALL BY NAME {summary_sql('theta', THETA, '(FROM f WHERE theta > 0)')}
    UNION ALL BY NAME {top_sql('found', '(FROM f WHERE score > 0.5)', 5)}
    UNION ALL BY NAME {top_sql('missed', '(FROM f WHERE score <= 0.5)', 5)}
    UNION ALL BY NAME SELECT 'unscored' AS section, 'all' AS subject, count(*) AS n FROM a WHERE tier IS NOT NULL AND score IS NULL GROUP BY ALL
    UNION ALL BY NAME SELECT 'excluded' AS section, reason AS subject, count(*) AS n FROM a WHERE tier IS NULL GROUP BY ALL""",
)
def _(spark, d):
    return rounded(e.anchor_report(anchors(spark, d), "doc_id", "tier", "theta", "score", reason="reason"), 9)


PREVALENCE = {"src0": 0.4, "src1": 0.3, "src2": 0.05}


@register(
    "ev_contaminants",
    f"""WITH {S}, c AS (SELECT doc_id, source, CASE WHEN doc_id % 11 > 0 THEN score END AS score FROM s WHERE quality = 0),
    g AS (SELECT * FROM c WHERE score IS NOT NULL), r AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE score > 0.5) AS k FROM g GROUP BY 1),
    w AS (SELECT *, CASE source {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in PREVALENCE.items())} ELSE 0 END AS w FROM r)
    {summary_sql('all', "'all'", 'g')} UNION ALL BY NAME {summary_sql('category', 'source', 'g')}
    UNION ALL BY NAME SELECT 'weighted' AS section, 'all' AS subject, round(coalesce(sum(k / n * w) / nullif(sum(w), 0), sum(k) / nullif(sum(n), 0)), 9) AS rate FROM w
    UNION ALL BY NAME {top_sql('worst', '(FROM g WHERE score > 0.5)', 10)}
    UNION ALL BY NAME SELECT 'unscored' AS section, 'all' AS subject, count(*) AS n FROM c WHERE score IS NULL""",
)
def _(spark, d):
    t = scored(spark, d).where("quality = 0").withColumn("score", F.when(F.col("doc_id") % 11 > 0, F.col("score")))
    return rounded(e.contaminant_report(t, "doc_id", "source", "score", PREVALENCE), 9)


@register(
    "ev_gates",
    f"""WITH {S}, {ANCHORS}, c AS (SELECT *, {RATES} FROM (SELECT {CONF} FROM s)),
    r AS (SELECT count(*) FILTER (WHERE score > 0.5) / count(*) AS rate FROM f),
    t AS (SELECT 'recall' AS gate, recall AS value, 0.5 AS bound, recall >= 0.5 AS passed FROM c
        UNION ALL SELECT 'fpr', fpr, 0.2, fpr <= 0.2 FROM c
        UNION ALL SELECT 'anchor recall', rate, 0.4, rate >= 0.4 FROM r)
    SELECT gate, round(value, 9) AS value, bound::DOUBLE AS bound, passed FROM t UNION ALL SELECT 'all', NULL, NULL, bool_and(passed) FROM t""",
)
def _(spark, d):
    c = m.confusion(scored(spark, d), "score", good(), 0.5)
    first = e.anchor_report(anchors(spark, d), "doc_id", "tier", "theta", "score").where("section = 'tier' and subject = 'A'")
    return rounded(e.gate_report([("recall", c, "recall", ">=", 0.5), ("fpr", c, "fpr", "<=", 0.2), ("anchor recall", first, "rate", ">=", 0.4)]), 9)


def poisson_sql() -> str:
    edge, case = 0.0, "CASE"
    for k in range(8):
        edge += math.exp(-1) / math.factorial(k)
        case += f" WHEN u < {edge!r}::DOUBLE THEN {k}"
    return case + " ELSE 8 END"


def replicates_sql(source: str, b: int, by: str = "", threshold: str = "0.5") -> str:
    """CTEs up to z(by, b, auc, recall, precision) of source(by, doc_id, score, quality)."""
    u = "(('0x' || substr(sha256(doc_id::VARCHAR || '_' || b::VARCHAR || '_boot'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"
    by = by + ", " if by else ""
    return f"""x AS (SELECT *, {u} AS u FROM {source}, range({b}) r(b)), v AS (SELECT *, {poisson_sql()} AS w FROM x WHERE score IS NOT NULL),
    k AS (SELECT {by}b, score, sum(CASE WHEN quality = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN quality = 0 THEN w ELSE 0 END) AS n FROM v GROUP BY ALL),
    y AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by}b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
    z AS (SELECT {by}b, sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auc, sum(p) FILTER (WHERE score >= {threshold}) / nullif(sum(p), 0) AS recall,
        sum(p) FILTER (WHERE score >= {threshold}) / nullif(sum(p + n) FILTER (WHERE score >= {threshold}), 0) AS precision FROM y GROUP BY ALL)"""


@register(
    "ev_bootstrap",
    f"""WITH {S}, {replicates_sql('s', 20)}
    SELECT metric, round(avg(value), 9) AS mean, round(stddev(value), 9) AS std, round(quantile_cont(value, 0.025), 9) AS low,
        round(quantile_cont(value, 0.975), 9) AS high, count(value) AS valid
    FROM (FROM z UNPIVOT INCLUDE NULLS (value FOR metric IN (auc, recall, precision))) GROUP BY 1""",
)
def _(spark, d):
    return rounded(e.bootstrap_intervals(scored(spark, d), "doc_id", "score", good(), 0.5, 20), 9)


@register(
    "ev_bootstrap_replicates",
    f"WITH {S}, {replicates_sql('s', 20)} SELECT b::INT AS replicate, round(auc, 9) AS auc, round(recall, 9) AS recall, round(precision, 9) AS precision FROM z",
)
def _(spark, d):
    return rounded(e.replicate_metrics(scored(spark, d), "doc_id", "score", good(), 0.5, 20), 9)


@register(
    "ev_permutation",
    f"""WITH {S}, p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM s),
    l AS (SELECT b, quality, row_number() OVER (PARTITION BY b ORDER BY ('0x' || substr(sha256(doc_id::VARCHAR || '_' || b::VARCHAR || '_perm'), 1, 8))::UBIGINT, doc_id) AS i FROM s, range(10) r(b)),
    x AS (SELECT l.b, p.score, l.quality FROM p JOIN l USING (i)), t AS (SELECT *, {RANK.format(w='PARTITION BY b', p='b, ')} FROM x),
    n AS (SELECT b, {AUC} AS null_auc FROM t GROUP BY 1), o AS (SELECT {AUC} AS auc FROM (SELECT *, {RANK.format(w='', p='')} FROM s))
    SELECT round(any_value(auc), 9) AS auc, round(avg(null_auc), 9) AS mean_null, round(stddev(null_auc), 9) AS std_null,
        count(*) FILTER (WHERE round(null_auc, 12) >= round(auc, 12)) AS n_exceed, round((count(*) FILTER (WHERE round(null_auc, 12) >= round(auc, 12)) + 1) / 11.0::DOUBLE, 9) AS p_value FROM n, o""",
)
def _(spark, d):
    return rounded(e.permutation_test(scored(spark, d), "doc_id", "score", good(), 10), 9)


@register("ev_bootstrap_counts")  # draws of a generator have no SQL form
def _(spark, d):
    return rounded(e.bootstrap_intervals(scored(spark, d), "doc_id", "score", good(), 0.5, 200, draws="counts"), 9)


@register("ev_permutation_counts")  # draws of a generator have no SQL form
def _(spark, d):
    return rounded(e.permutation_test(scored(spark, d), "doc_id", "score", good(), 200, draws="counts"), 9)


@register("ev_permutation_refit")  # an optimiser has no SQL form
def _(spark, d):
    return rounded(refit_test(read(spark, d, "embeddings"), "vec_id", F.col("label") % 2 == 1, "embedding", 50), 4)


FEATURES = ("n_chars", "score", "toxic")
AUDIT = f"""f AS ({' UNION ALL '.join(f"SELECT '{x}' AS feature, doc_id, {x}::DOUBLE AS score, quality FROM s" for x in FEATURES)}),
    a AS (SELECT feature, count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg, {AUC} AS auc FROM (SELECT *, {RANK.format(w='PARTITION BY feature', p='feature, ')} FROM f) GROUP BY 1),
    {replicates_sql('f', 20, 'feature', '0')}, q AS (SELECT feature, quantile_cont(greatest(auc, 1 - auc), 0.025) AS auc_low, quantile_cont(greatest(auc, 1 - auc), 0.975) AS auc_high FROM z GROUP BY 1),
    h AS (SELECT feature, quantile_cont(score, 0.5) FILTER (WHERE quality = 1) AS pos_median, stddev_pop(score) FILTER (WHERE quality = 1) AS pos_std,
        quantile_cont(score, 0.5) FILTER (WHERE quality = 0) AS neg_median, stddev_pop(score) FILTER (WHERE quality = 0) AS neg_std FROM f GROUP BY 1),
    audit AS (SELECT feature, greatest(auc, 1 - auc) AS auc, n_pos, n_neg, auc_low, auc_high, pos_median, pos_std, neg_median, neg_std,
        abs(pos_median - neg_median) / greatest(pos_std + neg_std, 1e-10) AS separation, feature = 'toxic' AS is_expected, auc_low > 0.7 AS is_red, auc_low > 0.6 AS is_yellow FROM a JOIN q USING (feature) JOIN h USING (feature))"""


def audit(spark, d):
    return e.shortcut_audit(scored(spark, d), "doc_id", good(), FEATURES, 20, ["toxic"])


@register(
    "ev_shortcut_audit",
    f"""WITH {S}, {AUDIT} SELECT feature, n_pos, n_neg, {', '.join(f'round({x}, 6) AS {x}' for x in ('auc', 'auc_low', 'auc_high', 'pos_median', 'pos_std', 'neg_median', 'neg_std', 'separation'))},
    is_expected, is_red, is_yellow, is_red AND NOT is_expected AS is_shortcut FROM audit""",
)
def _(spark, d):
    return rounded(audit(spark, d))


@register(
    "ev_shortcut_gates",
    f"""WITH {S}, {AUDIT}, t AS (SELECT count(*) FILTER (WHERE is_red AND feature = 'n_chars')::DOUBLE AS c, max(auc) FILTER (WHERE feature = 'toxic') AS g,
        count(*) FILTER (WHERE is_red AND NOT is_expected)::DOUBLE AS r, count(*) FILTER (WHERE is_yellow AND NOT is_expected)::DOUBLE AS y FROM audit),
    u AS (SELECT 'no core shortcuts' AS gate, c AS value, 0.0 AS bound, c <= 0 AS passed FROM t UNION ALL SELECT 'signal separates', g, 0.55, g >= 0.55 FROM t
        UNION ALL SELECT 'no shortcuts', r, 0.0, r <= 0 FROM t UNION ALL SELECT 'few yellow flags', y, 3.0, y <= 3 FROM t)
    SELECT gate, round(value, 6) AS value, bound::DOUBLE AS bound, passed FROM u UNION ALL SELECT 'all', NULL, NULL, bool_and(passed) FROM u""",
)
def _(spark, d):
    return rounded(e.shortcut_gates(audit(spark, d), ["n_chars"], "toxic"))


@register(
    "ev_roc_tables",
    f"""WITH {S}, p AS (SELECT 'all' AS stratum, score FROM s WHERE quality = 1 UNION ALL SELECT lang, score FROM s WHERE quality = 1),
    z AS (SELECT stratum, count(*) + (SELECT count(*) FROM s WHERE quality = 0) AS n FROM p WHERE stratum IS NOT NULL GROUP BY 1 HAVING count(*) + (SELECT count(*) FROM s WHERE quality = 0) >= 150),
    b AS (SELECT stratum, score, 1 AS y FROM p UNION ALL SELECT stratum, score, 0 FROM z, s WHERE quality = 0),
    c AS (SELECT stratum, score, sum(y) AS p, sum(1 - y) AS q FROM b JOIN z USING (stratum) GROUP BY ALL),
    r AS (SELECT stratum, score, sum(q) OVER w / sum(q) OVER (PARTITION BY stratum) AS fpr, sum(p) OVER w / sum(p) OVER (PARTITION BY stratum) AS tpr FROM c WINDOW w AS (PARTITION BY stratum ORDER BY score DESC)),
    t AS (SELECT stratum, 'fpr_at_tpr' AS kind, x AS given, max_by(struct_pack(v := fpr, t := score), score) AS m FROM r, (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE]) AS x) WHERE tpr >= x GROUP BY ALL
        UNION ALL SELECT stratum, 'tpr_at_fpr', x, min_by(struct_pack(v := tpr, t := score), score) FROM r, (SELECT unnest([0.1::DOUBLE, 0.3::DOUBLE]) AS x) WHERE fpr <= x GROUP BY ALL)
    SELECT stratum, n, kind, given, round(m.v, 9) AS value, m.t AS threshold FROM t JOIN z USING (stratum)""",
)
def _(spark, d):
    return rounded(e.roc_tables(scored(spark, d), "score", good(), (0.5, 0.8), (0.1, 0.3), "lang", 150), 9)


@register(
    "ev_ece",
    f"""WITH {S}, {BINS}, q AS (SELECT quantile_cont(score, [{', '.join(f'{i / 10!r}::DOUBLE' for i in range(1, 10))}]) AS e FROM s),
    h AS (SELECT len(list_filter(e, lambda x: x < score)) AS bin, count(*) AS n, avg(score) AS confidence, avg(quality) AS accuracy FROM s, q GROUP BY 1)
    SELECT 'width' AS bins, round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece, round(max(abs(confidence - accuracy)), 6) AS mce FROM b
    UNION ALL SELECT 'mass', round(sum(n * abs(confidence - accuracy)) / sum(n), 6), round(max(abs(confidence - accuracy)), 6) FROM h""",
)
def _(spark, d):
    t = scored(spark, d)
    of = lambda curve, name: m.calibration_error(curve).select(F.lit(name).alias("bins"), "ece", "mce")
    return rounded(of(m.reliability(t, "score", good()), "width").unionAll(of(e.equal_mass_reliability(t, "score", good()), "mass")))


@register(
    "ev_brier",
    f"""WITH {S} SELECT round(avg((score - quality) * (score - quality)), 9) AS brier,
    {', '.join(f"count(*) FILTER (WHERE score >= {x}::DOUBLE) AS n_{round(100 * x)}, round(avg(quality) FILTER (WHERE score >= {x}::DOUBLE), 9) AS above_{round(100 * x)}" for x in (0.9, 0.95, 0.99))} FROM s""",
)
def _(spark, d):
    return rounded(e.brier(scored(spark, d), "score", good()), 9)


@register(
    "ev_recall_strata",
    f"""WITH {S}, r AS (SELECT source AS subject, count(*) AS n, avg((score >= 0.5)::INT) AS value FROM s WHERE quality = 1 GROUP BY 1),
    t AS (SELECT avg(value) AS mean, min(value) AS min, max(value) AS max, max(value) - min(value) AS spread FROM r)
    SELECT 'stratum' AS section, subject, n, round(value, 9) AS value, round(1.96 * sqrt(value * (1 - value) / n), 9) AS error FROM r
    UNION ALL BY NAME SELECT 'summary' AS section, subject, round(value, 9) AS value FROM (FROM t UNPIVOT (value FOR subject IN (mean, min, max, spread)))""",
)
def _(spark, d):
    return rounded(e.recall_strata(scored(spark, d).where("quality = 1"), "source", F.col("score") >= 0.5), 9)


def ks_p_sql(ks: str, n1: str, n2: str) -> str:
    x2 = f"({ks} * {ks} * {n1} * {n2} / ({n1} + {n2}))"
    terms = f"list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0::DOUBLE * j * j * {x2})))"
    return f"CASE WHEN sqrt({x2}) < 0.2 THEN 1.0 ELSE greatest(least({terms}, 1.0), 0.0) END"


@register("ev_ks", f"WITH {S}, t AS (SELECT n_chars AS v, quality = 1 AS y FROM s), k AS (WITH {KS[5:]}) SELECT *, round({ks_p_sql('ks', 'n1', 'n2')}, 6) AS p FROM k")
def _(spark, d):
    t = sp.ks(scored(spark, d), "n_chars", good())
    return t.select(F.round("ks", 9).alias("ks"), "n1", "n2", F.round(sp.ks_p(F.round("ks", 9), F.col("n1"), F.col("n2")), 6).alias("p"))


@register(
    "ev_class_balance",
    f"""WITH {S}, f AS ({' UNION ALL '.join(f"SELECT '{x}' AS feature, {x}::DOUBLE AS v, quality FROM s" for x in ('n_chars', 'score'))}),
    g AS (SELECT feature, avg(v) FILTER (WHERE quality = 1) AS mean1, avg(v) FILTER (WHERE quality = 0) AS mean0, stddev(v) FILTER (WHERE quality = 1) AS std1,
        stddev(v) FILTER (WHERE quality = 0) AS std0, count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n2 FROM f GROUP BY 1),
    c AS (SELECT feature, v, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM f GROUP BY ALL),
    k AS (SELECT feature, max(abs(a - b)) AS ks FROM (SELECT feature, sum(p) OVER w / sum(p) OVER (PARTITION BY feature) AS a, sum(n) OVER w / sum(n) OVER (PARTITION BY feature) AS b FROM c WINDOW w AS (PARTITION BY feature ORDER BY v)) GROUP BY 1)
    SELECT feature, round(mean1, 6) AS mean1, round(mean0, 6) AS mean0, round(std1, 6) AS std1, round(std0, 6) AS std0, round(mean1 / mean0, 6) AS ratio,
        round((mean1 - mean0) / sqrt((std1 * std1 + std0 * std0) / 2), 6) AS cohen_d, round(ks, 6) AS ks, round({ks_p_sql('ks', 'n1', 'n2')}, 6) AS ks_p,
        abs((mean1 - mean0) / sqrt((std1 * std1 + std0 * std0) / 2)) < 0.2 AS passed FROM g JOIN k USING (feature)""",
)
def _(spark, d):
    return rounded(e.class_separation(scored(spark, d), ("n_chars", "score"), good()))


PAIRS = (("l_extendedprice", "l_quantity"), ("l_discount", "l_tax"))


@register(
    "ev_correlation",
    " UNION ALL ".join(
        f"""SELECT '{y}' AS y, '{x}' AS x, count(*) AS n, round(corr({y}, {x}), 6) AS r, round(regr_slope({y}, {x}), 4) AS slope, round(regr_intercept({y}, {x}), 2) AS intercept,
        round(regr_r2({y}, {x}), 6) AS r2, round(avg({y} - {x}), 4) AS offset, round(stddev({y} - {x}), 4) AS offset_std FROM lineitem"""
        for y, x in PAIRS
    ),
)
def _(spark, d):
    places = {"r": 6, "slope": 4, "intercept": 2, "r2": 6, "offset": 4, "offset_std": 4}
    t = e.pair_stats(read(spark, d, "lineitem"), PAIRS)
    return t.select("y", "x", "n", *[F.round(c, p).alias(c) for c, p in places.items()])


@register(
    "ev_variant_compare",
    f"""WITH {S}, v AS (SELECT source AS variant, avg(((score >= 0.5) = (quality = 1))::INT) AS accuracy, avg(quality)::DOUBLE AS share FROM s GROUP BY 1),
    l AS (FROM v UNPIVOT (value FOR metric IN (accuracy, share))), b AS (SELECT metric, max(value) AS top, max(value) FILTER (WHERE variant = 'src0') AS base FROM l GROUP BY 1),
    g AS (SELECT *, value >= CASE metric WHEN 'accuracy' THEN 0.5 ELSE 0.8 END AS passed FROM l JOIN b USING (metric))
    SELECT variant, metric, round(value, 9) AS value, round(value - base, 9) AS delta, value = top AS best, passed, avg(passed::INT) OVER (PARTITION BY variant) AS pass_rate FROM g""",
)
def _(spark, d):
    hit = (F.col("score") >= 0.5) == good()
    v = scored(spark, d).groupBy("source").agg(F.avg(hit.cast("double")).alias("accuracy"), F.avg("quality").alias("share"))
    return rounded(e.compare_variants(v, "source", ("accuracy", "share"), "src0", {"accuracy": 0.5, "share": 0.8}), 9)


@register(
    "ev_score_quantiles",
    f"""WITH {S} SELECT source, count(score) AS n, round(avg(score), 9) AS mean, max(score) AS most, round(avg((score >= 0.9)::INT), 9) AS flagged,
    {', '.join(f"round(quantile_cont(score, {q}), 9) AS {n}" for q, n in ((0.5, 'p50'), (0.9, 'p90'), (0.95, 'p95'), (0.99, 'p99'), (0.999, 'p999')))} FROM s GROUP BY 1""",
)
def _(spark, d):
    return rounded(e.score_summary(scored(spark, d), "score", 0.9, ["source"]), 9)
