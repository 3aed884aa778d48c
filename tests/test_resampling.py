"""Draws on counts against draws on rows, and refits fitted together against refits one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import evaluation as e
from starloom.operators import resampling as r


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    s, y = np.asarray(scores)[order], np.asarray(labels)[order].astype(bool)
    _, first, n = np.unique(s, return_index=True, return_counts=True)
    rank = np.repeat(first + (n + 1) / 2, n)
    p = y.sum()
    return (rank[y].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    y = rng.random(600) < 0.4
    s = np.round(rng.normal(size=600) + 0.4 * y, 1)
    return spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(s, y, strict=True))] + [(600, None, True)], "id int, score double, y boolean").repartition(4), s, y


def test_bootstrap_on_counts_has_the_spread_of_rows(spark, rows):
    t, s, y = rows
    both = {d: {x.metric: x for x in e.bootstrap_intervals(t, "id", "score", F.col("y"), 0.2, 100, draws=d).collect()} for d in ("rows", "counts")}
    for metric in ("auc", "recall", "precision"):
        a, b = both["rows"][metric], both["counts"][metric]
        assert abs(a["mean"] - b["mean"]) < 5 * a["std"] / math.sqrt(100) and 0.7 < a["std"] / b["std"] < 1.45 and a.valid == b.valid == 100
    assert abs(both["counts"]["auc"]["mean"] - auc(s, y)) < 0.01
    again = r.poisson_counts(t.repartition(7), "score", F.col("y"), 5).collect()
    assert sorted(again) == sorted(r.poisson_counts(t, "score", F.col("y"), 5).collect())


@pytest.mark.parametrize("draws", ["rows", "counts"])
def test_no_row_is_copied(rows, draws):
    t = rows[0]
    source = r.poisson_counts(t, "score", F.col("y"), 20) if draws == "counts" else e._weighted_counts(t, "id", "score", F.col("y"), 20, [])
    plan = source._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Generate" not in plan.split("Aggregate", 1)[1]  # what is above the aggregate holds distinct scores only


def test_dealt_labels_have_the_null_of_shuffles(spark, rows):
    t, s, y = rows
    null = np.array([x.null for x in r.permuted_auc(t, "score", F.col("y"), 2000).collect()])
    rng = np.random.default_rng(3)
    want = np.array([auc(s, rng.permutation(y)) for _ in range(2000)])
    assert abs(null.mean() - want.mean()) < 5 * want.std() / math.sqrt(1000) and 0.9 < null.std() / want.std() < 1.1
    got = e.permutation_test(t, "id", "score", F.col("y"), 99, draws="counts").first()
    assert math.isclose(got.auc, auc(s, y), abs_tol=1e-12) and got.p_value == (got.n_exceed + 1) / 100
    one_sided = e.permutation_test(t.where("y"), "id", "score", F.col("y"), 9, draws="counts").first()
    assert one_sided.auc is None and one_sided.mean_null is None


def test_deals_keep_totals():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 0, 3, 1000, 2])
    out = r.deal(rng, sizes, np.array([0, 1010, 7, 500]))
    assert (out.sum(axis=0) == [0, 1010, 7, 500]).all() and (out <= sizes[:, None]).all() and (out >= 0).all()
    big = r.hypergeometric(rng, np.full(4000, 3 * 10**9), np.full(4000, 10**9), 10**6)
    assert abs(big.mean() - 750_000) < 60 and 0.9 < big.std() / math.sqrt(10**6 * 0.1875 * (1 - 10**6 / 4e9)) < 1.1


def fit(x, y, l2=1.0):
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.diag([l2] * x.shape[1] + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    return w


def test_refits_together_match_refits_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n, d, replicates = 500, 4, 19
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 1] + [0, 3, 0, 0]
    y = rng.random(n) < 1 / (1 + np.exp(-1.2 * x[:, 0] + 1.0))
    t = spark.createDataFrame([(i, v.tolist(), bool(b)) for i, (v, b) in enumerate(zip(x, y, strict=True))] + [(n, None, True), (n + 1, [None] * d, True)], "id int, v array<double>, y boolean").repartition(3)
    held = {q.id for q in t.where(r.hash_uniform("id", 0) < 0.2).collect()}
    test = np.array([i in held for i in range(n)])
    seen = []
    original = r.Stored.keep
    monkeypatch.setattr(r.Stored, "keep", lambda self, df: seen.append(original(self, df)) or seen[-1])
    got = {q.model: q.auc for q in r.permutation_refit(t, "id", F.col("y"), "v", replicates).collect()}
    assert len(got) == replicates + 1
    place = {tuple(v): i for i, v in enumerate(x.tolist())}
    marks = np.zeros((n, replicates + 1))
    for q in next(s for s in seen if "bits" in s.columns).collect():
        marks[place[tuple(q.x)]] = np.unpackbits(np.frombuffer(q.bits, np.uint8))[: replicates + 1]
    assert (marks[:, 0] == y).all() and (marks.sum(axis=0) == y.sum()).all()
    mean, std = x[~test].mean(axis=0), x[~test].std(axis=0)
    z, want = (x - mean) / std, []
    for m in range(replicates + 1):
        w = fit(z[~test], marks[~test, m])
        want.append(auc(np.c_[z[test], np.ones(test.sum())] @ w, marks[test, m]))
    assert max(abs(got[m] - want[m]) for m in range(replicates + 1)) < 2e-3
    p = r.refit_test(t, "id", F.col("y"), "v", replicates).first()
    assert abs(p.p_value - (sum(a >= want[0] for a in want[1:]) + 1) / (replicates + 1)) <= 1 / (replicates + 1) + 1e-12
    assert r.permutation_refit(t.where("false"), "id", F.col("y"), "v", 3).count() == 0
