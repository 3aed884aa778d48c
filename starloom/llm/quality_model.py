"""Quality classifier from weak labels.

Simple labellers vote good, bad or nothing on every text. Expectation-
maximisation over the counts of vote patterns estimates how often each labeller
is right, without true labels. The resulting posteriors train a linear scorer on
hashed byte trigrams, which scores every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import frugal, table
from starloom.llm.words import SPACED, Words, mix, slices

SIZE = 2048
_LINES = np.zeros(256, bool)
_LINES[10] = True


def _class(chars: str | range) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) if isinstance(c, str) else c for c in chars]] = 1
    return out


_SYMBOL, _UPPER, _LOWER, _DIGIT, _BANG = _class("#*$%&|<>{}\\^~@="), _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58)), _class("!?")

#: Labellers that say "bad" or nothing, each for one kind of junk, and then those that say "good" or nothing.
BAD = ("symbols", "capitals", "bangs", "digits", "repeats", "lines", "words", "marks")
GOOD = ("prose", "calm", "varied")


def _repeated(h: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each text, the share of its ``width``-word windows that equal another one of it."""
    out = np.zeros(len(first) - 1)
    if len(h) < width:
        return out
    n = len(h) - width + 1
    g = h[:n].copy()
    for k in range(1, width):
        g = mix(g) + h[k : n + k]
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        m = b - a - width + 1
        if m > 1:
            out[i] = 1 - len(np.unique(g[a : a + m])) / m
    return out


def votes(w: Words, line_share: np.ndarray) -> np.ndarray:
    """texts x labellers: whether each of BAD, then of GOOD, votes."""
    total = lambda table: np.diff(np.r_[0, np.cumsum(table[w.data])][w.offsets])
    n = np.diff(w.first)
    size = np.maximum(np.diff(w.offsets), 1)
    upper, lower = total(_UPPER), total(_LOWER)
    letters = np.maximum(upper + lower, 1)
    lone = np.zeros(len(w.start) + 1, np.int64)
    one = (w.end - w.start == 1) & (_SYMBOL[w.data[w.start]] == 1) if len(w.start) else np.zeros(0, bool)
    lone[1:] = np.cumsum(one)
    width = (size - (n - 1)) / np.maximum(n, 1)
    repeats = _repeated(w.hashes, w.first, 3)
    symbols, bangs, caps = total(_SYMBOL) / size, total(_BANG) / np.maximum(n, 1), upper / letters
    marks = (lone[w.first[1:]] - lone[w.first[:-1]]) / np.maximum(n, 1)
    bad = [symbols >= 0.04, caps >= 0.5, bangs >= 0.25, total(_DIGIT) / size >= 0.3, (n >= 30) & (repeats >= 0.6), line_share >= 0.6, (n > 0) & ((width > 15) | (width < 2)), marks >= 0.1]
    good = [(symbols <= 0.01) & (total(_DIGIT) / size <= 0.15), (caps <= 0.3) & (bangs <= 0.1), (repeats <= 0.5) & (line_share <= 0.5)]
    return np.stack(bad + good, axis=1)


def _line_shares(texts: pa.Array) -> np.ndarray:
    """For each text, the share of its lines that repeat an earlier one."""
    return np.concatenate([_repeated(w.hashes, w.first, 1) for w in slices(texts, _LINES, lower=False)] or [np.zeros(0)])


def _patterns(texts: pa.Array) -> list[str]:
    shares, out = _line_shares(texts), []
    for w in slices(texts, SPACED, lower=False):
        out += ["".join("01"[v] for v in row) for row in votes(w, shares[w.row : w.row + len(w.first) - 1]).astype(int).tolist()]
    return out


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, n = np.unique(np.array(_patterns(batch.column(0)), str), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(seen.tolist(), pa.string()), pa.array(n.astype(np.int64))], names=["pattern", "n"])


def estimate(patterns: dict[str, int], rounds: int = 500, bad: float = 0.1, weight: float = 0.01) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """(P(good) of each vote pattern; chance of each labeller's vote on good and on bad texts; shares of good and bad texts), by expectation-maximisation.

    Junk comes in kinds, one for each labeller that says "bad", so the hidden
    classes are good texts and each kind of bad ones, with a chance of every
    labeller's vote in each. Votes and silence both count: a text on which no
    labeller says "bad" is unlikely in any kind, so its posterior is near one.
    The search starts from labellers that mostly see their own kind and from a
    share ``bad`` of bad texts; a prior worth ``weight`` of all texts keeps
    chances off zero and one. At most 2^labellers patterns exist. Without
    patterns the start is returned.
    """
    keys = sorted(patterns)
    count = np.array([patterns[k] for k in keys], float)
    v = np.array([[c == "1" for c in k] for k in keys], bool).reshape(len(keys), len(BAD) + len(GOOD))
    kinds = len(BAD)
    start = np.hstack([np.vstack([np.full(kinds, 0.01), np.where(np.eye(kinds) > 0, 0.9, 0.1)]), np.r_[[[0.9] * len(GOOD)], np.full((kinds, len(GOOD)), 0.5)]])
    at_first = np.r_[1 - bad, np.full(kinds, bad / kinds)]
    chance, share, prior = start.copy(), at_first.copy(), weight * count.sum()
    p = np.ones((1 + kinds, 0))
    for _ in range(rounds if keys else 0):
        like = np.log(share)[:, None] + np.log(chance) @ v.T + np.log(1 - chance) @ ~v.T
        p = np.exp(like - like.max(axis=0))
        p /= p.sum(axis=0)
        weights = p * count
        chance = (weights @ v + prior * start) / (weights.sum(axis=1, keepdims=True) + prior)
        share = (weights.sum(axis=1) + prior * at_first) / (count.sum() + prior)
    on_bad = share[1:] @ chance[1:] / share[1:].sum()
    return dict(zip(keys, p[0].tolist(), strict=True)), np.stack([chance[0], on_bad]), np.array([share[0], share[1:].sum()])


def _vectors(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(words, hashed trigram vector of length 1) of each text."""
    for w in slices(texts, SPACED, lower=False):
        d = w.data.astype(np.uint32)
        h = ((d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)).astype(np.int64) if len(d) > 2 else np.zeros(0, np.int64)
        for i, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
            x = np.log1p(np.bincount(h[a : max(a, b - 2)], minlength=SIZE)).astype(np.float32)
            norm = float(np.sqrt((x * x).sum()))
            yield int(w.first[i + 1] - w.first[i]), x / norm if norm else x


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.round(v * 255).astype(np.uint8).tobytes() for _, v in _vectors(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(_patterns(batch.column(0)), pa.string()), pa.array(x, pa.binary())], names=["pattern", "x"])


def fit(x: np.ndarray, y: np.ndarray, steps: int = 500, rate: float = 20.0, ridge: float = 1e-5) -> np.ndarray:
    """Weights and bias of a logistic scorer, by accelerated full-batch steps."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    c = np.float32(1 / max(len(x), 1))
    w, last = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        at = w + t / (t + 3) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        last, w = w, at - rate * (x.T @ (c * (p - y)) + ridge * at)
    return w


def _scorer(weights: np.ndarray, text: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [float(1 / (1 + np.exp(-np.clip(v @ weights[:-1] + weights[-1], -30, 30)))) if n else 0.0 for n, v in _vectors(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=names)

    return run


def score_quality(docs: DataFrame, text: str = "text", most_rows: int = 8_000) -> DataFrame:
    """docs plus quality_score (0 to 1, higher is better) of each whole text.

    Vote patterns are counted over all texts. The scorer is fitted on about
    ``most_rows`` distinct texts, chosen by text hash, with the posteriors of
    their patterns as targets. Null and wordless texts score 0; equal texts score the
    same, so ties and repeated rows do; a text of any length is scored whole;
    an empty table gives no rows. A column named quality_score is an error.
    """
    if "quality_score" in docs.columns:
        raise ValueError("docs must not have a column named quality_score")
    body = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = {r.pattern: r.n for r in body.mapInArrow(frugal(_vote), "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    known, _, _ = estimate(seen)
    share = min(1.0, most_rows / max(sum(seen.values()), 1))
    some = body.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().mapInArrow(frugal(_sampler), "pattern string, x binary").toArrow()
    x = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, SIZE).astype(np.float32) / 255
    y = np.array([known.get(k, 0.5) for k in some.column(0).to_pylist()], np.float32)
    weights = fit(x, y) if len(y) else np.zeros(SIZE + 1, np.float32)
    names = [*docs.columns, "quality_score"]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", quality_score double"
    return docs.mapInArrow(frugal(_scorer(weights, docs.columns.index(text), names)), schema)


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5, **how) -> DataFrame:
    """Rows of docs that score ``least`` or more, with their columns, whatever those are named."""
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return score_quality(plain, f"_{docs.columns.index(text)}", **how).where(F.col("quality_score") >= least).select(*plain.columns).toDF(*docs.columns)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("kept"))
