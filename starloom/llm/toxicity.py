"""Toxicity from the nearest labelled examples by TF-IDF cosine.

Terms are words and word beginnings that labelled rows tie to toxicity.
Labelled examples lie in an inverted index whose postings are cut into blocks
with their largest weights; a block is opened only if its bound can still
reach the k nearest, so the neighbours are exact. Their distance-weighted votes
are calibrated on left-out votes and come with evidence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, table
from starloom.llm.words import LETTERS, Words, prefixes, slices

#: Lengths in bytes of the word beginnings that may be terms.
BEGINNINGS = (4, 5, 6, 7)
BLOCK = 64


def fold(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5))


def _terms(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word indices, term hashes): whole words, then each length of beginning."""
    yield np.arange(len(w.hashes)), w.hashes
    for k in BEGINNINGS:
        yield prefixes(w, k)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): texts of the slice that hold the term, by label."""
    for batch in batches:
        label = np.asarray(batch.column(1).to_pylist(), np.int64)
        for w in slices(batch.column(0), LETTERS, lower=False, most=1 << 21):
            doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
            keys, docs = [], []
            for at, h in _terms(w):
                keys.append(h)
                docs.append(doc[at])
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])] if len(keys) else np.zeros(0, bool)
            keys, y = keys[new], label[w.row + docs[new]]
            head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            toxic = np.add.reduceat(y, head) if len(head) else y[:0]
            yield pa.RecordBatch.from_arrays([pa.array(keys[head].view(np.int64)), pa.array(toxic), pa.array(np.diff(np.r_[head, len(keys)]) - toxic)], names=["term", "toxic", "clean"])


class Vocabulary(NamedTuple):
    terms: np.ndarray  # sorted hashes
    idf: np.ndarray

    def vectors(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
        """(term places, weights of length 1, matched words) of each text, in order."""
        maybe = np.zeros(1 << 20, bool)
        low = np.uint64(len(maybe) - 1)
        maybe[(self.terms & low).astype(np.int64)] = True
        for w in slices(texts, LETTERS, lower=False):
            words, places = [], []
            for at, h in _terms(w):
                some = np.flatnonzero(maybe[(h & low).astype(np.int64)])
                if len(some) and len(self.terms):
                    p = np.minimum(np.searchsorted(self.terms, h[some]), len(self.terms) - 1)
                    ok = self.terms[p] == h[some]
                    words.append(at[some[ok]])
                    places.append(p[ok])
            words = np.concatenate(words) if words else np.zeros(0, np.int64)
            places = np.concatenate(places) if places else np.zeros(0, np.int64)
            doc = np.searchsorted(w.first, words, "right") - 1
            order = np.argsort(doc, kind="stable")
            doc, words, places = doc[order], words[order], places[order]
            cuts = np.searchsorted(doc, np.arange(len(w.first)))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    yield places[:0], np.zeros(0), []
                    continue
                t, n = np.unique(places[a:b], return_counts=True)
                x = (1 + np.log(n)) * self.idf[t]
                shown = [w.data[w.start[k] : w.end[k]].tobytes().decode("utf-8", "replace") for k in np.unique(words[a:b])[:5]]
                yield t, x / np.sqrt((x * x).sum()), shown


class Index(NamedTuple):
    """Distinct example vectors with counts, their postings in blocks of consecutive examples, and the calibration."""

    total: np.ndarray
    toxic: np.ndarray
    example: np.ndarray  # a document id as evidence
    bounds: np.ndarray  # term x block: largest weight
    post: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # of a term: examples, weights, first place of each block
    prior: float
    none: float  # rate among examples without any term
    raw: np.ndarray
    fitted: np.ndarray

    def nearest(self, t: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest, ties to the smaller number; blocks that cannot reach them stay closed."""
        bound = x @ self.bounds[t]
        order = np.argsort(-bound, kind="stable")
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        for b in order:
            if bound[b] <= 0 or len(best_s) >= k and bound[b] + 1e-9 < best_s[k - 1]:
                break
            score = np.zeros(BLOCK)
            for term, weight in zip(t, x, strict=True):
                ids, w, at = self.post[term]
                score[ids[at[b] : at[b + 1]] - b * BLOCK] += weight * w[at[b] : at[b + 1]]
            hit = np.flatnonzero(score > 0)
            best_i, best_s = np.r_[best_i, hit + b * BLOCK], np.r_[best_s, np.round(score[hit], 12)]
            top = np.lexsort((best_i, -best_s))[:k]
            best_i, best_s = best_i[top], best_s[top]
        return best_i, best_s

    def vote(self, i: np.ndarray, s: np.ndarray, less: tuple[int, int, int] | None = None) -> float:
        """Toxic share of the neighbours, nearer ones weighing more; less: (example, rows, toxic rows) to leave out."""
        n, y = self.total[i].astype(float), self.toxic[i].astype(float)
        if less:
            n[i == less[0]] -= less[1]
            y[i == less[0]] -= less[2]
        w = 1 / (1.05 - np.minimum(s, 1))
        return float(((w * y).sum() + 0.5 * self.prior) / ((w * n).sum() + 0.5))

    def score(self, t: np.ndarray, x: np.ndarray, k: int) -> tuple[float, np.ndarray]:
        if not len(t):
            return self.none, np.zeros(0, np.int64)
        i, s = self.nearest(t, x, k)
        v = self.vote(i, s)
        return float(np.clip(np.interp(v, self.raw, self.fitted), 0, 1)) if len(self.raw) else v, i


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best non-decreasing fit of y on x by pooling neighbours."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order], strict=True):
        pools.append([xi, xi, yi, wi])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            b, a = pools.pop(), pools.pop()
            pools.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]])
    flat = [(e, p[2]) for p in pools for e in dict.fromkeys((p[0], p[1]))]
    return np.array([e for e, _ in flat]), np.array([v for _, v in flat])


def build_index(examples: list[tuple[int, int, np.ndarray, np.ndarray]], terms: int, k: int) -> Index:
    """The index of (doc id, toxic, term places, weights); equal vectors are one entry with counts."""
    prior = (sum(e[1] for e in examples) + 0.5) / (len(examples) + 1)
    empty = [e for e in examples if not len(e[2])]
    merged: dict[tuple, list] = {}
    for doc, y, t, x in examples:
        if len(t):
            entry = merged.setdefault((t.tobytes(), np.round(x, 9).tobytes()), [0, 0, doc, t, x])
            entry[0] += 1
            entry[1] += y
            entry[2] = min(entry[2], doc)
    rows = sorted(merged.values(), key=lambda e: (e[3].tolist(), e[2]))  # like vectors share blocks
    n = len(rows)
    blocks = max(1, -(-n // BLOCK))
    lists: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
    for i, e in enumerate(rows):
        for t, x in zip(e[3], e[4], strict=True):
            lists[t].append((i, x))
    bounds, post = np.zeros((terms, blocks)), []
    for t, items in enumerate(lists):
        ids, w = np.array([i for i, _ in items], np.int64), np.array([x for _, x in items])
        np.maximum.at(bounds[t], ids // BLOCK, w)
        post.append((ids, w, np.searchsorted(ids, np.arange(blocks + 1) * BLOCK)))
    none = (sum(e[1] for e in empty) + 0.5 * prior) / (len(empty) + 0.5)
    column = lambda j: np.array([e[j] for e in rows], np.int64)
    index = Index(column(0), column(1), column(2), bounds, post, prior, none, np.zeros(0), np.zeros(0))
    votes: list[tuple[float, int, int]] = []
    for i, e in enumerate(rows):  # each example is judged by the others
        near, s = index.nearest(e[3], e[4], k)
        for y, count in ((1, e[1]), (0, e[0] - e[1])):
            if count:
                votes.append((index.vote(near, s, (i, 1, y)), y, count))
    if votes:
        raw, fitted = _isotonic(np.array([v for v, _, _ in votes]), np.array([float(y) for _, y, _ in votes]), np.array([float(c) for _, _, c in votes]))
        index = index._replace(raw=raw, fitted=fitted)
    return index


def _scorer(shared, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = shared.value
        known: dict[bytes, tuple] = {}
        for batch in batches:
            scores, near, words = [], [], []
            for t, x, shown in vocabulary.vectors(batch.column(1)):
                key = t.tobytes() + x.tobytes()
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    s, i = index.score(t, x, k)
                    known[key] = (s, index.example[i[:3]].tolist())
                scores.append(known[key][0])
                near.append(known[key][1])
                words.append(shown)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "score", "nearest", "matched"])

    return run


def _vectorizer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(shared.value.vectors(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.tolist() for t, _, _ in got], pa.list_(pa.int64())), pa.array([x.tolist() for _, x, _ in got], pa.list_(pa.float64()))], names=["doc_id", "toxic", "t", "x"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "toxic", most_labelled: int = 20_000, most_terms: int = 2_048, k: int = 16) -> DataFrame:
    """(doc_id, held_out, score, predicted, nearest, matched) of every row of docs.

    About ``most_labelled`` labelled rows outside fold 0 of crc32(key) mod 5,
    chosen by hash, are the examples. At most ``most_terms`` terms that occur
    with toxic examples several times as often as with clean ones, by the
    likelihood ratio statistic, make the vectors. Null, empty and unmatched
    texts get the toxic rate of examples without terms; without examples
    every score is 0. Equal texts get equal scores. A key with several labels
    counts as toxic if one of them is. nearest lists example ids, matched the
    words behind them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    lab = labels.where(F.col(target).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.max(F.col(target).cast("long")).alias("toxic")).where(fold("doc_id") != 0)
    count = lab.count()
    share = min(1.0, most_labelled / max(count, 1))
    lab = lab.where(F.pmod(F.xxhash64("doc_id", F.lit("examples")), F.lit(1 << 30)) < int(share * (1 << 30)))
    body = docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    train = scratch.keep(body.join(F.broadcast(lab), "doc_id").select("doc_id", "toxic", "text"), "examples")  # about most_labelled rows are broadcast
    n1, n0 = (int(v or 0) for v in train.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    held = (fold(key) == 0).alias("held_out")
    if not n1 + n0:
        return docs.select(F.col(key).alias("doc_id"), held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr("cast(array() as array<bigint>)").alias("nearest"), F.expr("cast(array() as array<string>)").alias("matched"))
    seen = train.select("text", "toxic").mapInArrow(_count_terms, "term bigint, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a >= 3")
    seen = scratch.keep(seen, "terms")
    bar = 2 * np.log(max(seen.count(), 1)) + 4  # so that chance passes hardly any of the terms tested
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    p = (a + b) / F.lit(float(n1 + n0))
    g = 2 * (part(a, p * n1) + part(b, p * n0))
    chosen = seen.where((a + 0.5) / (n1 + 1.0) > 4 * (b + 0.5) / (n0 + 1.0)).withColumn("g", F.round(g, 6)).where(F.col("g") > float(bar))
    top = sorted((int(np.int64(r.term).view(np.uint64)), r.a + r.b) for r in chosen.orderBy(F.desc("g"), "term").limit(most_terms).collect())
    vocabulary = Vocabulary(np.array([t for t, _ in top], np.uint64), np.array([1 + np.log((n1 + n0) / d) for _, d in top]))
    words = spark.sparkContext.broadcast(vocabulary)
    found = train.select("doc_id", "toxic", "text").mapInArrow(_vectorizer(words), "doc_id bigint, toxic bigint, t array<bigint>, x array<double>")
    rows = [(r.doc_id, r.toxic, np.array(r.t, np.int64), np.array(r.x)) for r in found.collect()]  # about most_labelled short vectors
    rows.sort(key=lambda r: r[0])
    shared = spark.sparkContext.broadcast((vocabulary, build_index(rows, len(top), k)))
    out = body.mapInArrow(_scorer(shared, k), "doc_id bigint, score double, nearest array<bigint>, matched array<string>")
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "nearest", "matched")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
