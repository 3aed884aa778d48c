"""Benchmark decontamination with a generalised suffix automaton.

The automaton of the normalised test items recognises every run of words that
any item holds. Training words stream through it and the longest match ending
at each word is tracked; a match as long as a window hits the words under it.
Spans or documents beyond given limits are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import free_name, frugal, positions, table
from starloom.llm.words import PUNCTUATED, slices

#: Words of test items in one automaton, which is broadcast; a larger benchmark is cut into several, used one after another.
SHARD_WORDS = 100_000


class Automaton(NamedTuple):
    """States are numbers; step maps state * vocabulary + token to a state."""

    vocabulary: np.ndarray  # sorted word hashes; a token is a place here
    pairs: np.ndarray  # sorted token * vocabulary + token of neighbours in items
    step: dict[int, int]
    link: list[int]
    length: list[int]
    items: dict[int, frozenset[str]]  # state of a window's words: items that hold it
    short: dict[int, frozenset[str]]  # state of a whole item shorter than a window: those items
    window: int
    least: int  # words of the shortest window


def build(items: list[tuple[str, np.ndarray]], window: int = 13) -> Automaton | None:
    """The automaton of (item id, word hashes); items without words add nothing."""
    items = [(k, h) for k, h in items if len(h)]
    if not items:
        return None
    vocabulary = np.unique(np.concatenate([h for _, h in items]))
    size = len(vocabulary)
    texts = [(k, np.searchsorted(vocabulary, h)) for k, h in items]
    pairs = np.unique(np.concatenate([t[:-1] * size + t[1:] for _, t in texts]))
    step: dict[int, int] = {}
    out: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def fresh(n: int, edges: dict[int, int], up: int) -> int:
        out.append(edges)
        length.append(n)
        link.append(up)
        return len(out) - 1

    def split(p: int, c: int, q: int) -> int:
        """The part of q that p reaches by c, as a state of its own."""
        copy = fresh(length[p] + 1, dict(out[q]), link[q])
        link[q] = copy
        while p >= 0 and out[p].get(c) == q:
            out[p][c] = copy
            p = link[p]
        return copy

    ends: list[list[int]] = []
    for _, tokens in texts:
        last, path = 0, []
        for c in tokens.tolist():
            q = out[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else split(last, c, q)
            else:
                now, p = fresh(length[last] + 1, {}, 0), last
                while p >= 0 and c not in out[p]:
                    out[p][c] = now
                    p = link[p]
                if p >= 0:
                    q = out[p][c]
                    link[now] = q if length[q] == length[p] + 1 else split(p, c, q)
                last = now
            path.append(last)
        ends.append(path)
    holds: dict[int, set[str]] = {}
    whole: dict[int, set[str]] = {}
    for (k, tokens), _ in zip(texts, ends, strict=True):
        s, n = 0, 0
        for c in tokens.tolist():  # walked again, since later items may have split states
            s, n = out[s][c], n + 1
            if n > window:
                n = window
            while link[s] >= 0 and length[link[s]] >= n:
                s = link[s]
            if n == window:
                holds.setdefault(s, set()).add(k)
        if len(tokens) < window:
            whole.setdefault(s, set()).add(k)
    for s, edges in enumerate(out):
        for c, q in edges.items():
            step[s * size + c] = q
    freeze = lambda d: {s: frozenset(v) for s, v in d.items()}
    return Automaton(vocabulary, pairs, step, link, length, freeze(holds), freeze(whole), window, min([window, *(len(t) for _, t in texts)]))


def trace(a: Automaton, tokens: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
    """(start, end) of each window that occurs in the tokens, and the items that hold one."""
    size, state, n = len(a.vocabulary), 0, 0
    spans: list[tuple[int, int]] = []
    names: set[str] = set()
    for i, c in enumerate(tokens):
        while state and state * size + c not in a.step:
            state = a.link[state]
            n = a.length[state]
        if state * size + c in a.step:
            state, n = a.step[state * size + c], n + 1
        s = state
        if n >= a.window:
            while a.length[a.link[s]] >= a.window:
                s = a.link[s]
            spans.append((i + 1 - a.window, i + 1))
            names |= a.items[s]
        if a.short:
            s = state
            while s > 0:
                if s in a.short and a.length[s] <= n:
                    spans.append((i + 1 - a.length[s], i + 1))
                    names |= a.short[s]
                s = a.link[s]
    return spans, names


HITS = "n_words bigint, hits array<struct<start:int,end:int>>, items array<string>"


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searcher(shared, text: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Automaton = shared.value
        size = len(a.vocabulary)
        maybe = np.zeros(1 << 20, bool)  # most words are in no item
        low = np.uint64(len(maybe) - 1)
        maybe[(a.vocabulary & low).astype(np.int64)] = True
        for batch in batches:
            old_hits, old_items = batch.column(names.index("hits")).to_pylist(), batch.column(names.index("items")).to_pylist()
            count = np.zeros(batch.num_rows, np.int64)
            for w in slices(batch.column(text), PUNCTUATED):
                count[w.row : w.row + len(w.first) - 1] = np.diff(w.first)
                at = np.flatnonzero(maybe[(w.hashes & low).astype(np.int64)])
                place = np.minimum(np.searchsorted(a.vocabulary, w.hashes[at]), size - 1)
                ok = a.vocabulary[place] == w.hashes[at]
                at, place = at[ok], place[ok]
                if not len(at):
                    continue
                doc = np.searchsorted(w.first, at, "right") - 1
                pair = place[:-1] * size + place[1:]
                near = np.minimum(np.searchsorted(a.pairs, pair), max(len(a.pairs) - 1, 0))
                joined = (np.diff(at) == 1) & (np.diff(doc) == 0) & (a.pairs[near] == pair if len(a.pairs) else False)
                cuts = np.flatnonzero(np.r_[True, ~joined, True])
                for k in np.flatnonzero(np.diff(cuts) >= a.least):
                    b, e = cuts[k], cuts[k + 1]
                    spans, found = trace(a, place[b:e].tolist())
                    if spans:
                        r = w.row + int(doc[b])
                        zero = int(at[b]) - int(w.first[doc[b]])
                        old_hits[r] = _merge([(x["start"], x["end"]) if isinstance(x, dict) else x for x in old_hits[r]] + [(zero + x, zero + y) for x, y in spans])
                        old_items[r] = sorted({*old_items[r], *found})
            hits = [[x if isinstance(x, dict) else {"start": x[0], "end": x[1]} for x in h] for h in old_hits]
            own = {"n_words": pa.array(count), "hits": pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "items": pa.array(old_items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(i) for i, c in enumerate(names)], names=names)

    return run


def _counter(text: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            for w in slices(batch.column(text), PUNCTUATED):
                count[w.row : w.row + len(w.first) - 1] = np.diff(w.first)
            yield pa.RecordBatch.from_arrays([pa.array(count) if c == "n_words" else batch.column(i) for i, c in enumerate(names)], names=names)

    return run


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for w in slices(pa.array(texts, pa.string()), PUNCTUATED):
        out += [w.hashes[x:y] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs plus n_words, hits (merged word ranges under windows, end exclusive) and items (ids as text, sorted).

    Words are lower-cased runs of digits, a-z and signs beyond ASCII. A window
    is ``window`` consecutive item words, or all words of a shorter item.
    Null texts have no words; items that are null, wordless or without an id
    hit nothing; equal items are all reported. A benchmark of more than
    ``shard_words`` characters / 2 is cut by id hash and searched part by part.
    Where docs has a column of an added name, the added one gets an underscore behind it.
    """
    spark = docs.sparkSession
    final = [*docs.columns, *[free_name(c, docs.columns) for c in ("n_words", "hits", "items")]]
    at = docs.columns.index(text)
    docs = positions(docs)[0]
    names = [*docs.columns, "n_words", "hits", "items"]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", {HITS}"
    out = docs.selectExpr("*", "0L as n_words", "cast(array() as array<struct<start:int,end:int>>) as hits", "cast(array() as array<string>) as items")
    bench = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("k"), F.col(item_text).alias("t"))
    half = (bench.agg(F.sum(F.char_length("t"))).first()[0] or 0) // 2  # at least as many as words
    shards = max(1, -(-half // shard_words))
    used = False
    for s in range(shards):  # each part is of bounded size
        part = bench.where(F.pmod(F.xxhash64("k"), F.lit(shards)) == s).collect()
        a = build(list(zip([r.k for r in part], _hashes([r.t for r in part]), strict=True)), window)
        if a:
            out = out.mapInArrow(frugal(_searcher(spark.sparkContext.broadcast(a), at, names)), schema)
            used = True
    return (out if used else out.mapInArrow(frugal(_counter(at, names)), schema)).toDF(*final)


def contaminated(percent: int = 5) -> Column:
    """True where at least ``percent`` of a document's words are hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return (n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))


def _cutter(text: int, hits: int, names: list[str], longer: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(hits).to_pylist(), batch.column(text).to_pylist()
            for w in slices(batch.column(text), PUNCTUATED):
                for i in range(len(w.first) - 1):
                    gone = [x for x in spans[w.row + i] if x["end"] - x["start"] >= longer]
                    if gone:
                        first, stop = int(w.first[i]), int(w.offsets[i + 1])
                        keep, at = [], int(w.offsets[i])
                        for x in gone:
                            keep.append(w.data[at : w.start[first + x["start"]]].tobytes())
                            at = int(w.end[first + x["end"] - 1])
                        texts[w.row + i] = (b"".join(keep) + w.data[at:stop].tobytes()).decode("utf-8")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == text else batch.column(i) for i in range(len(names))], names=names)

    return run


def remove_spans(found: DataFrame, text: str = "text", longer: int = 13) -> DataFrame:
    """``overlaps`` rows with hit ranges of at least ``longer`` words cut out of the text."""
    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    return found.mapInArrow(_cutter(found.columns.index(text), found.columns.index("hits"), found.columns, longer), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = 5, longer: int | None = None, **how) -> DataFrame:
    """docs without documents whose hit share reaches ``percent``; with ``longer``, hit ranges of that many words leave the other texts.

    Columns come back as they are, whatever their names.
    """
    plain, text = positions(docs, text)
    found = overlaps(plain, benchmark, text, **how).where(~contaminated(percent))
    return (remove_spans(found, text, longer) if longer else found).select(*plain.columns).toDF(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = overlaps(docs, table(spark, sf_dir, "benchmark")).drop("text")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
