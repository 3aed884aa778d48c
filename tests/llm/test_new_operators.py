"""Tokenizer alignment, bit-plane clustering and licence scans against brute force."""

import collections
import hashlib
import math
import os
import re

import duckdb
import numpy as np
import pytest

from starloom.llm import alignment, bitplanes, licenses
from starloom.llm.token_store import public_tokenizer

A, B = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model")
CLASH = "radix int, run long, row long, cluster int, n long, pairs string, places string"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    parts = ["a", "the", " ", " ", " ", "\n", "  ", "\t", "é", "́", "日本", "😀", "don't", "'s", "<s>", "<|endoftext|>", "▁", "<0x41>", "12", "345", "...", "\r\n", "\xa0", " ", "Vertrag", "\x00", "x" * 50, "!!", "\x85", "\x1c"]
    out = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(400)]
    return out + ["the same text", "the same text", "", None, " lead", "tail ", "tail\n", "\nfoo", "▁a b", "a\n\nb", "one", " ".join(f"w{i % 977} and" for i in range(20_000)), "y" * 5_000]


def expected_alignment(texts):
    one = alignment.aligner_of(A, B)
    per, counts = [], collections.Counter()
    for t in texts:
        said = f" {t}".encode() if t else b""
        a, b = (one.a.encode(f" {t}", add_special_tokens=False).ids, one.b.encode(t)) if t else ([], [])
        if not t or b"".join(one.bytes_a[i] for i in a) != said or b"".join(one.bytes_b[i] for i in b) != said:
            per.append(None)
            continue
        spans = []
        for ids, size in ((a, one.size_a), (b, one.size_b)):
            ends = np.cumsum([size[i] for i in ids]).tolist()
            spans.append([*zip(ids, [0, *ends[:-1]], ends, strict=True)])
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = ";".join("|".join(",".join(str(i) for i, p, q in side if lo <= p and q <= hi) for side in spans) for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)) if len(a) < 500 else None
        links, j = collections.Counter(), 0
        for i, p, q in spans[0]:
            while spans[1][j][2] <= p:
                j += 1
            k = j
            while k < len(b) and spans[1][k][1] < q:
                links[i, b[k]] += 1
                k += 1
        counts.update(links)
        per.append((len(a), len(b), len(cuts), groups, links))
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for p in per:
        if p is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            links = p[4].items()
            sha = p[3] and hashlib.sha256(p[3].encode()).hexdigest()
            yield *p[:3], sum(p[4].values()), sum(n for (a, b), n in links if counts[a, b] == best[b]), sum(n * counts[k] for k, n in links), sha


@pytest.mark.parametrize("run_records", [50, 1_000_000])
def test_alignment_agrees_with_brute_force(spark, texts, run_records):
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, A, B, radixes=8, run_records=run_records).collect()}
    assert len(got) == len(texts) and alignment.aligner_of(A, B).cut
    for k, want in enumerate(expected_alignment(texts)):
        assert got[k][:6] == want[:6], texts[k]
        assert want[6] is None or got[k][6] == want[6], texts[k]


def test_merges_have_bounded_fan_in(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, f"word{i % 3} and the other {i % 11}") for i in range(120)], "doc_id long, text string").repartition(2)
    want = sorted(map(str, alignment.align(docs, A, B).collect()))
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    monkeypatch.setattr(alignment, "CELL_RUNS", 2)
    assert sorted(map(str, alignment.align(docs, A, B, radixes=2, run_records=10).collect())) == want


def test_alignment_of_nothing_and_of_clashing_names(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    docs = spark.createDataFrame([(None, "a b", 1, 2, 3, 4, 5, "x", "y"), (1, None, 1, 2, 3, 4, 5, "x", "y")], f"doc_id long, text string, {CLASH}")
    rows = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    assert rows[None].n_links == 2 and rows[None].n_best == 2 and rows[1].n_a == 0 and rows[1].groups_sha256 == ""


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            if own := [v for (_, v), a in zip(kept, at, strict=True) if a == j]:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    total = collections.Counter()
    for _, j, d in out:
        total[j] += d
    return collections.Counter((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in out)


def test_clusters_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * rng.choice([0.1, 1, 900])).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (200, None), (201, [0.5] * 63), (202, [0.5] * 63 + [None]), (203, [0.5] * 63 + [float("nan")]), (204, [0.5] * 63 + [float("-inf")]), (205, [-1 / 64] * 64), (206, [0.0] * 64), (206, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", *[f"1 as {c.split()[0]}" for c in CLASH.split(", ")]).repartition(5)
    got = collections.Counter(tuple(r) for r in bitplanes.cluster(df)[0].collect())
    assert got == brute_clusters(rows)
    few = collections.Counter(tuple(r) for r in bitplanes.cluster(df.where("vec_id < 5"))[0].collect())
    assert few == brute_clusters([r for r in rows if r[0] is not None and r[0] < 5])
    empty = bitplanes.cluster(df.where("vec_id < 0"))[0]
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    wide = bitplanes.cluster(spark.createDataFrame([(1, [1e9] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<double>"))[0].collect()
    assert {r.vec_id: r.distance for r in wide} == {1: None, 2: 0}


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for dims in (3, 64, 100):
        x, c = (rng.integers(-(1 << 20), 1 << 20, (n, dims)) for n in (40, 6))
        assert (bitplanes.dots(bitplanes.pack(x), bitplanes.pack(c)) == x @ c.T).all()
        at = rng.integers(0, 6, 40)
        assert (bitplanes.sums(bitplanes.pack(x), at, 6, dims) == np.array([x[at == k].sum(axis=0) for k in range(6)])).all()


@pytest.mark.parametrize(
    ("text", "labels", "burden"),
    [
        ("MIT", {"mit"}, 0.1), ("MIT OR GPL-3.0-only", {"mit"}, 0.1), ("MIT AND GPL-3.0-or-later", {"mit", "gpl-3"}, 0.7), ("GPL-2.0+ WITH Classpath-exception-2.0", {"gpl-2"}, 0.35),
        ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT OR AGPL-3.0", {"gpl-2", "mit"}, 0.35), ("(MIT OR CC-BY-NC-4.0) AND Apache-2.0", {"mit", "apache-2"}, 0.15), ("MIT AND (CC-BY-NC-4.0 OR (Apache-2.0 AND LGPL-2.1", {"mit", "apache-2", "lgpl"}, 0.5),
        ("MIT OR", {"mit"}, 0.1), ("mit and", {"mit"}, 0.1), ("MIT) AND GPL-3.0", {"mit"}, 0.1), ("LicenseRef-own OR CC-BY-SA-4.0", {"cc-by-sa"}, 0.6), ("MIT */ or more", {"mit"}, 0.1), ("MIT AND ( OR", {"mit"}, 0.1),
    ],
)
def test_expressions(text, labels, burden):
    got = licenses.evaluate(licenses.parse(text))
    assert set(got[1]) == labels and got[0] == pytest.approx(burden)


def test_no_expression():
    assert licenses.parse("") == [] and licenses.parse("OR MIT") == [] and licenses.parse("()") == [] and licenses.parse("(") == []
    assert licenses.parse("the terms of use", any_name=False) == [] and licenses.parse("MIT or the other", any_name=False) == ["MIT"]


def test_scans_agree_with_brute_force(spark):
    rng = np.random.default_rng(9)
    parts = ["under", "the", "MIT", "license", "Apache", "License,", "version", "2", "cc", "by-nc", "CC-BY-NC", "Under the MIT License", "é", "日", " ", "\n", "-", "\xa0", "by", "nc", "\x85", "ſ", "K", "SPDX-License-Identifier: MIT OR GPL-3.0\n", "all rights reserved"]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(300)] + ["", None, "cc by nc " * 30_000, "x" * 100_000]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").selectExpr("*", *[f"1 as {c.split()[0]}" for c in CLASH.split(", ")])
    got = {r.doc_id: r for r in licenses.judge(licenses.scan(df)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + p.count(" ") + 1] == p.split()]
        r = got[k]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(starts, default=None), max(starts, default=None)), t
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")}
        if t and "SPDX" in t:
            assert "mit" in r.labels.split(",")
        assert 0 <= r.score <= 1 and (r.score == 0) == (r.labels == "")
    assert licenses.scan(df.where("false")).count() == 0


def test_tags_and_places(spark):
    text = 'x\n# SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause\n"license": "Apache-2.0",\nthe license: see below\nLicense-Expression: CC-BY-NC-SA-4.0'
    docs = spark.createDataFrame([(1, text), (None, "All rights reserved."), (1, text)], "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    one = next(r for r in rows if r.doc_id == 1)
    assert [(e.expression, e.labels) for e in one.expressions] == [("((GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause)", ["bsd"]), ("Apache-2.0", ["apache-2"]), ("CC-BY-NC-SA-4.0", ["cc-by-nc"])]
    judged = licenses.judge(licenses.scan(docs)).collect()
    assert sorted((r.doc_id or 0, r.labels, r.score) for r in judged) == [(0, "all-rights-reserved", 1.0), (1, "apache-2,bsd,cc-by-nc", 0.9), (1, "apache-2,bsd,cc-by-nc", 0.9)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_clusters_agree_with_sql(spark):
    db = duckdb.connect()
    db.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = db.sql(bitplanes.OP12_SQL).fetchall()
    assert collections.Counter(map(tuple, bitplanes.op12_centroid_clustering(spark, "/root/testdata/sf0.001").collect())) == collections.Counter(want)
