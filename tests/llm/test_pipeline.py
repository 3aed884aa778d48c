"""The pipeline's stages on a small table with copies, benchmark passages, nulls, empty texts and repeated rows, against brute force."""

import zlib

import numpy as np

import corpus_pipeline
from starloom.llm import mixing, token_store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = " ".join(f"item{k}" for k in range(20))


def rows():
    rng, out = np.random.default_rng(3), []
    for i in range(30):
        out.append((i, " ".join(f"w{k}" for k in rng.integers(0, 5000, 60)), "en", f"s{i % 3}", 1))
    out += [(100, out[0][1], "en", "s0", 1), (101, out[1][1].upper(), None, None, None)]  # copies
    out += [(102, "lead " + PASSAGE + " tail", "en", "s1", 1), (103, PASSAGE + " " + " ".join(f"z{k}" for k in range(600)), "en", "s1", 1)]  # above and below a twentieth
    return out + [(104, None, "en", "s2", 0), (105, "", "en", "s2", 0), (106, "\n \t", None, None, 0), (2, out[2][1], "en", "s2", 1)]


def test_stages_agree_with_brute_force(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(7, PASSAGE)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows(), schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]

    good = stages["quality"](spark, docs, str(tmp_path))
    assert good.columns == COLUMNS and stages["quality"](spark, docs.where("false"), str(tmp_path)).count() == 0
    kept = stages["near_dedup"](spark, docs, str(tmp_path))
    ids = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == COLUMNS and ids == sorted(r[0] for r in rows() if r[0] not in (100, 101))
    clean = stages["decontamination"](spark, kept, str(tmp_path))
    assert clean.columns == COLUMNS and sorted(r.doc_id for r in clean.collect()) == [i for i in ids if i != 102]
    mixed = stages["mixing"](spark, clean, str(tmp_path))
    want = {}
    for r in mixing.mix(clean).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = mixed.collect()
    assert mixed.columns == COLUMNS and {i: n for i, n in want.items() if n} == {i: sum(r.doc_id == i for r in got) for i in {r.doc_id for r in got}}

    encoder, at = token_store.Encoder(token_store.public_tokenizer()), 0
    out = sorted(stages["tokens"](spark, mixed, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in got)
    text = {r[0]: r[1] or "" for r in rows()}
    for r in out:
        x = np.frombuffer(encoder.whole(text[r.doc_id]), np.uint16).astype("<u4").tolist() + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
