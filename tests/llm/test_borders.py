"""Every stage gives the caller's columns back, whatever they are called."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import starloom.llm
from starloom.llm import decontamination, line_dedup, mixing, neardup, quality_model

LINES = "\n".join(" ".join(f"w{i}x{k}" for k in range(12)) for i in range(6))
ROWS = [(1, LINES, "a"), (2, LINES + "\nlast", "a"), (3, "one two three", None), (None, "no key here at all", "b"), (None, "no key here at all", "b"), (4, None, "b"), (5, "", "a")]


def used_names():
    """All names that the package's own code gives to columns."""
    said = "".join(p.read_text() for p in pathlib.Path(starloom.llm.__file__).parent.glob("*.py"))
    found = {m for pattern in (r'alias\("(\w+)"\)', r'withColumn\("(\w+)"', r'F\.col\("(\w+)"\)') for m in re.findall(pattern, said)}
    return sorted((found | {"_slot", "_gone", "_mix_hash", "hits", "n_words", "items", "n_lines", "n_removed_lines", "n_removed_words", "_mix", "_mix_copy"}) - {"doc_id", "text", "source"})


def stages(spark):
    bench = spark.createDataFrame([(7, "an item of some words")], "item_id long, text string")
    return {
        "near_dedup": neardup.keep_one,
        "decontaminate": lambda d: decontamination.decontaminate(d, bench),
        "cut": lambda d: decontamination.decontaminate(d, bench, longer=3),
        "repeat": mixing.repeat,
        "quality": lambda d: quality_model.keep_good(d, least=0.0),
        "lines": lambda d: line_dedup.drop_repeated_lines(d).select(*d.columns),
    }


@pytest.mark.parametrize("stage", ["near_dedup", "decontaminate", "cut", "repeat", "quality", "lines"])
def test_columns_come_back(spark, stage):
    names = [n for n in used_names() if n != "quality_score"] + ["quality_score"]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    clash = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(n) for n in names])
    plain = sorted(map(str, stages(spark)[stage](docs).collect()))
    out = stages(spark)[stage](clash)
    assert out.columns == clash.columns
    rows = out.collect()
    assert sorted(str(r) for r in out.select("doc_id", "text", "source").collect()) == plain
    for r in rows:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert all(r[n] == f"{n}-{key}" for n in names)


def test_added_names_give_way(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("n_lines", F.lit("mine")).withColumn("hits", F.lit("too"))
    assert line_dedup.drop_repeated_lines(docs).columns == [*docs.columns, "n_lines_", "n_removed_lines", "n_removed_words"]
    bench = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    found = decontamination.overlaps(docs, bench)
    assert found.columns == [*docs.columns, "n_words", "hits_", "items"] and {r.hits for r in found.collect()} == {"too"}
