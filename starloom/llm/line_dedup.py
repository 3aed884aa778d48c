"""Repeated line runs by a suffix array over line ids, with distributed prefix doubling [native].

Lines that occur once end every run, so only repeated lines get an id (their
rank). Round k ranks the runs of 2^k lines that start at each place by the pair
of ranks of their halves; a run that occurs once loses its rank. A run of any
length n is named by the ranks of its first and last 2^k lines, k = floor(log2 n).

The suffixes are sorted as deep as the threshold needs: the suffixes that share
their shortest beginning of ``min_words`` words form a longest-common-prefix
interval. Its first member keeps its lines, and the beginnings of the others are
deleted. Overlapping beginnings add up to the maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, free_name, numbered, positions, spread_join, table

DOC = ["_key", "_hash"]


def _words(line):
    return F.size(F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), ""))


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _hash, i, pos, w, h1, h2): the i-th line with a word, its place among all lines, its words and its hashes."""
    body = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.split(text, "\n").alias("_lines"))
    some = F.filter(F.transform("_lines", lambda x, k: F.struct(k.alias("pos"), x.alias("line"))), lambda s: F.rlike(s["line"], F.lit(r"[^\x20\x09-\x0D]")))
    flat = body.select(*DOC, F.posexplode(some).alias("i", "s"))
    return flat.select(*DOC, "i", F.col("s.pos").alias("pos"), _words(F.col("s.line")).alias("w"), F.xxhash64("s.line").alias("h1"), F.hash("s.line").alias("h2"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(_key, _hash, i, pos, w) of the lines to delete."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(line_table(docs, key, text), "lines")
    twice = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = scratch.keep(numbered(scratch, twice, ["h1", "h2"], "r0"), "ids")
    live = spread_join(lines, ids, ["h1", "h2"], "n").select(*DOC, "i", "pos", "w", "r0")
    in_doc = Window.partitionBy(*DOC).orderBy("i", "pos")
    live = live.withColumn("seg", F.col("i") - F.dense_rank().over(in_doc))  # equal over lines without a gap
    seg = Window.partitionBy(*DOC, "seg")
    live = live.withColumn("_all", F.sum("w").over(seg)).where(F.col("_all") >= min_words).drop("_all")
    # a line with a word adds at least one, so that many lines are enough
    ahead = F.collect_list("w").over(seg.orderBy("i").rowsBetween(0, min_words - 1))
    run = F.aggregate(ahead, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda a, x: F.when(a["sum"] >= min_words, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"))))
    live = live.withColumn("_run", run).withColumn("len", F.when(F.col("_run.sum") >= min_words, F.col("_run.n"))).drop("_run")
    live = scratch.keep(live.dropDuplicates([*DOC, "i"]), "live")  # rows that repeat key and text are one document

    longest = live.agg(F.max("len")).first()[0] or 0
    place, k = seg.orderBy("i"), 0
    while 2 << k <= longest:
        paired = scratch.keep(live.withColumn("a", F.col(f"r{k}")).withColumn("b", F.lead(f"r{k}", 1 << k).over(place)), "paired")
        scratch.drop(live)
        pairs = paired.where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
        ranks = numbered(scratch, pairs, ["a", "b"], f"r{k + 1}")
        # most runs are unique by then and have no rank to look for; they would all meet in the task of the null key
        sought = paired.where("a is not null and b is not null").join(ranks, ["a", "b"], "left")
        rest = paired.where("a is null or b is null").withColumn(f"r{k + 1}", F.lit(None).cast("long"))
        live = scratch.keep(sought.unionByName(rest).drop("a", "b"), "live")
        scratch.drop(paired)
        k += 1

    power = F.floor(F.log2("len") + 1e-9).cast("int")
    first, last = F.lit(None).cast("long"), F.lit(None).cast("long")
    for j in range(k + 1):
        behind = F.coalesce(*[F.when(F.col("len") == n, F.lead(f"r{j}", n - (1 << j)).over(place)) for n in range(1 << j, min(2 << j, min_words + 1))])
        first, last = F.when(power == j, F.col(f"r{j}")).otherwise(first), F.when(power == j, behind).otherwise(last)
    runs = scratch.keep(live.select(*DOC, "seg", "i", "pos", "w", "len", first.alias("a"), last.alias("b")), "runs")
    where = F.struct(*DOC, "i")
    named = "len is not null and a is not null and b is not null"
    heads = scratch.keep(runs.where(named).groupBy("len", "a", "b").agg(F.min(where).alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    marked = spread_join(runs.where(named), heads, ["len", "a", "b"], "n", "left").unionByName(runs.where(f"not ({named})").withColumn("_first", F.lit(None).cast(heads.schema["_first"].dataType)))
    marked = marked.withColumn("_to", F.when(where > F.col("_first"), F.col("i") + F.col("len")))
    reach = F.max("_to").over(place.rowsBetween(1 - min_words, 0))
    return marked.withColumn("_reach", reach).where("_reach > i").select(*DOC, "i", "pos", "w")


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """docs with repeated runs of lines deleted from the text, plus n_lines, n_removed_lines and n_removed_words.

    A run of whole lines with at least ``min_words`` words that also occurs
    earlier, by key, text hash and place, is deleted; its first copy stays.
    Lines without a word belong to no run and stay. Null texts stay null and
    have no lines; a text that loses all lines is empty. Rows that repeat key
    and text get the same result. A null key sorts first. The lines of one
    document are sorted in one task. Columns come back whatever their names; where
    one has an added name, the added one gets an underscore behind it.
    """
    names = [*docs.columns, *[free_name(c, docs.columns) for c in ("n_lines", "n_removed_lines", "n_removed_words")]]
    docs, key, text = positions(docs, key, text)
    scratch = Scratch(docs.sparkSession, "linecut")
    gone = repeated_lines(docs, key, text, min_words)
    cut = scratch.keep(gone.groupBy(*DOC).agg(F.collect_list("pos").alias("_gone"), F.sum("w").alias("_w")), "cut")
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines")
    # only texts that may lose lines are shuffled
    slots = 1 << 20
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(slots)).cast("int").alias("_slot")
    marks = F.broadcast(cut.select(slot("_key")).distinct())
    slotted = docs.select("*", slot(key))
    every = cut.count() > slots // 4  # then the slots would let most rows through
    some = docs if every else slotted.join(marks, "_slot", "left_semi").drop("_slot")
    rest = docs.limit(0) if every else slotted.join(marks, "_slot", "left_anti").drop("_slot")
    rest = rest.select("*", n, F.lit(0).cast("long").alias("n_removed_lines"), F.lit(0).cast("long").alias("n_removed_words"))
    on = F.col(key).eqNullSafe(F.col("_key")) & F.xxhash64(text).eqNullSafe(F.col("_hash"))
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i))
    new = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    some = some.join(cut, on, "left").select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns], n, F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed_lines"), F.coalesce("_w", F.lit(0)).cast("long").alias("n_removed_words"))
    return rest.unionAll(some).toDF(*names)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_words", F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
i AS (SELECT *, row_number() OVER d AS i, list(line) OVER f AS ls, list(w) OVER f AS ws FROM n
      WINDOW d AS (PARTITION BY doc_id ORDER BY pos), f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
c AS (SELECT *, len(list_filter(range(1, len(ws) + 1), lambda k: list_sum(ws[1:k]) < 50)) + 1 AS m FROM i WHERE list_sum(ws) >= 50),
b AS (SELECT doc_id, i, m, row_number() OVER (PARTITION BY array_to_string(ls[1:m], chr(10)) ORDER BY doc_id, i) AS nth FROM c),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS i FROM b WHERE nth > 1),
k AS (SELECT i.doc_id, i.pos, i.w FROM i JOIN g USING (doc_id, i)),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(k.pos) AS gone, coalesce(sum(k.w), 0) AS words,
             coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE k.pos IS NULL), '') AS text
      FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.pos = k.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_lines,
       CAST(coalesce(words, 0) AS BIGINT) AS n_removed_words, sha256(r.text) AS text_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""
