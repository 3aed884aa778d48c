"""Mixing sources to target weights with nested hash thresholds.

Every row has a fixed hash. A source's budget becomes a threshold on that
hash, found from a histogram of words by hash bucket; only the bucket that
the threshold falls in is split again. Rows under the threshold are taken:
nothing is sorted, and a larger budget only adds rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import WORD, Scratch, numbered, positions, table

#: Hash bits used at each level: 4 levels of 10 bits give 2^40 thresholds.
LEVELS, BITS = 4, 10


def word_count(text):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(scratch: Scratch, sizes: DataFrame, pattern=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size) plus weight and target.

    Sources in code-point order, null last, weigh ``pattern`` over and over
    and divide ``share`` of all sizes; a target stops at ``most`` times its
    source's size and the excess is shared again by weight until none is above.
    """
    n = len(pattern)
    ranked = numbered(scratch, sizes, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in pattern]), (F.col("_rank") % n + 1).cast("int"))
    t = ranked.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(most))
    t = scratch.keep(t, "weights")
    total = (t.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, free = 0.0, F.lit(True)
    while True:  # each turn fixes at least one more source at its cap
        full = ~free
        left, w, count = t.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0)), F.sum(full.cast("int"))).first()
        if not w:
            break
        rate = (total - left) / w
        free = F.col("weight") * F.lit(rate) <= F.col("_cap")
        if t.agg(F.sum((~free).cast("int"))).first()[0] == count:
            break
    target = F.when(free, F.col("weight") * F.lit(rate)).otherwise(F.col("_cap"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def thresholds(scratch: Scratch, rows: DataFrame, budgets: DataFrame, levels: int = LEVELS, bits: int = BITS) -> DataFrame:
    """(source, threshold): rows of a source with hash < threshold hold at most its budget, and all that whole hash values allow.

    rows(source, size, hash), hash below 2^(levels*bits); budgets(source, budget).
    Sources that fit whole have no row. Each later level reads only the rows
    of the bucket that the threshold falls in, joined by source and bucket, so
    no join is dealt by source alone.
    """
    part = lambda k: F.shiftrightunsigned("hash", bits * (levels - k)).alias("bucket")
    hist, rest, edge = rows.groupBy("source", part(1)).agg(F.sum("size").alias("size")), budgets, None
    for k in range(1, levels + 1):
        r = rest.withColumnRenamed("source", "_s")
        run = hist.join(r, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_sum", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        over = run.where("_sum > budget").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("budget") - F.col("_sum") + F.col("size")).alias("budget")), "bucket").alias("_e"))
        edge = scratch.keep(over.select("source", F.col("_e.bucket").alias("bucket"), F.col("_e.budget").alias("budget")), "edge")
        if k < levels:
            e = edge.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"))
            near = rows.withColumn("bucket", part(k)).join(e, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
            hist, rest = near.groupBy("source", part(k + 1)).agg(F.sum("size").alias("size")), edge.select("source", "budget")
    return edge.select("source", F.col("bucket").alias("threshold"))


def row_hash(key: str):
    """The first bits of the MD5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def plan(scratch: Scratch, rows: DataFrame, **how) -> DataFrame:
    """(source, source_size, target, whole, threshold) for rows(source, size, hash): whole copies of each row, and one more of those under the threshold."""
    bucket = F.shiftrightunsigned("hash", BITS * (LEVELS - 1))
    sizes = rows.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_n")).groupBy("source").agg(F.sum("_n").alias("source_size"))
    goal = targets(scratch, sizes, **how)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = scratch.keep(goal.withColumn("whole", whole.cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "goal")
    limit = thresholds(scratch, rows, goal.where("budget > 0").select("source", "budget")).withColumnRenamed("source", "_s")
    last = F.coalesce("threshold", F.when(F.col("budget") > 0, F.lit(1 << (LEVELS * BITS))).otherwise(0))
    out = goal.join(limit, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", last.alias("threshold"))
    return scratch.keep(out, "plan")


def with_copies(df: DataFrame, made: DataFrame, source: str = "source", hash_: str = "_mix_hash", small: int = 50_000) -> DataFrame:
    """df plus _mix: a struct of source_size, target and copies. The plan is broadcast up to ``small`` sources; beyond, it is dealt by source and hash bucket."""
    p = made.select(F.col("source").alias("_mix_source"), F.struct("source_size", "target", "whole", "threshold").alias("_mix_plan"))
    on = F.col(source).eqNullSafe(F.col("_mix_source"))
    if made.count() <= small:
        j = df.join(F.broadcast(p), on)
    else:
        p = p.withColumn("_mix_bucket", F.explode(F.sequence(F.lit(0), F.lit((1 << BITS) - 1))))
        j = df.join(p, on & (F.shiftrightunsigned(hash_, BITS * (LEVELS - 1)) == F.col("_mix_bucket")))
    copies = F.col("_mix_plan.whole") + F.when(F.col(hash_) < F.col("_mix_plan.threshold"), 1).otherwise(0)
    return j.select(*df.columns, F.struct("_mix_plan.source_size", "_mix_plan.target", copies.cast("long").alias("copies")).alias("_mix"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """Rows (key, source, size, source_size, target, copies, taken) of all docs.

    copies says how often the mix repeats a row: whole copies of the source
    as far as its target reaches, and one more of the rows under the hash
    threshold of what is left. Null and empty texts have size 0. Rows with
    the same key share a hash, so ties are taken or left together. An empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(text).alias("size"), row_hash(key).alias("hash")), "rows")
    out = with_copies(rows, plan(scratch, rows, **how), hash_="hash")
    return out.select(F.col("_key").alias(key), "source", "size", "_mix.*", (F.col("size") * F.col("_mix.copies")).alias("taken"))


def repeat(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: each row of docs as often as ``mix`` says, with its columns, whatever those are named."""
    names = docs.columns
    docs, key, text, source = positions(docs, key, text, source)
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(docs.select(F.col(source).alias("source"), word_count(text).alias("size"), row_hash(key).alias("hash")), "rows")
    out = with_copies(docs.withColumn("_mix_hash", row_hash(key)), plan(scratch, rows, **how), source)
    return out.where("_mix.copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_mix.copies"))).alias("_mix_copy")).drop("_mix_copy").toDF(*names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 10) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
l AS (SELECT arg_min(rate, cap / weight) FILTER (WHERE weight * rate <= cap) AS rate FROM r),
g AS (SELECT source, source_size, CASE WHEN weight * l.rate <= cap THEN weight * l.rate ELSE cap END AS target FROM w, l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS copies FROM g),
q AS (SELECT d.doc_id, d.size, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS run FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN copies < 2 AND budget > 0 AND run <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q
"""
