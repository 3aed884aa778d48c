"""Quality rules as a learned decision list [native].

Text measures are computed with built-in functions. Sequential covering
learns an ordered list of threshold conjunctions that find bad documents:
grow a rule on one part of the labelled rows, prune it on another, keep it if
it is precise enough, drop what it covers, go on. Only histograms of measure
bins by label reach the driver. The list is emitted as a conditional expression.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import SPACES, Scratch, table

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Condition(NamedTuple):
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.measure) >= self.threshold if self.above else F.col(self.measure) < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.threshold:.6g}"


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key plus counts and ratios of each whole text; null texts have no words.

    n_repeat_words counts words inside 3-word windows that occur twice or
    more: windows are compared by 64-bit hash, their equal neighbours found in
    sorted order, and their words counted once, so a text of n words takes
    n log n steps. Columns of docs other than key and text are not read.
    """
    cut = lambda chars: F.char_length("_t") - F.char_length(F.translate("_t", chars, ""))
    d = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = d.select("_key", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), "").alias("_w"), lines.alias("_l"), (F.char_length("_t") - cut(SPACES)).cast("long").alias("word_chars"), cut(SYMBOLS).cast("long").alias("n_symbols"), cut("!").alias("_bangs"), cut(UPPER).alias("_upper"), cut("0123456789").alias("_digits"))
    h = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.get("_w", i - 1), F.get("_w", i), F.get("_w", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    d = d.select("*", F.size("_w").cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), h.alias("_h")).drop("_w", "_l")
    d = d.withColumn("_s", F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))).drop("_h")
    twice = F.filter("_s", lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]))
    d = d.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["at"]))).drop("_s")
    # places rise, so each adds its own three words less those that the next window holds too
    own = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x)).drop("_p")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    ratios = [share("n_symbols", "word_chars").alias("symbol_share"), share("_bangs", "word_chars").alias("bang_share"), share("_upper", "word_chars").alias("upper_share"), share("_digits", "word_chars").alias("digit_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("mean_word")]
    return d.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *ratios)


MEASURES = ("n_words", "symbol_share", "bang_share", "upper_share", "digit_share", "dup_line_share", "repeat_share", "mean_word")


def _best(hist: dict[tuple[int, int], tuple[int, int]], cuts: list[list[float]]) -> tuple[float, Condition, int] | None:
    """The condition of the largest FOIL gain, with the gain and the good rows that it leaves."""
    bad = sum(p for (f, _), (p, _) in hist.items() if f == 0)
    good = sum(n for (f, _), (_, n) in hist.items() if f == 0)
    if not bad:
        return None
    before, best = math.log2(bad / (bad + good)), None
    for f, edges in enumerate(cuts):
        p = n = 0
        for b, edge in enumerate(edges):  # rows in bins 0..b lie below edge b
            p, n = p + hist.get((f, b), (0, 0))[0], n + hist.get((f, b), (0, 0))[1]
            for above, x, y in ((False, p, n), (True, bad - p, good - n)):
                if x:
                    gain = x * (math.log2(x / (x + y)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Condition(MEASURES[f], above, edge), y)
    return best


def learn(scratch: Scratch, rows: DataFrame, label: str = "bad", fold: str = "fold", rules: int = 8, width: int = 3, bins: int = 64, precision: float = 0.95, least: int = 3) -> list[list[Condition]]:
    """The ordered rules. rows: the measures, ``label`` 1 for bad, and ``fold`` (0 prunes, others grow).

    Without labelled rows, or if no rule is precise enough, the list is empty.
    """
    parts = [i / bins for i in range(1, bins)]
    at = rows.where(f"{label} is not null").agg(*[F.percentile_approx(m, parts, 5000).alias(m) for m in MEASURES], *[F.percentile_approx(F.when(F.col(label) == 1, F.col(m)), parts, 5000).alias(f"bad_{m}") for m in MEASURES]).first()
    cuts = [sorted({*(at[m] or []), *(at[f"bad_{m}"] or [])}) for m in MEASURES]
    passed = lambda m: lambda edge: F.col(m) >= edge
    place = [F.size(F.filter(F.array(*map(F.lit, c)), passed(m))) if c else F.lit(0) for m, c in zip(MEASURES, cuts, strict=True)]
    rows = scratch.keep(rows.select(*MEASURES, label, fold, F.array(*place).alias("_bins")), "binned")
    grown, pruned = rows.where(F.col(fold) != 0), rows.where(F.col(fold) == 0)
    out: list[list[Condition]] = []
    left = F.lit(True)
    while len(out) < rules:
        rule: list[Condition] = []
        while len(rule) < width:
            here = grown.where(left)
            for c in rule:
                here = here.where(c.column())
            hist = here.select(label, F.posexplode("_bins").alias("f", "b")).groupBy("f", "b").agg(F.sum(label), F.sum(1 - F.col(label))).collect()
            found = _best({(r[0], r[1]): (int(r[2]), int(r[3])) for r in hist}, cuts)
            if found is None:
                break
            rule.append(found[1])
            if found[2] == 0:
                break
        if not rule:
            break
        sums, cond = [], F.lit(True)
        for c in rule:
            cond = cond & c.column()
            sums += [F.sum((cond & (F.col(label) == 1)).cast("long")), F.sum((cond & (F.col(label) == 0)).cast("long"))]
        got = [int(x or 0) for x in pruned.where(left).agg(*sums).first()]
        worth = [((p - n) / max(1, p + n), p, -k) for k, (p, n) in enumerate(zip(got[::2], got[1::2], strict=True))]
        _, p, k = max(worth)
        n = got[2 * -k + 1]
        if p < least or p < precision * (p + n):
            break
        rule = rule[: -k + 1]
        out.append(rule)
        whole = F.lit(True)
        for c in rule:
            whole = whole & c.column()
        left = left & ~whole
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: the text of the first rule that holds, else null."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column()
        name = F.lit(" and ".join(map(str, rule)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(None).cast("string") if out is None else out


def fold_of(key: str) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "quality") -> DataFrame:
    """One row per row of docs: its counts, base_failed, the rule that rejects it and kept.

    Rules learn from labelled rows outside fold 0 of crc32(key) mod 5; fold 1
    prunes. Null and empty texts have no words and fail the base rule. Labels
    repeated for a key count once each; rows without a label are judged only.
    Rows that repeat a key are each judged by their own text; an empty table
    gives no rows. Ties between conditions go to the first measure and the
    lowest threshold. The list has at most 8 rules of 3 conditions, and
    thresholds are the 64-quantiles of all and of bad labelled rows. Columns
    of docs other than key and text are left out, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    m = scratch.keep(measures(docs, key, text), "measures")
    bad = labels.where(F.col(target).isNotNull()).select(F.col(key).alias("_k"), (1 - F.col(target).cast("int")).alias("bad"))
    fold = fold_of(key)
    seen = m.join(bad, F.col(key) == F.col("_k")).withColumn("fold", fold - 1).where("fold >= 0")
    rules = learn(scratch, seen)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = m.withColumn("base_failed", failed).withColumn("rejected_by", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
