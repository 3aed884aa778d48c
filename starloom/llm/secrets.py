"""Secret scans with a trigram inverted index [native].

Each rule's regex gives a Boolean trigram query: an OR of trigram sets, one
set of which any match must contain. Postings (trigram, document) are built
for the trigrams that the rules ask for, the sets are intersected, and only
documents that pass are searched with the regex. Rules without a mandatory
trigram read every text.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, table


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: The group whose length counts, and the least length that it must have.
    group: int = 0
    least: int = 1


# The three base kinds come from the contract, in its order. A run
# of a class that is long enough is the same as the longest run filtered by length.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Public shapes of keys that the base kinds miss.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

_MANY = 64


def _literal(items) -> tuple[set[str] | None, list[frozenset[str]]]:
    """(all strings a sequence can match, or None if too many; sets of which each match holds one string) for parsed items."""
    now: set[str] | None = {""}
    must: list[frozenset[str]] = []

    def flush() -> None:
        nonlocal now
        if now:
            must.append(frozenset(now))
        now = {""}

    whole = True
    for op, arg in items:
        part: set[str] | None = None
        inner: list[frozenset[str]] = []
        if op is C.LITERAL:
            part = {chr(arg).lower()}
        elif op is C.IN and arg[0][0] is not C.NEGATE:
            chars: set[str] = set()
            for kind, x in arg:
                chars |= {chr(x).lower()} if kind is C.LITERAL else {chr(c).lower() for c in range(x[0], x[1] + 1)} if kind is C.RANGE and x[1] - x[0] < _MANY else {""}
            part = chars if len(chars) <= 8 and "" not in chars else None
        elif op is C.SUBPATTERN:
            part, inner = _literal(arg[3])
        elif op is C.BRANCH:
            options = [_literal(x) for x in arg[1]]
            part = set().union(*(x for x, _ in options)) if all(x is not None for x, _ in options) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            one, inner_one = _literal(sub)
            inner = inner_one if low else []
            if one is not None and high == 1:
                part = one | {""} if low == 0 else one
            elif one is not None and low == high and len(one) ** low <= _MANY:
                part = {""}
                for _ in range(low):
                    part = {a + b for a in part for b in one}
        elif op is C.AT:
            part = {""}
        must += inner
        if part is None or len(now) * len(part) > _MANY:
            whole = False
            flush()
            now = part if part is not None and len(part) <= _MANY else {""}
            if part is None:
                now = {""}
        else:
            now = {a + b for a in now for b in part}
    if whole:
        return now, []
    flush()
    return None, must


def trigram_query(pattern: str, most: int = 6) -> list[frozenset[str]]:
    """Sets of lower-case trigrams, one of which every match's text contains whole; [] if the pattern has no mandatory trigram."""
    whole, must = _literal(_parser.parse(pattern).data)
    choices: list[frozenset[str]] = [frozenset()]
    for strings in must if whole is None else [frozenset(whole)]:
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() in grams:
            continue
        choices = [a | b for a in choices for b in grams]
        choices = [a for a in set(choices) if not any(b < a for b in choices)]  # a superset asks for more than its part
    if frozenset() in choices:
        return []
    # a part of a set is a weaker but still mandatory query: the trigrams with other signs than letters are the rarer ones
    return sorted({frozenset(sorted(c, key=lambda t: (t.isalpha(), t))[:most]) for c in choices}, key=sorted)


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, key) for each of the given trigrams in each text, letters in either case."""
    low = docs.select(key, F.lower(text).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(key, F.explode(found).alias("trigram"))


def candidates(index: DataFrame, asked: dict[str, list[frozenset[str]]], key: str = "doc_id") -> DataFrame:
    """(key, rule): documents that hold all trigrams of one of the rule's sets. asked: rule to its sets."""
    spark = index.sparkSession
    rows = [(rule, n, len(s), t) for rule, sets in asked.items() for n, s in enumerate(sets) for t in sorted(s)]
    wants = spark.createDataFrame(rows, "rule string, part int, needed int, trigram string")
    hits = index.join(F.broadcast(wants), "trigram")  # wants has a row for each trigram of each rule
    return hits.groupBy(key, "rule", "part").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed")).where("n = needed").select(key, "rule")


SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string>"
#: Matches whose spans are added up one after another; whole blocks are placed by the sums of their lengths.
BLOCK = 256


def found_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end, kind>> of the rule's leftmost non-overlapping matches that are long enough; places in code points.

    The pieces between matches and the matches add up to the text, so places
    are running sums of their lengths: of blocks first, then inside each block.
    """
    pieces, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    size = lambda c: F.transform(c, lambda x: F.char_length(x).cast("long"))
    parts = F.arrays_zip(size(pieces).alias("p"), size(whole).alias("m"), size(group).alias("g"))
    # the lengths are bound once, as the only element of an array, and so are the blocks and where they begin
    bound = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    both = lambda x: x["p"] + F.coalesce(x["m"], F.lit(0).cast("long"))  # noqa: E731  the last piece has no match behind it

    def block_spans(block: Column, begin: Column) -> Column:
        def step(acc, x):
            start = acc["at"] + x["p"]
            span = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + x["m"]).alias("end"), F.lit(rule.kind).alias("kind"))
            here = F.when(x["g"] >= rule.least, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))
            return F.struct((acc["at"] + both(x)).alias("at"), F.concat(acc["out"], here).alias("out"))

        return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), step, lambda acc: acc["out"])

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + both(x)))
        begins = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return bound(begins, lambda at: F.flatten(F.transform(blocks, lambda b, i: block_spans(b, F.get(at, i)))))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, BLOCK))
    return bound(parts, lambda all_: bound(cut(all_), placed))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, key: str = "doc_id", text: str = "text", slots: int = 1 << 20) -> DataFrame:
    """(key, found): found holds every rule's spans sorted by start, then rule order.

    Null texts count as empty and have no spans; repeated rows each keep
    their own; an empty table gives no rows. Matches of one kind never overlap;
    spans that tie on their start are in rule order. A text of m matches takes
    about m steps, however long it is. Other columns are left out, whatever
    their names. Up to ``slots`` / 4 candidates reach the texts as the hash slots
    that they fall in, broadcast; documents that share a slot are searched too
    and give no false spans. Beyond that they are joined by key.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    order = {r.kind: i for i, r in enumerate(rules)}
    grams = sorted({t for q in asked.values() for s in q for t in s})
    body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if asked:
        index = scratch.keep(postings(body, grams, "_key", "_text"), "postings")
        bit = F.element_at(F.create_map(*[x for k in asked for x in (F.lit(k), F.lit(1 << order[k]))]), F.col("rule"))
        may = scratch.keep(candidates(index, asked, "_key").groupBy("_key").agg(F.bit_or(bit).alias("_mask")), "candidates")
        scratch.drop(index)
        if may.count() > slots // 4:
            body = body.join(may.withColumnRenamed("_key", "_of"), F.col("_key").eqNullSafe(F.col("_of")), "left").drop("_of")
        else:
            slot = F.pmod(F.xxhash64("_key"), F.lit(slots)).cast("int").alias("_slot")
            body = body.select("*", slot).join(F.broadcast(may.groupBy(slot).agg(F.bit_or("_mask").alias("_mask"))), "_slot", "left")
    else:
        body = body.withColumn("_mask", F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")
    each = []
    for i, r in enumerate(rules):
        may = F.rlike("_text", F.lit(r.pattern))
        if r.kind in asked:
            may = (F.coalesce("_mask", F.lit(0)).bitwiseAND(1 << i) != 0) & may
        each.append(F.when(may, found_spans(F.col("_text"), r, i)).otherwise(none))
    return body.select(F.col("_key").alias(key), F.array_sort(F.concat(*each)).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["ord"] < len(BASE))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
