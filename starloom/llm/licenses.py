"""Licence notices, identifier tags and licence expressions in texts.

One Aho-Corasick automaton over whole words finds notice phrases and tags. A
tag's value is read by a shunting-yard parser (WITH binds before AND, AND
before OR) and evaluated: AND joins terms and takes the heavier, OR
takes the lighter side, WITH an exception lightens a copyleft term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import table

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: More notices that the operator knows, by the words they are recognised by.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl-2",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl-1",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Words of tags, and whether a name that IDENTIFIERS lacks may stand in their value.
TAGS = {"spdx license identifier": True, "license expression": False, "license": False, "licence": False}

#: Labels of identifiers, in lower case and without a version's end: the longest beginning counts.
IDENTIFIERS = {
    "mit": "mit", "apache-2": "apache-2", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "bsl-1": "bsl-1", "unlicense": "public-domain", "cc0": "cc0",
    "gpl-2": "gpl-2", "gpl-3": "gpl-3", "lgpl": "lgpl", "agpl": "agpl-3", "mpl-2": "mpl-2", "epl-2": "epl-2",
    "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd",
}

#: How much a label binds who uses the text: 0 not at all, 1 no use.
BURDEN = {
    "cc0": 0.05, "public-domain": 0.05, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "zlib": 0.1, "bsl-1": 0.1, "apache-2": 0.15, "cc-by": 0.2,
    "mpl-2": 0.4, "epl-2": 0.4, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl-2": 0.7, "gpl-3": 0.7, "agpl-3": 0.8, "cc-by-nc": 0.9, "cc-by-nd": 0.9, "all-rights-reserved": 1.0,
}
COPYLEFT = {"mpl-2", "epl-2", "lgpl", "gpl-2", "gpl-3", "agpl-3"}
UNKNOWN = 1.0

#: Letters A-Z become small, other ASCII signs that are neither letters nor digits become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_VALUE = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"'\[]{0,2}")
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str | None:
    """The label of a licence identifier; versions, -only, -or-later and + do not change it."""
    name = re.sub(r"(\+|-only|-or-later)$", "", identifier.lower())
    fits = [x for x in IDENTIFIERS if name == x or name.startswith((f"{x}-", f"{x}."))]
    return IDENTIFIERS[max(fits, key=len)] if fits else None


def parse(text: str, at: int = 0, any_name: bool = True) -> list[str]:
    """The expression that begins at ``at``, in postfix order; it ends where no grammar goes on. Empty if there is none.

    An operator without a right side falls away and brackets left open close at the end. Without ``any_name``, names without a label end it.
    """
    out: list[str] = []
    held: list[str] = []
    operand = True
    while m := _TOKEN.match(text, at):
        token, word = m[1].rstrip(".:_-"), m[1].lower()
        if operand:
            if token == "(":
                held.append(token)
            elif token == ")" or word in _STRENGTH or not any_name and label_of(token) is None and held[-1:] != ["with"]:
                break
            else:
                out.append(token)
                operand = False
        elif token == ")":
            if "(" not in held:
                break
            while (top := held.pop()) != "(":
                out.append(top)
        elif word in _STRENGTH:
            while held and held[-1] != "(" and _STRENGTH[held[-1]] >= _STRENGTH[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        else:
            break
        at = m.end()
    if operand:  # what is held last still waits for its right side
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    out += [x for x in reversed(held) if x != "("]
    return out if len(out) > out.count("or") + out.count("and") + out.count("with") else []


def evaluate(postfix: list[str]) -> tuple[float, frozenset[str], str]:
    """(burden, labels that take effect, the expression with all brackets) of a parsed expression."""
    stack: list[tuple[float, frozenset[str], str]] = []
    for x in postfix:
        if x not in _STRENGTH:
            label = label_of(x)
            stack.append((BURDEN[label], frozenset([label]), x) if label else (UNKNOWN, frozenset([x.lower()]), x))
            continue
        (rb, rl, rt), (lb, ll, lt) = stack.pop(), stack.pop()
        said = f"({lt} {x.upper()} {rt})"
        if x == "with":
            stack.append((lb / 2 if ll & COPYLEFT else lb, ll, said))
        elif x == "and":
            stack.append((max(lb, rb), ll | rl, said))
        else:
            stack.append((lb, ll, said) if lb <= rb else (rb, rl, said))
    return stack[0]


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...], tags: tuple[tuple[str, bool], ...]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for phrase, label in notices:
            found.setdefault(phrase, []).append((label, None))
        for phrase, any_name in tags:
            found.setdefault(phrase, []).append((None, any_name))
        for phrase, what in found.items():
            self.machine.add_word(f" {phrase} ", (len(phrase), phrase.count(" ") + 1, what))
        self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[dict], list[dict]]:
        """(words, places of notices, expressions), both in text order."""
        raw = (text or "").encode()
        words = raw.translate(_FOLD).split()
        said = f" {b' '.join(words).decode('latin-1')} "
        places, tags, seen, word = [], {}, 0, 0
        for end, (size, n, what) in self.machine.iter(said):
            start = end - size
            word += said.count(" ", seen, end) if end > seen else 0  # spaces up to the one that ends the match
            seen = max(seen, end)
            first = word - n
            for label, any_name in what:
                if label is None:
                    tags[first + n - 1] = tags.get(first + n - 1, False) or any_name
                else:
                    places.append({"label": label, "word": first, "phrase": said[start:end]})
        if not tags:
            return len(words), places, []
        out, plain = [], raw.decode("latin-1")  # a sign for each byte; values are ASCII
        for k, m in enumerate(islice(_WORDS.finditer(raw.lower()), max(tags) + 1)):
            if k in tags:
                if (v := _VALUE.match(plain, m.end())) and (p := parse(plain, v.end(), tags[k])):
                    burden, labels, text_of = evaluate(p)
                    out.append({"word": k, "expression": text_of, "labels": sorted(labels), "burden": burden})
        return len(words), places, out


@lru_cache(maxsize=4)
def scanner_of(notices: tuple, tags: tuple) -> Scanner:
    """One automaton per Python worker, shared by the tasks that it runs."""
    return Scanner(notices, tags)


_PLACES = "places array<struct<label:string,word:bigint,phrase:string>>"
_EXPRESSIONS = "expressions array<struct<word:bigint,expression:string,labels:array<string>,burden:double>>"


def _runner(notices: tuple, tags: tuple, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(notices, tags)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], schema.field(i + 1).type) for i in range(3))], schema=schema)

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None, tags: dict[str, bool] | None = None) -> DataFrame:
    """(key, n_words, places, expressions) of each row of docs, in one pass and without a shuffle.

    Words are runs of letters, digits and signs beyond ASCII, A-Z in lower
    case. A place is a notice whose words stand consecutively: its label and
    first word. An expression is the value of a tag, on its line and as far as
    the grammar goes: the tag's last word, the expression's text, the labels that
    take effect and its burden.
    Null and empty texts have no words and two empty lists; rows that
    repeat a key stay, null keys too. Other columns, whatever their names, are
    not returned. ``notices`` maps phrases in folded words to labels.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    body = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    layout = f"key {body.schema['key'].dataType.simpleString()}, n_words bigint, {_PLACES}, {_EXPRESSIONS}"
    notices, tags = BASE | NOTICES if notices is None else notices, TAGS if tags is None else tags
    found = body.mapInArrow(_runner(tuple(notices.items()), tuple(tags.items()), to_arrow_schema(_parse_datatype_string(layout))), layout)
    return found.withColumnRenamed("key", key)


def judge(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of scanned documents.

    Base columns come from BASE's phrases alone. labels holds all notices' and
    expressions' labels; score is the heaviest burden among them, 0 without any.
    """
    base = F.filter("places", lambda p: p["phrase"].isin(*BASE))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    burdens = F.create_map(*[F.lit(x) for pair in BURDEN.items() for x in pair])
    labels = F.concat(F.transform("places", lambda p: p["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    heaviest = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("places", lambda p: F.coalesce(F.try_element_at(burdens, p["label"]), F.lit(UNKNOWN))), F.transform("expressions", lambda e: e["burden"])))
    return found.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda p: p["word"])).alias("first_word"), F.array_max(F.transform(base, lambda p: p["word"])).alias("last_word"),
        joined(F.transform(base, lambda p: p["label"])).alias("base_labels"), joined(labels).alias("labels"), heaviest.alias("score"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(scan(table(spark, sf_dir, "documents")))
