"""Alignment of two tokenizers over a corpus: where their tokens share byte ranges, and which pairs come together most.

Each task encodes its documents with both tokenizers and keeps one record per
document and pair of linked ids. Full buffers are sorted by B id, A id and
document, cut by a radix of the B id and written as zstd runs. Runs'
pair counts meet in k-way heap merges of bounded fan-in, level by level; the
last merge sees all A ids of a B id in a row and so marks the best of them. The
counts then stream past the runs once more and give each document its sums.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import mul
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, per_worker, table
from starloom.llm.token_store import _PLAIN, Encoder, _byte_letters, public_tokenizer

#: Bits of an id in a pair code: B id, then A id.
ID_BITS = 28
RUN_RECORDS = 1_000_000
FAN_IN = 64
#: Runs of a radix that meet one copy of its counts.
CELL_RUNS = 16

#: White space that stands beside other white space or ends the text: only then does a cut before a space change what a tokenizer sees.
_RUNS = re.compile(r"\s\s|\s\Z")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Aligned(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    groups: bytes
    codes: bytes  # uint64 for each link: B id, A id


def cut_groups(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> Aligned:
    """Groups and links of two id sequences over the same bytes."""
    x, y = a[0], b[0]
    codes = [y << ID_BITS | x]
    if len(a) == 1 == len(b):
        return Aligned(1, 1, 1, b"%d|%d" % (x, y), array("Q", codes).tobytes())
    n, i, j, groups = len(a), 1, 1, 1
    at_a, at_b, left, right, said = size_a[x], size_b[y], str(x), str(y), ""
    while True:
        if at_a == at_b:
            said += f"{left}|{right}"
            if i == n:
                break
            x, y = a[i], b[j]
            i, j, groups, left, right = i + 1, j + 1, groups + 1, f";{x}", str(y)
            at_a, at_b = at_a + size_a[x], at_b + size_b[y]
        elif at_a < at_b:
            x = a[i]
            i, left = i + 1, f"{left},{x}"
            at_a += size_a[x]
        else:
            y = b[j]
            j, right = j + 1, f"{right},{y}"
            at_b += size_b[y]
        codes.append(y << ID_BITS | x)
    return Aligned(n, len(b), groups, said.encode(), array("Q", codes).tobytes())


class Aligner:
    """Aligns a byte-level BPE file (A, gets a space before the text) with a sentencepiece model (B, adds one itself).

    A's words begin with their space and no piece of B runs on from a sign
    into a space, so a text whose spaces and newlines stand alone is aligned chunk by
    chunk, and chunks met before are looked up. About ``most`` short ones are held, those not asked
    for since the last turn go first. Other texts, and all texts if the model's pieces say
    otherwise, are aligned whole.
    """

    def __init__(self, path_a: str, path_b: str, most: int = 900_000):
        import sentencepiece

        self.encoder, self.b, self.most = Encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), most
        self.a = self.encoder.tokenizer
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in _byte_letters().items()}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE_PIECE.fullmatch(x)) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        if max(len(names), len(pieces)) >= 1 << ID_BITS:
            raise ValueError("pair codes hold ids of 28 bits")
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.lead = self.b.piece_to_id("▁")
        self.known: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}
        probe = "It's a\nprobe,\nwith 12\nétés 日本\ńx <s> <|endoftext|> don't"
        self.cut = not any(re.search("[^▁]▁", p) or "\n" in p for p in pieces)
        try:
            self.cut = self.cut and self.text(probe)[0][:4] == self.checked(probe)[:4]
        except Exception:  # noqa: BLE001  other kinds of models get whole texts
            self.cut = False

    def checked(self, text: str) -> Aligned | None:
        """The whole text at once; None if the bytes of either side differ from it."""
        said = " " + text
        return self._align(said, self.a.encode(said, add_special_tokens=False).ids, self.b.encode(text))

    def _align(self, said: str, a: list[int], b: list[int]) -> Aligned | None:
        data = said.encode()
        if b"".join([self.bytes_a[i] for i in a]) != data or b"".join([self.bytes_b[i] for i in b]) != data:
            return None
        return cut_groups(a, b, self.size_a, self.size_b)

    def _parts(self, chunks: Iterable[str]) -> dict[str, Aligned | None]:
        """Alignments of chunks: a chunk stands for a space and itself, or for itself if it begins with a newline."""
        known, older, parts, missing = self.known, self.older, {}, []
        tokenize, letters = self.a.model.tokenize, self.encoder.known.letters
        for c in chunks:
            if c in known:
                parts[c] = known[c]
            elif c in older:
                parts[c] = known[c] = older[c]
            else:
                missing.append(c)
        for c, b in zip(missing, self.b.encode(missing, num_threads=1), strict=True) if missing else ():
            said = c if c[0] == "\n" else " " + c
            if said is c:
                if b[0] != self.lead:
                    raise LookupError("the space before the newline is part of another piece")
                b = b[1:]
            if not self.encoder.pieces or not c.isascii() and _PLAIN.search(c):
                a = self.a.encode(said, add_special_tokens=False).ids
            elif c.isalpha():  # one piece
                a = [t.id for t in tokenize(said.encode().decode("latin-1").translate(letters))]
            else:
                a = array("H", self.encoder.split(said)).tolist()
            parts[c] = x = self._align(said, a, b)
            if len(c) <= 40:
                known[c] = x
        if len(known) > self.most // 2:
            self.known, self.older = {}, known
        return parts

    def text(self, text: str | None) -> tuple[Aligned, np.ndarray, np.ndarray] | None:
        """(sizes and groups, distinct pair codes ascending, links of each); None for a text without tokens."""
        if not text:
            return None
        parts = None
        if self.cut and not _RUNS.search(" " + text):
            order = text.replace("\n", " \n").split(" ")
            many = Counter(order)
            try:
                parts = self._parts(many)
            except LookupError:
                parts = None
        if parts is None:
            parts, order, many = {"": self.checked(text)}, [""], {"": 1}
        held, times = [parts[c] for c in many], list(many.values())
        if None in held:
            return None
        codes = np.frombuffer(b"".join([x.codes for x in held]), np.uint64)
        n = np.repeat(np.array(times, np.int64), [len(x.codes) >> 3 for x in held])
        by = np.argsort(codes, kind="stable")
        codes, n = codes[by], n[by]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        sums = [sum(map(mul, times, x)) for x in ([x.n_a for x in held], [x.n_b for x in held], [x.n_groups for x in held])]
        return Aligned(*sums, b";".join([parts[c].groups for c in order]), b""), codes[first], np.add.reduceat(n, first)


@per_worker
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One aligner per Python worker, shared by the tasks that it runs."""
    return Aligner(path_a, path_b)


def _press(**columns: np.ndarray) -> bytes:
    batch, out = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()}), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpress(data: bytes) -> dict[str, np.ndarray]:
    batch = next(iter(pa.ipc.open_stream(data)))
    return {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def _radix(codes: np.ndarray, radixes: int) -> np.ndarray:
    return ((codes >> np.uint64(ID_BITS)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(radixes)


def runs_of(codes: np.ndarray, rows: np.ndarray, n: np.ndarray, radixes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, records, pair counts) of one buffer: records by B id, A id and row, pair counts by B id and A id."""
    radix = _radix(codes, radixes)
    by = np.lexsort((codes, radix))  # stable, and rows come in ascending order
    codes, rows, n, radix = codes[by], rows[by], n[by], radix[by]
    edges = np.r_[0, np.flatnonzero(radix[1:] != radix[:-1]) + 1, len(radix)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        c, k = codes[lo:hi], n[lo:hi]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        yield int(radix[lo]), _press(step=_steps(c), row=rows[lo:hi], n=k.astype(np.uint32 if k.max() < 1 << 32 else np.uint64)), _press(step=_steps(c[first]), n=np.add.reduceat(k, first))


def _cutter(path_a: str, path_b: str, radixes: int, run_records: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = aligner_of(path_a, path_b), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, number, at = 0, 0, part << 33

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            out = [(part << 33 | number, *x) for x in runs_of(*(np.concatenate(x) for x in zip(*held, strict=True)), radixes)]
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_pylist([dict(zip(("run", "radix", "records", "pairs"), x, strict=True)) for x in out], schema)

        for batch in batches:
            said = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = aligner.text(text.as_py())
                if found is None:
                    said.append({"row": at, "key": key, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""})
                else:
                    x, codes, n = found
                    said.append({"row": at, "key": key, "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "n_links": int(n.sum()), "groups_sha256": hashlib.sha256(x.groups).hexdigest()})
                    held.append((codes, np.full(len(codes), at, np.int64), n))
                    size += len(codes)
                    if size >= run_records:
                        yield flush()
                at += 1
            yield pa.RecordBatch.from_pylist(said, schema)
        if held:
            yield flush()

    return run


def _stream(data: bytes) -> Iterator[tuple[int, int]]:
    x = _unpress(data)
    codes, n = np.cumsum(x["step"]), x["n"]
    for i in range(0, len(codes), 1 << 14):
        yield from zip(codes[i : i + (1 << 14)].tolist(), n[i : i + (1 << 14)].tolist(), strict=True)


def merge_counts(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pair codes and their summed counts: a heap holds the next pair of each payload."""
    codes, sums, last = array("Q"), array("q"), None
    for code, n in heapq.merge(*map(_stream, payloads)):
        if code == last:
            sums[-1] += n
        else:
            codes.append(code)
            sums.append(n)
            last = code
    return np.frombuffer(codes, np.uint64), np.frombuffer(sums, np.int64)


def _merged(t: pa.Table, codes: np.ndarray, n: np.ndarray, **more: np.ndarray) -> pa.Table:
    return pa.table({"radix": t.column("radix").slice(0, 1), "run": t.column("group").slice(0, 1), "pairs": pa.array([_press(step=_steps(codes), n=n, **more)], pa.binary())})


def _merge(t: pa.Table) -> pa.Table:
    return _merged(t, *merge_counts(t.column("pairs").to_pylist()))


def _merge_last(t: pa.Table) -> pa.Table:
    """The merge of a whole radix: all A ids of a B id stand together, so their maximum is known at its end."""
    codes, n = merge_counts(t.column("pairs").to_pylist())
    side = codes >> np.uint64(ID_BITS)
    first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
    return _merged(t, codes, n, best=n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(n)])))


def _contribute(runs: pa.Table, counts: pa.Table) -> pa.Table:
    rows, best, total = [], [], []
    if runs.num_rows:
        c = _unpress(counts.column("pairs")[0].as_py())
        codes = np.cumsum(c["step"])
        for data in runs.column("records"):
            r = _unpress(data.as_py())
            at = np.searchsorted(codes, np.cumsum(r["step"]))
            n, by = r["n"].astype(np.int64), np.argsort(r["row"], kind="stable")
            row = r["row"][by]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            rows.append(row[first])
            best.append(np.add.reduceat((n * c["best"][at])[by], first))
            total.append(np.add.reduceat((n * c["n"][at])[by], first))
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, best, total)]
    return pa.table(dict(zip(("row", "n_best", "count_sum"), map(pa.array, joined), strict=True)))


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text", radixes: int = 64, run_records: int = RUN_RECORDS) -> DataFrame:
    """One row per row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens of both files that share bytes are linked; a pair's count is the
    links of the whole corpus that hold it. n_best counts a document's links
    whose count is the highest of their B id, ties included, and count_sum sums the counts.
    Null and empty texts, and texts that either tokenizer does not give back
    byte for byte, have no tokens: zeros and ''. Rows that repeat a key are
    aligned each for itself; null keys stay. Other columns, whatever their names, are
    not returned. Both files must be readable on every executor.

    A task buffers ``run_records`` records (one document at least). A merge
    holds FAN_IN payloads of one radix; ``radixes`` should grow with the
    distinct pairs of the corpus, not with its size. Runs of a common B id are spread over
    cells of about CELL_RUNS runs, each with a copy of that radix's counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    body = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = body.schema["key"].dataType.simpleString()
    layout = f"row long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, run long, radix int, records binary, pairs binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(layout))
    both = scratch.keep(body.mapInArrow(_cutter(tokenizer_a, tokenizer_b, radixes, run_records, arrow), layout), "runs")
    said, runs = both.where("run is null"), both.where("run is not null")

    pairs = runs.select("radix", "run", "pairs")
    most = pairs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    rows, groups = most, -1
    while groups != 1:
        groups = max(-(-rows // FAN_IN), 1)
        grouped = pairs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
        pairs = scratch.keep(grouped.groupBy("radix", "group").applyInArrow(_merge_last if groups == 1 else _merge, "radix int, run long, pairs binary"), "pairs")
        rows = groups

    cells = max(-(-most // CELL_RUNS), 1)
    left = runs.select("radix", "records", F.pmod(F.xxhash64("run"), F.lit(cells)).alias("cell"))
    right = pairs.select("radix", "pairs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"))
    back = left.groupBy("radix", "cell").cogroup(right.groupBy("radix", "cell")).applyInArrow(_contribute, "row long, n_best long, count_sum long")
    sums = back.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return said.join(sums, "row", "left").select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align(docs, public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))
