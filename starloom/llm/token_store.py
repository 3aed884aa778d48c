"""Token ids in Re-Pair compressed shards.

Documents are range partitioned by id and encoded with a given tokenizer file.
Each shard replaces frequent id pairs by nonterminals, round after round, and
stores rules, expansion lengths and the remaining sequence, so that any run
of ids is decoded without the rest. Shards are rows of a Parquet table.

Layout of a shard, little-endian: magic RPR2; uint32 counts of documents,
rules and symbols, uint32 vocabulary, uint64 ids; int64 document ids; a byte
per document, 1 where its id is null; uint32 ids per document; uint16 left and
right of each rule; uint32 expansion length of each rule; uint64 ids before
every 1,024th symbol; uint16 symbols.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, frugal, per_worker, table

HEAD = struct.Struct("<4sIIIIQ")
SHARD_IDS = 1_000_000
#: A shard stores how many ids lie before every STEP-th symbol.
STEP = 1024

_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
#: Texts of these letters only are split here as the tokenizer's own pattern splits them; others go to it whole.
_PLAIN = re.compile(f"[^\\x00-\\x7f{_L}]|<\\|")
#: The tokenizer's white space; Python's \\s also holds U+001C to U+001F.
_S = "\\t-\\r \\x85\\xa0"
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0")
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: The same with U+0000 as a piece of its own.
_PARTS = re.compile("\0|" + _PIECES.pattern.replace("[^", "[^\\0", 1))
#: RE2: texts that are not plain, or empty, or hold U+0000, U+0001, or white space at an end or beside other white space.
_HARD = f"[\\t-\\r ][\\t-\\r ]|^[\\t-\\r ]|[\\t-\\r ]$|^$|<\\||[\\x00\\x01]|[^\\x00-\\x7f{_L}]"
#: RE2: a letter before a sign that is none, where a piece always ends.
_ENDS = f"([{_L}])([^\\t-\\r {_L}0-9])"
#: Bytes of text that are encoded together.
SLICE = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is a visible sign of Latin-1, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Values made when first asked for. ``turn`` makes all entries old ones; of those, only the ones asked for again stay on."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class _Pieces(_Known):
    """Ids of pieces as uint16 bytes."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def make(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        return self.ids(letters.translate(self.letters))

    def ids(self, letters: str) -> bytes:
        return array("H", [t.id for t in self.tokenize(letters)]).tobytes()


class _Chunks(_Known):
    """Ids of what lies between two single spaces, with the space before it. A newline begins a chunk of its own and takes no space."""

    def __init__(self, pieces: _Pieces, split: Callable[[str], bytes]):
        super().__init__()
        self.pieces, self.split, self.space = pieces, split, pieces.letters[32]

    def make(self, chunk: str) -> bytes:
        if chunk.isalpha() or chunk.isdecimal():  # one piece; visible signs of ASCII stand for themselves
            return self.pieces.ids(self.space + chunk) if chunk.isascii() else self.pieces.make(" " + chunk)
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        if body and (body[0] in _WHITE or body[-1] in _WHITE) or not chunk:
            raise LookupError("white space around the chunk must be seen too")
        return self.split(chunk if chunk[0] == "\n" else " " + chunk)


class _Parts(_Known):
    """Ids of the parts that ``Encoder.encode_all`` cuts texts into, made many at a time.

    A part takes the space before it, but for those that begin with a newline
    and those that U+0001 marks as following without one. The model gets the pieces of
    many parts in one string: U+0000 before each part and U+0001 between the pieces
    of one are in no longer entry of the vocabulary, so no merge reaches over them.
    """

    def __init__(self, tokenizer):
        super().__init__()
        from tokenizers import Tokenizer

        model, letters = tokenizer.model, _byte_letters()
        self.encode, self.signs = Tokenizer(model).encode_batch_fast, np.zeros(256, "<u2")
        for byte, letter in letters.items():
            self.signs[byte] = ord(letter)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.head, self.gap = (vocabulary.get(letters[b], -1) for b in (0, 1))
        holding = [t for t in vocabulary if letters[0] in t or letters[1] in t]
        self.mark = letters[0]
        #: Whether the model takes a string for its pieces one by one, as only merges can join what stands side by side.
        self.exact = sorted(holding) == [letters[0], letters[1]] and not (model.ignore_merges or model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix)

    def take(self, parts: list[str]) -> list[bytes]:
        out = [*map(self.get, parts)]
        new = [k for k, x in enumerate(out) if x is None]
        if self.old:
            for k in new:
                out[k] = self.old.get(parts[k])
            self.update((parts[k], out[k]) for k in new if out[k] is not None)
            new = [k for k in new if out[k] is None]
        names = [parts[k] for k in new]
        made = self.many(names)
        self.update(zip(names, made, strict=True))
        for k, ids in zip(new, made, strict=True):
            out[k] = ids
        return out

    def many(self, parts: list[str], longest: int = 500) -> list[bytes]:
        """Ids of each part; the model gets strings of about ``longest`` letters, as its work on one grows faster than its length."""
        if not parts:
            return []
        text = ("\0 " + "\0 ".join(parts)).replace("\0 \n", "\0\n").replace("\0 \1", "\0")
        text = "\1".join(_PARTS.findall(text)).replace("\1\0", "\0").replace("\0\1", "\0")
        text = self.signs[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
        strings, at = [], 0
        while at < len(text):
            end = text.find(self.mark, at + longest)
            strings.append(text[at : end if end > 0 else len(text)])
            at += len(strings[-1])
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.encode(strings, add_special_tokens=False)])
        head = ids == self.head
        real = ~head & (ids != self.gap)
        stop = 2 * np.r_[np.cumsum(real)[head], real.sum()]
        data = ids[real].tobytes()
        return [data[a:b] for a, b in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]


class Encoder:
    """Ids of texts as uint16 bytes.

    Where the vocabulary is byte-level with the pattern above, texts are cut at
    single spaces and newlines, which end a piece whatever stands around them;
    chunks met before are looked up and the others cut into pieces. At most
    ``most`` pieces and as many chunks are held. Everything else goes to the
    tokenizer whole. ``encode_all`` does this for many texts at once: Arrow cuts
    them and numbers their distinct parts, and each of these is looked up or made
    once; as many parts are held, and those of one slice.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.last = Tokenizer.from_file(path), most, ("", b"")
        self.size, self.known = self.tokenizer.get_vocab_size(), _Pieces(self.tokenizer.model)
        self.chunks = _Chunks(self.known, self.split)
        if self.size > 1 << 16:
            raise ValueError("this file format holds vocabularies of up to 65,536 ids")
        # pieces are cut here only for byte-level vocabularies with the pattern above
        probe = "It's  a\ttest,\n\n 12 \x00\x7f\xa0\xad \xe9\xff \xf1and\xfa's we'll_x\n x\n\n\x1cx \x1d\x1e\n \x1f "
        try:
            self.pieces = self.whole(probe) == self.split(probe)
        except Exception:  # noqa: BLE001  another kind of model: it gets whole texts
            self.pieces = False
        self.parts = _Parts(self.tokenizer) if self.pieces else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def split(self, text: str) -> bytes:
        if len(self.known) > self.most // 2:
            self.known.turn()
        return b"".join(map(self.known.__getitem__, _PIECES.findall(text)))

    def joined(self, text: str) -> bytes:
        """Ids chunk by chunk. Only white space of one sign between two others is cut at, so runs of it fall back to ``split``."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in _WHITE or text[-1:] in _WHITE:
            return self.split(text)
        if len(self.chunks) > self.most // 2:
            self.chunks.turn()
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return self.split(first) + b"".join(map(self.chunks.__getitem__, rest))
        except LookupError:
            return self.split(text)

    def encode(self, text: str) -> bytes:
        if text != self.last[0]:  # repeated rows stand next to each other
            plain = "<|" not in text if text.isascii() else not _PLAIN.search(text)
            self.last = text, self.joined(text) if self.pieces and plain else self.whole(text)
        return self.last[1]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string array without nulls, slice by slice of about ``SLICE`` bytes."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = texts.slice(a, b - a)
            if self.parts is None or not self.parts.exact:
                hard = np.ones(len(part), bool)
            else:
                hard = pc.match_substring_regex(part, _HARD).to_numpy(zero_copy_only=False)
            easy = iter(self.together(part.filter(pa.array(~hard))) if not hard.all() else ())
            for k, alone in enumerate(hard.tolist()):
                yield np.frombuffer(self.encode(part[k].as_py()), np.uint16) if alone else next(easy)

    def together(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none of them matches ``_HARD``."""
        if len(self.parts) > self.most // 2:
            self.parts.turn()
        marked = pc.replace_substring_regex(pc.binary_join_element_wise("\1", texts, ""), _ENDS, "\\1 \1\\2")
        cut = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        found = self.parts.take(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        ids, first, which = np.frombuffer(b"".join(found), np.uint16), np.cumsum(size) - size, coded.indices.to_numpy()
        ids, stop = ids[_ranges_at(first[which], size[which])], np.cumsum(size[which])
        return np.split(ids, stop[np.cumsum(pc.list_value_length(cut).to_numpy()) - 1][:-1])


@per_worker
def encoder_of(path: str) -> Encoder:
    """One encoder per Python worker, shared by the tasks that it runs."""
    return Encoder(path)


def _ranges_at(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then those of first[1], and so on."""
    stop = np.cumsum(n)
    return np.repeat(first - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)


def compress(ids: np.ndarray, vocabulary: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k is the pair that nonterminal vocabulary + k stands for.

    A round counts all pairs of the sequence and replaces those of ``least`` or
    more places together, the most frequent first. No symbol is on the left of one and on the right of another,
    so occurrences never overlap; of a run of one symbol paired with itself,
    every second place is taken. Rounds go on until no pair comes ``least``
    times, or all symbols of 16 bits are in use. A rule takes 8 bytes and each
    of its occurrences saves 2.

    Pairs are counted with their places, by one sort. A pair of older symbols only loses places,
    so after the first round only places of pairs that were frequent and those beside new symbols are looked at.
    """
    seq, rules = ids.astype(np.uint32), []
    at = np.arange(max(len(seq) - 1, 0))  # places whose pair may be frequent
    while len(at) >= least and (room := (1 << 16) - vocabulary - len(rules)) > 0:
        keys = seq[at].astype(np.uint64)
        keys <<= np.uint64(16)
        keys |= seq[1:][at]
        keys <<= np.uint64(32)
        keys |= at.view(np.uint64)
        keys.sort()
        codes = (keys >> np.uint64(32)).astype(np.uint32)
        keys &= np.uint64(0xFFFFFFFF)
        at = keys.view(np.int64)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        n = np.diff(np.r_[first, len(codes)])
        first, n = first[n >= least], n[n >= least]
        codes = codes[first]
        left, right, chosen = set(), set(), []
        by_count = np.lexsort((codes, -n))
        for k, c in zip(by_count.tolist(), codes[by_count].tolist(), strict=True):
            a, b = c >> 16, c & 0xFFFF
            if (a not in right and b not in left) if a != b else not (a in left or a in right):
                left.add(a)
                right.add(b)
                chosen.append(k)
                if len(chosen) == room:
                    break
        if not chosen:
            break
        taken, new = at[_ranges_at(first[chosen], n[chosen])], np.repeat(np.arange(len(chosen)), n[chosen])
        touch = (np.diff(taken) == 1) & (np.diff(new) == 0)
        if touch.any():  # only runs of one symbol can touch
            head = np.flatnonzero(np.r_[True, ~touch])
            ok = (np.arange(len(taken)) - np.repeat(head, np.diff(np.r_[head, len(taken)]))) % 2 == 0
            taken, new = taken[ok], new[ok]
        seq[taken] = vocabulary + len(rules) + new
        keep, look = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        keep[taken + 1] = False
        look[at[_ranges_at(first, n)]] = look[taken] = look[taken[taken > 0] - 1] = True
        seq, at = seq[keep], np.flatnonzero(look[keep][:-1])
        rules += [(c >> 16, c & 0xFFFF) for c in codes[chosen].tolist()]
    return np.array(rules, np.uint16).reshape(-1, 2), seq.astype(np.uint16)


def pack(docs: list[int | None], counts: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    rules, seq = compress(ids, vocabulary)
    length = np.ones(vocabulary + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        length[vocabulary + k] = length[a] + length[b]
    marks = np.concatenate([[0], np.cumsum(length[seq], dtype=np.uint64)])[:-1:STEP]
    null = np.array([d is None for d in docs], np.uint8)
    names = np.array([0 if d is None else d for d in docs], "<i8")
    parts = (names, null, counts.astype("<u4"), rules.astype("<u2"), length[vocabulary:].astype("<u4"), marks.astype("<u8"), seq.astype("<u2"))
    return b"".join([HEAD.pack(b"RPR2", len(docs), len(rules), len(seq), vocabulary, len(ids)), *(p.tobytes() for p in parts)])


class Shard(NamedTuple):
    docs: np.ndarray
    null: np.ndarray
    counts: np.ndarray
    vocabulary: int
    rules: np.ndarray
    length: np.ndarray  # of every rule's expansion
    marks: np.ndarray  # ids before every STEP-th symbol
    symbols: np.ndarray
    n_ids: int

    @classmethod
    def read(cls, data: bytes) -> Shard:
        magic, n, r, m, vocabulary, ids = HEAD.unpack_from(data)
        if magic != b"RPR2":
            raise ValueError("not a Re-Pair shard")
        out, at = [], HEAD.size
        for kind, size in (("<i8", n), ("u1", n), ("<u4", n), ("<u2", 2 * r), ("<u4", r), ("<u8", -(-m // STEP)), ("<u2", m)):
            out.append(np.frombuffer(data, kind, size, at))
            at += out[-1].nbytes
        return cls(out[0], out[1], out[2], vocabulary, out[3].reshape(-1, 2), out[4], out[5], out[6], ids)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for: nonterminals are replaced by their pairs, level by level, until none is left."""
        out = symbols.astype(np.uint32)
        while (some := np.flatnonzero(out >= self.vocabulary)).size:
            wide = np.repeat(out, 1 + (out >= self.vocabulary))
            at = some + np.arange(len(some))
            pair = self.rules[out[some] - self.vocabulary]
            wide[at], wide[at + 1] = pair[:, 0], pair[:, 1]
            out = wide
        return out

    def sizes(self) -> np.ndarray:
        return np.concatenate([np.ones(self.vocabulary, np.int64), self.length.astype(np.int64)])

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids start..end of the shard; only symbols over that range are read and expanded."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if end <= start:
            return np.zeros(0, np.uint32)
        a = (int(np.searchsorted(self.marks, start, "right")) - 1) * STEP
        b = int(np.searchsorted(self.marks, end, "left")) * STEP
        some, sizes = self.symbols[a:b], self.sizes()
        stop = int(self.marks[a // STEP]) + np.cumsum(sizes[some])
        i, j = int(np.searchsorted(stop, start, "right")), int(np.searchsorted(stop, end, "left")) + 1
        some = some[i:j]
        used = np.flatnonzero(np.bincount(some, minlength=len(sizes)))  # each symbol of the range is expanded once
        flat, first = self.expand(used), np.zeros(len(sizes), np.int64)
        first[used] = np.cumsum(sizes[used]) - sizes[used]
        n = sizes[some]
        out = flat[_ranges_at(first[some], n)]
        skip = start - int(stop[i] - n[0])
        return out[skip : skip + end - start]


SHARDS = "part int, shard int, n_docs bigint, n_ids bigint, before bigint, payload binary"


def _writer(path: str, end_id: int, shard_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = encoder_of(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint16)
        docs: list[int | None] = []
        held: list[np.ndarray] = []  # ids and end id of each document
        size, before = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, size, number, before
            counts = np.array([len(x) + 1 for x in held[::2]], np.uint32)
            data = pack(docs, counts, np.concatenate(held), encoder.size)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([size], pa.int64()), pa.array([before], pa.int64()), pa.array([data], pa.binary())], names=["part", "shard", "n_docs", "n_ids", "before", "payload"])
            docs, held, size, number, before = [], [], 0, number + 1, before + size
            return out

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                docs.append(d)
                held += (x, end)
                size += len(x) + 1
                if size >= shard_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            s, base = Shard.read(batch.column(1)[k].as_py()), batch.column(0)[k].as_py()
            ids = memoryview(s.ids().astype("<u4")).cast("B")
            stop = np.cumsum(s.counts, dtype=np.int64)
            crc = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for b, n in zip(stop.tolist(), s.counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(s.docs, pa.int64(), mask=s.null.astype(bool)), pa.array(base + stop - s.counts), pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for wanted, payload in zip(batch.column(0), batch.column(1), strict=True):
            s = Shard.read(payload.as_buffer())
            for w in wanted:
                a, b = w["from"].as_py(), w["to"].as_py()
                out.append((w["start"].as_py(), w["end"].as_py(), w["at"].as_py(), s.ids(a, b).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(3)] + [pa.array([o[3] for o in out], pa.list_(pa.int64()))], names=["start", "end", "at", "part"])


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The table of shards (part, shard, n_docs, n_ids, ids before it in its part, payload), in ascending key order by part and shard.

    It is written as Parquet to ``path``, which must not exist, or to the
    scratch folder without one. Null texts are empty and give the end id alone;
    null keys come first; rows that repeat a key are all written, in any order
    among themselves, and spread over partitions. tokenizer is a file that
    every executor can open. A shard holds ``shard_ids`` ids, and a longer
    document whole. An empty table gives no shards. Other columns of docs,
    whatever their names, are not stored.
    """
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_tie"))
    body = body.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return Scratch(docs.sparkSession, "tokens").keep(body.mapInArrow(frugal(_writer(tokenizer, end_id, shard_ids), __name__), SHARDS), "shards", path)


def _placed(shards: DataFrame) -> DataFrame:
    """shards with _base, the ids of all shards before each."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part_base"))
    # one row per partition of the writer is broadcast, so payloads stay where they are
    return shards.join(F.broadcast(base), "part").withColumn("_base", F.col("_part_base") + F.col("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document: ids of all documents before it, its ids, and their CRC."""
    return _placed(shards).select("_base", "payload").mapInArrow(frugal(_reader, __name__), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ranges(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(start, end, ids): the ids start..end of the whole store for each row of wanted(start, end).

    Ranges meet the shards under them by equal stretches of as many ids as the
    longest shard holds; a payload is read only where a range lies, and only the symbols
    under it are expanded. Ranges are cut off at the end of the store; empty
    and null ones give no row.
    """
    heads = _placed(shards.drop("payload")).select("part", "shard", "_base", (F.col("_base") + F.col("n_ids")).alias("_stop"))
    wide = max(shards.agg(F.max("n_ids")).first()[0] or 1, 1)
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / wide), F.floor((b - 1) / wide))).alias("_cell")
    want = wanted.select(F.col("start").cast("long"), F.col("end").cast("long")).where("start >= 0 and start < end").distinct()
    heads = heads.select("*", cells(F.col("_base"), F.col("_stop")))
    on = want.select("*", cells(F.col("start"), F.col("end"))).join(heads, "_cell").where("start < _stop and _base < end")
    at = F.greatest("start", "_base")
    one = F.struct("start", "end", at.alias("at"), (at - F.col("_base")).alias("from"), (F.least("end", "_stop") - F.col("_base")).alias("to"))
    asked = on.select("part", "shard", one.alias("_one")).distinct().groupBy("part", "shard").agg(F.collect_list("_one").alias("_wanted"))
    found = shards.join(asked, ["part", "shard"]).select("_wanted", "payload").mapInArrow(_ranges, "start bigint, end bigint, at bigint, part array<bigint>")
    pieces = found.groupBy("start", "end").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("_p"))
    return pieces.select("start", "end", F.flatten(F.transform("_p", lambda x: x["part"])).alias("ids"))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents"), public_tokenizer()))
