"""Words of Arrow text columns as 64-bit hashes, vectorised over slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACED = np.zeros(256, bool)
SPACED[[0x20, *range(9, 14)]] = True
#: For words of digits, a-z and everything beyond ASCII.
PUNCTUATED = np.ones(256, bool)
PUNCTUATED[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: For words of a-z and everything beyond ASCII.
LETTERS = np.ones(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        for k, base in (("p", _P), ("q", _PINV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    row: int  # of the slice's first text in the batch
    first: np.ndarray  # for each text of the slice, and one more: the index of its first word
    hashes: np.ndarray
    start: np.ndarray  # byte places in data
    end: np.ndarray
    data: np.ndarray  # the slice's bytes as they were
    offsets: np.ndarray  # of texts in data
    run: np.ndarray  # running sums behind the hashes


def slices(texts: pa.Array, separators: np.ndarray, lower: bool = True, most: int = 1 << 20) -> Iterator[Words]:
    """Runs over a text column in slices of about ``most`` bytes (one text at least). Nulls have no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if n == 0:
        return
    _, offs, values = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    values = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        data, o = values[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        low = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~separators[low]
        begin, stop = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = o[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]  # a word never runs over the end of a text
        cut = edges[inside[1:-1][edges] & inside[:-2][edges]] if len(edges) else edges
        begin[cut] = True
        stop[cut - 1] = True
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        p, q = _power(max(len(data), most) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[low] * p[: len(data)], out=run[1:], dtype=np.uint64)
        hashes = mix((run[end] - run[start]) * q[start] + (end - start).astype(np.uint64))
        yield Words(at, np.searchsorted(start, o), hashes, start, end, data, o, run)
        at = to


def prefixes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of words of at least k bytes, hashes of their first k bytes), apart from the hashes of words."""
    long = np.flatnonzero(w.end - w.start >= k)
    s = w.start[long]
    return long, mix((w.run[s + k] - w.run[s]) * _power(len(w.data) + 1)[1][s] + np.uint64(1 << 40 | k))
