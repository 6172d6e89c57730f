"""Words of Arrow text columns as 64-bit hashes, found and hashed without a Python loop over words.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of
the lower-cased text. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R = U(0x9E3779B97F4A7C15)
_RINV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
CHUNK = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[ord("a") : ord("z") + 1] = _WORD[ord("0") : ord("9") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _R)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant modulo 2**64, and of its inverse."""
    if len(_POW[0]) < n:
        size = max(n, 2 * CHUNK)
        for k, base in enumerate((_R, _RINV)):
            p = np.full(size, base, U)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=U)
    return _POW[0][:n], _POW[1][:n]


class Words(NamedTuple):
    """Hashes of the words of several texts; those of text k are at ``off[k]:off[k + 1]``; start and end are byte positions in data."""

    h: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    text_off: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text array, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end positions of the words."""
    word = _WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < len(data))]  # a word ends where its text ends
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def scan(texts: pa.Array, lower: bool = True) -> Words:
    if lower:
        texts = pc.utf8_lower(texts)
    data, off = buffers(texts)
    if not len(data):
        e = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), np.zeros(len(off), np.int64), e, e, data, off)
    start, end = split(data, off)
    p, inv = powers(len(data))
    s = np.empty(len(data) + 1, U)
    s[0] = 0
    np.cumsum(_BYTE[data] * p, out=s[1:])
    h = mix((s[end] - s[start]) * inv[start] + (end - start).astype(U))
    return Words(h, np.searchsorted(start, off), start, end, data, off)


def ngrams(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each position on, and whether they lie in one text."""
    count = len(h)
    ok = np.zeros(count, bool)
    if count < n:
        return np.zeros(count, U), ok
    p, inv = powers(count)
    s = np.empty(count + 1, U)
    s[0] = 0
    np.cumsum(h * p, out=s[1:])
    g = np.zeros(count, U)
    g[: count - n + 1] = mix((s[n:] - s[: count - n + 1]) * inv[: count - n + 1])
    ok[: count - n + 1] = True
    for j in range(1, n):  # the last n - 1 positions of each text
        at = off[1:] - j
        ok[at[at >= off[:-1]]] = False
    return g, ok


def doc_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def slices(batches, column: str = "text", most_bytes: int = CHUNK, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each hold about most_bytes; a longer text comes alone. Small slices stay in the CPU's cache and keep workers small."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + most_bytes, side="right"))
            to = min(max(to, at + 1), at + most_rows, n)
            yield batch.slice(at, to - at)
            at = to
