"""Token ids packed by Simple-8b, word-aligned.

Each 64-bit word has a selector in its top 4 bits and 60 bits of payload: selector 1 packs 60 ids of 1 bit, ..., selector 14 one
id of 60 bits. Selector 15 is the escape: the whole next word is one id, for ids of more than 60 bits and negative ones. Ids are cut
into blocks; packing starts anew in each, and the word at which each block starts is kept, so that any block decodes alone
and all words of a selector decode at once.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd

BLOCK = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COUNTS = [0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE = 15
U = np.uint64


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; 64 for negative ids."""
    x = ids.view(U)
    if not len(x) or x.max() < 1 << 52:  # exact as float64
        return np.frexp(x.astype(np.float64))[1].astype(np.int8)
    out = np.zeros(len(x), np.int8)
    for s in (32, 16, 8, 4, 2, 1):
        big = x >= U(1) << U(s)
        out[big] += s
        x = np.where(big, x >> U(s), x)
    return out + (x > 0)


def encode(ids: np.ndarray, off: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs sequences; those of sequence k are ``ids[off[k]:off[k + 1]]``.

    Gives the words of all, the first word of each block, counted over all, and the number of blocks before each sequence.
    """
    ids = np.ascontiguousarray(ids, np.int64)
    n = len(ids)
    blocks = -(-np.diff(off) // block)
    before = np.concatenate([[0], np.cumsum(blocks)])
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), before
    start = np.repeat(off[:-1], blocks) + (np.arange(before[-1]) - np.repeat(before[:-1], blocks)) * block
    end = np.r_[start[1:], n]
    left = (np.repeat(end, end - start) - np.arange(n)).astype(np.int32)
    bits = _bit_lengths(ids)
    selector = np.zeros(n, np.int8)
    at = np.arange(n, dtype=np.int32)
    open_ = np.ones(n, bool)
    for s in range(1, 15):
        small = np.flatnonzero(bits <= BITS[s])
        if not len(small):
            continue
        stop = np.flatnonzero(np.r_[small[1:] != small[:-1] + 1, True])
        run = np.repeat(small[stop] + 1, np.diff(np.r_[-1, stop])) - small  # ids from here on that fit
        fits = small[run >= np.minimum(COUNTS[s], left[small])]
        fits = fits[open_[fits]]
        selector[fits] = s
        open_[fits] = False
    selector[open_] = ESCAPE
    count = np.array([*COUNTS, 1], np.int32)[selector]
    nxt = (at + np.minimum(count, left)).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = nxt[i]
    p = np.array(starts, np.int64)
    sel = selector[p]
    place = np.cumsum(1 + (sel == ESCAPE)) - (1 + (sel == ESCAPE))
    out = np.zeros(int(place[-1]) + 1 + int(sel[-1] == ESCAPE), U)
    out[place] = sel.astype(U) << U(60)
    raw = ids.view(U)
    for s in range(1, 15):
        own = np.flatnonzero(sel == s)
        if len(own):
            q = p[own]
            rest = left[q]
            acc = np.zeros(len(own), U)
            for j in range(COUNTS[s]):
                inside = j < rest
                if not inside.any():
                    break
                acc |= np.where(inside, raw[np.minimum(q + j, n - 1)], U(0)) << U(j * BITS[s])
            out[place[own]] |= acc
    own = np.flatnonzero(sel == ESCAPE)
    out[place[own] + 1] = raw[p[own]]
    return out, place[np.searchsorted(p, start)], before


def decode(packed: bytes | np.ndarray, blocks, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of a sequence from its words and the first word of each of its blocks."""
    w = np.frombuffer(packed, U) if isinstance(packed, (bytes, memoryview)) else packed
    out = np.empty(n, np.int64)
    if not n:
        return out
    first = np.asarray(blocks, np.int64)
    head = (w >> U(60)).astype(np.int64)
    # a word after an escape is data; escapes can follow each other, so walk the chain where there are any
    is_word = np.ones(len(w), bool)
    for i in np.flatnonzero(head == ESCAPE):
        if is_word[i]:
            is_word[i + 1] = False
    at = np.flatnonzero(is_word)
    count = np.array([*COUNTS, 1])[head[at]]
    in_block = np.searchsorted(first, at, side="right") - 1
    total = np.cumsum(count) - count
    begin = np.searchsorted(at, first)
    to = total - total[begin][in_block] + in_block * block
    limit = np.minimum((in_block + 1) * block, n)
    for s in range(1, 15):
        own = np.flatnonzero(head[at] == s)
        if len(own):
            mask = U((1 << BITS[s]) - 1)
            for j in range(COUNTS[s]):
                where = to[own] + j
                ok = where < limit[own]
                out[where[ok]] = ((w[at[own[ok]]] >> U(j * BITS[s])) & mask).view(np.int64)
    own = np.flatnonzero(head[at] == ESCAPE)
    out[to[own]] = w[at[own] + 1].view(np.int64)
    return out


_ENCODINGS: dict[str, object] = {}


def encoding(ranks: bytes):
    """The tiktoken encoding of a ranks file's content; made once in each worker."""
    key = hashlib.md5(ranks).hexdigest()
    if key not in _ENCODINGS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def tokens(enc, text: str, piece: int = 100_000) -> np.ndarray:
    """Ids of a text. A very long one is cut between a letter and a space before a letter, where no token crosses, so the ids are those of the whole."""
    if len(text) <= piece:
        return enc.encode_to_numpy(text, disallowed_special=())
    out, at = [], 0
    while at < len(text):
        to = at + piece
        while to < len(text) and not (text[to] == " " and text[to - 1].isalpha() and text[to + 1 : to + 2].isalpha()):
            to += 1
        out.append(enc.encode_to_numpy(text[at:to], disallowed_special=()))
        at = to
    return np.concatenate(out)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_ids, words, blocks)`` for each row of docs: the ids of its text, packed.

    words holds little-endian 64-bit words, blocks the first word of each block of ``block`` ids. tokenizer is the path of a ranks file on the driver; its content is broadcast.
    Null and empty texts give no ids, no words and no blocks; an empty table gives no rows; very long texts are encoded piece by piece, to the ids of the whole. Each row stands for itself: nulls and repeats of doc_id don't matter. Other columns are ignored.
    """
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc = encoding(ranks.value)
        for b in wd.slices(batches, most_bytes=1 << 19):
            lists = [tokens(enc, x) if x else np.zeros(0, np.uint32) for x in b.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            ids = np.concatenate(lists).astype(np.int64)
            packed, first, before = encode(ids, off, block)
            word_at = np.r_[first, len(packed)][before]  # first word of each sequence
            raw = packed.astype("<u8").tobytes()
            col = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer((word_at * 8).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            local = first - np.repeat(word_at[:-1], np.diff(before))
            blocks = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(local.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), col, blocks], ["doc_id", "n_ids", "words", "blocks"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_ids long, words binary, blocks array<int>")


def unpack(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, ids)`` from the rows of ``pack``, with the same block: an array of ids for each row, empty where there are none. Null words or blocks give a null."""

    def run(batches):
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())
            ids = [None if w is None or at is None or n is None else decode(w, at, n, block) for n, w, at in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else x for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return packed.select("doc_id", "n_ids", "words", "blocks").mapInArrow(run, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Byte-pair merges and packed words have no SQL form; tests decode them and compare with the tokenizer.
SQL = None
