"""N-gram Jaccard join through parity sketches.

Each document is the set of its distinct word n-grams. A set is hashed by exclusive or: every n-gram toggles one bit, so two sketches
differ in at most as many bits as the sets differ in n-grams, and a Hamming distance above the largest symmetric difference that sizes and
threshold allow rules a pair out. A sketch has one and a half to three bits for each n-gram; of two sketches the longer one is folded to the shorter.

Candidates come from a pigeonhole over the set bits of a sketch of 2**52 bits, in which each n-gram has a bit of its own: of the first
``size - ceil(threshold * size) + 1`` bits, in any one order, a partner lacks fewer than all, so two similar sets share
one of them, without exception. (Wider chunks need more of them than two thirds of the n-grams at the threshold of 0.6, so would hold hardly more
than one n-gram each, and empty ones would lose pairs.) The order has frequent n-grams last, by the frequency that their words lead to expect, or by their own where that is known to be higher; any order that is the same for all is right, so the
counts of words, in hashed places, and the list of frequent n-grams, both gathered by each task with bounded memory and added up, decide about speed only. Only sets of one size band, from threshold times a size on, meet.

Sets of equal content form one group first, and its least doc_id stands for it. Documents that share many bits with one of lesser doc_id are gathered around it;
within such a star all sets are compared, in blocks, and only numbers of links leave a block. What is left are runs of documents of different stars that share a bit: in short ones pairs are counted, and are
candidates if they share enough of their bits; of long ones, the sketches of documents outside the largest star meet those of all, in blocks, and only pairs that pass leave them. Pairs are then verified by their sets. So a chain of documents, each similar to the next one, costs what its links cost, not the square of its length.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd
from .shared import Tables, groups

N = 3
THRESHOLD = 0.6
U = np.uint64
#: Frequent n-grams: seen in so many documents by one task, and by all; of more than MOST the most frequent ones are listed. These decide about order alone.
LOCAL, FREQUENT, MOST = 3, 16, 1 << 19
#: Places in which words are counted, those of them that are added up together, and steps of a frequency's logarithm to the base 2, which is taken as at least -FLOOR. These decide about order alone, too.
PLACES, SLICE, STEPS, FLOOR = 1 << 16, 1 << 12, 1 << 12, 128
#: N-grams between two prunings of a task's counts.
BUCKET = 1 << 21
#: Rows of an n-gram that go to one task, by the frequent ones' counts.
PIECE = 1 << 15
#: Longest run whose pairs are counted; in longer ones sketches meet. Pairs that are formed at once, and rows that are counted together.
SHORT, PAIRS, CHUNK = 512, 1 << 21, 1 << 17
#: Sketches, and sets, that meet in one block of a longer run or a star.
BLOCK, MEMBERS = 2048, 512
_H52 = U((1 << 52) - 1)


def sets(w: wd.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 52-bit hash of each distinct n-gram, in that order. A text of 1 to n - 1 words has one n-gram, all its words."""
    key = np.unique(_keys(w, n)[0])
    return (key >> U(52)).astype(np.int64), key & _H52


def weighed_sets(w: wd.Words, n: int, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``sets``, and the expected frequency of each n-gram, in steps of its logarithm from 0 on. logs: of the frequencies of words as shares, by places, and of the number of all words last."""
    key, at, size = _keys(w, n)
    key, first = np.unique(key, return_index=True)
    at, size = at[first], size[first]
    # sums of whole numbers, so the same in every task
    total = np.concatenate([[0], np.cumsum(logs[place(w.h)])])
    weight = np.maximum(total[at + size] - total[at] + logs[-1] + FLOOR * STEPS, 0)
    return (key >> U(52)).astype(np.int64), key & _H52, weight.astype(U)


def place(h: np.ndarray) -> np.ndarray:
    return (h & U(PLACES - 1)).astype(np.int64)


def _keys(w: wd.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of all n-grams in 64 bits, their first words' positions and numbers of words."""
    g, ok = wd.ngrams(w.h, w.off, n)
    doc = wd.doc_of(w.off)
    key = (doc[ok].astype(U) << U(52)) | (g[ok] >> U(12))
    at = np.flatnonzero(ok)
    words = np.full(len(at), n)
    size = np.diff(w.off)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        more = np.empty(len(short), U)
        for m in range(1, n):
            own = size[short] == m
            if own.any():
                gm, _ = wd.ngrams(w.h, w.off, m)
                more[own] = gm[w.off[short[own]]]
        key = np.concatenate([key, (short.astype(U) << U(52)) | (more >> U(12))])
        at, words = np.concatenate([at, w.off[short]]), np.concatenate([words, size[short]])
    return key, at, words


def fingerprints(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell the sets of ``rows`` texts apart."""
    f1, f2 = np.zeros(rows, U), np.zeros(rows, U)
    if len(doc):
        m = wd.mix(h + U(0x2545F4914F6CDD1D))
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        f1[doc[first]] = np.add.reduceat(m, first)
        f2[doc[first]] = np.add.reduceat(wd.mix(m + U(77)), first)
    return f1.view(np.int64), f2.view(np.int64)


def sketch(h: np.ndarray, size: int) -> bytes:
    """Parity of the n-grams at each bit; one and a half to three bits for each of ``size`` n-grams, at which unrelated sets differ by more than similar ones may."""
    places = max(256, 1 << (max(int(size), 1) * 3 // 2 - 1).bit_length())
    at = wd.mix(h + U(0x51ED27)) & U(places - 1)
    bits = np.bincount(at.astype(np.int64), minlength=places) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def distances(x: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Hamming distances of a sketch to others of one length, the longer kind folded; folding xors halves, which hold the bits whose lower places are equal."""
    while len(x) > many.shape[1]:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while many.shape[1] > len(x):
        many = many[:, : many.shape[1] // 2] ^ many[:, many.shape[1] // 2 :]
    return np.bitwise_count(many ^ x).sum(1, dtype=np.int64)


def far(size_a, size_b, distance, threshold: float):
    """Whether sizes and distance rule a pair out."""
    return (np.minimum(size_a, size_b) < threshold * np.maximum(size_a, size_b) - 1e-9) | (distance > (1 - threshold) / (1 + threshold) * (size_a + size_b) + 1e-9)


def _profiles(n: int):
    """mapInArrow function: fingerprint, size and sketch of each document's set, what n-grams the task saw often (doc_id null, f1 the n-gram, size its documents), and how many words at each place (doc_id null, f2 the slice, sketch its counts)."""

    def run(batches):
        grams, counts, held, waiting, rounds = np.zeros(0, U), np.zeros(0, np.int64), [], 0, 0
        words = np.zeros(PLACES, np.int64)

        def pruned():
            x, c = np.unique(np.concatenate(held), return_counts=True)
            both = np.concatenate([grams, x])
            u, at = np.unique(both, return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([counts, c])).astype(np.int64)
            return u, total

        for b in wd.slices(batches):
            rows = b.num_rows
            w = wd.scan(b.column(1))
            words += np.bincount(place(w.h), minlength=PLACES)
            doc, h = sets(w, n)
            size = np.bincount(doc, minlength=rows)
            f1, f2 = fingerprints(doc, h, rows)
            off = np.concatenate([[0], np.cumsum(size)])
            marks = pa.array([sketch(h[i:j], j - i) for i, j in zip(off, off[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f1), pa.array(f2), pa.array(size, pa.int32()), marks], ["doc_id", "f1", "f2", "size", "sketch"])
            held.append(h)
            waiting += len(h)
            if waiting > BUCKET:  # lossy counting: what is dropped was seen at most once in each bucket so far
                grams, counts = pruned()
                rounds += 1
                grams, counts = grams[counts > rounds], counts[counts > rounds]
                held, waiting = [], 0
        if held:
            grams, counts = pruned()
        often = counts >= LOCAL
        k = int(often.sum())
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(grams[often].view(np.int64)), pa.nulls(k, pa.int64()), pa.array(counts[often], pa.int32()), pa.nulls(k, pa.binary())], ["doc_id", "f1", "f2", "size", "sketch"])
        parts = [(k, x.tobytes()) for k, x in enumerate(words.reshape(-1, SLICE)) if x.any()]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([x for x, _ in parts], pa.int64()), pa.nulls(k, pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["doc_id", "f1", "f2", "size", "sketch"])

    return run


def _summed(batches):
    """Over rows (slice, counts): the counts of each slice, added up."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])


def logarithms(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the places' shares of all words, and of the number of words, in steps."""
    total = max(int(counts.sum()), 1)
    return np.rint(np.log2(np.r_[np.maximum(counts, 1) / total, total]) * STEPS).astype(np.int64)


def prefixes(doc: np.ndarray, h: np.ndarray, w: np.ndarray, size: np.ndarray, threshold: float, grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places in h of each set's first bits: rarer n-grams before frequent ones, by what is expected or, if more, by the listed ones' ranks (grams, in order, and their frequencies in steps as of w), then by hash. doc, h and w are as from ``weighed_sets``."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(grams):
        at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
        w = np.where(grams[at] == h, np.maximum(rank[at], w), w)
    w = np.minimum(w, U((1 << 20) - 1))
    order = np.argsort((doc.astype(U) << U(52)) | (w << U(32)) | (wd.mix(h) >> U(32)), kind="stable")  # h is in order, so ties are in order of h
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    some = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    return order[np.arange(len(h)) - start[doc] < some[doc]]


def _bits(n: int, threshold: float, listed):
    """mapInArrow function: the bits that a document goes into the join with; salt tells the pieces of a very frequent n-gram apart."""

    def run(batches):
        grams, rank, _, logs = listed.value
        for b in wd.slices(batches):
            doc, h, w = weighed_sets(wd.scan(b.column(1)), n, logs)
            size = np.bincount(doc, minlength=b.num_rows)
            at = prefixes(doc, h, w, size, threshold, grams, rank)
            off = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=b.num_rows))]).astype(np.int32)
            f1, _ = fingerprints(doc, h, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f1), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), pa.array(h[at].view(np.int64)))], ["doc", "f1", "size", "keys"])

    return run


def _shared(batches):
    """Over rows (key, salt, doc, size) in order of the first three: those whose run has another document, with the run's first."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        key, salt, doc, size = (np.asarray(c) for c in b.columns)
        first0 = None
        if held is not None:
            key, salt, doc, size, first0 = np.r_[held[0], key], np.r_[held[1], salt], np.r_[held[2], doc], np.r_[held[3], size], held[4]
        new = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
        head = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if first0 is not None:  # the row held back may be within a run
            head[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(key)] = first0
        single = new & np.r_[new[1:], False] & (head == doc)
        x = ~single[:-1]
        held = tuple(c[-1:].copy() for c in (key, salt, doc, size)) + (head[-1],)
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][x]) for c in (key, salt, doc, size, head)], ["key", "salt", "doc", "size", "first"])
    if held is not None and held[4] != held[2][0]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[:4]] + [pa.array([held[4]])], ["key", "salt", "doc", "size", "first"])


def _starred(batches):
    """Over rows (key, doc, size, first) in order of doc: each with its star, the first document of most of its runs, or itself where that is no lesser one or too few runs have it."""

    def stars(doc, size, first):
        star = doc.copy()
        at = np.flatnonzero(first < doc)
        if len(at):
            at = at[np.lexsort((first[at], doc[at]))]
            new = np.flatnonzero(np.r_[True, (doc[at][1:] != doc[at][:-1]) | (first[at][1:] != first[at][:-1])])
            n, d, f, s = np.diff(np.r_[new, len(at)]), doc[at][new], first[at][new], size[at][new]
            good = (n >= 2) & (n * 20 >= s)
            n, d, f = n[good], d[good], f[good]
            order = np.lexsort((f, -n, d))
            d, f = d[order], f[order]
            d, head = np.unique(d, return_index=True)
            if len(d):
                to = np.minimum(np.searchsorted(d, doc), len(d) - 1)
                star = np.where(d[to] == doc, f[head][to], doc)
        return star

    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None and b.num_rows:
            x = [np.asarray(c) for c in b.columns]
            x = [np.r_[p, q] for p, q in zip(held, x)] if held else x
            cut = int(np.searchsorted(x[1], x[1][-1]))
            held = [c[cut:] for c in x]
            x = [c[:cut] for c in x]
        elif b is None and held:
            x = held
        else:
            continue
        if len(x[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x[0], x[1], x[2], stars(*x[1:]))], ["key", "doc", "size", "star"])


def _mixed(batches):
    """Over rows (key, star, doc, size) in order of key and star: those of runs with several stars; n: the run's rows, m: those outside its largest star, minor: whether the row is one of these, lead: the run's least document."""

    def several(key, star, doc, size):
        new = np.r_[True, key[1:] != key[:-1]]
        other = new | np.r_[True, star[1:] != star[:-1]]
        run, part = np.cumsum(new) - 1, np.cumsum(other) - 1
        n, c = np.bincount(run), np.bincount(part)
        of = run[other]
        order = np.lexsort((np.arange(len(c)), -c, of))
        largest = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        m = n - c[largest]
        x = m[run] > 0
        minor = part != largest[run]
        lead = np.minimum.reduceat(doc, np.flatnonzero(new))
        return pa.RecordBatch.from_arrays([pa.array(v[x]) for v in (key, star, doc, size, n[run], m[run], minor, lead[run])], ["key", "star", "doc", "size", "n", "m", "minor", "lead"])

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        x = [np.asarray(c) for c in b.columns]
        if held and x[0][-1] == held[0][0][-1] and x[0][0] == x[0][-1]:
            held.append(x)  # a long run goes on
            continue
        x = [np.concatenate(c) for c in zip(*held, x)]
        cut = int(np.flatnonzero(x[0] != x[0][-1])[-1]) + 1 if x[0][0] != x[0][-1] else 0
        held = [[c[cut:] for c in x]]
        if cut:
            yield several(*(c[:cut] for c in x))
    if held:
        yield several(*(np.concatenate(c) for c in zip(*held)))


def _by_block(batches, names: int):
    """Rows of one block pair after the other: the first ``names`` columns are its name, by which rows are in order."""
    name, held = None, None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for r in zip(*cols):
            if name != r[:names]:
                if held:
                    yield name, held
                name, held = r[:names], [[] for _ in r[names:]]
            for c, v in zip(held, r[names:]):
                c.append(v)
    if held:
        yield name, held


def _counted(threshold: float):
    """mapInArrow function over rows (lead, key, star, doc, size) in order of lead and key: pairs of documents of different stars and one size band, with how many of the runs hold both.

    Runs of one passage have the same least document, so its pairs are counted here, and leave once.
    """

    def pairs(key, star, doc, size):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[start, len(key)])
        names, own = np.unique(doc, return_inverse=True)
        sizes = np.zeros(len(names), np.int64)
        sizes[own] = size
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for k in np.unique(n[n > 1]):
            left, right = np.triu_indices(k, 1)
            runs = start[n == k]
            step = max(1, PAIRS // len(left))
            for lo in range(0, len(runs), step):
                at = runs[lo : lo + step, None]
                x, y = (at + left).ravel(), (at + right).ravel()
                ok = (star[x] != star[y]) & (own[x] != own[y]) & (np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9)
                x, y = own[x[ok]], own[y[ok]]
                code, count = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_counts=True)
                codes.append(code)
                counts.append(count)
        if not codes:
            return None
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        x, y = code // len(names), code % len(names)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (names[x], names[y], sizes[x].astype(np.int32), sizes[y].astype(np.int32), total)], ["doc_a", "doc_b", "size_a", "size_b", "n"])

    def run(batches):
        held: list = []
        waiting = 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                if b.num_rows:
                    held.append([np.asarray(c) for c in b.columns])
                    waiting += b.num_rows
                if waiting < CHUNK:
                    continue
            if not held:
                continue
            x = [np.concatenate(c) for c in zip(*held)]
            cut = len(x[0]) if b is None else int(np.searchsorted(x[0], x[0][-1]))
            if b is not None and not cut:  # one lead so far; its runs, but for the last, can go
                cut = int(np.flatnonzero(np.r_[True, x[1][1:] != x[1][:-1]])[-1])
            held, waiting = [[c[cut:] for c in x]], len(x[0]) - cut
            if cut and (out := pairs(*(c[:cut] for c in x[1:]))) is not None:
                yield out

    return run


def _near(threshold: float):
    """mapInArrow function over rows (key, i, j, left, doc, star, size, minor, sketch): pairs of a left and a right document, of different stars, whose sketches are near enough."""

    def run(batches):
        for _, (left, doc, star, size, minor, marks) in _by_block(batches, 3):
            left, doc, star, size, minor = (np.array(x) for x in (left, doc, star, size, minor))
            words = np.array([len(m) for m in marks])
            kinds = [(own, np.frombuffer(b"".join(marks[x] for x in own), U).reshape(len(own), -1)) for k in np.unique(words) if len(own := np.flatnonzero((words == k) & ~left))]
            for x in np.flatnonzero(left):
                mine = np.frombuffer(marks[x], U)
                for own, rows in kinds:
                    ok = (star[own] != star[x]) & (~minor[own] | (doc[own] > doc[x]))
                    ok &= np.minimum(size[own], size[x]) >= threshold * np.maximum(size[own], size[x]) - 1e-9
                    if ok.any():
                        y = own[ok]
                        y = y[~far(size[y], size[x], distances(mine, rows[ok]), threshold)]
                        if len(y):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[x], doc[y])), pa.array(np.maximum(doc[x], doc[y]))], ["doc_a", "doc_b"])

    return run


def _passing(threshold: float):
    """mapInArrow function over rows (doc_a, doc_b, size_a, size_b, sketch_a, sketch_b): pairs whose sketches are near enough."""

    def run(batches):
        for b in batches:
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            gap = np.array([distances(np.frombuffer(p, U), np.frombuffer(q, U)[None])[0] for p, q in zip(x, y)], np.int64)
            ok = ~far(np.asarray(b.column(2)).astype(np.int64), np.asarray(b.column(3)).astype(np.int64), gap, threshold)
            yield b.select(["doc_a", "doc_b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _set_rows(n: int):
    """mapInArrow function over rows (text, f1, ...): the set of n-grams in place of the text, of those texts that f1 is the fingerprint of."""

    def run(batches):
        for b in wd.slices(batches):
            doc, h = sets(wd.scan(b.column(0)), n)
            own = pa.array(fingerprints(doc, h, b.num_rows)[0] == np.asarray(b.column(1)))
            off = np.searchsorted(doc, np.arange(b.num_rows + 1))
            s = pa.array([h[i:j].tobytes() for i, j in zip(off, off[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[2:], s], [*b.schema.names[2:], "s"]).filter(own)

    return run


def _compare(threshold: float, forest: bool):
    """mapInArrow function over rows (star, i, j, block, doc, weight, s): compares the sets of block i with those of block j.

    Gives for each document the weights of those similar to it, and the least document that it is connected with. As a forest, documents that are connected already aren't compared, and weights aren't counted.
    """

    def run(batches):
        for (_, i, j), (block, doc, weight, raw) in _by_block(batches, 3):
            block, doc, weight = (np.array(x) for x in (block, doc, weight))
            size = np.array([len(x) // 8 for x in raw])
            order = np.unique(doc, return_index=True)[1]  # repeated rows count once
            order = order[np.argsort(size[order], kind="stable")]
            block, doc, weight, size = block[order], doc[order], weight[order], size[order]
            off = np.concatenate([[0], np.cumsum(size)])
            _, ids = np.unique(np.concatenate([np.frombuffer(raw[k], U) for k in order]), return_inverse=True)
            mark = np.zeros(int(ids.max()) + 1, np.int32)
            label, links = np.arange(len(doc)), np.zeros(len(doc), np.int64)
            for x in range(len(doc) - 1):
                # as sizes ascend, only later sets of the size band are left
                others = np.arange(x + 1, int(np.searchsorted(size * threshold - 1e-9, size[x], side="right")))
                if i != j:
                    # blocks are compared within themselves elsewhere; a forest needs what is connected here too
                    others = others if forest else others[block[others] != block[x]]
                if forest:
                    others = others[label[others] != label[x]]
                if not len(others):
                    continue
                mark[ids[off[x] : off[x + 1]]] = 1
                lo, hi = others[0], others[-1] + 1
                if len(others) * 16 > hi - lo:
                    same = np.add.reduceat(mark[ids[off[lo] : off[hi]]], off[lo:hi] - off[lo])[others - lo]
                else:
                    same = np.array([mark[ids[off[k] : off[k + 1]]].sum() for k in others])
                mark[ids[off[x] : off[x + 1]]] = 0
                ok = others[same >= threshold * (size[x] + size[others] - same)]
                if len(ok):
                    both = np.unique(np.r_[label[x], label[ok]])
                    if len(both) > 1:
                        label[np.isin(label, both)] = both[0]
                    links[x] += weight[ok].sum()
                    links[ok] += weight[x]
            least = np.full(len(doc), np.iinfo(np.int64).max)
            np.minimum.at(least, label, doc)
            least = least[label]
            on = (links > 0) | (least < doc)
            yield pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(links[on]), pa.array(least[on])], ["doc", "links", "least"])

    return run


def _similar(threshold: float):
    """mapInArrow function over rows (doc_a, doc_b, weight_a, weight_b, s_a, s_b): the pairs that are similar, without their sets."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(same >= threshold * (len(x) + len(y) - same))
            yield b.select(["doc_a", "doc_b", "weight_a", "weight_b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _profiled(base: DataFrame, tables: Tables, n: int) -> tuple[DataFrame, DataFrame, tuple]:
    """Profiles of documents; (doc_id, rep, weight) of those with words; the frequent n-grams in order, their ranks by frequency and pieces, and the logarithms of words' frequencies."""
    all_ = tables.write(base.mapInArrow(_profiles(n), "doc_id long, f1 long, f2 long, size int, sketch binary"), "profiles")
    often = all_.where("doc_id is null and f1 is not null").groupBy(F.col("f1").alias("gram")).agg(F.sum("size").alias("n")).where(F.col("n") >= FREQUENT)
    got = often.orderBy(F.desc("n"), "gram").limit(MOST).toPandas()  # bounded by MOST
    grams, count = got["gram"].to_numpy(np.int64).view(U), got["n"].to_numpy(np.int64)
    rank = np.rint((np.log2(np.maximum(count, 1)) + FLOOR) * STEPS).astype(U)
    order = np.argsort(grams)
    words = np.zeros((PLACES // SLICE, SLICE), np.int64)
    slices = all_.where("doc_id is null and f2 is not null").select(F.col("f2").alias("slice"), F.col("sketch").alias("counts"))
    for k, x in slices.repartition(PLACES // SLICE, "slice").mapInArrow(_summed, "slice long, counts binary").collect():  # PLACES numbers
        words[k] = np.frombuffer(x, np.int64)
    profiles = all_.where("doc_id is not null")
    known = profiles.where("size > 0").groupBy("doc_id").agg(F.max(F.struct("size", "f1", "f2")).alias("x")).select("doc_id", "x.*")
    reps = known.groupBy("f1", "f2", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"))
    members = tables.write(known.join(reps, ["f1", "f2", "size"]).select("doc_id", "f1", "rep", "size", "weight"), "members")
    return profiles, members, (grams[order], rank[order], -(-count[order] // PIECE), logarithms(words.ravel()))


def _runs(base: DataFrame, reps: DataFrame, tables: Tables, n: int, threshold: float, listed: tuple) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, doc, size, star) of the bits that several sets share; and the keys that are in pieces, if there are any."""
    spark = base.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = base.mapInArrow(_bits(n, threshold, spark.sparkContext.broadcast(listed)), "doc long, f1 long, size int, keys array<long>")
    rows = bits.join(reps.select("doc", "f1"), ["doc", "f1"], "left_semi").select(F.explode("keys").alias("key"), "doc", "size")
    grams, _, pieces, _ = listed
    many = None
    if int(pieces.max(initial=0)) > 1:
        many = F.broadcast(spark.createDataFrame([(int(g), int(p)) for g, p in zip(grams.view(np.int64), pieces) if p > 1], "key long, pieces int"))  # MOST rows at most
        rows = rows.join(many, "key", "left").select("key", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int"), F.lit(0)).alias("salt"), "doc", "size")
    else:
        rows = rows.select("key", F.lit(0).alias("salt"), "doc", "size")
    rows = rows.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "doc")
    runs = rows.mapInArrow(_shared, "key long, salt int, doc long, size int, first long")
    if many is not None:
        runs = tables.write(runs, "pieces")
        firsts = runs.join(many, "key", "left_semi").groupBy("key").agg(F.min("first").alias("least"))
        runs = runs.join(F.broadcast(firsts), "key", "left").withColumn("first", F.coalesce("least", "first"))  # as many as many
    runs = runs.select("key", "doc", "size", "first").repartition(parts, "doc").sortWithinPartitions("doc")
    return tables.write(runs.mapInArrow(_starred, "key long, doc long, size int, star long"), "runs"), many


def _candidates(runs: DataFrame, many: DataFrame | None, profiles: DataFrame, tables: Tables, threshold: float) -> DataFrame:
    """Pairs of documents of different stars that share a bit, and whose sketches are near enough."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "key long, star long, doc long, size int, n long, m long, minor boolean, lead long"
    rows = (runs if many is None else runs.join(many, "key", "left_anti")).select("key", "star", "doc", "size")
    mixed = rows.repartition(parts, "key").sortWithinPartitions("key", "star").mapInArrow(_mixed, kind)
    if many is not None:  # their rows don't come to one task
        hot = runs.join(many.drop("pieces"), "key")
        sizes = hot.groupBy("key", "star").agg(F.count("*").alias("count"), F.min("doc").alias("lead")).groupBy("key").agg(F.sum("count").alias("n"), F.max(F.struct("count", "star")).alias("x"), F.min("lead").alias("lead"))
        sizes = F.broadcast(sizes.select("key", "n", (F.col("n") - F.col("x.count")).alias("m"), F.col("x.star").alias("largest"), "lead").where("m > 0"))  # as many as many
        mixed = mixed.unionByName(hot.join(sizes, "key").select("key", "star", "doc", "size", "n", "m", (F.col("star") != F.col("largest")).alias("minor"), "lead"))
    mixed = tables.write(mixed, "mixed")
    tables.drop("runs")
    tables.release()
    # Up to where the first of two lists of bits ends, all that the sets share is in both lists; so they share no more than the runs show and what that set has beyond its list.
    few = mixed.where(F.col("n") <= SHORT).select("lead", "key", "star", "doc", "size")
    few = few.repartition(parts, "lead").sortWithinPartitions("lead", "key").mapInArrow(_counted(threshold), "doc_a long, doc_b long, size_a int, size_b int, n long")
    pairs = few.groupBy("doc_a", "doc_b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.sum("n").alias("n"))
    more = mixed.where(F.col("n") > SHORT).groupBy("doc").agg(F.count("*").alias("more"))
    for x in "ab":
        pairs = pairs.join(more.select(F.col("doc").alias(f"doc_{x}"), F.col("more").alias(f"more_{x}")), f"doc_{x}", "left")
    beyond = F.ceil(F.greatest("size_a", "size_b") * F.lit(threshold) - 1e-9) - 1
    seen = F.col("n") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    pairs = pairs.where(seen + beyond >= (F.col("size_a") + F.col("size_b")) * F.lit(threshold / (1 + threshold)) - 1e-9).select("doc_a", "doc_b", "size_a", "size_b")
    pairs = tables.write(pairs, "pairs")
    tables.release()
    marks = profiles.groupBy("doc_id").agg(F.max(F.struct("size", "f1", "f2", "sketch")).alias("x")).select(F.col("doc_id").alias("doc"), "x.sketch")
    for x in "ab":
        pairs = pairs.join(marks.select(F.col("doc").alias(f"doc_{x}"), F.col("sketch").alias(f"sketch_{x}")), f"doc_{x}")
    pairs = pairs.select("doc_a", "doc_b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_passing(threshold), "doc_a long, doc_b long")
    # a long run is a grid: documents outside its largest star, in blocks, by all its documents, in blocks
    long = mixed.where(F.col("n") > SHORT).join(marks, "doc")
    high, wide = (F.floor((F.col(c) - 1) / BLOCK).cast("int") for c in ("m", "n"))
    row, column = F.pmod(F.xxhash64("doc"), high + 1).cast("int"), F.pmod(F.xxhash64("doc", F.lit(1)), wide + 1).cast("int")
    rest = ["doc", "star", "size", "minor", "sketch"]
    left = long.where("minor").select("key", row.alias("i"), F.explode(F.sequence(F.lit(0), wide)).alias("j"), F.lit(True).alias("left"), *rest)
    right = long.select("key", F.explode(F.sequence(F.lit(0), high)).alias("i"), column.alias("j"), F.lit(False).alias("left"), *rest)
    long = left.unionByName(right).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_near(threshold), "doc_a long, doc_b long")
    return tables.write(pairs.unionByName(long).distinct(), "candidates")


def _linked(base: DataFrame, tables: Tables, n: int, threshold: float, forest: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, rep, weight) of sets, links (doc, links) and edges (doc_a, doc_b) of reps; as a forest, edges suffice to connect what is similar and links aren't counted."""
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    profiles, members, listed = _profiled(base, tables, n)
    reps = members.where("doc_id = rep").select(F.col("doc_id").alias("doc"), "f1", "weight")
    runs, many = _runs(base, reps, tables, n, threshold, listed)
    tables.drop("pieces")
    tables.release()
    stars = tables.write(runs.where("star <> doc").select("doc", "star").distinct(), "stars")
    pairs = _candidates(runs, many, profiles, tables, threshold)
    tables.drop("mixed", "pairs", "profiles")
    tables.release()

    # within stars
    centres = stars.select(F.col("star").alias("doc"), "star").distinct().join(stars.select("doc"), "doc", "left_anti")
    inside = stars.unionByName(centres)
    inside = inside.join(inside.groupBy("star").agg(F.count("*").alias("n")), "star").withColumn("last", F.floor((F.col("n") - 1) / MEMBERS).cast("int"))
    inside = inside.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("last") + 1).cast("int")).join(reps, "doc")
    inside = base.withColumnRenamed("doc_id", "doc").join(inside, "doc").select("text", "f1", "star", "last", "block", "doc", "weight")
    inside = inside.mapInArrow(_set_rows(n), "star long, last int, block int, doc long, weight long, s binary")
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    inside = inside.select("star", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "weight", "s")
    inside = inside.repartition(parts, "star", "i", "j").sortWithinPartitions("star", "i", "j")
    inside = tables.write(inside.mapInArrow(_compare(threshold, forest), "doc long, links long, least long"), "inside")

    # between stars
    some = pairs.select(F.col("doc_a").alias("doc")).unionByName(pairs.select(F.col("doc_b").alias("doc"))).distinct().join(reps, "doc")
    own = base.withColumnRenamed("doc_id", "doc").join(some, "doc").select("text", "f1", "doc", "weight").mapInArrow(_set_rows(n), "doc long, weight long, s binary").dropDuplicates(["doc"])
    own = tables.write(own, "sets")
    side = lambda x: own.select(F.col("doc").alias(f"doc_{x}"), F.col("weight").alias(f"weight_{x}"), F.col("s").alias(f"s_{x}"))
    both = pairs.join(side("a"), "doc_a").join(side("b"), "doc_b").select("doc_a", "doc_b", "weight_a", "weight_b", "s_a", "s_b")
    between = tables.write(both.mapInArrow(_similar(threshold), "doc_a long, doc_b long, weight_a long, weight_b long"), "between")
    tables.drop("sets", "candidates")
    tables.release()

    links = inside.select("doc", "links").unionByName(between.select(F.col("doc_a").alias("doc"), F.col("weight_b").alias("links"))).unionByName(between.select(F.col("doc_b").alias("doc"), F.col("weight_a").alias("links")))
    edges = inside.where("least <> doc").select(F.col("least").alias("doc_a"), F.col("doc").alias("doc_b")).unionByName(between.select("doc_a", "doc_b"))
    return members, links.groupBy("doc").agg(F.sum("links").alias("links")), edges


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _classed(members: DataFrame, edges: DataFrame, tables: Tables) -> DataFrame:
    """members with class_id, the least doc_id of those that are connected."""
    roots = groups(edges, tables).select(F.col("node").alias("rep"), "root")
    return members.join(roots, "rep", "left").withColumn("class_id", F.coalesce("root", "rep"))


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, n_links)``, one row for each document.

    n_links: other documents whose sets of word n-grams have a Jaccard similarity of threshold or more to its own, equal sets included. class_id: the least doc_id of
    all documents that it is connected with by such links, directly or through others.

    Rows with a null doc_id are left out. Documents without words (null or empty texts, or signs only) have no links and are classes of their own. Of several rows of a doc_id, one with most
    n-grams counts. Words are as in ``words``; texts of fewer than n words have one n-gram, all their words. Of an empty table there are no rows. Very long texts are sets like others. Ties don't
    matter: every pair at the threshold counts. Other columns are ignored, whatever their names.
    """
    tables = Tables(docs.sparkSession, "parity")
    base = _base(docs)
    members, links, edges = _linked(base, tables, n, threshold, False)
    out = _classed(members, edges, tables).join(links.withColumnRenamed("doc", "rep"), "rep", "left")
    out = out.select("doc_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    rest = base.select("doc_id").distinct().join(members.select("doc_id"), "doc_id", "left_anti")
    return out.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that are, directly or through others, similar to one of a lesser doc_id.

    Rows without doc_id or words stay. Of repeated rows of a doc_id all stay, or none. All columns are kept as they are.
    """
    tables = Tables(docs.sparkSession, "one")
    members, _, edges = _linked(_base(docs), tables, n, threshold, True)
    gone = _classed(members, edges, tables).where("doc_id <> class_id").select(F.col("doc_id").alias("textloom_gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["textloom_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as w from documents where doc_id is not null and text is not null),
g as (select doc_id, case when len(w) < {N} then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + {N - 1}], ' ') for i in range(1, len(w) - {N - 2})]) end as g from w where len(w) > 0),
s as (select doc_id, list_sort(g) as g from g),
r as (select g, min(doc_id) as rep, len(g) as n, count(*) as weight from s group by g),
m as (select s.doc_id, r.rep, r.weight from s join r on s.g = r.g),
e as (select rep, n, weight, unnest(g) as x from r),
p as (select a.rep as a, b.rep as b, b.weight from e a join e b on a.x = b.x and a.rep <> b.rep group by a.rep, b.rep, a.n, b.n, b.weight having cast(count(*) as double) / (a.n + b.n - count(*)) >= {THRESHOLD}),
l as (select a, sum(weight) as links from p group by a),
c as (select a as node, a as root from p union select c.node, p.b from c join p on p.a = c.root),
k as (select node, min(root) as root from c group by node)
select m.doc_id, coalesce(k.root, m.rep) as class_id, cast(coalesce(l.links, 0) + m.weight - 1 as bigint) as n_links from m left join k on k.node = m.rep left join l on l.a = m.rep
union all
select distinct doc_id, doc_id, cast(0 as bigint) from documents where doc_id is not null and doc_id not in (select doc_id from m)
"""
