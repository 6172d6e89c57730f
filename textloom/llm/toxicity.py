"""Toxicity of text that hides what it says: noisy-channel deobfuscation, then a score of the restored text.

A writer who hides a word swaps letters for look-alikes, sets its letters apart or repeats them. Each such stretch becomes a lattice of characters:
a look-alike may stand for several letters, a repeated letter for one or two, a separator for nothing or for a word boundary, each at a cost. The Viterbi path of least cost under a
character language model, 4-grams counted over all documents, is the restored word. A stretch without look-alikes, three equal letters or spacing isn't searched; words are
compared with repeated letters taken once, so a letter that is only doubled needs no search.

The score is naive Bayes over words that labelled documents show to be toxic. Copies among the labelled documents are told by min-hashes of their word 3-grams, half of which must agree, and
count once, so the words of a text that was copied many times don't become signs of anything.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd

#: Labelled documents that the classifier is fitted on, at most so many of each class, chosen by hash of doc_id.
TRAIN_DOCS = 3000
#: A word is a sign when its odds of standing in toxic documents are, with 95 % confidence, so many times those in others.
LIFT = 4.0
#: Documents that a sign occurs in, copies counted once.
SUPPORT = 3
#: Min-hashes of a labelled document. Documents that share one of the first BANDS are compared, and are copies if half of all are equal, so at a Jaccard similarity of word 3-grams of about a half.
SKETCH, BANDS = 64, 8
U = np.uint64

#: Boundary, a to z, other letters.
SYMBOLS = 28
OTHER = 27
_FOLD = {"à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ø": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y"}
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "¢": "c"}
#: Costs in nats: a look-alike, a separator dropped or taken as a boundary, one letter of two dropped, the second of three or more kept, a look-alike taken as no letter, a sign at the edge of a word taken as punctuation.
SWAP, JOIN, CUT, HALVE, DOUBLE, PLAIN, EDGE = 0.7, 0.1, 1.0, 2.0, 1.0, 6.0, 0.0

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "@$!|+"]] = True
_BODY = _LETTER | _DIGIT | _SIGN
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[ord(c) for c in " .-_*~,/"]] = True
_GAPS = _SEPARATORS.copy()
_GAPS[[ord(c) for c in "\n\r\t"]] = True
#: Pieces of a stretch, and what stands between them.
_PIECE = re.compile("([a-z0-9@$!|+\x80-\U0010ffff]+)|[^a-z0-9@$!|+\x80-\U0010ffff]+")

_CODE = np.zeros(256, np.uint8)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[128:] = OTHER
_CODE_C3 = np.full(256, OTHER, np.uint8)
for _c, _to in _FOLD.items():
    _CODE_C3[_c.encode()[1]] = ord(_to) - 96


def code(char: str) -> int:
    """Symbol of a lower-case character; 0 for what isn't a letter."""
    char = _FOLD.get(char, char)
    return ord(char) - 96 if "a" <= char <= "z" else OTHER if char.isalpha() else 0


def symbols(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Symbols of lower-case texts, boundaries once, and around each text."""
    out = _CODE[data]
    after = np.flatnonzero(data[:-1] == 0xC3)
    out[after] = _CODE_C3[data[after + 1]]
    lead = (data & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(lead)])
    out = np.insert(out[lead], count[off], 0)
    return out[np.r_[True, (out[1:] > 0) | (out[:-1] > 0)]]


def _counted(batches):
    total = np.zeros(SYMBOLS**4, np.int64)
    for b in wd.slices(batches, "text", wd.CHUNK):
        s = symbols(*wd.buffers(pc.utf8_lower(b.column(0)))).astype(np.int32)
        s = np.r_[np.zeros(2, np.int32), s]
        total += np.bincount(((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:], minlength=SYMBOLS**4)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])


def language_model(texts: DataFrame) -> np.ndarray:
    """Costs (negative log probabilities) of a character after three others, Witten-Bell smoothed; counts of each task's 4-grams are added up by Spark, over all texts."""
    counted = texts.select("text").mapInArrow(_counted, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(SYMBOLS**4)
    got = counted.toPandas()  # at most SYMBOLS ** 4 rows, whatever the input
    n[got["gram"]] = got["n"]
    n = n.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        c = n.sum(axis=tuple(range(3 - order))) if order < 3 else n
        sort, total = (c > 0).sum(axis=-1, keepdims=True), c.sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (c + sort * p) / np.maximum(total + sort, 1), p)
    return -np.log(p).astype(np.float32)


def lattice(span: str) -> list[list[tuple[int, str, float]]]:
    """Slots of a stretch of lower-case text: choices (symbol, or -1 for none; text; cost)."""
    slots: list = []
    for m in _PIECE.finditer(span):
        piece = m[1]
        if not piece:
            slots.append([(-1, "", JOIN), (0, m[0], CUT)])
            continue
        n, lead, tail = len(piece), len(piece) - len(piece.lstrip("!|+")), len(piece.rstrip("!|+@"))
        if piece[:tail].endswith("$$$"):
            tail = len(piece[:tail].rstrip("$"))
        i = 0
        while i < n:
            c, edge = piece[i], i < lead or i >= tail
            j = i + 1
            while not edge and j < tail and piece[j] == c:
                j += 1
            own = code(c)
            if own:
                one = [(own, c, 0.0)]
            elif c in LOOKS:
                one = [(code(x), x, SWAP) for x in LOOKS[c]] + [(0, c, EDGE if edge else PLAIN)]
            else:
                one = [(0, c, 0.0)]
            slots.append(one)
            if j - i == 2:
                slots.append([*one, (-1, "", HALVE)])
            elif j - i > 2:
                slots.append([*((s, x, v + DOUBLE) for s, x, v in one), (-1, "", 0.0)])
            i = j
    return slots


def viterbi(span: str, cost: np.ndarray) -> str:
    """The restored text of a stretch: the path of least cost through its lattice, between boundaries. Of equal paths the first in order of choices."""
    best: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
    item = cost.item
    for choices in lattice(span):
        new: dict = {}
        for (a, b, c), (v, path) in best.items():
            for s, text, own in choices:
                if s < 0 or (s == 0 and c == 0):
                    state, w = (a, b, c), v + own
                else:
                    state, w = (b, c, s), v + own + item(a, b, c, s)
                if state not in new or w < new[state][0]:
                    new[state] = (w, (path, text) if text else path)
        best = new
    path = min((v + (item(*state, 0) if state[2] else 0.0), k, p) for k, (state, (v, p)) in enumerate(best.items()))[2]
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def noisy(data: np.ndarray, off: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the stretches of lower-case texts that have more than one reading.

    wide: signs at the edges of words, which are mostly punctuation, belong to the stretches, and so do neighbouring pieces of up to two characters, or of three beside
    one, whatever number of separators stands between; the lattice has their harmless readings too.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    body, letter = _BODY[data], _LETTER[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = body & np.r_[True, ~body[:-1]] | body & cut[:n]
    start = np.flatnonzero(first)
    last = body & np.r_[~body[1:], True] | body & cut[1:]
    end = np.flatnonzero(last) + 1
    look = (_DIGIT | _SIGN)[data]
    signs = np.concatenate([[0], np.cumsum(look)])
    letters = np.concatenate([[0], np.cumsum(letter)])
    three = np.zeros(n, bool)
    if n > 2:
        three[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & body[2:] & (data[2:] < 128) & ~look[2:]
    runs = np.concatenate([[0], np.cumsum(three)])
    # signs at the end of a word are punctuation, unless it is one or two dollar signs
    e = end.copy()
    while not wide:
        back = (e > start) & np.isin(data[np.maximum(e - 1, 0)], [ord(c) for c in "!|+@"])
        if not back.any():
            break
        e[back] -= 1
    dollars = np.zeros(len(e), np.int64)
    x = e.copy()
    while True:
        more = (x > start) & (data[np.maximum(x - 1, 0)] == ord("$"))
        if not more.any():
            break
        x[more] -= 1
        dollars[more] += 1
    e = e if wide else np.where(dollars > 2, x, e)
    b = start.copy()
    while not wide:
        ahead = (b < e) & np.isin(data[np.minimum(b, n - 1)], [ord(c) for c in "!|+"])
        if not ahead.any():
            break
        b[ahead] += 1
    has = (letters[e] > letters[b]) & ((signs[e] > signs[b]) | (runs[e] - runs[np.minimum(b + 2, e)] > 0))
    spans = [np.stack([b[has], e[has]])]
    # single characters with single separators between them
    size = end - start
    one = (size == 1) | ((size == 2) & (data[start] >= 0xC3) & (data[start] < 0xE0))
    near = one[1:] & one[:-1] & (start[1:] == end[:-1] + 1) & ~cut[start[1:]] & _SEPARATORS[data[np.minimum(end[:-1], n - 1)]] if len(start) > 1 else np.zeros(0, bool)
    if wide and len(start) > 1:
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        size = chars[end] - chars[start]
        stop = np.concatenate([[0], np.cumsum(~_GAPS[data])])
        cuts = np.concatenate([[0], np.cumsum(cut)])
        most = np.maximum(size[1:], size[:-1])
        near = (most <= 2) | (most == 3) & (np.minimum(size[1:], size[:-1]) == 1)
        near &= (stop[start[1:]] == stop[end[:-1]]) & (cuts[start[1:] + 1] == cuts[end[:-1]])
    opens = near & np.r_[True, ~near[:-1]] if len(near) else near
    closes = near & np.r_[~near[1:], True] if len(near) else near
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = hi - lo >= (1 if wide else 2)
    lo, hi = lo[long], hi[long]
    some = letters[end[hi]] > letters[start[lo]] if len(lo) else np.zeros(0, bool)
    spans.append(np.stack([start[lo[some]], end[hi[some]]]) if len(lo) else np.zeros((2, 0), np.int64))
    s = np.concatenate(spans, axis=1)
    order = np.argsort(s[0], kind="stable")
    return s[0][order], s[1][order]


def squeezed(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """Texts with repeated ASCII letters taken once, as signs are compared."""
    keep = np.r_[True, (data[1:] != data[:-1]) | ~_LETTER[data[1:]] | (data[1:] >= 128)] if len(data) else np.zeros(0, bool)
    keep[off[:-1][off[:-1] < len(data)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[keep].tobytes())])


_KNOWN: dict[str, str] = {}


def restore(texts: pa.Array, cost: np.ndarray) -> tuple[wd.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts as they are, the texts' numbers and words of the restored stretches, and how many stretches each text has that were restored to something else. All words are squeezed."""
    data, off = wd.buffers(pc.utf8_lower(texts))
    w = wd.scan(squeezed(data, off), lower=False)
    start, end = noisy(data, off, wide=True)
    doc = np.searchsorted(off, start, side="right") - 1
    raw, got, own, changed = data.tobytes(), [], [], np.zeros(len(off) - 1, np.int64)
    for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist()):
        span = raw[s:e].decode("utf-8", "replace")
        out = _KNOWN.get(span)
        if out is None:
            out = viterbi(span, cost)
            if len(span) < 64:
                if len(_KNOWN) > 200_000:
                    _KNOWN.clear()
                _KNOWN[span] = out
        if out != span:
            got.append(out)
            own.append(d)
            changed[d] += 1
    more = wd.scan(squeezed(*wd.buffers(pa.array(got, pa.large_string()))), lower=False)
    number = np.array(own, np.int64)[wd.doc_of(more.off)] if got else np.zeros(0, np.int64)
    return w, number, more.h, changed


def _word_sets(cost):
    def run(batches):
        _KNOWN.clear()
        for b in wd.slices(batches):
            w, number, more, _ = restore(b.column(1), cost.value)
            g, ok = wd.ngrams(w.h, w.off, 3)
            cut = np.searchsorted(number, np.arange(b.num_rows + 1))
            rows = [(np.unique(np.r_[w.h[i:j], more[k:m]]), g[i:j][ok[i:j]]) for i, j, k, m in zip(w.off, w.off[1:], cut, cut[1:])]
            least = [[int(wd.mix(x ^ U(37 * i + 1)).min().view(np.int64)) for i in range(SKETCH)] if len(x) else [] for _, x in rows]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([s.view(np.int64).tolist() for s, _ in rows], pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64()))], ["toxic", "words", "least"])

    return run


def lexicon(rows: list, lift: float = LIFT, support: int = SUPPORT) -> tuple[np.ndarray, np.ndarray, float]:
    """Signs, their weights, and the prior, from rows (toxic, words, least): labels, word hashes and min-hashes of labelled documents.

    Documents with half of their min-hashes equal are copies, and count as one document of each label that the group has.
    """
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen: dict[tuple[int, int], list[int]] = {}
    sketch = np.array([least or [0] * SKETCH for *_, least in rows], np.int64).reshape(len(rows), SKETCH)
    for i, (*_, least) in enumerate(rows):
        near = {j for key in enumerate(least[:BANDS]) for j in seen.get(key, ())}
        if near:
            at = np.array(sorted(near))
            for j in at[2 * (sketch[at] == sketch[i]).sum(1) >= len(least)].tolist():
                root[top(i)] = top(j)
        for key in enumerate(least[:BANDS]):
            seen.setdefault(key, []).append(i)
    union: dict = {}
    for i, (toxic, own, _) in enumerate(rows):
        union.setdefault((top(i), bool(toxic)), []).append(np.array(own, np.int64))
    count = {True: sum(t for _, t in union), False: sum(not t for _, t in union)}
    sets = {t: [np.unique(np.concatenate(v)) for (_, x), v in union.items() if x == t] for t in count}
    words, n1 = np.unique(np.concatenate(sets[True]) if sets[True] else np.zeros(0, np.int64), return_counts=True)
    other, m = np.unique(np.concatenate(sets[False]) if sets[False] else np.zeros(0, np.int64), return_counts=True)
    n0 = np.zeros(len(words), np.int64)
    if len(other):
        at = np.minimum(np.searchsorted(other, words), len(other) - 1)
        n0 = np.where(other[at] == words, m[at], 0)
    a, b, c, d = n1 + 0.5, count[True] - n1 + 0.5, n0 + 0.5, count[False] - n0 + 0.5
    odds = np.log(a * d / (b * c))
    sure = odds - 1.96 * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    use = (n1 >= support) & (sure > np.log(lift))
    weight = np.log(a / (count[True] + 1)) - np.log(c / (count[False] + 1))
    prior = np.log((count[True] + 1) / (count[False] + 1))
    return words[use].view(U), weight[use], float(prior)


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``(doc_id, score, toxic, signs, restored)`` for each row of docs.

    score: probability that the restored text is toxic. signs: different toxic words in it. restored: stretches that were obfuscated. toxic: score is 0.5 or more and there is a sign.
    The classifier is fitted on at most train_docs labelled documents of each class; doc_ids with labels of both kinds count as toxic. Without labelled toxic documents no document has a sign.

    Null and empty texts have no signs and score the prior; an empty table gives no rows; very long texts are read whole. Of equally good paths the first in order of choices counts. Each row stands for itself: a null doc_id is reported as null, repeated rows repeat; labels with a null doc_id or
    null toxic are left out. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cost = spark.sparkContext.broadcast(language_model(base))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [given.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs) for t in (0, 1)]
    some = some[0].unionByName(some[1])
    sets = base.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_word_sets(cost), "toxic int, words array<long>, least array<long>")
    rows = [(r[0], r[1], r[2]) for r in sets.toLocalIterator()]
    signs, weight, prior = lexicon(rows)
    prior = prior if rows else 0.0

    def run(batches):
        _KNOWN.clear()
        for b in wd.slices(batches):
            w, number, more, changed = restore(b.column(1), cost.value)
            doc = np.r_[wd.doc_of(w.off), number]
            h = np.r_[w.h, more]
            total, found = np.full(b.num_rows, prior), np.zeros(b.num_rows, np.int64)
            if len(signs):
                at = np.minimum(np.searchsorted(signs, h), len(signs) - 1)
                own = np.flatnonzero(signs[at] == h)
                pairs = np.unique(doc[own] * len(signs) + at[own])
                np.add.at(total, pairs // len(signs), weight[pairs % len(signs)])
                np.add.at(found, pairs // len(signs), 1)
            score = 1 / (1 + np.exp(-total))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5) & (found > 0)), pa.array(found.astype(np.int32)), pa.array(changed.astype(np.int32))], ["doc_id", "score", "toxic", "signs", "restored"])

    order = np.argsort(signs)
    signs, weight = signs[order], weight[order]
    return base.mapInArrow(run, "doc_id long, score double, toxic boolean, signs int, restored int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: A search through lattices has no SQL form; tests compare with a search of all paths and plant obfuscated words.
SQL = None
