"""Quality rule: repetition inside a document, through suffix arrays.

The words of each document get a suffix array and the longest common prefixes (LCP) of neighbours in it. A suffix whose
LCP with a neighbour is ``min_words`` or more starts a repeated substring of that length; the maximal
repeated substrings of all LCP intervals cover, together, exactly the union of those spans. A document is rejected if
they cover too large a part of it, or if the longest is too long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd

MIN_WORDS = 8
MAX_COVERED = 0.35
MAX_LONGEST = 100
U = np.uint64


def suffix_array(ids: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling of several sequences at once.

    ids: symbols, those of different sequences being different; end: where the sequence of each position ends.
    Each round sorts only the suffixes that aren't told apart yet.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    first = np.r_[True, s[1:] != s[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    single = np.r_[first[1:], True] & first
    todo = order[~single]
    h = 1
    while len(todo):
        after = todo + h
        inside = after < end[todo]
        second = np.zeros(len(todo), np.int64)
        second[inside] = rank[after[inside]] + 1
        key = rank[todo] * (n + 1) + second
        o = np.argsort(key, kind="stable")
        todo, key = todo[o], key[o]
        old = rank[todo]
        m = len(todo)
        new = np.r_[True, key[1:] != key[:-1]]
        grp = np.r_[True, old[1:] != old[:-1]]
        at = np.arange(m)
        rank[todo] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(grp, at, 0))
        todo = todo[~(np.r_[new[1:], True] & new)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def common_prefix(h: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes a and b, by binary search over prefix hashes."""
    p, inv = wd.powers(len(h))
    s = np.concatenate([np.zeros(1, U), np.cumsum(h * p, dtype=U)])
    most = np.minimum(end[a] - a, end[b] - b)
    low = np.zeros(len(a), np.int64)
    step = 1 << int(most.max()).bit_length() if len(a) else 0
    while step:
        to = low + step
        ok = to <= most
        x, y = a[ok], b[ok]
        same = (s[x + to[ok]] - s[x]) * inv[x] == (s[y + to[ok]] - s[y]) * inv[y]
        where = np.flatnonzero(ok)[same]
        low[where] = to[where]
        step >>= 1
    return low


def repeats(w: wd.Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered words and longest repeat of each text."""
    n_docs = len(w.off) - 1
    covered, longest = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    g, ok = wd.ngrams(w.h, w.off, min_words)
    doc = wd.doc_of(w.off)
    at = np.flatnonzero(ok)
    key = wd.mix(g[at] ^ (doc[at].astype(U) * U(0xD6E8FEB86659FD93)))
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return covered, longest
    # only texts in which min_words words recur need their suffix array
    pick = np.zeros(n_docs, bool)
    pick[doc[at[np.isin(key, twice)]]] = True
    use = pick[doc]
    h, d = w.h[use], doc[use]
    last = np.searchsorted(d, d, side="right")
    _, ids = np.unique(wd.mix(h + d.astype(U) * U(0x9FB21C651E98DF25)), return_inverse=True)
    sa = suffix_array(ids, last)
    a, b = sa[:-1], sa[1:]
    same = (d[a] == d[b]) & (h[a] == h[b])
    a, b = a[same], b[same]
    lcp = common_prefix(h, a, b, last)
    long = lcp >= min_words
    a, b, lcp = a[long], b[long], lcp[long]
    reach = np.zeros(len(h), np.int64)
    np.maximum.at(reach, a, lcp)
    np.maximum.at(reach, b, lcp)
    np.maximum.at(longest, d[a], lcp)
    starts = np.flatnonzero(reach)
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + reach[starts], -1)
    inside = np.cumsum(mark)[:-1] > 0
    covered += np.bincount(d[inside], minlength=n_docs)
    return covered, longest


def _measures(texts: pa.Array, min_words: int, max_covered: float, max_longest: int):
    w = wd.scan(texts)
    covered, longest = repeats(w, min_words)
    n = np.diff(w.off)
    part = covered / np.maximum(n, 1)
    return n, covered, part, longest, (part <= max_covered) & (longest <= max_longest)


def measure(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """``(doc_id, n_words, covered_words, covered_fraction, longest_repeat, keep)`` for each row of docs.

    covered_words: words in repeated substrings of min_words words or more, each occurrence counting, overlaps once.
    Null and empty texts have no words, nothing covered, and are kept; an empty table gives no rows; very long texts are read whole. Each row stands for itself: nulls and repeats of doc_id don't matter. Other columns are ignored.
    """

    def run(batches):
        for b in wd.slices(batches):
            n, covered, part, longest, keep = _measures(b.column(1), min_words, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(covered), pa.array(part), pa.array(longest), pa.array(keep)], ["doc_id", "n_words", "covered_words", "covered_fraction", "longest_repeat", "keep"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_words long, covered_words long, covered_fraction double, longest_repeat long, keep boolean")


def keep_unrepetitive(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of docs that the rule keeps, all columns as they are, in one pass without a shuffle."""
    k = docs.columns.index("text")

    def run(batches):
        for b in wd.slices(batches, "text"):
            keep = _measures(b.column(k), min_words, max_covered, max_longest)[4]
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Words are covered where windows of MIN_WORDS words recur in a document; a repeat is as long as equal windows follow each other at one distance.
SQL = rf"""
with w as (select row_number() over () as id, doc_id, case when text is null then [] else regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') end as w from documents),
g as (select id, unnest(range(0, len(w) - {MIN_WORDS - 1})) as s, unnest([hash(array_to_string(w[i:i + {MIN_WORDS - 1}], ' ')) for i in range(1, len(w) - {MIN_WORDS - 2})]) as h from w where len(w) >= {MIN_WORDS}),
r as (select id, s, h from (select *, count(*) over (partition by id, h) as n from g) where n > 1),
c as (select id, sum(least({MIN_WORDS}, s - coalesce(lag, -1000000))) as covered from (select id, s, lag(s) over (partition by id order by s) as lag from r) group by id),
p as (select a.id, b.s - a.s as d, a.s - row_number() over (partition by a.id, b.s - a.s order by a.s) as run from r a join r b on a.id = b.id and a.h = b.h and a.s < b.s),
l as (select id, max(n) + {MIN_WORDS - 1} as longest from (select id, count(*) as n from p group by id, d, run) group by id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(covered, 0) as bigint) as covered_words, coalesce(covered, 0) / cast(greatest(len(w), 1) as double) as covered_fraction, cast(coalesce(longest, 0) as bigint) as longest_repeat,
coalesce(covered, 0) / cast(greatest(len(w), 1) as double) <= {MAX_COVERED} and coalesce(longest, 0) <= {MAX_LONGEST} as keep
from w left join c using (id) left join l using (id)
"""
