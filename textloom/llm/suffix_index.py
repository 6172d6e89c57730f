"""Suffix-array dedup with a logarithmic family of indexes.

Documents come in batches. The suffixes of a batch are sorted into a suffix
array; it is merge-scanned against the existing levels for suffixes that share a long prefix; then
levels of equal size merge with the new array, so that after 2**k batches each suffix
was rewritten k times and the family has at most one level of each size.

A suffix is ordered by the symbols of its first PREFIX words, 8 bits of each word's hash, so neighbours have the longest common prefixes and the suffixes that agree in all of it are next to each other.
An array is sparse: of any ``MIN_WORDS - PREFIX + 1`` successive suffixes the one whose first PREFIX words hash lowest is kept, so two copies of a passage of
MIN_WORDS words or more keep the same suffix of it, wherever it stands.

A level is a table in buckets by the symbols, sorted in each, in the shared folder. Only a new batch is shuffled, into the same buckets; scans and merges go bucket by bucket over what is there.
A manifest names the levels, so a family can be opened again and go on.

Suffixes that share a prefix of PREFIX words are candidates. Matches may go on before and after it: around each candidate, all windows of MIN_WORDS words of its document are
compared by 64-bit hash with the windows around the other candidates; windows that occur twice or more are repeated passages, and
overlapping ones join to spans.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd
from .shared import Tables

MIN_WORDS = 50
PREFIX = 24
BATCHES = 4
#: Numbers that hold the symbols of a prefix.
KEYS = 3
NAMES = [f"p{k}" for k in range(KEYS)]
U = np.uint64


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over x[i : i + n] for each i up to len(x) - n."""
    done, cur = 1, x
    while done * 2 <= n:
        cur = op(cur[: len(cur) - done], cur[done:])
        done *= 2
    rest = n - done
    return op(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def suffixes(w: wd.Words, min_words: int, prefix: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of the kept suffixes, with the symbols of their first ``prefix`` words, eight to a number, which order them."""
    n, span = len(w.h), min_words - prefix + 1
    empty = np.zeros(0, np.int64)
    if n < min_words:
        return empty, [empty] * KEYS
    g, _ = wd.ngrams(w.h, w.off, prefix)
    _, whole = wd.ngrams(w.h, w.off, min_words)
    last = n - prefix + 1
    low = _sliding(g[:last], span, np.minimum)
    low = np.where(whole[: len(low)], low, U(0))
    # suffix i is in the windows that start at i - span + 1 to i
    padded = np.concatenate([np.zeros(span - 1, U), low, np.zeros(last - len(low), U)])
    most = _sliding(padded, span, np.maximum)[:last]
    at = np.flatnonzero((most == g[:last]) & (most > 0))
    keys = []
    for k in range(KEYS):
        p = np.zeros(len(at), U)
        for j in range(8 * k, min(8 * k + 8, prefix)):
            p |= (w.h[at + j] >> U(56)) << U(56 - 8 * (j - 8 * k))
        keys.append((p ^ U(1 << 63)).view(np.int64))  # signed numbers in the order of the symbols
    return at, keys


def _entries(min_words: int, prefix: int):
    def run(batches):
        for b in wd.slices(batches):
            w = wd.scan(b.column(1))
            at, keys = suffixes(w, min_words, prefix)
            doc = np.searchsorted(w.off, at, side="right") - 1
            ids = b.column(0).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), ids, pa.array((at - w.off[doc]).astype(np.int32))], [*NAMES, "doc_id", "pos"])

    return run


class IndexFamily:
    """Levels of suffix arrays in a folder; ``levels`` maps a size in batches to its table's folder. A folder with a manifest is opened as it is."""

    def __init__(self, spark: SparkSession, path: str, min_words: int = MIN_WORDS, prefix: int = PREFIX, buckets: int | None = None):
        if prefix > 8 * KEYS:
            raise ValueError(f"at most {8 * KEYS} words order a suffix")
        self.spark, self.path = spark, path.rstrip("/")
        fs, p = self._fs("manifest.json")
        if fs.exists(p):
            stream = fs.open(p)
            try:
                state = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            if (state["min_words"], state["prefix"]) != (min_words, prefix):
                raise ValueError("the index was made with other lengths")
        else:
            state = {"min_words": min_words, "prefix": prefix, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "batches": 0, "levels": {}}
        self.min_words, self.prefix, self.buckets, self.batches = min_words, prefix, state["buckets"], state["batches"]
        self.levels: dict[int, str] = {int(k): v for k, v in state["levels"].items()}

    def _fs(self, name: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _save(self) -> None:
        """The manifest is written aside and renamed, so that one or the other is there."""
        text = json.dumps({"min_words": self.min_words, "prefix": self.prefix, "buckets": self.buckets, "batches": self.batches, "levels": self.levels})
        fs, p = self._fs("manifest.json")
        _, tmp = self._fs(f"manifest-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(tmp, p)

    def _write(self, df: DataFrame, name: str) -> None:
        table = f"textloom_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").bucketBy(self.buckets, *NAMES).sortBy(*NAMES, "doc_id", "pos").option("path", f"{self.path}/{name}")
        writer.saveAsTable(table)
        self.spark.sql(f"drop table {table}")  # the files stay

    def _level(self, name: str, made: list[str]) -> DataFrame:
        """A level as a table that Spark knows the buckets of, under a passing name."""
        table = f"textloom_{uuid.uuid4().hex}"
        keys = ", ".join(NAMES)
        self.spark.sql(f"create table {table} ({', '.join(f'{k} long' for k in NAMES)}, doc_id long, pos int) using parquet clustered by ({keys}) sorted by ({keys}, doc_id, pos) into {self.buckets} buckets location '{self.path}/{name}'")
        made.append(table)
        return self.spark.table(table)

    def add(self, docs: DataFrame, tables: Tables) -> DataFrame:
        """Sorts a batch's suffixes, scans them against all levels, merges levels of equal size; gives the candidates found, ``(doc_id, pos)``, of the batch and of those that it matches."""
        made: list[str] = []
        k = self.batches
        new = docs.mapInArrow(_entries(self.min_words, self.prefix), ", ".join(f"{x} long" for x in NAMES) + ", doc_id long, pos int")
        self._write(new.repartition(self.buckets, *NAMES), f"batch{k}")  # all that is shuffled
        try:
            new = self._level(f"batch{k}", made).distinct()  # repeated rows of a document
            own = new.groupBy(*NAMES).agg(F.count("*").alias("n"))
            hits = new.join(own.where("n > 1").select(*NAMES), NAMES, "left_semi").select("doc_id", "pos")
            for name in self.levels.values():
                old = self._level(name, made)
                hits = hits.unionByName(old.join(own.select(*NAMES), NAMES, "left_semi").select("doc_id", "pos"))
                hits = hits.unionByName(new.join(old.select(*NAMES), NAMES, "left_semi").select("doc_id", "pos"))
            hits = tables.write(hits, f"hits{k}")
            size, merged = 1, [f"batch{k}"]
            while size in self.levels:
                merged.append(self.levels.pop(size))
                size *= 2
            # the levels' files, each of one bucket, come to one folder; a bucket is then read whole, and written in order
            fs, heap = self._fs(f"heap{k}")
            fs.mkdirs(heap)
            for i, name in enumerate(merged):
                _, old = self._fs(name)
                for s in fs.listStatus(old):
                    file = s.getPath().getName()
                    if file.startswith("part-"):
                        fs.rename(s.getPath(), self._fs(f"heap{k}/part-{i:05d}{file[10:]}")[1])
                fs.delete(old, True)
            self._write(self._level(f"heap{k}", made).distinct(), f"level{k}")
            fs.delete(heap, True)
        finally:
            for table in made:
                self.spark.sql(f"drop table if exists {table}")
        self.levels[size] = f"level{k}"
        self.batches += 1
        self._save()
        return hits


def _windows(min_words: int, prefix: int):
    def run(batches):
        for b in wd.slices(batches):
            w = wd.scan(b.column(1))
            g, ok = wd.ngrams(w.h, w.off, min_words)
            pos = b.column(2)
            flat, lens = np.asarray(pos.flatten()).astype(np.int64), np.asarray(pos.value_lengths())
            doc = np.repeat(np.arange(b.num_rows), lens)
            at = w.off[doc] + flat
            at = at[at < w.off[doc + 1]]
            mark = np.zeros(len(w.h) + 1, np.int64)
            np.add.at(mark, np.maximum(at - (min_words - prefix), 0), 1)
            np.add.at(mark, at + 1, -1)
            s = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & ok)
            doc = np.searchsorted(w.off, s, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(g[s].view(np.int64)), b.column(0).take(pa.array(doc)), pa.array((s - w.off[doc]).astype(np.int32))], ["h", "doc_id", "s"])

    return run


def _repeated(batches):
    """Over rows (h, doc_id, s) in that order: those of repeated windows, with whether an earlier copy is there."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        h, doc, s = (np.asarray(c) for c in b.columns)
        lead = True
        if held is not None:
            h, doc, s, lead = np.r_[held[0], h], np.r_[held[1], doc], np.r_[held[2], s], held[3]
        one = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])]
        h, doc, s = h[one], doc[one], s[one]
        start = np.r_[lead, h[1:] != h[:-1]]
        hit = ~start | np.r_[~start[1:], False]
        held = (h[-1:].copy(), doc[-1:].copy(), s[-1:].copy(), bool(start[-1]))
        hit[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(s[hit]), pa.array(~start[hit])], ["doc_id", "s", "later"])
    if held is not None and not held[3]:
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2]), pa.array([True])], ["doc_id", "s", "later"])


def _spans(min_words: int):
    """Over rows (doc_id, s, later) in order of doc_id, s: spans of overlapping windows."""

    def made(doc, s, later):
        if not len(doc):
            return
        first = np.r_[True, (doc[1:] != doc[:-1]) | (s[1:] > s[:-1] + min_words)]
        at = np.flatnonzero(first)
        end = s[np.r_[at[1:], len(s)] - 1] + min_words
        # words of later copies: each such window adds what the one before it left uncovered
        prior = np.full(len(s), -(1 << 40), np.int64)
        own = np.flatnonzero(later)
        if len(own):
            same = np.r_[False, doc[own][1:] == doc[own][:-1]]
            prior[own[same]] = s[own[:-1][same[1:]]] + min_words
        add = np.where(later, np.minimum(min_words, s + min_words - prior), 0)
        total = np.add.reduceat(add, at)
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(s[at].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array((end - s[at]).astype(np.int32)), pa.array(total.astype(np.int32))], ["doc_id", "start_word", "end_word", "n_words", "n_later"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            doc, s, later = (np.asarray(c) if c.type != pa.bool_() else np.array(c.to_pylist(), bool) for c in b.columns)
            s = s.astype(np.int64)
            if held is not None:
                doc, s, later = np.r_[held[0], doc], np.r_[held[1], s], np.r_[held[2], later]
            cut = int(np.searchsorted(doc, doc[-1]))
            held = (doc[cut:].copy(), s[cut:].copy(), later[cut:].copy())
            yield from made(doc[:cut], s[:cut], later[:cut])
        if held is not None:
            yield from made(*held)

    return run


def repeated_spans(docs: DataFrame, batches: int = BATCHES, min_words: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """Spans ``(doc_id, start_word, end_word, n_words, n_later)`` of the documents of which every window of min_words words occurs twice or more.

    start_word counts from 0, end_word is exclusive. Windows that overlap or touch make one span. n_later counts the span's words in
    windows that occur earlier too, in a document of lesser doc_id or earlier in the same one: those that a dedup removes.
    The documents, spread over batches by a hash of doc_id, enter the family of indexes one batch after the other; the result doesn't depend on the number of batches.

    Rows with a null doc_id and null texts have no spans, an empty table gives none, and very long texts are read whole. Repeated rows of a doc_id count once; copies of equal age are in order of doc_id. Other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "suffix")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    family = IndexFamily(spark, f"{tables.base}/family", min_words, prefix)
    hits = None
    for k in range(batches):
        more = family.add(base.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), tables)
        hits = more if hits is None else hits.unionByName(more)
        tables.release()
    tables.drop("family")
    hits = hits.groupBy("doc_id").agg(F.collect_set("pos").alias("pos"))
    windows = base.join(hits, "doc_id").select("doc_id", "text", "pos").mapInArrow(_windows(min_words, prefix), "h long, doc_id long, s int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    windows = windows.repartition(parts, "h").sortWithinPartitions("h", "doc_id", "s").mapInArrow(_repeated, "doc_id long, s int, later boolean")
    rows = windows.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "s")
    return rows.mapInArrow(_spans(min_words), "doc_id long, start_word int, end_word int, n_words int, n_later int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with w as (select distinct doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as w from documents where doc_id is not null and text is not null),
g as (select doc_id, unnest(range(0, len(w) - {MIN_WORDS - 1})) as s, unnest([md5(array_to_string(w[i:i + {MIN_WORDS - 1}], ' ')) for i in range(1, len(w) - {MIN_WORDS - 2})]) as h from w where len(w) >= {MIN_WORDS}),
r as (select doc_id, s, count(*) over (partition by h) as n, row_number() over (partition by h order by doc_id, s) as k from g),
x as (select doc_id, s, k > 1 as later, case when s <= lag(s) over (partition by doc_id order by s) + {MIN_WORDS} then 0 else 1 end as brk, max(case when k > 1 then s end) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) as prior from r where n > 1),
y as (select *, sum(brk) over (partition by doc_id order by s rows unbounded preceding) as span from x)
select doc_id, cast(min(s) as integer) as start_word, cast(max(s) + {MIN_WORDS} as integer) as end_word, cast(max(s) + {MIN_WORDS} - min(s) as integer) as n_words,
cast(sum(case when later then least({MIN_WORDS}, s - coalesce(prior, -1000000)) else 0 end) as integer) as n_later
from y group by doc_id, span
"""
