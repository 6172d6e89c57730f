"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of WINDOW template tokens of the documents are joined by hash with those of the benchmark
items. Where they match at one alignment, each value behind the item's placeholders must map to one value of the document; windows with a slot that
doesn't are left out, those with unchanged values never: a question with other numbers or names is caught, and a mere likeness of shape isn't.

Documents send only the windows that pass a Bloom bitmap of the benchmark's window hashes to the join. The bitmap has a fixed
size, whatever the benchmark's: with a large benchmark it lets more through, and the join decides.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd

WINDOW = 8
MIN_COVERAGE = 0.5
BITS = 22
U = np.uint64
#: At least so many tokens of a benchmark window are no placeholders, or half of a shorter one; other windows are matched by their words, not by their template.
LITERALS = 4
UNITS = "km m cm mm mile miles meter meters metre metres kilometer kilometers kilometre kilometres foot feet inch inches yard yards kg g mg gram grams kilogram kilograms pound pounds lb lbs ounce ounces ton tons tonne tonnes liter liters litre litres ml gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur gbp percent mph kmh degree degrees celsius fahrenheit volt volts watt watts joule joules newton newtons stunde stunden minuten tage jahre heure heures jours ans hora horas dias".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
NUM, NAME, UNIT, EXACT = (wd.mix(np.array([x], U))[0] for x in (11, 12, 13, 14))


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(wd.scan(pa.array(words)).h)


_UNITS, _NUMBERS = _hashes(UNITS), _hashes(NUMBERS)


def _isin(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


@functools.cache
def _upper_points() -> np.ndarray:
    """Whether a code point changes when it is lower-cased; those past the end have no case."""
    return np.array([chr(c).lower() != chr(c) for c in range(0xD800)] + [False] * 0x800 + [chr(c).lower() != chr(c) for c in range(0xE000, 0x20000)] + [False])


def _uppers(data: np.ndarray) -> np.ndarray:
    """Marks the first bytes of upper-case letters."""
    out = (data >= ord("A")) & (data <= ord("Z"))
    if len(data) and data.max() >= 128:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        out[(data & 0xC0) != 0x80] = _upper_points()[np.minimum(points, 0x20000)]
    return out


def template(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of the texts, the words behind them, whether they are placeholders, and offsets.

    A number is a word that starts with a digit, or a spelled-out one; parts joined by one point or comma are one number. A
    unit is a listed word after a number. A name is a capitalised word, not all capitals, that starts no sentence, line or text.
    """
    w = wd.scan(texts)
    raw, raw_off = wd.buffers(texts)
    if not len(w.h):
        return w.h, w.h, np.zeros(0, bool), w.off
    data = w.data
    # lower-casing may change a word's bytes, never the words: word i of the raw texts is word i of the lower-case ones
    raw_start, raw_end = wd.split(raw, raw_off)
    upper = _uppers(raw)
    capitals = np.concatenate([[0], np.cumsum(upper)])
    n = len(w.h)
    first = np.zeros(n, bool)
    first[w.off[:-1][w.off[:-1] < w.off[1:]]] = True
    lut = np.zeros(256, bool)
    lut[[ord(c) for c in ".!?:;|\n\""]] = True
    stops = np.concatenate([[0], np.cumsum(lut[data])])
    before = np.r_[0, w.end[:-1]]
    opens = first | (stops[w.start] > stops[before])
    lead = data[w.start]
    name = upper[raw_start] & ~opens & (capitals[raw_end] - capitals[raw_start] == 1)
    digit = (lead >= ord("0")) & (lead <= ord("9"))
    num = digit | _isin(w.h, _NUMBERS)
    gap = w.start - before
    glue = np.r_[False, digit[:-1]] & digit & ~first & (gap == 1) & np.isin(data[before], [ord("."), ord(",")])
    prev_num = np.r_[False, num[:-1]] & ~first
    unit = prev_num & _isin(w.h, _UNITS)
    tok = w.h.copy()
    tok[name], tok[unit], tok[num] = NAME, UNIT, NUM
    value = w.h.copy()
    for i in np.flatnonzero(glue):  # 3.5 is one value
        value[i] = wd.mix(value[i - 1 : i] * U(31) + value[i : i + 1])[0]
    drop = np.r_[glue[1:], False]
    keep = ~drop
    off = np.concatenate([[0], np.cumsum(keep)])[w.off]
    return tok[keep], value[keep], (name | unit | num)[keep], off


def _exact(val: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows' words, placeholders or not, apart from those of templates."""
    g, ok = wd.ngrams(val, off, n)
    return wd.mix(g ^ EXACT), ok


def _item_windows(window: int):
    def run(batches):
        for b in wd.slices(batches):
            tok, val, slot, off = template(b.column(1))
            out = []
            for k in range(b.num_rows):
                lo, hi = int(off[k]), int(off[k + 1])
                n = min(window, hi - lo)
                if not n:
                    continue
                one = np.array([0, hi - lo])
                g, exact = wd.ngrams(tok[lo:hi], one, n)[0], _exact(val[lo:hi], one, n)[0]
                ident = b.column(0)[k].as_py()
                count = hi - lo - n + 1
                at = [i + np.flatnonzero(slot[lo + i : lo + i + n]) for i in range(count)]
                literal = [n - len(x) >= min(LITERALS, (n + 1) // 2) for x in at]
                for i, x in enumerate(at):
                    h, x = (g[i], x) if literal[i] else (exact[i], x[:0])
                    out.append((int(h.view(np.int64)), ident, i, n, literal[i], sum(literal), count, val[lo + x].view(np.int64).tolist(), x.tolist()))
            cols = list(zip(*out)) or [[]] * 9
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["h", "item_id", "i", "n", "literal", "literals", "windows", "item_values", "item_places"])

    return run


def _doc_windows(bitmap, sizes: list[int]):
    def run(batches):
        seen = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for b in wd.slices(batches):
            tok, val, slot, off = template(b.column(1))
            before, slots = np.concatenate([[0], np.cumsum(slot)]), val[slot].view(np.int64)
            for n in sizes:
                for exact, (g, ok) in ((False, wd.ngrams(tok, off, n)), (True, _exact(val, off, n))):
                    at = np.flatnonzero(ok & seen[g >> U(64 - BITS)])
                    doc = np.searchsorted(off, at, side="right") - 1
                    lens = np.zeros(len(at), np.int64) if exact else before[at + n] - before[at]
                    loff = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                    take = np.repeat(before[at] - loff[:-1], lens) + np.arange(loff[-1])
                    values = pa.ListArray.from_arrays(pa.array(loff), pa.array(slots[take]))
                    yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), b.column(0).take(pa.array(doc)), pa.array((at - off[doc]).astype(np.int32)), values], ["h", "doc_id", "pos", "doc_values"])

    return run


def agreed(hit: list[tuple], slots: list[tuple[int, int, int]]) -> tuple[list[int], bool]:
    """The windows of an alignment whose slots agree, and whether any slot in them has another value; windows are (start, length, ...), slots (place, item's value, document's value).

    A slot agrees if its value is unchanged, or is the one that most slots of the item's value have; of a tie, none. Several values of the item may become one.
    """
    votes: dict[int, Counter] = {}
    for _, a, b in slots:
        votes.setdefault(a, Counter())[b] += 1
    most = {}
    for a, c in votes.items():
        top = c.most_common(2)
        if len(top) == 1 or top[0][1] > top[1][1]:
            most[a] = top[0][0]
    clash = sorted({p for p, a, b in slots if a != b and most.get(a) != b})
    other = sorted({p for p, a, b in slots if a != b})
    kept = [(i, n) for i, n, *_ in hit if bisect_left(clash, i) == bisect_left(clash, i + n)]
    return [i for i, _ in kept], any(bisect_left(other, i) < bisect_left(other, i + n) for i, n in kept)


def _consistent(batches):
    for b in batches:
        doc, item, _, hit, literals, windows, slots = b.columns
        rows = []
        for k in range(b.num_rows):
            own = [tuple(x.values()) for x in hit[k].as_py()]
            kept, other = agreed(own, [tuple(x.values()) for x in slots[k].as_py()])
            literal = {i for i, _, x in own if x}
            rows.append((kept, [i for i in kept if i in literal], other))
        ints = pa.list_(pa.int32())
        out = [doc, item, pa.array([r[0] for r in rows], ints), pa.array([r[1] for r in rows], ints), literals, windows, pa.array([r[2] for r in rows], pa.bool_())]
        names = ["doc_id", "item_id", "hit", "part", "literals", "item_windows", "other"]
        yield pa.RecordBatch.from_arrays(out, names).filter(pa.array([bool(r[0]) for r in rows], pa.bool_()))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``(doc_id, item_id, windows, item_windows, coverage, reworded)`` of documents that hold a benchmark item, as it is or with other numbers, names or units.

    windows: how many of the item's item_windows windows occur in the document at alignments whose slot values are consistent; coverage, their part, is min_coverage or more. reworded: a matched slot has another value.
    Items of fewer than ``window`` template tokens are one window. Windows with too few literal words match by their words alone, values and all, so an item of
    such windows is found as a copy, not reworded. item_windows are the windows of the item that may be reworded, or all of it where these are covered better.

    Rows with a null doc_id or item_id, null and empty texts match nothing; an empty table gives no rows; very long texts are read whole. Of tied slot values none counts as the common one. Repeated rows, and repeated ids, count once. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    items = items.mapInArrow(_item_windows(window), "h long, item_id long, i int, n int, literal boolean, literals int, windows int, item_values array<long>, item_places array<int>")
    place = F.shiftrightunsigned("h", 64 - BITS) + 1
    parts = items.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()  # 2**BITS bits at most
    sizes = sorted(r[0] for r in items.select("n").distinct().collect())
    seen = np.zeros((1 << BITS) // 8, np.uint8)
    for r in parts:
        m = np.frombuffer(r["m"], np.uint8)
        seen[(r["b"] - 1) * len(m) : r["b"] * len(m)] = m
    bitmap = spark.sparkContext.broadcast(seen.tobytes())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    found = base.mapInArrow(_doc_windows(bitmap, sizes), "h long, doc_id long, pos int, doc_values array<long>")
    both = found.join(items, "h").where(F.size("doc_values") == F.size("item_values"))
    both = both.withColumn("at", F.col("pos") - F.col("i"))
    slots = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_places", "item_values", "doc_values"))))
    match = both.groupBy("doc_id", "item_id", "at").agg(F.collect_set(F.struct("i", "n", "literal")).alias("hit"), F.max("literals").alias("literals"), F.max("windows").alias("item_windows"), slots.alias("slots"))
    match = match.mapInArrow(_consistent, "doc_id long, item_id long, hit array<int>, part array<int>, literals int, item_windows int, other boolean")
    def number(name):
        return F.size(F.array_distinct(F.flatten(F.collect_list(name))))

    out = match.groupBy("doc_id", "item_id").agg(number("hit").alias("windows"), number("part").alias("part"), F.max("literals").alias("literals"), F.max("item_windows").alias("item_windows"), F.max("other").alias("reworded"))
    # a reworded item is told by its windows that can be reworded, a copy by all
    fewer = (F.col("literals") > 0) & (F.col("part") * F.col("item_windows") >= F.col("windows") * F.col("literals"))
    out = out.select("doc_id", "item_id", F.when(fewer, F.col("part")).otherwise(F.col("windows")).alias("windows"), F.when(fewer, F.col("literals")).otherwise(F.col("item_windows")).alias("item_windows"), "reworded")
    out = out.withColumn("coverage", F.col("windows") / F.col("item_windows")).where(F.col("coverage") >= min_coverage)
    return out.select("doc_id", "item_id", "windows", "item_windows", "coverage", "reworded")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The documents that hold no benchmark item; rows without doc_id stay. All columns are kept as they are."""
    gone = leaks(docs, benchmark, window, min_coverage).select(F.col("doc_id").alias("textloom_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["textloom_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Placeholders depend on capitals and sentence starts word by word; tests compare with a brute-force version.
SQL = None
