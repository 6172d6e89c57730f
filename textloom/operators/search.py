"""Search: weights on the driver from a small statistics job, then one scan of the queried terms' postings, one aggregation by document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.automata import matcher
from textloom.plans.query import MUST, MUST_NOT, Boolean, MatchAll, Pattern, Phrase, Query, Term
from textloom.plans.similarity import Similarity, f32, of_field

from .index import Index


@dataclass
class Weighted:
    """A query node with its normalised weight. value: what a term's tf is multiplied by, or a constant query's score."""

    query: Query
    idf: np.float32 = f32(1)
    weight: np.float32 = f32(1)
    value: np.float32 = f32(1)
    clauses: tuple = ()
    doc_freq: int = 0
    max_doc: int = 0


def _terms(q: Query) -> set[tuple[str, str]]:
    if isinstance(q, Term):
        return {(q.field, q.term)} if q.doc_freq is None else set()
    if isinstance(q, Phrase):
        return {(q.field, t) for t in q.terms}
    if isinstance(q, Boolean):
        return set().union(*(_terms(c) for _, c in q.clauses))
    return set()


def _squares(q: Query, df: dict, max_doc: int, sim: Similarity) -> tuple[Weighted, np.float32]:
    boost = f32(q.boost)
    if isinstance(q, Boolean):
        total, inner = f32(0), []
        for occur, c in q.clauses:
            w, s = _squares(c, df, max_doc, sim)
            if occur != MUST_NOT:
                total = f32(total + s)
            inner.append((occur, w))
        return Weighted(q, clauses=tuple(inner)), f32(total * f32(boost * boost))
    if isinstance(q, Term):
        own = of_field(sim, q.field)
        idf = own.idf(df.get((q.field, q.term), 0) if q.doc_freq is None else q.doc_freq, max_doc)
    elif isinstance(q, Phrase):
        idf = f32(0)
        for t in q.terms:
            idf = f32(idf + of_field(sim, q.field).idf(df.get((q.field, t), 0), max_doc))
    else:
        idf = f32(1)
    weight = f32(idf * boost)
    found = (df.get((q.field, q.term), 0) if q.doc_freq is None else q.doc_freq) if isinstance(q, Term) else 0
    return Weighted(q, idf=idf, weight=weight, doc_freq=found, max_doc=max_doc), f32(weight * weight)


def _normalise(w: Weighted, norm: np.float32, top: np.float32) -> None:
    if isinstance(w.query, Boolean):
        for _, c in w.clauses:
            _normalise(c, norm, f32(top * f32(w.query.boost)))
        return
    w.weight = f32(w.weight * f32(norm * top))
    w.value = f32(w.weight * w.idf)


def weigh(index: Index, query: Query, similarity: Similarity | None = None) -> tuple[Weighted, np.float32]:
    """The rewritten query with its weights, and the query norm. A term that no document holds still counts in the norm."""
    sim = similarity or Similarity()
    query = query.rewrite()
    terms = sorted(_terms(query))
    df = {}
    if terms:
        # a condition on each field that Parquet can skip row groups by
        fields = sorted({a for a, _ in terms})
        pairs = reduce(Column.__or__, [(F.col("field") == a) & F.col("term").isin(*[b for x, b in terms if x == a]) for a in fields])
        stats = index.stats if index.stats is not None else index.postings
        rows = stats.where(pairs)
        rows = rows.groupBy("field", "term").agg((F.sum("doc_freq") if index.stats is not None else F.count("*")).alias("n"))
        df = {(r[0], r[1]): r[2] for r in rows.collect()}  # a row for each term of the query
    w, squares = _squares(query, df, index.size(), sim)
    norm = sim.query_norm(squares)
    _normalise(w, norm, f32(1))
    return w, norm


def _f(x) -> Column:
    return F.lit(float(x)).cast("float")


def _leaf(index: Index, w: Weighted, sim: Similarity) -> DataFrame:
    """``(doc_id, score)`` of a query that isn't boolean."""
    q = w.query
    own = index.postings
    if isinstance(q, Term):
        rows = own.where((F.col("field") == q.field) & (F.col("term") == q.term))
        return rows.select("doc_id", of_field(sim, q.field).score(F.col("freq"), F.col("norm"), _f(w.value)).alias("score"))
    if isinstance(q, MatchAll):
        return index.docs.select("doc_id", _f(w.value).alias("score"))
    if isinstance(q, Pattern):
        rows = own.where(F.col("field") == q.field)
        if index.stats is None:
            rows = rows.where(term_filter(q))
        else:  # the pattern is tried on each term once, not on each of its postings
            rows = rows.join(index.stats.where((F.col("field") == q.field) & term_filter(q)).select("term"), "term", "left_semi")
        return rows.select("doc_id").distinct().select("doc_id", _f(w.value).alias("score"))
    if isinstance(q, Phrase):
        rows = own.where((F.col("field") == q.field) & F.col("term").isin(*q.terms)).where("positions is not null")
        at = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("norm").alias("norm"))
        found = F.element_at("at", F.lit(q.terms[0]))
        freq = F.aggregate(F.filter(found, lambda p: _follows(q, p)), F.lit(0), lambda n, _: n + 1) if q.slop == 0 else _sloppy(q)
        at = at.where(F.size(F.map_keys("at")) == len(set(q.terms))).withColumn("freq", freq).where("freq > 0")
        return at.select("doc_id", of_field(sim, q.field).score(F.col("freq"), F.col("norm"), _f(w.value)).alias("score"))
    raise TypeError(f"can't search for {q!r}")


def _follows(q: Phrase, p: Column) -> Column:
    ok = F.lit(True)
    for k, t in enumerate(q.terms[1:], 1):
        ok = ok & F.array_contains(F.element_at("at", F.lit(t)), p + k)
    return ok


def _sloppy(q: Phrase) -> Column:
    """Starts from which each term follows the one before, the whole within slop more positions than an exact phrase."""

    def within(p):
        last = p
        for t in q.terms[1:]:
            last = F.array_min(F.filter(F.element_at("at", F.lit(t)), _above(last)))
        return last.isNotNull() & (last - p - (len(q.terms) - 1) <= q.slop)

    return F.size(F.filter(F.element_at("at", F.lit(q.terms[0])), within))


def _above(least: Column):
    return lambda x: x > least


def term_filter(q: Pattern) -> Column:
    """Whether a term is in the pattern's set."""
    t = F.col("term")
    if q.kind == "prefix":
        return t.startswith(q.text)
    if q.kind == "range":
        ok = F.lit(True)
        if q.text != "*":
            ok = t >= q.text if q.inclusive else t > q.text
        if q.upper not in (None, "*"):
            ok = ok & (t <= q.upper if q.inclusive else t < q.upper)
        return ok
    if q.kind == "fuzzy":
        return F.levenshtein(t, F.lit(q.text), q.edits) >= 0
    if q.kind == "wildcard":
        return t.rlike(wildcard(q.text))
    if q.kind == "regexp":
        return matcher(q.text)(t)
    raise ValueError(f"no such pattern: {q.kind}")


def wildcard(text: str) -> str:
    r"""Regular expression of a pattern of ? and *, with \ before literal ones."""
    import re

    out = re.sub(r"\\(.)|([*?])|(.)", lambda m: re.escape(m[1] or m[3]) if not m[2] else ".*" if m[2] == "*" else ".", text, flags=re.S)
    return f"(?s)^(?:{out})$"


def _scored(index: Index, w: Weighted, sim: Similarity) -> DataFrame:
    q = w.query
    if not isinstance(q, Boolean):
        return _leaf(index, w, sim)
    scoring = [(o, c) for o, c in w.clauses if o != MUST_NOT]
    if not scoring:
        return index.postings.select("doc_id", F.lit(0.0).cast("float").alias("score")).where(F.lit(False))
    frames = []
    flat = [(k, o, c) for k, (o, c) in enumerate(w.clauses) if isinstance(c.query, Term)]
    by: dict = {}
    for k, o, c in flat:
        by.setdefault((c.query.field, c.query.term), []).append((k, o, c))
    for name in sorted({f for f, _ in by}):
        # all terms of a field in one scan; each posting meets the clauses of its term
        terms = {t: v for (f, t), v in by.items() if f == name}
        rows = index.postings.where((F.col("field") == name) & F.col("term").isin(*terms))
        table = [x for t, v in terms.items() for x in (F.lit(t), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(o).alias("occur"), _f(c.value).alias("value")) for k, o, c in v]))]
        rows = rows.select("doc_id", "freq", "norm", F.explode(F.element_at(F.create_map(*table), F.col("term"))).alias("c"))
        s = of_field(sim, name).score(F.col("freq"), F.col("norm"), F.col("c.value"))
        frames.append(rows.select("doc_id", F.col("c.occur").alias("occur"), s.alias("score")))
    for o, c in w.clauses:
        if not isinstance(c.query, Term):
            frames.append(_scored(index, c, sim).select("doc_id", F.lit(o).alias("occur"), "score"))
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    counted = F.col("occur") != MUST_NOT
    got = rows.groupBy("doc_id").agg(
        F.sum(F.when(counted, F.col("score").cast("double"))).alias("s"),
        F.count(F.when(counted, 1)).alias("overlap"),
        F.count(F.when(F.col("occur") == MUST, 1)).alias("required"),
        F.count(F.when(~counted, 1)).alias("prohibited"),
    )
    needed = sum(o == MUST for o, _ in scoring)
    got = got.where((F.col("prohibited") == 0) & (F.col("overlap") > 0) & (F.col("required") == needed))
    if q.min_should:
        got = got.where(F.col("overlap") - F.col("required") >= q.min_should)
    coord = _f(1) if q.disable_coord else sim.coord(F.col("overlap"), len(scoring))
    return got.select("doc_id", (F.col("s") * coord.cast("double")).cast("float").alias("score"))


def search(index: Index, query: Query, similarity: Similarity | None = None, where: Column | None = None) -> DataFrame:
    """``(doc_id, score)`` of all hits. where: a condition on stored columns, which changes neither scores nor statistics. Deleted documents are no hits."""
    w, _ = weigh(index, query, similarity)
    out = _scored(index, w, similarity or Similarity())
    if where is not None:
        out = out.join(index.docs.where(where).select("doc_id"), "doc_id", "left_semi")
    if index.deletes is not None:
        out = out.join(index.deletes, "doc_id", "left_anti")
    return out


def top(hits: DataFrame, k: int, after: tuple[float, int] | None = None) -> DataFrame:
    """The k best hits, equal scores by doc_id; after: the (score, doc_id) of the last hit of the page before."""
    if after is not None:
        s, d = F.lit(after[0]).cast("float"), after[1]
        hits = hits.where((F.col("score") < s) | ((F.col("score") == s) & (F.col("doc_id") > d)))
    broken = F.isnan("score") | (F.col("score") == float("-inf"))
    score = F.when(broken, F.raise_error(F.lit("a score is no number")).cast("float")).otherwise(F.col("score"))
    return hits.withColumn("score", score).orderBy(F.desc("score"), "doc_id").limit(max(1, k))


def collect(index: Index, query: Query, collector: Callable[[DataFrame], DataFrame], similarity: Similarity | None = None, where: Column | None = None) -> DataFrame:
    """What a collector makes of all hits ``(doc_id, score)``: any aggregation, in the same job as the search. ``top``, ``page`` and ``total_hits`` are collectors."""
    return collector(search(index, query, similarity, where))


def page(hits: DataFrame, start: int, count: int) -> DataFrame:
    """Hits start to start + count of the ranking, with their rank from 0. Only the first start + count are sorted out of the whole."""
    if start < 0 or count <= 0:
        return hits.where(F.lit(False)).withColumn("rank", F.lit(0))
    best = top(hits, start + count)
    rank = (F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1).alias("rank")
    return best.select("*", rank).where(F.col("rank") >= start)


def fetch(index: Index, hits: DataFrame, *columns: str) -> DataFrame:
    """Stored columns of hits, which are few: the top of a ranking."""
    return index.docs.select("doc_id", *columns).join(F.broadcast(hits), "doc_id")


def total_hits(hits: DataFrame) -> DataFrame:
    """``(total_hits, max_score)``; max_score is null without hits."""
    return hits.agg(F.count("*").alias("total_hits"), F.max("score").alias("max_score"))


def search_batch(index: Index, queries: DataFrame, field: str, k: int, similarity: Similarity | None = None) -> DataFrame:
    """``(query_id, doc_id, score)``: the k best hits of many OR queries of one field in one job, scored as each query alone.

    queries: (query_id, term[, clause]), a row for each clause; clauses are in order of clause, if that column is there, else of term. The queries' terms are joined with their statistics, then with the postings; the aggregation is by query and document.
    """
    sim = of_field(similarity or Similarity(), field)
    postings = index.postings.where(F.col("field") == field)
    place = F.col("clause") if "clause" in queries.columns else F.col("term")
    given = queries.select("query_id", "term", place.alias("place"))
    df = postings.join(given.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")) if index.stats is None else index.stats.where(F.col("field") == field).select("term", F.col("doc_freq").alias("df"))
    c = given.join(df, "term", "left").withColumn("idf", sim.idf_column(F.coalesce("df", F.lit(0)), index.size()))
    zero = F.lit(0.0).cast("float")
    # squares add up in single precision, clause by clause; the clauses of a query are few
    squares = F.aggregate(F.sort_array(F.collect_list(F.struct("place", "term", "idf"))), zero, lambda s, x: (s + (x["idf"] * x["idf"]).cast("float")).cast("float"))
    norms = c.groupBy("query_id").agg(squares.alias("squares"), F.count("*").alias("most"))
    norm = (F.lit(1.0) / F.sqrt(F.col("squares").cast("double"))).cast("float")
    norms = norms.select(F.col("query_id").alias("q"), F.when(F.col("squares") > 0, norm).otherwise(F.lit(1.0).cast("float")).alias("qn"), "most")
    c = c.groupBy("query_id", "term").agg(F.count("*").alias("times"), F.max("idf").alias("idf")).join(norms, F.col("query_id").eqNullSafe(F.col("q")))
    c = c.withColumn("value", ((F.col("idf") * F.col("qn")).cast("float") * F.col("idf")).cast("float"))
    rows = postings.join(c.select("query_id", "term", "times", "most", "value"), "term")
    s = sim.score(F.col("freq"), F.col("norm"), F.col("value"))
    got = rows.groupBy("query_id", "doc_id").agg(F.sum(s.cast("double") * F.col("times")).alias("s"), F.sum("times").alias("overlap"), F.first("most").alias("most"))
    coord = F.when(F.col("most") > 1, (F.col("overlap").cast("float") / F.col("most").cast("float")).cast("float")).otherwise(F.lit(1.0).cast("float"))
    got = got.select("query_id", "doc_id", (F.col("s") * coord.cast("double")).cast("float").alias("score"))
    if index.deletes is not None:
        got = got.join(index.deletes, "doc_id", "left_anti")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
