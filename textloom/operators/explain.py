"""Explanation of a score as a tree of values."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.query import MUST, MUST_NOT, Boolean, Query, Term
from textloom.plans.similarity import Similarity, f32, of_field

from .index import Index
from .search import Weighted, _leaf, weigh


@dataclass
class Explanation:
    value: np.float32
    description: str
    details: list = field(default_factory=list)
    match: bool = True

    def is_match(self) -> bool:
        return self.match

    def __str__(self, depth: int = 0):
        return "  " * depth + f"{self.value} = {self.description}\n" + "".join(d.__str__(depth + 1) for d in self.details)

    def shown(self, depth: int = 0) -> str:
        """Like str, each line with whether it matches."""
        mark = "MATCH" if self.match else "NON_MATCH"
        return "  " * depth + f"{self.value} = ({mark}) {self.description}\n" + "".join(d.shown(depth + 1) for d in self.details)

    def rows(self, path: str = "0") -> list[tuple[str, float, str]]:
        out = [(path, float(self.value), self.description)]
        for k, d in enumerate(self.details):
            out += d.rows(f"{path}.{k}")
        return out


def _idf(w: Weighted) -> Explanation:
    return Explanation(w.idf, f"idf(docFreq={w.doc_freq}, maxDocs={w.max_doc})")


def _term(w: Weighted, norm: np.float32, row) -> Explanation:
    q = w.query
    if row is None:
        return Explanation(f32(0), "no matching term", match=False)
    tf = f32(row["tf"])
    parts = [Explanation(tf, f"tf(freq={float(row['freq'])}), with freq of:", [Explanation(f32(row["freq"]), f"termFreq={float(row['freq'])}")]), _idf(w)]
    value = f32(tf * w.idf)
    if row["norm"] is not None:
        parts.append(Explanation(f32(row["norm"]), "fieldNorm"))
        value = f32(value * f32(row["norm"]))
    part = Explanation(value, "fieldWeight, product of:", parts)
    own = [Explanation(f32(q.boost), "boost")] if q.boost != 1 else []
    weight = Explanation(w.weight, "queryWeight, product of:", [*own, _idf(w), Explanation(norm, "queryNorm")])
    score = f32(row["score"])
    details = [part] if w.weight == 1 else [weight, part]
    return Explanation(score, f"weight({q}), product of:", details)


def explain(index: Index, query: Query, doc_id: int, similarity: Similarity | None = None) -> Explanation:
    """Why a document scores as it does; its value is the score of ``search``. One job fetches the document's postings of the queried terms."""
    w, norm = weigh(index, query, similarity)
    sim = similarity or Similarity()
    leaves: list[Weighted] = []

    def gather(x):
        if isinstance(x.query, Term):
            leaves.append(x)
        for _, c in x.clauses:
            gather(c)

    gather(w)
    # one job: each clause with its tf and score as the search's own plan has them, whatever the similarity
    own = index.postings.where(F.col("doc_id") == doc_id)
    found: dict[int, object] = {}
    if leaves:
        rows = None
        for k, x in enumerate(leaves):
            s = of_field(sim, x.query.field)
            part = own.where((F.col("field") == x.query.field) & (F.col("term") == x.query.term))
            part = part.select(F.lit(k).alias("k"), "freq", "norm", s.tf(F.col("freq")).alias("tf"), s.score(F.col("freq"), F.col("norm"), F.lit(float(x.value)).cast("float")).alias("score"))
            rows = part if rows is None else rows.unionByName(part)
        found = {id(leaves[r["k"]]): r for r in rows.collect()}  # a row for each clause at most

    def made(x: Weighted) -> Explanation:
        q = x.query
        if isinstance(q, Term):
            return _term(x, norm, found.get(id(x)))
        if not isinstance(q, Boolean):
            got = _leaf(index, x, sim).where(F.col("doc_id") == doc_id).first()
            return Explanation(f32(got["score"]), str(q)) if got else Explanation(f32(0), f"no match on {q}", match=False)
        total, overlap, parts, most = 0.0, 0, [], sum(o != MUST_NOT for o, _ in x.clauses)
        for o, c in x.clauses:
            e = made(c)
            if o == MUST_NOT and e.match:
                return Explanation(f32(0), f"match on prohibited clause ({c.query})", [e], match=False)
            if o == MUST and not e.match:
                return Explanation(f32(0), f"no match on required clause ({c.query})", [e], match=False)
            if o != MUST_NOT and e.match:
                total, overlap = total + float(e.value), overlap + 1
                parts.append(e)
        if not overlap or overlap - sum(o == MUST for o, _ in x.clauses) < q.min_should:
            return Explanation(f32(0), "no matching clause", match=False)
        coord = f32(1) if q.disable_coord or most == 1 else f32(f32(overlap) / f32(most))
        score = f32(total * float(coord))
        if coord == 1:
            return Explanation(score, "sum of:", parts)
        return Explanation(score, "product of:", [Explanation(f32(total), "sum of:", parts), Explanation(coord, f"coord({overlap}/{most})")])

    out = made(w)
    if out.match and index.deletes is not None and index.deletes.where(F.col("doc_id") == doc_id).first():
        return Explanation(f32(0), "deleted", match=False)
    return out


def explain_all(index: Index, query: Term, similarity: Similarity | None = None) -> DataFrame:
    """``(doc_id, tf, idf, field_norm, query_weight, field_weight, score)`` of all hits of a term."""
    w, _ = weigh(index, query, similarity)
    q = w.query
    sim = similarity or Similarity()
    rows = index.postings.where((F.col("field") == q.field) & (F.col("term") == q.term))
    idf, weight, value = (F.lit(float(x)).cast("float") for x in (w.idf, w.weight, w.value))
    tf = sim.tf(F.col("freq"))
    return rows.select("doc_id", tf.alias("tf"), idf.alias("idf"), F.col("norm").alias("field_norm"), weight.alias("query_weight"), ((tf * idf).cast("float") * F.col("norm")).cast("float").alias("field_weight"), sim.score(F.col("freq"), F.col("norm"), value).alias("score"))
