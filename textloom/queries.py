"""Registered queries: name to (function of session and table folder, DuckDB SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import analysis as an
from textloom.functions import bitsets, norms, scalars
from textloom.functions.automata import matcher, running
from textloom.functions.automata import string_set as string_automaton
from textloom.operators import index as ix
from textloom.operators import search as se
from textloom.operators.explain import explain, explain_all
from textloom.operators.index import Index, build
from textloom.plans import oracle as o
from textloom.plans.config import DOCS, KEYWORD, OFFSETS, TEXT, FieldOptions
from textloom.plans.parser import Parser
from textloom.plans.query import MUST, MUST_NOT, SHOULD, Boolean, MatchAll, Pattern, Phrase, Query, Term, must, should
from textloom.plans.similarity import PerField, Similarity
from textloom.sources.store import Store, Tiers
from textloom.streaming.indexer import index_stream

QUERIES: dict = {}


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, **how) -> Index:
    return build(table(spark, sf_dir), {"text": how.pop("options", TEXT)}, **how)


def T(term: str, **more) -> Term:
    return Term(field="text", term=term, **more)


def shared(spark: SparkSession, name: str) -> str:
    """A folder of its own for an index that a query writes: below spark.checkpoint.dir, which all executors see; a local session may do without."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="textloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(spark: SparkSession, name: str, fields: dict | None = None, **how) -> Store:
    return Store(spark, shared(spark, name), fields or {"text": TEXT}, **how)


# analysis


def tokens(spark, sf_dir, analyzer, name="documents", doc_id="doc_id", text="text"):
    return an.token_rows(table(spark, sf_dir, name), doc_id, text, analyzer)


@add("tokenize_standard", f"with {o.raw()} select doc_id, pos, t as term from raw where length(t) <= 255")
def tokenize_standard(spark, sf_dir):
    return tokens(spark, sf_dir, an.Analyzer(lower=False, stop=()))


@add("tokenize_lower", f"with {o.tokens(stop=False)} select doc_id, pos, term from k")
def tokenize_lower(spark, sf_dir):
    return tokens(spark, sf_dir, an.PLAIN)


@add("stop_filter", f"with {o.tokens()} select doc_id, pos, term from k")
def stop_filter(spark, sf_dir):
    return tokens(spark, sf_dir, an.STANDARD)


@add("token_types", f"with {o.raw()} select type, count(*) as n from (select case when regexp_matches(t, '\\p{{L}}') then '<ALPHANUM>' else '<NUM>' end as type from raw) group by type")
def token_types(spark, sf_dir):
    rows = an.token_rows(table(spark, sf_dir), "doc_id", "text", an.Analyzer(lower=False, stop=(), max_length=None))
    return rows.groupBy(an.token_type(F.col("term")).alias("type")).agg(F.count("*").alias("n"))


@add("token_offsets", f"with m as (select doc_id, unnest(string_split(regexp_replace(translate(text, chr(1), ' '), '({o._TOKEN})', chr(1) || '\\1' || chr(1), 'g'), chr(1))) as part, unnest(range(len(string_split(regexp_replace(translate(text, chr(1), ' '), '({o._TOKEN})', chr(1) || '\\1' || chr(1), 'g'), chr(1))))) as k from documents), e as (select doc_id, k, part, sum(length(part)) over (partition by doc_id order by k) as e from m) select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as integer) as pos, part as raw, cast(e - length(part) as integer) as start, cast(e as integer) as \"end\" from e where k % 2 = 1 and regexp_matches(part, '[\\p{{L}}\\p{{N}}]')")
def token_offsets(spark, sf_dir):
    return an.offsets(table(spark, sf_dir), "doc_id", "text")


@add("whitespace_analyze", "select doc_id, cast(pos as integer) as pos, lower(t) as term from (select doc_id, unnest(l) as t, unnest(range(len(l))) as pos from (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as l from documents))")
def whitespace_analyze(spark, sf_dir):
    return tokens(spark, sf_dir, an.WHITESPACE)


@add("keyword_field", "select source as term, count(*) as doc_freq from documents where source <> '' group by source")
def keyword_field(spark, sf_dir):
    index = build(table(spark, sf_dir), {"source": KEYWORD})
    return index.term_stats().select("term", "doc_freq")


_LONG = "(select doc_id, coalesce(text, '') || ' ' || repeat('x', 256) || ' cd ' || coalesce(text, '') as text from documents)"


@add("long_token_skip", f"with {o.tokens(_LONG)} select doc_id, pos, term from k")
def long_token_skip(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir).select("doc_id", F.concat(text, F.lit(" "), F.repeat(F.lit("x"), 256), F.lit(" cd "), text).alias("text"))
    return an.token_rows(docs, "doc_id", "text")


@add("custom_filter", f"with {o.tokens()} select term, count(*) as n from k where length(term) >= 8 group by term")
def custom_filter(spark, sf_dir):
    long = an.Analyzer(keep=lambda t: F.char_length(t) >= 8)
    return tokens(spark, sf_dir, long).groupBy("term").agg(F.count("*").alias("n"))


# inversion and statistics


@add("invert_postings", f"with {o.inverted()} select doc_id, term, freq from post")
def invert_postings(spark, sf_dir):
    return documents(spark, sf_dir).postings.select("doc_id", "term", "freq")


@add("postings_positions", f"with {o.inverted()} select doc_id, term, array_to_string(positions, ',') as positions from post")
def postings_positions(spark, sf_dir):
    return documents(spark, sf_dir).postings.select("doc_id", "term", F.array_join("positions", ",").alias("positions"))


_PARTS = f"string_split(regexp_replace(translate(text, chr(1), ' '), '({o._TOKEN})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"


@add("postings_offsets", f"with m as (select doc_id, unnest({_PARTS}) as part, unnest(range(len({_PARTS}))) as k from documents), e as (select doc_id, k, part, sum(length(part)) over (partition by doc_id order by k) as e from m), t as (select doc_id, lower(part) as term, e - length(part) as s, e from e where k % 2 = 1 and regexp_matches(part, '[\\p{{L}}\\p{{N}}]')) select doc_id, term, count(*) as freq, string_agg(cast(s as bigint) || '-' || cast(e as bigint), ',' order by s) as offsets from t where length(term) <= 255 and term not in ({o._STOP}) group by doc_id, term")
def postings_offsets(spark, sf_dir):
    rows = documents(spark, sf_dir, options=FieldOptions(options=OFFSETS)).postings
    shown = F.array_join(F.transform("offsets", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return rows.select("doc_id", "term", F.col("freq").cast("long").alias("freq"), shown.alias("offsets"))


@add("doc_freq", f"with {o.inverted()} select term, count(*) as doc_freq from post group by term")
def doc_freq(spark, sf_dir):
    return documents(spark, sf_dir).term_stats().select("term", "doc_freq")


@add("total_term_freq", f"with {o.inverted()} select term, cast(sum(freq) as bigint) as total_term_freq from post group by term")
def total_term_freq(spark, sf_dir):
    return documents(spark, sf_dir).term_stats().select("term", "total_term_freq")


@add("field_stats", f"with {o.inverted()} select 'text' as field, (select maxdoc from n) as max_doc, count(distinct doc_id) as doc_count, cast(sum(freq) as bigint) as sum_total_term_freq, count(*) as sum_doc_freq from post")
def field_statistics(spark, sf_dir):
    return documents(spark, sf_dir).field_stats()


@add("field_length_norm", f"with {o.inverted()} select doc_id, length, norm from norms")
def field_length_norm(spark, sf_dir):
    return documents(spark, sf_dir).norms.select("doc_id", F.col("length").cast("long").alias("length"), "norm")


@add("norm_decode", "select cast(b as integer) as byte, cast(v as float) as norm from (values " + ", ".join(f"({b}, {norms.decode(b)!r})" for b in range(256)) + ") t(b, v)")
def norm_decode(spark, sf_dir):
    return spark.range(256).select(F.col("id").cast("int").alias("byte"), norms.norm_value(F.col("id").cast("int")).alias("norm"))


@add("term_seek_exact", f"with {o.inverted()} select doc_id, freq from post where term = 'hash'")
def term_seek_exact(spark, sf_dir):
    return documents(spark, sf_dir).postings.where((F.col("field") == "text") & (F.col("term") == "hash")).select("doc_id", "freq")


@add("term_seek_ceil", f"with {o.inverted()} select min(term) as term from post where term >= 'hasg'")
def term_seek_ceil(spark, sf_dir):
    return ix.seek_ceil(documents(spark, sf_dir), "text", "hasg")


@add("term_enum", f"with {o.inverted()} select distinct term from post where term >= 'er' and term < 'es'")
def term_enum(spark, sf_dir):
    return documents(spark, sf_dir).postings.where((F.col("term") >= "er") & (F.col("term") < "es")).select("term").distinct()


@add("postings_advance", f"with {o.inverted()} select doc_id, freq from post where term = 'ble' and doc_id >= 100 order by doc_id limit 1")
def postings_advance(spark, sf_dir):
    return ix.advance(documents(spark, sf_dir), "text", "ble", 100)


@add("idf_table", f"with {o.inverted()}, s as (select term, count(*) as df from post group by term) select term, cast(cast(ln(cast(maxdoc as double) / (df + 1)) as float) + cast(1.0 as float) as float) as idf from s, n")
def idf_table(spark, sf_dir):
    index = documents(spark, sf_dir)
    idf = (F.ln(F.lit(float(index.size())) / (F.col("doc_freq") + 1)).cast("float") + F.lit(1.0).cast("float")).cast("float")
    return index.term_stats().select("term", idf.alias("idf"))


# search


def searches(name: str, query: Query, node: dict, k: int = 10, **how):
    def run(spark, sf_dir):
        return se.top(se.search(documents(spark, sf_dir), query, **how), k)

    QUERIES[name] = (run, o.best(node, k))


HASH3 = should(T("hash"), T("ingre"), T("und"))
HASH3_NODE = o.boolean(("", o.term("hash")), ("", o.term("ingre")), ("", o.term("und")))
GOLDEN = Boolean(clauses=((SHOULD, T("hash")), (SHOULD, T("ingre")), (SHOULD, T("und")), (MUST_NOT, T("ung"))))
GOLDEN_NODE = o.boolean(("", o.term("hash")), ("", o.term("ingre")), ("", o.term("und")), ("-", o.term("ung")))

searches("golden_query", GOLDEN, GOLDEN_NODE)
searches("term_query", T("hash"), o.term("hash"))
searches("term_query_boosted", T("hash", boost=3.5), o.term("hash", 3.5))
searches("term_query_negative_boost", T("hash", boost=-42.0), o.term("hash", -42.0))
searches("term_query_docfreq_override", T("hash", doc_freq=7), o.term("hash", doc_freq=7))
searches("term_query_absent", T("nosuchterm"), o.term("nosuchterm"))
searches("bool_should", HASH3, HASH3_NODE)
searches("bool_must", must(T("ble"), T("er")), o.boolean(("+", o.term("ble")), ("+", o.term("er"))))
searches("bool_must_not", Boolean(clauses=((SHOULD, T("ble")), (MUST_NOT, T("er")))), o.boolean(("", o.term("ble")), ("-", o.term("er"))))
searches("bool_mixed", Boolean(clauses=((MUST, T("ble")), (SHOULD, T("hash")), (SHOULD, T("er", boost=2.0)), (MUST_NOT, T("und")))), o.boolean(("+", o.term("ble")), ("", o.term("hash")), ("", o.term("er", 2.0)), ("-", o.term("und"))))
searches("bool_min_should_match", should(T("ble"), T("er"), T("hash"), T("in"), min_should=2), o.boolean(("", o.term("ble")), ("", o.term("er")), ("", o.term("hash")), ("", o.term("in")), min_should=2))
searches("bool_nested", Boolean(clauses=((SHOULD, T("hash")), (SHOULD, must(T("ble"), T("er"), boost=2.0)))), o.boolean(("", o.term("hash")), ("", o.boolean(("+", o.term("ble")), ("+", o.term("er")), boost=2.0))))
searches("bool_disable_coord", should(T("hash"), T("ble"), disable_coord=True), o.boolean(("", o.term("hash")), ("", o.term("ble")), coord=False))
searches("bool_repeated_clause", should(T("hash"), T("hash"), T("ble")), o.boolean(("", o.term("hash")), ("", o.term("hash")), ("", o.term("ble"))))
searches("bool_absent_term", should(T("hash"), T("nosuchterm")), o.boolean(("", o.term("hash")), ("", o.term("nosuchterm"))))
searches("bool_single_clause", Boolean(clauses=((SHOULD, T("hash")),), boost=2.0), o.term("hash", 2.0))
searches("prefix_query", Pattern(kind="prefix", field="text", text="hash"), o.pattern("starts_with(term, 'hash')"))
searches("wildcard_query", Pattern(kind="wildcard", field="text", text="h?sh*e"), o.pattern("regexp_full_match(term, 'h.sh.*e')"))
searches("fuzzy_query", Pattern(kind="fuzzy", field="text", text="hash", edits=1), o.pattern("levenshtein(term, 'hash') <= 1"))
searches("range_query", Pattern(kind="range", field="text", text="has", upper="hat"), o.pattern("term >= 'has' and term <= 'hat'"))
searches("regexp_query", Pattern(kind="regexp", field="text", text="h(a|e)sh.{0,2}"), o.pattern("regexp_full_match(term, 'h(a|e)sh.{0,2}')"))
searches("phrase_query", Phrase(field="text", terms=("eriner", "thanea")), o.phrase("eriner", "thanea"))
searches("parse_and_search", Parser("text").parse("+ble hash er^2 -und"), o.boolean(("+", o.term("ble")), ("", o.term("hash")), ("", o.term("er", 2.0)), ("-", o.term("und"))))
searches("parse_operators", Parser("text").parse("(hash OR ble) AND er NOT text:und"), o.boolean(("+", o.boolean(("", o.term("hash")), ("", o.term("ble")))), ("+", o.term("er")), ("-", o.term("und"))))

EMPTY = "select cast(0 as bigint) as doc_id, cast(0 as float) as score where false"


@add("bool_only_negative", EMPTY)
def bool_only_negative(spark, sf_dir):
    return se.search(documents(spark, sf_dir), Boolean(clauses=((MUST_NOT, T("hash")),)))


@add("parse_empty_query", EMPTY)
def parse_empty_query(spark, sf_dir):
    return se.search(documents(spark, sf_dir), Parser("text").parse("the of"))


@add("match_all", "select doc_id, cast(1.0 as float) as score from documents order by doc_id limit 10")
def match_all(spark, sf_dir):
    return se.top(se.search(documents(spark, sf_dir), MatchAll()), 10)


@add("query_norm", o.hits(GOLDEN_NODE) + " select qn as query_norm from q")
def query_norm(spark, sf_dir):
    return spark.createDataFrame([(float(se.weigh(documents(spark, sf_dir), GOLDEN)[1]),)], "query_norm float")


@add("search_all_hits", o.hits(GOLDEN_NODE) + " select doc_id, score from hits")
def search_all_hits(spark, sf_dir):
    return se.search(documents(spark, sf_dir), GOLDEN)


@add("total_hits", o.hits(GOLDEN_NODE) + " select count(*) as total_hits, max(score) as max_score from hits")
def total_hits(spark, sf_dir):
    return se.total_hits(se.search(documents(spark, sf_dir), GOLDEN))


@add("topk_ties", o.best(o.boolean(("", o.term("red")), ("", o.term("blue"))), 50, table="part", doc_id="p_partkey", text="p_name"))
def topk_ties(spark, sf_dir):
    index = build(table(spark, sf_dir, "part"), {"p_name": TEXT}, "p_partkey")
    return se.top(se.search(index, should(Term(field="p_name", term="red"), Term(field="p_name", term="blue"))), 50)


@add("page_range", o.hits(GOLDEN_NODE) + " select doc_id, score, cast(r - 1 as integer) as rank from (select doc_id, score, row_number() over (order by score desc, doc_id) as r from hits) where r > 5 and r <= 12")
def page_range(spark, sf_dir):
    return se.page(se.search(documents(spark, sf_dir), GOLDEN), 5, 7)


@add("search_after", o.hits(GOLDEN_NODE) + ", f as (select doc_id, score from hits order by score desc, doc_id limit 1 offset 4) select h.doc_id, h.score from hits h, f where h.score < f.score or (h.score = f.score and h.doc_id > f.doc_id) order by h.score desc, h.doc_id limit 5")
def search_after(spark, sf_dir):
    hits = se.search(documents(spark, sf_dir), GOLDEN)
    first = se.top(hits, 5).collect()
    return se.top(hits, 5, (first[-1]["score"], first[-1]["doc_id"]) if first else None)


@add("filtered_search", o.hits(HASH3_NODE) + " select h.doc_id, h.score from hits h join documents d using (doc_id) where d.lang = 'en' order by h.score desc, h.doc_id limit 10")
def filtered_search(spark, sf_dir):
    return se.top(se.search(documents(spark, sf_dir), HASH3, where=F.col("lang") == "en"), 10)


@add("stored_field_fetch", o.hits(GOLDEN_NODE) + " select h.doc_id, h.score, d.lang, d.source from (select * from hits order by score desc, doc_id limit 10) h join documents d using (doc_id)")
def stored_field_fetch(spark, sf_dir):
    index = documents(spark, sf_dir)
    return se.fetch(index, se.top(se.search(index, GOLDEN), 10), "lang", "source").select("doc_id", "score", "lang", "source")


def _two(a: str, b: str) -> str:
    """Scores of text:hash OR source:src3, whose norms are omitted."""
    idf = lambda df: f"cast(cast(ln(cast(maxdoc as double) / ({df} + 1)) as float) + cast(1.0 as float) as float)"
    return (
        f"with {o.inverted()}, u as (select {idf(f"(select count(*) from post where term = '{a}')")} as a, {idf(f"(select count(*) from documents where source = '{b}')")} as b from n), "
        "q as (select *, cast(1.0 / sqrt(cast(cast(cast(a * a as float) + cast(b * b as float) as float) as double)) as float) as qn from u), v as (select cast(cast(a * qn as float) * a as float) as va, cast(cast(b * qn as float) * b as float) as vb from q), "
        f"s as (select doc_id, cast(cast(cast(sqrt(cast(freq as double)) as float) * va as float) * norm as float) as s from post join norms using (doc_id), v where term = '{a}' union all select doc_id, vb from documents, v where source = '{b}') "
        "select doc_id, cast(sum(cast(s as double)) * cast(cast(count(*) as float) / cast(2 as float) as double) as float) as score from s group by doc_id order by score desc, doc_id limit 20"
    )


@add("multi_field_search", _two("hash", "src3"))
def multi_field_search(spark, sf_dir):
    index = build(table(spark, sf_dir), {"text": TEXT, "source": KEYWORD})
    return se.top(se.search(index, should(T("hash"), Term(field="source", term="src3"))), 20)


@add("omit_norms_field", f"with {o.inverted()}, u as (select cast(cast(ln(cast(maxdoc as double) / ((select count(*) from post where term = 'ble') + 1)) as float) + cast(1.0 as float) as float) as i from n), w as (select cast(cast(i * cast(1.0 / sqrt(cast(cast(i * i as float) as double)) as float) as float) * i as float) as v from u) select doc_id, cast(cast(sqrt(cast(freq as double)) as float) * v as float) as score from post, w where term = 'ble' order by score desc, doc_id limit 10")
def omit_norms_field(spark, sf_dir):
    return se.top(se.search(documents(spark, sf_dir, options=FieldOptions(omit_norms=True)), T("ble")), 10)


@add("docs_only_field", f"with {o.inverted()} select term, count(*) as total_term_freq from post group by term")
def docs_only_field(spark, sf_dir):
    return documents(spark, sf_dir, options=FieldOptions(options=DOCS)).term_stats().select("term", "total_term_freq")


_CONV = "(select conv_id, string_agg(text, ' | ' order by turn) as text from conversations group by conv_id)"


@add("multi_valued_field", f"with c as {_CONV}, {o.inverted('c', 'conv_id')} select doc_id, term, freq, array_to_string(positions, ',') as positions from post")
def multi_valued_field(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    index = build(turns.select("conv_id", F.col("t.text").alias("text")), {"text": FieldOptions(many=True)}, "conv_id")
    return index.postings.select("doc_id", "term", "freq", F.array_join("positions", ",").alias("positions"))


@add("index_time_boost", f"with {o.inverted()}, b as (select doc_id, cast(cast(case when lang = 'en' then 2.0 else 0.5 end as float) * cast(1.0 / sqrt(cast(length as double)) as float) as float) as raw from norms join documents using (doc_id)), t as (select cast(v as float) as v from (values " + ", ".join(f"({norms.decode(b)!r})" for b in range(1, 256)) + ") t(v)) select doc_id, (select max(v) from t where v <= raw) as norm from b")
def index_time_boost(spark, sf_dir):
    index = documents(spark, sf_dir, boosts={"text": F.when(F.col("lang") == "en", 2.0).otherwise(0.5)})
    return index.norms.select("doc_id", "norm")


class _Flat(Similarity):
    """tf of one, whatever the frequency."""

    def tf(self, freq):
        return F.lit(1.0).cast("float")


@add("per_field_similarity", o.hits(o.term("ble")) + " select doc_id, cast(v0 * norm as float) as score from post join norms using (doc_id), v where term = 'ble' order by score desc, doc_id limit 10")
def per_field_similarity(spark, sf_dir):
    return se.top(se.search(documents(spark, sf_dir), T("ble"), similarity=PerField({"text": _Flat()})), 10)


@add("explain_term", o.hits(o.term("hash", 2.0)) + ", w as (select idf0, cast(cast(idf0 * cast(2.0 as float) as float) * qn as float) as qw from q) select p.doc_id, cast(sqrt(cast(freq as double)) as float) as tf, idf0 as idf, norm as field_norm, qw as query_weight, cast(cast(cast(sqrt(cast(freq as double)) as float) * idf0 as float) * norm as float) as field_weight, h.score from post p join norms using (doc_id) join hits h on h.doc_id = p.doc_id, w where term = 'hash'")
def explain_term(spark, sf_dir):
    return explain_all(documents(spark, sf_dir), T("hash", boost=2.0))


@add("explain_bool", o.hits(GOLDEN_NODE) + " select doc_id, score from hits order by score desc, doc_id limit 1")
def explain_bool(spark, sf_dir):
    index = documents(spark, sf_dir)
    best = se.top(se.search(index, GOLDEN), 1).collect()
    rows = [(r["doc_id"], float(explain(index, GOLDEN, r["doc_id"]).value)) for r in best]
    return spark.createDataFrame(rows, "doc_id long, score float")


@add("batch_search", " union all ".join(f"(select '{q}' as query_id, * from ({o.best(o.term(q), 5)}))" for q in ("hash", "ingre", "und")))
def batch_search(spark, sf_dir):
    queries = spark.createDataFrame([(q, q) for q in ("hash", "ingre", "und")], "query_id string, term string")
    return se.search_batch(documents(spark, sf_dir), queries, "text", 5)


# persistence


def loaded(spark, sf_dir, name):
    s = store(spark, name)
    s.add(table(spark, sf_dir))
    s.commit()
    return s


@add("persisted_search", o.best(GOLDEN_NODE))
def persisted_search(spark, sf_dir):
    return se.top(se.search(loaded(spark, sf_dir, "persisted").index(), GOLDEN), 10)


@add("ram_index", o.best(GOLDEN_NODE))
def ram_index(spark, sf_dir):
    index = ix.cached(documents(spark, sf_dir))
    try:
        best = se.top(se.search(index, GOLDEN), 10).collect()
    finally:
        ix.release(index)
    return spark.createDataFrame(best, "doc_id long, score float")


@add("delete_by_term", o.hits(HASH3_NODE) + " select doc_id, score from hits where doc_id not in (select doc_id from post where term = 'ung') order by score desc, doc_id limit 10")
def delete_by_term(spark, sf_dir):
    s = loaded(spark, sf_dir, "delete-term")
    s.delete_by_term("text", "ung")
    s.commit()
    return se.top(se.search(s.index(), HASH3), 10)


@add("delete_by_query", o.hits(o.boolean(("+", o.term("ble")), ("+", o.term("er")))) + " select doc_id from documents where doc_id not in (select doc_id from hits)")
def delete_by_query(spark, sf_dir):
    s = loaded(spark, sf_dir, "delete-query")
    s.delete_by_query(must(T("ble"), T("er")))
    s.commit()
    return s.index().docs.select("doc_id")


@add("update_document", "select case when lang = 'fr' then 'neuf' else 'old' end as state, count(*) as docs from documents group by 1")
def update_document(spark, sf_dir):
    s = loaded(spark, sf_dir, "update")
    s.update(table(spark, sf_dir).where("lang = 'fr'").withColumn("text", F.lit("neuf")))
    s.commit()
    live = s.index()
    new = live.postings.where("term = 'neuf'").select("doc_id", F.lit("neuf").alias("state"))
    return live.docs.select("doc_id").join(new, "doc_id", "left").groupBy(F.coalesce("state", F.lit("old")).alias("state")).agg(F.count("*").alias("docs"))


@add("merge_compaction", f"with kept as (select * from documents where lang <> 'de'), {o.inverted('kept')} select term, count(*) as doc_freq from post group by term")
def merge_compaction(spark, sf_dir):
    s = store(spark, "compact")
    docs = table(spark, sf_dir)
    for k in range(3):
        s.add(docs.where(F.pmod("doc_id", F.lit(3)) == k))
    s.delete_ids(docs.where("lang = 'de'").select("doc_id"))
    s.compact(force=True)
    s.commit()
    return s.index().term_stats().select("term", "doc_freq")


@add("merge_tiered", f"with kept as (select * from documents where lang <> 'de'), {o.inverted('kept')} select p.term, p.doc_id, p.freq, array_to_string(p.positions, ',') as positions, n.norm from post p join norms n using (doc_id)")
def merge_tiered(spark, sf_dir):
    s = store(spark, "tiers", tiers=Tiers(per_tier=2, at_once=2, floor=1))
    docs = table(spark, sf_dir)
    for k in range(5):
        s.add(docs.where(F.pmod("doc_id", F.lit(5)) == k))
        s.compact()
    s.delete_ids(docs.where("lang = 'de'").select("doc_id"))
    s.compact()
    s.commit()
    return s.index().postings.select("term", "doc_id", "freq", F.array_join("positions", ",").alias("positions"), "norm")


@add("commit_history", "select cast(1 as bigint) as generation, cast(1 as integer) as segments, (select count(*) from documents) as docs, cast(0 as integer) as deletes union all select 2, 1, (select count(*) from documents), 1")
def commit_history(spark, sf_dir):
    s = loaded(spark, sf_dir, "history")
    s.delete_by_term("text", "hash")
    s.commit()
    return s.commits()


@add("rollback", "select count(*) as docs from documents")
def rollback(spark, sf_dir):
    s = loaded(spark, sf_dir, "rollback")
    s.delete_by_term("text", "hash")
    s.add(table(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 10_000_000))
    s.rollback()
    return s.index().docs.agg(F.count("*").alias("docs"))


@add("check_index", "select c as \"check\", cast(0 as bigint) as bad from (values ('freq_is_number_of_positions'), ('length_is_sum_of_freqs'), ('postings_have_documents'), ('postings_are_unique'), ('statistics_are_right')) t(c)")
def check_index(spark, sf_dir):
    return ix.check(loaded(spark, sf_dir, "check").index())


@add("streaming_incremental", o.best(GOLDEN_NODE))
def streaming_incremental(spark, sf_dir):
    s = store(spark, "stream")
    # each task of the split is a file, each file a micro-batch
    src = shared(spark, "stream-source")
    docs = table(spark, sf_dir)
    docs.repartition(3, "doc_id").write.parquet(src)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    index_stream(stream, s, shared(spark, "stream-checkpoint"), upsert=False).awaitTermination()
    return se.top(se.search(s.index(), GOLDEN), 10)


@add("streaming_upsert", "select case when lang = 'fr' then 'neuf' else 'old' end as state, count(*) as docs from documents group by 1")
def streaming_upsert(spark, sf_dir):
    """Two streams into one store: all documents, then three versions of the French ones, of which the last one counts."""
    s = store(spark, "upsert")
    docs = table(spark, sf_dir).withColumn("version", F.lit(0))
    old, new = shared(spark, "upsert-old"), shared(spark, "upsert-new")
    docs.write.parquet(old)
    texts = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(x).alias("text")) for v, x in ((1, "un"), (3, "neuf"), (2, "deux"))]))
    docs.where("lang = 'fr'").drop("text", "version").withColumn("v", texts).select("*", "v.*").drop("v").select(*docs.columns).write.parquet(new)
    for k, src in enumerate((old, new)):
        stream = spark.readStream.schema(docs.schema).parquet(src)
        index_stream(stream, s, shared(spark, f"upsert-checkpoint{k}"), order=F.col("version")).awaitTermination()
    return s.index().docs.groupBy(F.when(F.col("text") == "neuf", "neuf").otherwise("old").alias("state")).agg(F.count("*").alias("docs"))


# regular languages and scalars


@add("regexp_match", f"with {o.inverted()} select distinct term from post where regexp_full_match(term, '(ha|in)[a-e]{{2,4}}.*')")
def regexp_match(spark, sf_dir):
    return documents(spark, sf_dir).postings.where(matcher("(ha|in)[a-e]{2,4}.*")(F.col("term"))).select("term").distinct()


@add("regexp_intersection_complement", f"with {o.inverted()} select distinct term from post where regexp_full_match(term, 'ha.*') and regexp_full_match(term, '.*er') and not regexp_full_match(term, '.*th.*')")
def regexp_intersection_complement(spark, sf_dir):
    return documents(spark, sf_dir).postings.where(matcher("ha.*&.*er&~(.*th.*)")(F.col("term"))).select("term").distinct()


@add("regexp_nested_complement", f"with {o.inverted()} select distinct term from post where regexp_full_match(term, 'hash.+') and not regexp_full_match(term, 'hash.*er')")
def regexp_nested_complement(spark, sf_dir):
    return documents(spark, sf_dir).postings.where(matcher("hash(~(.*er)&.+)")(F.col("term"))).select("term").distinct()


_M = 4294967295


def _byte(i: str) -> str:
    """Byte i of the string whose upper-case hex digits are x."""
    return f"cast((instr('0123456789ABCDEF', substr(x, cast(2 * ({i}) + 1 as bigint), 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, cast(2 * ({i}) + 2 as bigint), 1)) - 1 as ubigint)"


def _rotated(x: str, by: int) -> str:
    return f"((({x}) << {by}) | (({x}) >> {32 - by})) & {_M}"


def _murmur(table: str, key: str, column: str, seed: int) -> str:
    mixed = f"lambda r: (({_rotated('r', 15)}) * 461845907) & {_M}"
    block = " + ".join(f"{_byte(f'4 * i + {j}')} * {256**j}" for j in range(4))
    tail = " + ".join(f"case when n % 4 > {j} then {_byte(f'n // 4 * 4 + {j}')} * {256**j} else 0 end" for j in range(3))
    step = _rotated("xor(h, k)", 13)
    return (
        f"with s as (select {key}, hex({column}) as x, cast(length(hex({column})) // 2 as bigint) as n from {table}), "
        f"b as (select *, list_transform(list_transform(range(n // 4), lambda i: (({block}) * 3432918353) & {_M}), {mixed}) as blocks, (({tail}) * 3432918353) & {_M} as t from s), "
        f"r as (select {key}, n, list_reduce(list_prepend(cast({seed} as ubigint), blocks), lambda h, k: ((({step}) * 5) + 3864292196) & {_M}) as h, (({_rotated('t', 15)}) * 461845907) & {_M} as t from b), "
        f"f as (select {key}, xor(xor(h, cast(t as ubigint)), cast(n as ubigint)) as h from r), g as (select {key}, (xor(h, h >> 16) * 2246822507) & {_M} as h from f), i as (select {key}, (xor(h, h >> 13) * 3266489909) & {_M} as h from g) "
        f"select {key}, cast(xor(h, h >> 16) as bigint) as hash from i"
    )


@add("murmur3_x86_32", _murmur("part", "p_partkey", "p_name", 42))
def murmur3_x86_32(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.murmur3(F.col("p_name"), 42).alias("hash"))


@add("rolling_hash", f"select p_partkey, cast(list_reduce(list_prepend(cast(0 as ubigint), list_transform(range(cast(length(x) // 2 as bigint)), lambda i: {_byte('i')})), lambda h, c: (h * 16777619 + c) & {_M}) as bigint) as hash from (select p_partkey, hex(p_name) as x from part)")
def rolling_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.rolling_hash(F.col("p_name")).alias("hash"))


@add("segment_names", "select p_partkey, '_' || lower(to_base(p_partkey, 36)) as segment, '_' || lower(to_base(p_partkey, 36)) || '_' || lower(to_base(p_size, 36)) || '.liv' as file, '_' || lower(to_base(p_size, 36)) || '.liv' as rest, cast(p_size as bigint) as generation from part where p_size > 0")
def segment_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_size > 0")
    name = scalars.segment_file(F.concat(F.lit("_"), scalars.base36(F.col("p_partkey"))), F.lit(""), F.lit(""))
    rows = rows.select("p_partkey", scalars.generation_name(name, F.lit("liv"), F.col("p_size").cast("long")).alias("file"))
    f = F.col("file")
    return rows.select("p_partkey", scalars.segment_name(f).alias("segment"), f, scalars.strip_segment_name(f).alias("rest"), scalars.file_generation(f).alias("generation"))


@add("packed_sizes", "select o_orderkey, cast(ceil(o_orderkey * b / 8.0) as bigint) as packed, cast(8 * ceil(o_orderkey / cast(64 // b as double)) as bigint) as blocks, cast((cast(1 as hugeint) << b) - 1 as bigint) as most from (select o_orderkey, o_custkey % 63 + 1 as b from orders)")
def packed_sizes(spark, sf_dir):
    k, b = F.col("o_orderkey"), (F.col("o_custkey") % 63 + 1).cast("int")
    return table(spark, sf_dir, "orders").select(k, scalars.packed_bytes(k, b).alias("packed"), scalars.packed_bytes(k, b, True).alias("blocks"), scalars.max_value(b).alias("most"))


@add("versions", "select l_orderkey, l_linenumber, (a1, a2, a3) >= (4, 10, 1) as later from (select l_orderkey, l_linenumber, l_linenumber as a1, l_suppkey % 20 as a2, cast(l_quantity as bigint) % 5 as a3 from lineitem)")
def versions(spark, sf_dir):
    text = F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 20).cast("string"), (F.col("l_quantity").cast("long") % 5).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.on_or_after(text, F.lit("4.10.1")).alias("later"))


@add("utf16_validity", "select o_orderkey, case o_custkey % 4 when 0 then true when 1 then false when 2 then false else true end as valid from orders")
def utf16_validity(spark, sf_dir):
    high, low, plain = (x.cast("int") for x in (0xD800 + F.col("o_orderkey") % 1024, 0xDC00 + F.col("o_orderkey") % 1024, 65 + F.col("o_orderkey") % 26))
    units = F.when(F.col("o_custkey") % 4 == 0, F.array(plain, high, low, plain)).when(F.col("o_custkey") % 4 == 1, F.array(plain, high, plain)).when(F.col("o_custkey") % 4 == 2, F.array(low, plain)).otherwise(F.array(plain))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.valid_utf16(units).alias("valid"))


def _orders_with(spark, sf_dir, condition):
    return bitsets.from_numbers(table(spark, sf_dir, "orders").where(condition), "o_orderkey")


_SETS = "a as (select distinct o_orderkey as n from orders where o_totalprice > 100000), b as (select distinct o_orderkey as n from orders where o_orderstatus = 'F')"


@add("bit_sets", f"with {_SETS} select 'and' as op, n from a where n in (select n from b) union all select 'and_not', n from a where n not in (select n from b) union all select 'or', n from (select n from a union select n from b)")
def bit_sets(spark, sf_dir):
    a, b = _orders_with(spark, sf_dir, "o_totalprice > 100000"), _orders_with(spark, sf_dir, "o_orderstatus = 'F'")
    parts = [bitsets.to_numbers(f(a, b)).select(F.lit(op).alias("op"), "n") for op, f in (("and", bitsets.both), ("and_not", bitsets.without), ("or", bitsets.either))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@add("bit_set_walk", f"with {_SETS} select (select count(*) from a) as ones, (select min(n) from a where n >= 1000) as next")
def bit_set_walk(spark, sf_dir):
    a = _orders_with(spark, sf_dir, "o_totalprice > 100000")
    return bitsets.cardinality(a).withColumnRenamed("n", "ones").crossJoin(bitsets.next_set(a, 1000).withColumnRenamed("n", "next"))


@add("string_set", f"with {o.inverted()} select distinct term from post where term in ('hash', 'ingre', 'und', 'er', 'ble', 'nosuch')")
def string_set(spark, sf_dir):
    dfa = string_automaton(["hash", "ingre", "und", "er", "ble", "nosuch"])
    return documents(spark, sf_dir).term_stats().where(running(dfa)(F.col("term"))).select("term")


_D36 = "'0123456789abcdefghijklmnopqrstuvwxyz'"


@add("base36_generation", f"select o_orderkey, ltrim(substr({_D36}, cast(o_orderkey // 60466176 % 36 as integer) + 1, 1) || substr({_D36}, cast(o_orderkey // 1679616 % 36 as integer) + 1, 1) || substr({_D36}, cast(o_orderkey // 46656 % 36 as integer) + 1, 1) || substr({_D36}, cast(o_orderkey // 1296 % 36 as integer) + 1, 1) || substr({_D36}, cast(o_orderkey // 36 % 36 as integer) + 1, 1), '0') || substr({_D36}, cast(o_orderkey % 36 as integer) + 1, 1) as name from orders")
def base36_generation(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.base36(F.col("o_orderkey")).alias("name"))


@add("zigzag", "select o_orderkey, case when o_orderkey % 2 = 0 then 2 * o_orderkey else 2 * o_orderkey - 1 end as coded, case when o_orderkey % 2 = 0 then o_orderkey else -o_orderkey end as plain from orders")
def zigzag(spark, sf_dir):
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    coded = scalars.zigzag(signed)
    return table(spark, sf_dir, "orders").select("o_orderkey", coded.alias("coded"), scalars.unzigzag(coded).alias("plain"))


@add("bit_scalars", "select o_orderkey, cast(greatest(1, length(bin(o_orderkey))) as integer) as bits, cast(bit_count(o_orderkey) as integer) as ones, cast(length(cast(o_orderkey as varchar)) - 1 as integer) as log10, gcd(o_orderkey, o_custkey) as gcd, cast(case when o_orderkey = 0 then 64 else bit_count((o_orderkey & -o_orderkey) - 1) end as integer) as zeros from orders")
def bit_scalars(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, scalars.bits_required(k).alias("bits"), F.bit_count(k).cast("int").alias("ones"), scalars.integer_log(k, 10).cast("int").alias("log10"), scalars.gcd(k, F.col("o_custkey")).alias("gcd"), scalars.trailing_zeros(k).alias("zeros"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten documents of a boolean query, with stored columns."""
    index = documents(spark, sf_dir)
    hits = se.top(se.search(index, should(T("ble"), T("er"), T("hash"))), 10)
    return se.fetch(index, hits, "lang", "source").select("doc_id", "score", "lang", "source")
