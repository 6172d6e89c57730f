"""Inversion of text columns into postings, with norms and statistics."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import batches, norms
from textloom.functions.analysis import KEYWORD, STANDARD, Analyzer, offsets, raw_tokens
from textloom.plans.config import FREQS, OFFSETS, POSITIONS, TEXT, FieldOptions


@dataclass
class Index:
    """Tables of an index. postings: (field, term, doc_id, freq, positions, norm), and offsets if a field keeps them; max_doc counts deleted documents too, until they are compacted."""

    docs: DataFrame
    postings: DataFrame
    norms: DataFrame
    max_doc: int | None = None
    deletes: DataFrame | None = None
    stats: DataFrame | None = None
    fields: dict[str, FieldOptions] = field(default_factory=dict)

    def size(self) -> int:
        if self.max_doc is None:
            self.max_doc = self.docs.count()
        return self.max_doc

    def term_stats(self) -> DataFrame:
        """``(field, term, doc_freq, total_term_freq)``."""
        return self.stats if self.stats is not None else term_stats(self.postings)

    def field_stats(self) -> DataFrame:
        return field_stats(self.postings, self.size())


def analysed(docs: DataFrame, name: str, options: FieldOptions, analyzer: Analyzer, doc_id: str, boost: Column | None = None) -> DataFrame:
    """``(doc_id, tokens, length, norm_byte, norm)`` of one field: tokens and norm come from the row itself, without a shuffle."""
    analyzer = analyzer if options.tokenized else KEYWORD
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), analyzer.tokens(F.col(name), options.many).alias("tokens"), *([] if boost is None else [boost.cast("float").alias("boost")]))
    return normed(rows.where("doc_id is not null").withColumn("length", F.size("tokens")), options, "tokens")


def normed(rows: DataFrame, options: FieldOptions, *columns: str) -> DataFrame:
    """``(doc_id, columns, length, norm_byte, norm)`` of rows with a length, and a boost if there is one."""
    if options.omit_norms:
        return rows.select("doc_id", *columns, "length", F.lit(None).cast("int").alias("norm_byte"), F.lit(None).cast("float").alias("norm"))
    if "boost" not in rows.columns:
        return rows.select("doc_id", *columns, "length", F.expr(norms.sql_length_byte("length")).alias("norm_byte"), F.expr(norms.sql_length_value("length")).alias("norm"))
    rows = rows.withColumn("norm_byte", norms.boosted_byte(F.col("length"), F.col("boost")))
    return rows.select("doc_id", *columns, "length", "norm_byte", norms.norm_value(F.col("norm_byte")).alias("norm"))


def inverted(rows: DataFrame, name: str, options: FieldOptions = TEXT) -> DataFrame:
    """Postings of a field from its analysed rows. Without frequencies, freq is 1; without positions, positions is null."""
    tokens = rows.select("doc_id", "norm", F.explode("tokens").alias("t")).select("doc_id", "norm", "t.term", "t.pos")
    if not options.tokenized and not options.many:  # one token at most
        positions = F.array("pos") if options.options >= POSITIONS else F.lit(None).cast("array<int>")
        return tokens.select(F.lit(name).alias("field"), "term", "doc_id", F.lit(1).alias("freq"), positions.alias("positions"), "norm")
    freq = F.count("*").cast("int") if options.options >= FREQS else F.lit(1)
    positions = F.sort_array(F.collect_list("pos")) if options.options >= POSITIONS else F.lit(None).cast("array<int>")
    out = tokens.groupBy("doc_id", "term").agg(freq.alias("freq"), positions.alias("positions"), F.first("norm").alias("norm"))
    return out.select(F.lit(name).alias("field"), "term", "doc_id", "freq", "positions", "norm")


def inverted_in_batches(docs: DataFrame, name: str, options: FieldOptions, analyzer: Analyzer, doc_id: str, boost: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings and norm rows of a field of the standard tokenizer: a document's tokens are all in its row, so each task inverts what it reads. Postings come in runs sorted by term and doc_id."""
    text = F.array_join(F.col(name), "\n") if options.many else F.col(name).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text.alias("text"), *([] if boost is None else [boost.cast("float").alias("boost")])).where("doc_id is not null")
    how = rows, analyzer.lower, analyzer.stop, analyzer.max_length
    places = options.options >= OFFSETS
    own = normed(batches.inverted(*how, options.options >= POSITIONS, places), options, "term", "freq", "positions", *["offsets"] * places)
    freq = F.col("freq") if options.options >= FREQS else F.lit(1)
    postings = own.select(F.lit(name).alias("field"), "term", "doc_id", freq.alias("freq"), "positions", "norm", *["offsets"] * places)
    return postings, normed(batches.lengths(*how), options)


def inverted_with_offsets(docs: DataFrame, rows: DataFrame, name: str, analyzer: Analyzer, doc_id: str) -> DataFrame:
    """Postings of a field with ``offsets``: start and end of each occurrence in characters of the text, in order of position."""
    if analyzer.raw is not raw_tokens:
        raise ValueError("offsets are kept of texts that the standard tokenizer takes apart")
    term = F.lower("raw") if analyzer.lower else F.col("raw")
    at = offsets(docs.where(F.col(doc_id).isNotNull()), doc_id, name).select(F.col("doc_id").cast("long").alias("doc_id"), term.alias("term"), F.struct("pos", "start", "end").alias("o"))
    at = at.where(analyzer.accepts(F.col("term"))).groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("o")).alias("o"))
    at = at.join(rows.select("doc_id", "norm"), "doc_id")
    places = F.transform("o", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return at.select(F.lit(name).alias("field"), "term", "doc_id", F.size("o").alias("freq"), F.col("o.pos").alias("positions"), "norm", places.alias("offsets"))


def build(docs: DataFrame, fields: dict[str, FieldOptions], doc_id: str = "doc_id", analyzer: Analyzer = STANDARD, analyzers: dict[str, Analyzer] | None = None, boosts: dict[str, Column] | None = None) -> Index:
    """The index of docs, as a plan: nothing runs until a table is used. doc_id is unique; rows without one are left out, null and empty texts have no tokens."""
    postings = norm_rows = None
    for name, options in fields.items():
        if not options.indexed:
            continue
        own, boost = (analyzers or {}).get(name, analyzer), (boosts or {}).get(name)
        if options.options >= OFFSETS and (options.many or not options.tokenized):
            raise ValueError("offsets are kept of single tokenized texts")
        if options.tokenized and own.raw is raw_tokens and not own.keep:
            one, rows = inverted_in_batches(docs, name, options, own, doc_id, boost)
        else:
            rows = analysed(docs, name, options, own, doc_id, boost)
            one = inverted_with_offsets(docs, rows, name, own, doc_id) if options.options >= OFFSETS else inverted(rows, name, options)
        norm = rows.where("length > 0").select(F.lit(name).alias("field"), "doc_id", "length", "norm_byte", "norm")
        postings = one if postings is None else postings.unionByName(one, allowMissingColumns=True)
        norm_rows = norm if norm_rows is None else norm_rows.unionByName(norm)
    if postings is None:
        raise ValueError("no field is indexed")
    stored = docs.where(F.col(doc_id).isNotNull()).withColumn("doc_id", F.col(doc_id).cast("long"))
    return Index(stored, postings, norm_rows, fields=dict(fields))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("doc_freq"), F.sum("freq").cast("long").alias("total_term_freq"))


def field_stats(postings: DataFrame, max_doc: int) -> DataFrame:
    """``(field, max_doc, doc_count, sum_total_term_freq, sum_doc_freq)``; documents are counted per document first, as counting distinct ones would expand rows."""
    per_doc = postings.groupBy("field", "doc_id").agg(F.count("*").alias("n"), F.sum("freq").alias("f"))
    out = per_doc.groupBy("field").agg(F.count("*").alias("doc_count"), F.sum("f").cast("long").alias("sum_total_term_freq"), F.sum("n").cast("long").alias("sum_doc_freq"))
    return out.select("field", F.lit(max_doc).cast("long").alias("max_doc"), "doc_count", "sum_total_term_freq", "sum_doc_freq")


def seek_ceil(index: Index, name: str, term: str) -> DataFrame:
    """The least term of a field that isn't below the given one."""
    return index.postings.where((F.col("field") == name) & (F.col("term") >= term)).agg(F.min("term").alias("term")).where("term is not null")


def advance(index: Index, name: str, term: str, target: int) -> DataFrame:
    """The first posting of a term whose doc_id is target or more."""
    own = index.postings.where((F.col("field") == name) & (F.col("term") == term) & (F.col("doc_id") >= target))
    return own.select("doc_id", "freq").orderBy("doc_id").limit(1)


def check(index: Index) -> DataFrame:
    """``(check, bad)``: how many rows break each rule of a sound index."""
    p = index.postings
    spark = index.docs.sparkSession
    sizes = p.where(F.col("positions").isNotNull() & (F.size("positions") != F.col("freq"))).agg(F.count("*").alias("bad")).select(F.lit("freq_is_number_of_positions").alias("check"), "bad")
    lengths = p.groupBy("field", "doc_id").agg(F.sum("freq").alias("f")).join(index.norms, ["field", "doc_id"], "full_outer")
    lengths = lengths.where(~F.col("f").eqNullSafe(F.col("length"))).agg(F.count("*").alias("bad")).select(F.lit("length_is_sum_of_freqs").alias("check"), "bad")
    orphans = p.select("doc_id").distinct().join(index.docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("bad")).select(F.lit("postings_have_documents").alias("check"), "bad")
    twice = p.groupBy("field", "term", "doc_id").count().where("count > 1").agg(F.count("*").alias("bad")).select(F.lit("postings_are_unique").alias("check"), "bad")
    if index.stats is not None:
        a = index.stats.select("field", "term", F.col("doc_freq").alias("x"), F.col("total_term_freq").alias("y")).join(term_stats(p), ["field", "term"], "full_outer")
        wrong = a.where(~F.col("x").eqNullSafe(F.col("doc_freq")) | ~F.col("y").eqNullSafe(F.col("total_term_freq"))).agg(F.count("*").alias("bad")).select(F.lit("statistics_are_right").alias("check"), "bad")
    else:
        wrong = spark.createDataFrame([("statistics_are_right", 0)], "check string, bad long")
    return sizes.unionByName(lengths).unionByName(orphans).unionByName(twice).unionByName(wrong)


def cached(index: Index, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Index:
    """An index in the executors' memory, for one that isn't worth a store: its tables are made once, at their first use. ``release`` lets it go."""
    return replace(index, docs=index.docs.persist(level), postings=index.postings.persist(level), norms=index.norms.persist(level), stats=index.term_stats().persist(level))


def release(index: Index) -> None:
    for table in (index.docs, index.postings, index.norms, index.stats):
        if table is not None:
            table.unpersist()
