"""Empty tables, nulls in any column, repeated rows, extra columns of clashing names and very long texts, for all operators and stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import blocks, mixture, parity_join, quotes, registry, repetition, secrets, simple8b, suffix_index, templates, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size int, root string, h double, k int, words string, rank int, shard long, block int, row string, doc_a long, label int, toxic int"
EXTRA = [None] * 13


def rows(kind):
    if kind == "empty":
        return []
    out = [
        (1, "one text of some words that stands here alone", "en", "a", 3),
        (1, "one text of some words that stands here alone", "en", "a", 3),
        (None, "one text of some words that stands here alone", None, None, None),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, "!!! ... \n\t", "en", "", 0),
        (None, None, None, None, None),
        (5, "ж中😀 é " * 30, "xx", "b", 1),
    ]
    if kind == "long":
        out.append((6, "".join(f"w{i % 7919} " for i in range(200_000)), "en", "a", 1))
        out.append((7, "x" * 1_000_000, "en", "a", 1))
        out.append((8, "a " * 100_000, "en", "a", 1))
    return [(*r, *EXTRA) for r in out]


def frame(spark, kind):
    return spark.createDataFrame(rows(kind), SCHEMA)


def bench(spark, kind):
    own = [] if kind == "empty" else [(1, "what is the sum of all numbers that are below 100 and even", 5), (None, None, None), (2, "", 1)]
    return spark.createDataFrame(own, "item_id long, text string, h int")


OPERATORS = {
    "toxicity": lambda s, d, k: toxicity.toxicity(d, s.createDataFrame([] if k == "empty" else [(1, 1, "x"), (3, 0, "x"), (None, None, None)], "doc_id long, toxic int, text string")),
    "repetition": lambda s, d, k: repetition.measure(d),
    "suffix_index": lambda s, d, k: suffix_index.repeated_spans(d),
    "simple8b": lambda s, d, k: simple8b.pack(d),
    "parity_join": lambda s, d, k: parity_join.jaccard_join(d),
    "mixture": lambda s, d, k: mixture.mix(d),
    "secrets": lambda s, d, k: secrets.secrets(d),
    "templates": lambda s, d, k: templates.leaks(d, bench(s, k)),
    "blocks": lambda s, d, k: blocks.label(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), "label", "block", "row")),
    "quotes": lambda s, d, k: quotes.threads(d.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", "rank", "key", "h")),
}
PER_ROW = {"toxicity", "repetition", "simple8b"}


@pytest.mark.parametrize("kind", ["empty", "small", "long"])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(spark, name, kind):
    got = OPERATORS[name](spark, frame(spark, kind), kind).collect()
    if kind == "empty":
        assert not got
    elif name in PER_ROW:
        assert len(got) == len(rows(kind))


def test_edge_values(spark):
    """What nulls, empty texts, repeats and extra columns give, operator by operator."""
    got = {name: sorted((tuple(r) for r in f(spark, frame(spark, "small"), "small").collect()), key=str) for name, f in OPERATORS.items() if name not in ("mixture", "toxicity")}
    assert got["parity_join"] == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0)]
    assert got["repetition"] == sorted([(d, n, c, c / max(n, 1), longest, keep) for d, n, c, longest, keep in [(1, 9, 0, 0, True)] * 2 + [(None, 9, 0, 0, True), (2, 0, 0, 0, True), (3, 0, 0, 0, True), (4, 0, 0, 0, True), (None, 0, 0, 0, True), (5, 60, 60, 58, False)]], key=str)
    assert got["suffix_index"] == [(5, 0, 60, 60, 58)]
    assert [(r[0], r[1] > 0) for r in got["simple8b"]] == [(1, True), (1, True), (2, False), (3, False), (4, True), (5, True), (None, False), (None, True)]
    assert all(r[1:] == (0, b"", []) for r in got["simple8b"] if r[0] in (2, 3))
    assert got["secrets"] == [] and got["templates"] == []
    assert [(r[0], r[1], r[4]) for r in got["blocks"]] == [(1, 0, True), (1, 0, True), (4, 0, True), (5, 0, True), (None, 0, True)]
    assert [(r[0], r[1], r[3], r[5]) for r in got["quotes"]] == [(1, 3, "one text of some words that stands here alone", None), (3, 0, "", None), (4, 0, "!!! ... \n\t", None), (5, 1, "ж中😀 é " * 30, None)]
    mixed = OPERATORS["mixture"](spark, frame(spark, "small"), "small").collect()
    assert len(mixed) == 8 and sorted(r["position"] for r in mixed) == list(range(8)) and {r["source"] for r in mixed} <= {"a", "b", "", None}
    scored = OPERATORS["toxicity"](spark, frame(spark, "small"), "small").collect()
    assert not any(r["toxic"] for r in scored) and len({r["score"] for r in scored if r["doc_id"] in (2, 3, 4)}) == 1


@pytest.mark.parametrize("kind", ["empty", "small", "long"])
def test_stages_keep_columns(spark, tmp_path, kind):
    bench(spark, kind).write.parquet(str(tmp_path / "benchmark.parquet"))
    d = frame(spark, kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns, name
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
    assert d.columns == ["doc_id", "n_ids", "words", "blocks"]
    assert (d.count() > 0) == (kind != "empty")


def test_pipeline_is_its_operators_in_turn(spark, tiny):
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, tiny).select("doc_id").collect()}
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    good = {r["doc_id"] for r in repetition.measure(docs).where("keep").collect()}
    docs = docs.where(F.col("doc_id").isin(*good))
    gone = {r["doc_id"] for r in parity_join.jaccard_join(docs).where("doc_id <> class_id").collect()}
    docs = docs.where(~F.col("doc_id").isin(*gone)) if gone else docs
    leaked = {r["doc_id"] for r in templates.leaks(docs, spark.read.parquet(f"{tiny}/benchmark.parquet")).collect()}
    docs = docs.where(~F.col("doc_id").isin(*leaked)) if leaked else docs
    assert got == {r["doc_id"] for r in mixture.mix(docs).collect()}


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_ids"]


@pytest.mark.parametrize("name", sorted(k for k, (_, q) in registry.QUERIES.items() if q))
def test_sql_agrees(spark, tiny, name):
    import duckdb

    f, sql = registry.QUERIES[name]
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tiny}/documents.parquet'")
    want = c.execute(sql).df()
    got = f(spark, tiny).toPandas()
    key = sorted(want.columns)
    assert sorted(got.columns) == key
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))
