"""The full-text engine: unit tables, end-to-end cases, metamorphic tests and storage."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import analysis as an
from textloom.functions import automata as au
from textloom.functions import bitsets, norms, scalars
from textloom.operators import search as se
from textloom.operators.explain import explain
from textloom.operators.index import build, cached, check, release
from textloom.plans.config import DOCS, KEYWORD, OFFSETS, POSITIONS, STORED, TEXT, FieldOptions, IndexConfig
from textloom.plans.parser import ParseError, Parser
from textloom.plans.query import MUST, MUST_NOT, SHOULD, Boolean, Pattern, Phrase, Term, must, should
from textloom.plans.similarity import PerField, Similarity
from textloom.sources.store import Conflict, Store, Tiers
from textloom.streaming.indexer import index_stream


def T(term, **more):
    return Term(field="text", term=term, **more)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def ranked(hits, k=100):
    return [(r["doc_id"], r["score"]) for r in se.top(hits, k).collect()]


# tables of scalars


def test_norm_bytes():
    assert [norms.decode(b) for b in range(4)] == pytest.approx([0, 5.820766e-10, 6.9849193e-10, 8.1490725e-10], rel=1e-6)
    for n, byte, value in [(1, 124, 1.0), (2, 121, 0.625), (3, 120, 0.5), (8, 117, 0.3125), (41, 112, 0.125), (656, 104, 0.03125), (65537, 91, 0.00341796875)]:
        assert norms.length_norm(n) == byte and norms.decode(byte) == value
    assert all(norms.encode(norms.decode(b)) == b for b in range(1, 255))
    assert norms.encode(0) == norms.encode(-3.0) == 0 and norms.encode(1e-20) == 1 and norms.encode(1e20) == 255


def test_norm_columns(spark):
    rows = spark.range(0, 3000).select("id", norms.norm_byte(F.col("id")).alias("b"), norms.boosted_byte(F.col("id"), F.lit(2.5)).alias("c")).collect()
    assert all(r["b"] == (norms.length_norm(r["id"]) if r["id"] else None) for r in rows)
    assert all(r["c"] == (norms.encode(np.float32(2.5) * np.float32(1 / np.sqrt(r["id"]))) if r["id"] else None) for r in rows)


def test_murmur3(spark):
    assert scalars.murmur3_bytes(bytes([98, 97, 114]), 1553420910) == 609023304
    assert scalars.murmur3_bytes(bytes([98, 97, 114]), 1553490497) == 818114846
    assert scalars.murmur3_bytes(bytes([231, 175, 135]), 223189302) == 1845636694
    got = spark.createDataFrame([("bar",), (None,)], "s string").select(scalars.murmur3(F.col("s"), 1553420910)).collect()
    assert [r[0] for r in got] == [609023304, None]


def test_scalars(spark):
    row = spark.createDataFrame([(-158146830731166066, 48, 36, "zz")], "a long, b long, c long, s string").select(
        scalars.bits_required(F.col("a")), scalars.gcd(F.col("b"), F.col("c")), scalars.base36(F.lit(1295)), scalars.from_base36(F.col("s")), scalars.unzigzag(scalars.zigzag(F.col("a"))), scalars.integer_log(F.lit(1000), 10)
    ).first()
    assert list(row) == [64, 12, "zz", 1295, -158146830731166066, 3]


def test_more_scalars(spark):
    one = lambda *c: list(spark.range(1).select(*c).first())
    assert [scalars.string_hash(x) for x in ("", "a", "ab")] == [0, 97, (97 * 16777619 + 98) % 2**32]
    words = ["", "a", "hello world", "é漢字😀"]
    got = spark.createDataFrame([(w,) for w in [*words, None]], "s string").select(scalars.rolling_hash(F.col("s")), scalars.murmur3(F.col("s"), 7)).collect()
    assert [r[0] for r in got] == [*map(scalars.string_hash, words), None]
    assert [r[1] for r in got] == [*(scalars.murmur3_bytes(w.encode(), 7) for w in words), None]
    assert one(*(scalars.trailing_zeros(F.lit(x)) for x in (0, 1, 8, -(2**63), -2))) == [64, 0, 3, 63, 1]
    assert one(*(scalars.integer_log(F.lit(x), 3) for x in (-5, 0, 1, 2, 3, 80, 81))) == [0, 0, 0, 0, 1, 3, 4]
    assert one(*(scalars.max_value(F.lit(b)) for b in (0, 1, 2, 63, 64))) == [0, 1, 3, 2**63 - 1, 2**63 - 1]
    assert one(scalars.packed_bytes(F.lit(3), F.lit(7)), scalars.packed_bytes(F.lit(2**31 - 1), F.lit(64)), scalars.packed_bytes(F.lit(13), F.lit(21), True)) == [3, 8 * (2**31 - 1), 40]
    f = F.lit("_0_Lucene41_0.doc".replace("Lucene", "Codec"))
    assert one(scalars.segment_name(f), scalars.strip_segment_name(f), scalars.strip_segment_name(F.lit("_0.fnm")), scalars.segment_name(F.lit("segments")), scalars.strip_segment_name(F.lit("segments"))) == ["_0", "_Codec41_0.doc", ".fnm", "segments", "segments"]
    assert one(*(scalars.file_generation(F.lit(x)) for x in ("_0.fnm", "_0_zz.del", "_0_codec_0.doc", "_0_1_codec_0.doc", "x_1.del"))) == [0, 1295, 0, 1, None]
    name = lambda g: scalars.generation_name(F.lit("segments"), F.lit(""), F.lit(g))
    assert one(name(-1), name(0), name(37), scalars.segment_file(F.lit("_1"), F.lit("x"), F.lit("doc"))) == ["", "segments", "segments_11", "_1_x.doc"]
    version = lambda v: scalars.version_number(F.lit(v))
    assert one(*map(version, ("4.10.1", "4.9", "4.0.0.1", "", "4", "4.x", "4.1.0.1", "4.0.0.3", "256.0"))) == [4 << 18 | 10 << 10 | 4, 4 << 18 | 9 << 10, 4 << 18 | 1, None, None, None, None, None, None]
    assert one(scalars.on_or_after(F.lit("4.10.1"), F.lit("4.9.0")), scalars.on_or_after(F.lit("4.0.0.1"), F.lit("4.0.1"))) == [True, False]
    units = lambda *u: scalars.valid_utf16(F.array(*map(F.lit, u)).cast("array<int>"))
    assert one(units(0x41), units(0xD800, 0xDC00), units(0xD800), units(0xDC00), units(0xD800, 0x41), units(0xD800, 0xD800, 0xDC00), units()) == [True, True, False, False, False, False, True]


def test_bit_sets(spark):
    of = lambda *n: bitsets.from_numbers(spark.createDataFrame([(x,) for x in n], "n long"), "n")
    numbers = lambda b: sorted(r["n"] for r in bitsets.to_numbers(b).collect())
    first = lambda df: df.first()["n"]
    s = of(0, 64, 64, None)
    assert first(bitsets.next_set(s, 0)) == 0 and first(bitsets.next_set(s, 1)) == 64 and first(bitsets.next_set(s, 65)) is None
    a, b = of(1, 63, 64, 1 << 40), of(63, 65, 1 << 40)
    assert numbers(bitsets.both(a, b)) == [63, 1 << 40] and numbers(bitsets.without(a, b)) == [1, 64] and numbers(bitsets.either(a, b)) == [1, 63, 64, 65, 1 << 40]
    assert first(bitsets.cardinality(a)) == 4 and first(bitsets.cardinality(of())) == 0
    with pytest.raises(Exception, match="negative"):
        numbers(of(-1))


def test_string_sets():
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 5))) for _ in range(60)]
    dfa = au.string_set(words)
    assert len(dfa.accepts) == len(au.Automaton(au.union(*map(au.literal, words))).minimal().accepts)
    for _ in range(500):
        s = "".join(rng.choice("abéx") for _ in range(rng.randint(0, 6)))
        assert dfa.run(s) == (s in words)
    assert not au.string_set([]).run("") and au.string_set([""]).run("")
    for text in ("ab|c*d", "a(b&~c)x", "[a-c]{2}z"):
        e = au.parse(text)
        both = au.Automaton(e), au.Automaton(au.reverse(e))
        for _ in range(200):
            s = "".join(rng.choice("abcdxz") for _ in range(rng.randint(0, 4)))
            assert both[0].run(s) == both[1].run(s[::-1])


def test_field_options_merge():
    a = FieldOptions(options=POSITIONS)
    assert a.merge(KEYWORD).omit_norms and a.merge(KEYWORD).options == DOCS
    assert a.merge(STORED) == FieldOptions(stored=True) == STORED.merge(a)
    with pytest.raises(ValueError):
        FieldOptions(kind="long").merge(FieldOptions(kind="text"))
    c = IndexConfig()
    assert [c.add("x", TEXT, 5), c.add("y", TEXT), c.add("z", TEXT, 5), c.add("x", KEYWORD)] == [5, 0, 1, 5]


# analysis


def test_tokenizer(spark):
    cases = {"can't a.b a:b foo_bar x9 1,234.5 foo-bar ___ Ünïcode": ["can't", "a.b", "a:b", "foo_bar", "x9", "1,234.5", "foo", "bar", "Ünïcode"], "漢字 ひら カタ 한국": ["漢", "字", "ひ", "ら", "カタ", "한국"], "ไทย ok": ["ไทย", "ok"], "": [], None: []}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select(an.raw_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == list(cases.values())
    assert [an.PLAIN.words(t) for t in cases if t] == [[w.lower() for w in v] for t, v in cases.items() if t]


def test_fast_pattern_is_the_full_one(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab9Z_.:,;'’· é-́\n") for _ in range(60)) for _ in range(300)]
    row = spark.createDataFrame([(t,) for t in texts], "t string").where(F.regexp_extract_all("t", F.lit(an.TOKEN), F.lit(0)) != F.regexp_extract_all("t", F.lit(an._FAST), F.lit(0)))
    assert row.count() == 0


def test_positions_keep_gaps(spark):
    row = frame(spark, ["The quick " + "x" * 256 + " fox"]).select(an.STANDARD.tokens(F.col("text"))).first()[0]
    assert [tuple(t) for t in row] == [("quick", 1), ("fox", 3)]


def test_offsets(spark):
    text = "One, two_2  three-four."
    for r in an.offsets(frame(spark, [text]), "doc_id", "text").collect():
        assert text[r["start"] : r["end"]] == r["raw"]


def test_offsets_are_kept_with_postings(spark, tmp_path):
    text = "The Fox saw a fox. It's the FOX!"
    options = {"text": FieldOptions(options=OFFSETS)}
    d = frame(spark, [text, None, "no match"])
    s = Store(spark, str(tmp_path / "ix"), options)
    s.add(d)
    s.commit()
    for index in (build(d, options), s.index(), cached(build(d, options))):
        row = index.postings.where("term = 'fox'").first()
        assert row["freq"] == 3 and row["positions"] == [1, 4, 7] and {text[a:b].lower() for a, b in row["offsets"]} == {"fox"}
        assert ranked(se.search(index, T("fox"))) == ranked(se.search(build(d, {"text": TEXT}), T("fox")))
    release(index)
    with pytest.raises(ValueError):
        build(d, {"text": FieldOptions(options=OFFSETS, tokenized=False)})


# search


def test_one_document(spark):
    index = build(frame(spark, ["bar"]), {"text": TEXT})
    assert ranked(se.search(index, T("bar"))) == [(0, pytest.approx(0.30685282, abs=1e-7))]
    assert ranked(se.search(index, T("bar", boost=-42.0))) == [(0, pytest.approx(-0.30685282, abs=1e-7))]
    e = explain(index, T("bar", boost=-42.0), 0)
    assert e.is_match() and float(e.value) == pytest.approx(-0.30685282, abs=1e-7)


def test_eight_hits_best_title(spark):
    rows = [(i, f"story {i}", "a bat in the night " + "word " * (i + 3)) for i in range(7)] + [(7, "Bat recycling", "bat bat bat"), (8, "none", "nothing here")]
    index = build(spark.createDataFrame(rows, "doc_id long, title string, content string"), {"content": TEXT, "title": TEXT})
    hits = se.search(index, Parser("content").parse("bat"))
    assert se.total_hits(hits).first()["total_hits"] == 8
    assert se.fetch(index, se.top(hits, 1), "title").first()["title"] == "Bat recycling"


def texts(seed=3, n=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice("ape bee cat dog eel fox gnu hen".split()) for _ in range(rng.randint(1, 12))) for _ in range(n)] + ["", None]


QUERIES = ["ape", "ape bee", "+ape -bee cat^2.5", "ape AND bee", "ape OR NOT bee", "(ape bee)^2 cat", '"ape bee"', "c*", "d?g", "ape~1", "[cat TO eel]", "/(ape|gnu)/ hen"]


@pytest.mark.parametrize("q", QUERIES)
def test_explanation_is_the_score_however_it_is_partitioned(spark, q):
    d = frame(spark, texts())
    query = Parser("text").parse(q)
    a = build(d, {"text": TEXT})
    got = ranked(se.search(a, query))
    assert got and got == ranked(se.search(build(d.repartition(5), {"text": TEXT}), query))
    assert got == sorted(got, key=lambda x: (-x[1], x[0]))
    for doc, score in got[:2]:
        assert float(explain(a, query, doc).value) == score
    missing = set(range(62)) - {x for x, _ in got}
    if missing:
        assert not explain(a, query, min(missing)).is_match()


def test_matches_are_those_of_sets(spark):
    d = texts()
    index = build(frame(spark, d), {"text": TEXT})
    have = lambda w: {i for i, t in enumerate(d) if t and w in t.split()}
    got = lambda q: {x for x, _ in ranked(se.search(index, q))}
    a, b, c = have("ape"), have("bee"), have("cat")
    assert got(should(T("ape"), T("bee"))) == a | b
    assert got(must(T("ape"), T("bee"))) == a & b
    assert got(Boolean(clauses=((MUST, T("ape")), (SHOULD, T("bee")), (MUST_NOT, T("cat"))))) == a - c
    assert got(should(T("ape"), T("bee"), T("cat"), min_should=2)) == (a & b) | (a & c) | (b & c)
    assert got(Phrase(field="text", terms=("ape", "bee"))) == {i for i, t in enumerate(d) if t and re.search(r"\bape bee\b", t)}
    assert got(Phrase(field="text", terms=("ape", "bee"), slop=1)) == {i for i, t in enumerate(d) if t and re.search(r"\bape (\w+ )?bee\b", t)}
    assert got(Boolean()) == got(Boolean(clauses=((MUST_NOT, T("ape")),))) == set()
    assert got(Boolean(clauses=((MUST, T("ape")), (MUST, T("nosuch"))))) == set()


def test_paging_and_search_after(spark):
    index = build(frame(spark, texts()), {"text": TEXT})
    hits = se.search(index, should(T("ape"), T("bee")))
    whole = ranked(hits)
    assert [(r["doc_id"], r["score"]) for r in se.page(hits, 3, 4).orderBy("rank").collect()] == whole[3:7]
    after = [(r["doc_id"], r["score"]) for r in se.top(hits, 4, (whole[2][1], whole[2][0])).collect()]
    assert after == whole[3:7]
    assert se.page(hits, -1, 4).count() == 0


def test_batch_is_the_loop_of_single_queries(spark):
    index = build(frame(spark, texts()), {"text": TEXT})
    queries = {"x": ["bee", "ape", "cat"], "y": ["cat"], "z": ["nosuch", "dog", "dog"], "w": "hen ape fox eel gnu bee dog".split()}
    rows = spark.createDataFrame([(q, t, k) for q, ts in queries.items() for k, t in enumerate(ts)], "query_id string, term string, clause int")
    got = {}
    for r in se.search_batch(index, rows, "text", 5).collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for q, ts in queries.items():
        want = ranked(se.search(index, should(*map(T, ts))), 5)
        assert sorted(got[q], key=lambda x: (-x[1], x[0])) == want


class Flat(Similarity):
    def tf(self, freq):
        return F.lit(1.0).cast("float")


def test_explanation_under_another_similarity(spark):
    index = build(frame(spark, texts()), {"text": TEXT})
    q = Boolean(clauses=((SHOULD, T("ape")), (SHOULD, T("bee", boost=2.0)), (MUST_NOT, T("cat"))))
    sim = PerField({"text": Flat()})
    got = ranked(se.search(index, q, sim))
    for doc, score in got[:3]:
        assert float(explain(index, q, doc, sim).value) == score
    e = explain(index, T("ape"), ranked(se.search(index, T("ape")))[0][0])
    shown = e.shown()
    assert "(MATCH)" in shown and "docFreq=" in shown and "termFreq=" in shown and "maxDocs=62" in shown
    assert "(NON_MATCH)" in explain(index, T("nosuch"), 0).shown()
    batch = se.search_batch(index, spark.createDataFrame([("x", "ape"), ("x", "bee")], "query_id string, term string"), "text", 5, sim)
    assert {(r["doc_id"], r["score"]) for r in batch.collect()} == set(ranked(se.search(index, should(T("ape"), T("bee")), sim), 5))


def test_patterns_go_through_the_terms(spark, tmp_path):
    d = frame(spark, texts())
    s = Store(spark, str(tmp_path / "ix"), {"text": TEXT})
    s.add(d)
    s.commit()
    a, b = build(d, {"text": TEXT}), s.index()
    for text in ("c*", "d?g", "ape~1", "[cat TO eel]", "/(ape|gnu)/", "/a(~(.*x.*)&.+)/"):
        q = Parser("text").parse(text)
        assert ranked(se.search(a, q)) == ranked(se.search(b, q)) != []


def test_queries_are_analysed_as_the_index_is(spark):
    long = an.Analyzer(keep=lambda t: F.char_length(t) >= 4)
    assert long.words("the big Apes eat figs") == ["apes", "figs"]
    commas = an.Analyzer(raw=lambda c: F.split(c, ","), stop=())
    assert commas.words("A b,c") == ["a b", "c"]


def test_scores_are_numbers(spark):
    hits = spark.createDataFrame([(1, float("nan"))], "doc_id long, score float")
    with pytest.raises(Exception, match="no number"):
        se.top(hits, 5).collect()
    index = build(frame(spark, texts()), {"text": TEXT})
    got = se.collect(index, T("ape"), lambda h: h.agg(F.avg("score").alias("mean"), F.count("*").alias("n"))).first()
    assert got["n"] == len(ranked(se.search(index, T("ape"))))


# parser


def test_parser_trees():
    p = Parser("f")
    for text, shown in {"a b": "f:b", "word": "f:word", "x AND y": "+f:x +f:y", "x OR y": "f:x f:y", "x NOT y": "f:x -f:y", "+x -y z": "+f:x -f:y f:z", "g:x^2": "g:x^2.0", "(x y)^3 z": "(f:x f:y)^3.0 f:z", '"big fox"~2': 'f:"big fox"~2', "pre*": "f:pre*", "w?ld": "f:w?ld", "fuz~1": "f:fuz~1", "[b TO c]": "f:[b TO c]", "Can't": "f:can't", "x\\:y": "f:x:y", "\\u0041bc": "f:abc", "x　y": "f:x f:y", "Note Or": "f:note"}.items():
        assert str(p.parse(text)) == shown, text
    assert p.parse("") == p.parse("the and of".replace("and", "a")) == Boolean()
    assert str(Parser("f", and_default=True).parse("x y OR z")) == "+f:x f:y f:z"
    for bad in ("(x", "x AND", "x^", "x\\", "field:", "x)"):
        with pytest.raises(ParseError):
            p.parse(bad)
    with pytest.raises(ValueError):
        Boolean(clauses=tuple((SHOULD, T("x")) for _ in range(1025)))


def test_rewrite():
    one = Boolean(clauses=((SHOULD, T("x", boost=2.0)),), boost=3.0)
    assert one.rewrite() == T("x", boost=6.0)


# regular languages


@pytest.mark.parametrize("text,python", [("a(b|c)*d?", "a(b|c)*d?"), ("[a-c]{2,3}x+", "[a-c]{2,3}x+"), ("<8-11>", "8|9|10|11"), ('"a.b"@', r"a\.b[\s\S]*"), ("[^ab]c", "[^ab]c"), ("()", "")])
def test_languages_are_those_of_re(text, python):
    rng = random.Random(2)
    dfa = au.Automaton(au.parse(text))
    small = dfa.minimal()
    for _ in range(600):
        s = "".join(rng.choice("abcdx.189") for _ in range(rng.randint(0, 6)))
        assert dfa.run(s) == small.run(s) == bool(re.fullmatch(python, s)), s


def test_random_languages_keep_their_laws():
    rng = random.Random(7)

    def make(depth):
        if depth == 0:
            return au.chars((ord(rng.choice("ab")),) * 2) if rng.random() < 0.9 else au.EPS
        return rng.choice([lambda: au.cat(make(depth - 1), make(depth - 1)), lambda: au.union(make(depth - 1), make(depth - 1)), lambda: au.star(make(depth - 1)), lambda: au.intersection(make(depth - 1), au.complement(make(depth - 1)))])()

    for _ in range(60):
        a, b = make(3), make(3)
        assert au.same(au.complement(au.union(a, b)), au.intersection(au.complement(a), au.complement(b)))
        assert au.subset(au.intersection(a, b), a) and au.subset(a, au.union(a, b))
        d = au.Automaton(a)
        small = d.minimal()
        assert len(small.accepts) <= len(d.accepts)
        for _ in range(30):
            s = "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
            assert d.run(s) == small.run(s)


def test_matchers_on_columns(spark):
    words = spark.createDataFrame([(w,) for w in ("hat", "hater", "her", "heather", "x", "a\n", None)], "w string")
    got = lambda t: [r[0] for r in words.where(au.matcher(t)(F.col("w"))).collect()]
    assert got("h.*&.*er") == ["hater", "her", "heather"]
    assert got("h(~(.*th.*)&@)") == ["hat", "hater", "her"]
    assert got("~(h@)") == ["x", "a\n"] and got("#") == [] and got("a") == []


# storage


def test_generations(spark, tmp_path):
    d = frame(spark, texts())
    s = Store(spark, str(tmp_path / "ix"), {"text": TEXT})
    assert not s.exists()
    s.add(d.where("doc_id < 30"))
    assert s.commit() == 1 and s.commit() == 1
    s.add(d.where("doc_id >= 30"))
    assert s.commit() == 2
    q = should(T("ape"), T("bee"))
    whole = ranked(se.search(build(d, {"text": TEXT}), q))
    assert ranked(se.search(s.index(), q)) == whole
    assert {x for x, _ in ranked(se.search(s.index(1), q))} == {x for x, _ in whole if x < 30}
    s.delete_by_term("text", "cat")
    gone = {i for i, t in enumerate(texts()) if t and "cat" in t.split()}
    assert {x for x, _ in ranked(se.search(s.index(), q))} == {x for x, _ in whole} - gone
    s.rollback()
    assert ranked(se.search(s.index(), q)) == whole
    s.delete_by_query(T("cat"))
    s.commit()
    assert [x for x in ranked(se.search(s.index(), q))] == [x for x in whole if x[0] not in gone]  # statistics count deleted documents
    s.compact(force=True)
    s.commit()
    left = frame(spark, texts()).where(~F.col("doc_id").isin(*gone))
    assert ranked(se.search(s.index(), q)) == ranked(se.search(build(left, {"text": TEXT}), q))
    assert all(r["bad"] == 0 for r in check(s.index()).collect())
    assert [r["generation"] for r in s.commits().collect()] == [1, 2, 3, 4]
    s.vacuum(keep=1)
    assert s.generations() == [4] and ranked(se.search(s.index(4), q))


def test_update_and_conflict(spark, tmp_path):
    path = str(tmp_path / "ix")
    a = Store(spark, path, {"text": TEXT})
    a.add(frame(spark, ["ape", "bee", None]))
    a.commit()
    b = Store(spark, path, {"text": TEXT}, mode="append")
    a.update(spark.createDataFrame([(1, "cow")], "doc_id long, text string"))
    a.commit()
    assert not b.is_current()
    b.delete_by_term("text", "ape")
    with pytest.raises(Conflict):
        b.commit()
    b = Store(spark, path, {"text": TEXT})
    assert [ranked(se.search(b.index(), T(t))) != [] for t in ("ape", "bee", "cow")] == [True, False, True]
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none"), {"text": TEXT}, mode="append")
    with pytest.raises(RuntimeError), Store(spark, path, {"text": TEXT}) as c:
        c.add(frame(spark, ["zebra"]))
        raise RuntimeError
    assert Store(spark, path, {"text": TEXT}).state["generation"] == 2


def test_stream_is_the_batch(spark, tmp_path):
    d = frame(spark, texts())
    d.repartition(3).write.parquet(str(tmp_path / "src"))
    s = Store(spark, str(tmp_path / "ix"), {"text": TEXT})
    stream = lambda: spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    index_stream(stream(), s, str(tmp_path / "cp"), upsert=False).awaitTermination()
    q = should(T("ape"), T("bee"))
    assert ranked(se.search(s.index(), q)) == ranked(se.search(build(d, {"text": TEXT}), q))
    before = s.state["generation"]
    index_stream(stream(), s, str(tmp_path / "cp"), upsert=False).awaitTermination()  # the stream goes on where it was
    assert s.state["generation"] == before
    more = spark.createDataFrame([(1000, "ape again"), (1001, "bee again")], "doc_id long, text string")
    more.coalesce(1).write.parquet(str(tmp_path / "more"))
    other = spark.readStream.schema(d.schema).parquet(str(tmp_path / "more"))
    index_stream(other, s, str(tmp_path / "cp2"), upsert=False).awaitTermination()  # another stream counts for itself
    assert {x for x, _ in ranked(se.search(s.index(), q))} >= {1000, 1001}
    assert s.index().docs.count() == d.count() + 2


def test_replayed_batches_are_not_indexed_twice(spark, tmp_path):
    import shutil

    d = frame(spark, texts())
    d.coalesce(1).write.parquet(str(tmp_path / "src"))
    s = Store(spark, str(tmp_path / "ix"), {"text": TEXT})
    run = lambda: index_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "src")), s, str(tmp_path / "cp"), upsert=False).awaitTermination()
    run()
    shutil.rmtree(tmp_path / "cp" / "commits")  # as if it had failed before it noted the batch
    run()
    assert s.index().docs.count() == d.count() and len(s.generations()) == 1


def test_upserts_keep_the_last_row_and_rejects_are_kept(spark, tmp_path):
    rows = [(1, "old ape", 1), (1, "new bee", 5), (1, "mid cat", 3), (2, "dog", 1), (None, "lost", 1), (3, "bad", -1)]
    src = spark.createDataFrame(rows, "doc_id long, text string, at int")
    src.coalesce(1).write.parquet(str(tmp_path / "src"))
    s = Store(spark, str(tmp_path / "ix"), {"text": TEXT})
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "src"))
    index_stream(stream, s, str(tmp_path / "cp"), order=F.col("at"), valid=F.col("at") >= 0, rejects=str(tmp_path / "rejects")).awaitTermination()
    assert {(r["doc_id"], r["text"]) for r in s.index().docs.collect()} == {(1, "new bee"), (2, "dog")}
    assert {r["text"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()} == {"lost", "bad"}


def test_tiers_choose_like_sizes():
    t = Tiers(per_tier=3, at_once=3, most=1000, floor=1)
    assert t.choose([(10, 0.0)] * 3) == [] and t.choose([]) == [] and t.choose([(10, 0.0)]) == []
    uneven = t.choose([(90, 0.0)] + [(10, 0.0)] * 8)
    assert len(uneven) == 3 and 0 not in uneven
    assert 9 not in t.choose([(10, 0.0)] * 9 + [(600, 0.0)]) != []  # too large to merge
    assert 1 in Tiers(per_tier=3, at_once=3, most=1000, floor=10).choose([(10, 0.0), (10, 0.9)] + [(10, 0.0)] * 7)


def test_merging_analyses_no_text_again(spark, tmp_path, monkeypatch):
    from textloom.operators import index as module

    s = Store(spark, str(tmp_path / "ix"), {"text": TEXT}, tiers=Tiers(per_tier=1, at_once=2, floor=1 << 20))
    built, real = [], module.build
    monkeypatch.setattr(module, "build", lambda *a, **k: built.append(1) or real(*a, **k))
    d = texts()
    for k in range(5):
        s.add(frame(spark, d).where(F.col("doc_id") % 5 == k))
        if k == 2:
            s.delete_by_term("text", "cat")
        s.compact()
    assert len(built) == 5 and len(s.state["segments"]) < 5
    s.compact(force=True)
    s.commit()
    assert len(built) == 5 and len(s.state["segments"]) == 1 and not s.state["deletes"]
    gone = {i for i, t in enumerate(d) if i % 5 <= 2 and t and "cat" in t.split()}
    want = build(frame(spark, d).where(~F.col("doc_id").isin(*gone)), {"text": TEXT})
    q = should(T("ape"), T("bee"))
    assert ranked(se.search(s.index(), q)) == ranked(se.search(want, q))
    assert all(r["bad"] == 0 for r in check(s.index()).collect())


def test_lock(spark, tmp_path, monkeypatch):
    from textloom.sources import store as module

    s = Store(spark, str(tmp_path / "ix"), {"text": TEXT})
    s.add(frame(spark, ["ape"]))
    with s._lock(), pytest.raises(Conflict):
        s.commit()
    assert s.commit() == 1 and not (tmp_path / "ix" / "write.lock").exists()
    (tmp_path / "ix" / "write.lock").touch()
    s.add(spark.createDataFrame([(7, "bee")], "doc_id long, text string"))
    with pytest.raises(Conflict):
        s.commit()
    monkeypatch.setattr(module, "STALE", 0)
    assert s.commit() == 2
    again = Store(spark, str(tmp_path / "ix"), {"text": FieldOptions(options=DOCS), "more": KEYWORD})
    assert again.fields["text"].options == DOCS and set(again.fields) == {"text", "more"}


def test_empty_tables(spark):
    index = build(frame(spark, []), {"text": TEXT})
    assert ranked(se.search(index, should(T("a"), T("b")))) == []
    assert index.field_stats().count() == 0


# analysis in batches


def test_batches_give_the_tokens_of_the_columns(spark):
    rng = random.Random(5)
    alphabets = ["ab9Z_.:,;'’· é-́\n", "aΣσİ.:' 1,", "漢字ひらカ〇⺀ไทย๑๒.,:'1a _", "".join(map(chr, range(1, 0x600)))]
    rows = ["".join(rng.choice(alphabets[k % 4]) for _ in range(rng.randint(0, 90))) for k in range(400)] + ["", None, "x" * 300 + " " + "y" * 255 + " the of", "İ" * 127 + " " + "İ" * 128]
    d = frame(spark, rows).repartition(3)
    for analyzer in (an.STANDARD, an.Analyzer(lower=False, stop=()), an.Analyzer(keep=lambda t: F.char_length(t) > 3, max_length=None)):
        want = {(r[0], *r[1]) for r in d.select("doc_id", F.explode(analyzer.tokens(F.col("text")))).collect()}
        assert {(r["doc_id"], r["term"], r["pos"]) for r in an.token_rows(d, "doc_id", "text", analyzer).collect()} == want
        index = build(d, {"text": TEXT}, analyzer=analyzer)
        assert {(r["doc_id"], r["term"], p) for r in index.postings.collect() for p in r["positions"]} == want
        assert sum(r["length"] for r in index.norms.collect()) == len(want)
    for r in an.offsets(d, "doc_id", "text").collect():
        assert rows[r["doc_id"]][r["start"] : r["end"]] == r["raw"]


def test_documents_are_inverted_where_they_are_read(spark):
    d = frame(spark, texts())
    for options in (TEXT, FieldOptions(options=OFFSETS), FieldOptions(omit_norms=True), KEYWORD):
        assert "Exchange" not in build(d, {"text": options}).postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in an.offsets(d, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()


def test_writing_runs_a_plan_once_and_moves_no_postings(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    s = Store(spark, str(tmp_path / "ix"), {"text": TEXT})
    s.add(frame(spark, texts()).repartition(3).withColumn("text", count("text")))
    assert seen.value == len(texts())
    whole = ranked(se.search(s.index(), T("ape")))
    # postings of a document stay in the file of the task that read it
    per_doc = s.index().postings.select("doc_id", F.input_file_name().alias("f")).groupBy("doc_id").agg(F.countDistinct("f").alias("files"))
    assert per_doc.where("files > 1").count() == 0 and per_doc.count() > 50
    s.update(frame(spark, texts()).where("doc_id < 9").withColumn("text", count(F.lit("ape"))))
    assert seen.value == len(texts()) + 9
    s.commit()
    assert {x for x, _ in ranked(se.search(s.index(), T("ape")))} == {x for x, _ in whole} | set(range(9))
    assert s.index().docs.count() == len(texts())
    s.update(frame(spark, []))
    assert len(s.state["segments"]) == 2


def test_latest_row_of_a_batch_moves_once(spark):
    from textloom.streaming.indexer import latest

    d = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", None), (2, "e", 0), (3, "f", 0), (3, "f", 0)], "doc_id long, text string, at int")
    got = latest(d, "doc_id", F.col("at"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "b"), (2, "e"), (3, "f")] and got.columns == d.columns
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
