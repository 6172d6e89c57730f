"""Each operator against a brute-force version, an exact round trip or planted cases."""

import base64
import hashlib
import itertools
import json
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import blocks, mixture, parity_join, quotes, repetition, secrets, simple8b, suffix_index, templates, toxicity
from textloom.llm import words as wd
from textloom.llm.shared import Tables, groups

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ba", "do", "fi", "gu", "sa", "ta")]


def text(rng, n, alphabet=WORDS):
    return " ".join(rng.choice(alphabet) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain_words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


# 1


def test_viterbi_is_least_cost_of_all_paths():
    rng = np.random.default_rng(3)
    cost = rng.random((toxicity.SYMBOLS,) * 4).astype(np.float32) * 3

    def of(path):
        state, total = (0, 0, 0), 0.0
        for s, _, own in path:
            total += own
            if not (s < 0 or (s == 0 and state[2] == 0)):
                total += float(cost[(*state, s)])
                state = (*state[1:], s)
        return total + (float(cost[(*state, 0)]) if state[2] else 0.0)

    for span in ("1d10t", "i d i o t", "5ttup1dd", "looo0ser", "@$$", "a.1.b", "é1é"):
        paths = list(itertools.product(*toxicity.lattice(span)))
        least = min(map(of, paths))
        got = toxicity.viterbi(span, cost)
        assert any(abs(of(p) - least) < 1e-4 and "".join(x for _, x, _ in p) == got for p in paths), span


def test_noisy_finds_what_has_several_readings():
    def found(t):
        data, off = wd.buffers(pa.array([t.lower()]))
        return [t.lower().encode()[a:b].decode() for a, b in zip(*toxicity.noisy(data, off))]

    assert found("you 1d10t and i d i o t or s.c.u.m, looser stuuupid $cum!") == ["1d10t", "i d i o t", "s.c.u.m", "stuuupid", "$cum"]
    assert found("plain words, 2024 and 3.5 too!!! what%%% a *** the$$$") == []
    assert found("") == []


def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(60)]
        if bad:
            words[10], words[30] = "moron", rng.choice(["scumbag", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, text(rng, 30) + " m0r0n " + text(rng, 20)), (1001, text(rng, 30) + " m o r o n " + text(rng, 20)), (1002, text(rng, 30) + " moooorrron " + text(rng, 20)), (1003, text(rng, 60)), (1004, None), (1005, ""), (None, "a moron"), (1003, text(rng, 60))]
    return docs(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity_restores_before_it_scores(spark):
    d, labels = labelled(spark)
    got = [(r["doc_id"], r["toxic"]) for r in toxicity.toxicity(d, labels).collect()]
    flagged = {i for i, t in got if t}
    assert len(got) == d.count()
    assert {1000, 1001, 1002, None} <= flagged
    assert flagged - {1000, 1001, 1002, None} == {i for i in range(160) if i % 4 == 0}


HIDDEN = ["!diot", "idi0+", "|oser", "m  o  r  o  n", "m - o - r - o - n", "m\no\nr\no\nn", "m o ron", "l oo se r", "+rash!!", "sh!+"]


def test_edge_signs_and_loose_spacing_are_restored(spark):
    rng = random.Random(6)
    plain = ["idiot", "loser", "moron", "trash", "shit"]
    d = docs(spark, [(i, text(rng, 40, WORDS + plain)) for i in range(200)])
    cost = toxicity.language_model(d)
    whole = [set(plain) & set(toxicity.viterbi(x, cost).split()) or set(re.findall("[a-z]+", toxicity.viterbi(x, cost))) & set(plain) for x in HIDDEN]
    assert all(whole), [x for x, got in zip(HIDDEN, whole) if not got]
    t = pa.array([f"kaba lofi {x} rusa neta" for x in HIDDEN] + ["kaba lofi! rusa|", "moron!!! idiot+"])
    data, off = wd.buffers(t)
    start, end = toxicity.noisy(data, off, wide=True)
    found = [t.to_pylist()[k].encode()[a - off[k] : b - off[k]].decode() for k, a, b in zip(np.searchsorted(off, start, side="right") - 1, start, end)]
    assert set(HIDDEN) <= set(found)
    *_, changed = toxicity.restore(t, cost)
    assert changed[: len(HIDDEN)].min() >= 1 and changed[len(HIDDEN) :].tolist() == [0, 0]


def test_only_similar_labelled_documents_are_copies():
    rng = np.random.default_rng(8)
    size, words = toxicity.SKETCH, [[1, 2], [1, 3], [1, 4], [1, 5], [9], [9, 8]]
    least = [rng.integers(0, 1 << 60, size).tolist() for _ in words]
    for i in range(3):  # a chain of shared passages
        least[i + 1][i] = least[i][i]
    least[5] = least[4][: size * 3 // 4] + least[5][size * 3 // 4 :]
    rows = [(1, w, m) for w, m in zip(words, least)] + [(0, [7], rng.integers(0, 1 << 60, size).tolist()) for _ in range(60)]
    signs, weight, prior = toxicity.lexicon(rows)
    assert signs.tolist() == [1] and prior == pytest.approx(np.log(6 / 61))
    assert weight[0] == pytest.approx(np.log(4.5 / 6) - np.log(0.5 / 61))


def test_language_model_is_a_distribution(spark):
    d, _ = labelled(spark)
    cost = toxicity.language_model(d)
    assert np.allclose(np.exp(-cost.astype(np.float64)).sum(-1), 1, atol=1e-4)


# 2


def brute_repeats(words, least):
    n = len(words)
    inside, longest = [False] * n, 0
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                if k >= least:
                    longest = max(longest, k)
                    inside[i : i + k] = [True] * k
    return sum(inside), longest


@pytest.mark.parametrize("seed", range(12))
def test_repetition_is_brute_force(seed):
    rng = random.Random(seed)
    texts = [text(rng, rng.randint(0, 70), WORDS[: rng.choice([2, 4, 30])]) for _ in range(8)]
    texts.append((text(rng, 9) + " ") * 3)
    w = wd.scan(pa.array(texts))
    covered, longest = repetition.repeats(w, 4)
    for k, t in enumerate(texts):
        assert (covered[k], longest[k]) == brute_repeats(t.split(), 4), t


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    ids = np.array([rng.randint(0, 3) for _ in range(200)])
    end = np.full(200, 200)
    sa = repetition.suffix_array(ids, end)
    assert sa.tolist() == sorted(range(200), key=lambda i: ids[i:].tolist())


def test_quality_keeps_clean_documents(spark):
    rng = random.Random(2)
    rows = [(0, text(rng, 300, [f"w{i}" for i in range(2000)])), (1, "buy cheap pills now from our great web shop " * 20), (2, None), (3, ""), (None, "x")]
    assert [r["doc_id"] for r in repetition.keep_unrepetitive(docs(spark, rows)).collect()] == [0, 2, 3, None]


# 3


def test_quotes_link_and_order(spark):
    one, two = "The first message says a thing. It goes on for a while.", "I do not agree with that at all. Here is my reason for it."
    rows = [
        (1, 0, "user", one),
        (1, 1, "user", f"On Monday Ann wrote:\n> {one}\n\n{two}"),
        (1, 2, "user", f"> {one}\nA second answer to the first message."),
        (1, 3, "user", f">> {one}\n> {two}\nI answer the answer."),
        (1, 4, "user", "No quote here."),
        (2, 0, "user", None),
        (None, 0, "user", "x"),
        (1, 0, "user", one),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.threads(d).collect()}
    assert len(got) == 6
    assert got[1, 1]["text"] == two and got[1, 1]["reply_to"] == 0 and got[1, 1]["linked"]
    assert got[1, 2]["reply_to"] == 0
    assert got[1, 3]["reply_to"] == 1 and got[1, 3]["levels"] == 2 and got[1, 3]["depth"] == 2 and got[1, 3]["text"] == "I answer the answer."
    assert got[1, 4]["reply_to"] == 3 and not got[1, 4]["linked"]
    order = sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["position"])
    assert [t for _, t in order] == [0, 1, 3, 4, 2]


def discussion(rng, conv):
    """Random replies that quote: nested, trimmed, with and without a line of introduction. Gives rows and the parents."""
    said, shown, rows, parents = [], [], [], {}
    for turn in range(rng.randint(2, 14)):
        own = [f"{text(rng, rng.randint(4, 9), WORDS).capitalize()} {conv} {turn} {k}." for k in range(rng.randint(1, 4))]
        parent = rng.choice([None, *range(turn)]) if turn else None
        quote = []
        if parent is not None:
            old = [f"> {x}" for x in shown[parent]] if rng.random() < 0.6 else []
            picked = sorted(rng.sample(range(len(said[parent])), rng.randint(1, len(said[parent]))))  # trimmed
            quote = [f">{x}" if x.startswith(">") else f"> {x}" for x in (y[2:] for y in old)] + [f"> {said[parent][i]}" for i in picked]
            if rng.random() < 0.5:
                quote = [f"On Monday {rng.choice(WORDS)} wrote:", *quote]
        parents[turn] = parent
        said.append(own)
        shown.append([x for x in quote if x.startswith(">")] + own)
        lines = [*own, *quote] if rng.random() < 0.3 else [*quote, *own]
        rows.append((conv, turn, "user", "\n".join(lines)))
    return rows, parents, {k: "\n".join(v) for k, v in enumerate(said)}


def brute_threads(rows):
    """Line by line: what each message says, and which earlier one most of its outermost linked quotes come from."""
    said, quoted, out = {}, {}, {}
    norm = lambda s: tuple(re.findall(r"\w+", s.lower()))
    for _, turn, _, t in rows:
        own, quotes_, lines = [], [], (t or "").split("\n")
        for i, line in enumerate(lines):
            level, rest = 0, line
            while re.match(r"[ \t]{0,3}>", rest):
                rest = re.sub(r"^[ \t]{0,3}>[ \t]?", "", rest, count=1)
                level += 1
            if level:
                quotes_.append((level, rest))
            elif not (re.search(r"wrote:$", line) and i + 1 < len(lines) and lines[i + 1].startswith(">")):
                own.append(line)
        said[turn], quoted[turn] = {norm(x) for x in own if len(norm(x)) >= quotes.MIN_WORDS}, quotes_
        votes = Counter((v, e) for v, q in quotes_ for e in said if e < turn and norm(q) in said[e])
        best = min(votes, key=lambda k: (k[0], -votes[k], -k[1]), default=None)
        before = max((e for e in said if e < turn), default=None)
        out[turn] = (best[1] if best else before, best is not None, "\n".join(own), max((v for v, _ in quotes_), default=0))
    kids = defaultdict(list)
    for turn, r in out.items():
        kids[r[0]].append(turn)
    order = []

    def walk(turn, depth):
        order.append((turn, depth))
        for k in kids[turn]:
            walk(k, depth + 1)

    for k in kids[None]:
        walk(k, 0)
    place = {turn: (d, p) for p, (turn, d) in enumerate(order)}
    return {turn: (*r, *place[turn]) for turn, r in out.items()}


def test_threads_are_brute_force(spark):
    rng = random.Random(21)
    rows, want, linked = [], {}, 0
    for conv in range(60):
        own, parents, said = discussion(rng, conv)
        rows += own
        brute = brute_threads(own)
        want |= {(conv, turn): r for turn, r in brute.items()}
        for turn, parent in parents.items():
            assert brute[turn][2] == said[turn]
            if parent is not None:
                linked += 1
                assert brute[turn][:2] == (parent, True)
    assert linked > 150 and max(r[3] for r in want.values()) >= 3
    for longest in (quotes.LONGEST, 5):  # all in tasks; long ones by joins
        got = quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), longest=longest).collect()
        assert {(r["conv_id"], r["turn"]): (r["reply_to"], r["linked"], r["text"], r["levels"], r["depth"], r["position"]) for r in got} == want


def test_long_messages_take_linear_time():
    for t in ("> a b c\n" * 50_000, "x wrote:\n" * 50_000, ">" * 200_000, "a b c. " * 50_000, "\n" * 200_000, "> \n\n" * 50_000):
        began = time.process_time()
        quotes.parse(t)
        assert time.process_time() - began < 2
    assert quotes.levels(">>> > x")[0] == (4, "x") and quotes.levels("     > x")[0][0] == 0


# 4


def brute_spans(texts, least):
    where = defaultdict(list)
    for d in sorted(texts):
        w = plain_words(texts[d])
        for s in range(len(w) - least + 1):
            where[tuple(w[s : s + least])].append((d, s))
    hits = sorted((d, s, k > 0) for v in where.values() if len(v) > 1 for k, (d, s) in enumerate(v))
    out = []
    for d, own in itertools.groupby(hits, key=lambda x: x[0]):
        spans = []
        for _, s, later in own:
            if not spans or s > spans[-1][1]:
                spans.append([s, s + least, set()])
            spans[-1][1] = s + least
            if later:
                spans[-1][2].update(range(s, s + least))
        out += [(d, a, b, b - a, len(x)) for a, b, x in spans]
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_suffix_index_is_brute_force(spark, batches):
    rng = random.Random(8)
    shared = [text(rng, n) for n in (25, 40, 12)]
    texts = {i: " ".join([text(rng, rng.randint(0, 30)), rng.choice(shared), text(rng, rng.randint(0, 30)), rng.choice(shared)]) for i in range(24)}
    texts[24] = texts[3]
    texts[25] = "ka " * 60
    rows = [*texts.items(), (3, texts[3]), (50, None), (51, ""), (None, texts[3])]
    got = suffix_index.repeated_spans(docs(spark, rows), batches=batches, min_words=20, prefix=8).collect()
    assert sorted(map(tuple, got)) == brute_spans(texts, 20)


def test_levels_merge_geometrically(spark, tmp_path):
    """The family is opened anew for each batch; its levels' sizes count up in binary, and its order is that of the words' symbols."""
    rng = random.Random(8)
    tables, sizes, texts = Tables(spark, "test"), [], []
    for k in range(5):
        family = suffix_index.IndexFamily(spark, str(tmp_path / "family"), 20, 8, buckets=3)
        texts.append(text(rng, 80) + " " + texts[0][:200] if k == 3 else text(rng, 80))
        hits = family.add(docs(spark, [(k, texts[-1]), (k, texts[-1])]), tables)
        assert {r["doc_id"] for r in hits.collect()} == ({0, 3} if k == 3 else set())
        sizes.append(sorted(family.levels))
    assert sizes == [[1], [2], [1, 2], [4], [1, 4]]
    import pyarrow.parquet as pq

    rows = 0
    for f in (tmp_path / "family" / family.levels[4]).glob("part-*.parquet"):
        keys = list(zip(*(pq.read_table(f).column(c).to_pylist() for c in ("p0", "p1", "p2", "doc_id", "pos"))))
        assert keys == sorted(keys)
        rows += len(keys)
    assert rows == sum(len(suffix_index.suffixes(wd.scan(pa.array([t])), 20, 8)[0]) for t in texts[:4])


def test_only_new_batches_are_shuffled(spark, tmp_path):
    """Merges and scans have no exchange but for the keys' partial counts: bucketed tables meet bucket by bucket."""
    rng = random.Random(9)
    family = suffix_index.IndexFamily(spark, str(tmp_path / "family"), 20, 8, buckets=3)
    family.add(docs(spark, [(1, text(rng, 200))]), Tables(spark, "a"))
    made = []
    old = family._level(family.levels[1], made)
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (old.distinct(), old.join(old.groupBy(*suffix_index.NAMES).count(), suffix_index.NAMES, "left_semi")):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
        for x in made:
            spark.sql(f"drop table {x}")


# 5


@pytest.mark.parametrize("seed", range(6))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    lens = rng.integers(0, 3000, 6)
    lens[0] = 0
    high = [2, 300, 70_000, 1 << 40, (1 << 62) - 1, 1 << 20][seed]
    ids = rng.integers(0, high, lens.sum())
    if seed == 4:
        ids[::7] = -1
    off = np.concatenate([[0], np.cumsum(lens)])
    packed, first, before = simple8b.encode(ids, off, 100)
    at = np.r_[first, len(packed)][before]
    for k in range(6):
        own = first[before[k] : before[k + 1]] - at[k]
        assert (simple8b.decode(packed[at[k] : at[k + 1]], own, int(lens[k]), 100) == ids[off[k] : off[k + 1]]).all()


def test_pack_gives_the_tokenizers_ids(spark, tiny):
    enc = simple8b.encoding(open(simple8b.TOKENIZER, "rb").read())
    d = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    long = docs(spark, [(900_001, "word and more " * 30_000), (900_002, None), (900_003, ""), (None, "x y")])
    texts = {r[0]: r[1] for r in d.unionByName(long).collect()}
    for r in simple8b.pack(d.unionByName(long)).collect():
        want = enc.encode(texts[r["doc_id"]] or "", disallowed_special=())
        assert r["n_ids"] == len(want) and simple8b.decode(bytes(r["words"]), r["blocks"], r["n_ids"]).tolist() == want


def test_unpack_gives_the_ids_back(spark):
    enc = simple8b.encoding(open(simple8b.TOKENIZER, "rb").read())
    rows = [(1, "some words and more"), (2, None), (3, ""), (None, "x y"), (4, "word " * 3000)]
    got = simple8b.unpack(simple8b.pack(docs(spark, rows), block=128), block=128).collect()
    assert [(r["doc_id"], list(r["ids"])) for r in got] == [(d, enc.encode(t or "")) for d, t in rows]


# 6


def shingles(t):
    w = plain_words(t)
    return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])


def classes_of(texts, threshold=parity_join.THRESHOLD):
    """Brute force: doc_id to (class_id, n_links)."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root, links = {d: d for d in texts}, Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 10 * len(x & y) >= 10 * threshold * len(x | y) - 1e-6:
            links[a] += 1
            links[b] += 1
            r, s = sorted((top(a), top(b)))
            root[s] = r
    return {d: (top(d), links[d]) for d in texts}


def families(rng, vocab, number=60):
    texts = {}
    for _ in range(number):
        base = text(rng, rng.choice([1, 2, 3, 5, 12, 40, 150, 700]), vocab).split()
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts[len(texts)] = " ".join(w)
    return texts


def found_classes(spark, rows):
    got = parity_join.jaccard_join(docs(spark, rows)).collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got}


@pytest.mark.parametrize("seed", [4, 5])
def test_parity_join_is_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = families(rng, [f"w{i}" for i in range([3000, 40][seed - 4])])
    texts |= {9000: None, 9001: "...", 9002: ""}
    want = classes_of(texts)
    rows = [*texts.items(), (5, texts[5]), (None, texts[5])]
    assert found_classes(spark, rows) == want
    kept = [r["doc_id"] for r in parity_join.one_of_each(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([*(d for d in texts if want[d][0] == d), None, *([5] if want[5][0] == 5 else [])], key=str)


def test_pairs_of_common_bits_are_found(spark):
    """Pairs at the threshold, each shared n-gram of which stands in unrelated documents too; a chain; a star of many."""
    rng = random.Random(14)
    vocab = [f"v{i}" for i in range(5000)]
    texts = {}
    for k in range(20):
        w = rng.sample(vocab, 12)
        texts[1000 - 2 * k], texts[1001 - 2 * k] = " ".join(w[:10]), " ".join([*w[:8], *w[10:]])
        for i in range(6):
            for _ in range(4):
                texts[len(texts) + 2000] = " ".join([*rng.sample(vocab, rng.randint(3, 8)), *w[i : i + 3], *rng.sample(vocab, rng.randint(3, 8))])
    chain = rng.sample(vocab, 900)
    for k in range(200):
        texts[6000 + k * 7 % 200] = " ".join(chain[4 * k : 4 * k + 40])
    base = rng.sample(vocab, 60)
    for k in range(80):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(60)] = rng.choice(vocab)
        texts[8000 + k] = " ".join(w)
    want = classes_of(texts)
    assert sum(want[1000 - 2 * k] == (1000 - 2 * k, 1) for k in range(20)) == 20
    assert found_classes(spark, list(texts.items())) == want


def test_long_runs_and_pieces_lose_nothing(spark, monkeypatch):
    rng = random.Random(15)
    texts = families(rng, [f"w{i}" for i in range(25)], 30)
    want = classes_of(texts)
    for name, value in (("SHORT", 2), ("BLOCK", 8), ("MEMBERS", 3), ("PIECE", 5), ("LOCAL", 1), ("FREQUENT", 2), ("BUCKET", 500), ("CHUNK", 7), ("PAIRS", 3)):
        monkeypatch.setattr(parity_join, name, value)
    assert found_classes(spark, list(texts.items())) == want
    kept = {r["doc_id"] for r in parity_join.one_of_each(docs(spark, list(texts.items()))).collect()}
    assert kept == {d for d in texts if want[d][0] == d}


def test_bits_of_common_words_dont_meet(spark):
    """Unrelated documents, in many tasks each of which sees an n-gram of common words once or twice: hardly any share a bit, and copies are found."""
    rng = random.Random(16)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(20000)]
    texts = {k: " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(60)) for k in range(2400)}
    texts |= {5000 + k: texts[k] + " more" for k in range(20)}
    base = docs(spark, list(texts.items())).repartition(32)
    tables = Tables(spark, "test")
    _, members, listed = parity_join._profiled(base, tables, 3)
    reps = members.where("doc_id = rep").select(F.col("doc_id").alias("doc"), "f1", "weight")
    runs, _ = parity_join._runs(base, reps, tables, 3, 0.6, listed)
    assert runs.where("doc >= 20 and doc < 5000").count() < 2400
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in parity_join.jaccard_join(base).collect()}
    assert got == {d: (d % 5000, int(d % 5000 < 20)) for d in texts}


@pytest.mark.parametrize("counts", [[0, 0, 0, 0], [5, 1, 10**9, 0]])
def test_expected_frequencies_follow_the_words(counts):
    """Sums of logarithms over the words of each n-gram; short texts and repeated n-grams too; no count, one place for all and any n do no harm."""
    w = wd.scan(pa.array(["a b c a b c", "", None, "b", "c a", "a a a a"]))
    logs = parity_join.logarithms(np.resize(np.array(counts), parity_join.PLACES))
    for n in (1, 3, 9):
        doc, h, weight = parity_join.weighed_sets(w, n, logs)
        want_doc, want_h = parity_join.sets(w, n)
        assert (doc == want_doc).all() and (h == want_h).all()
        grams = {}
        for k in range(6):
            words = w.h[w.off[k] : w.off[k + 1]]
            m = min(n, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                g, _ = wd.ngrams(words[i : i + m], np.array([0, m]), m)
                grams[k, int(g[0] >> np.uint64(12))] = max(0, int(sum(logs[parity_join.place(words[i : i + m])]) + logs[-1] + parity_join.FLOOR * parity_join.STEPS))
        assert {(int(d), int(x)): int(v) for d, x, v in zip(doc, h, weight)} == grams


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64) for _ in range(2))
        x, y = (np.frombuffer(parity_join.sketch(s, len(s)), np.uint64) for s in (a, b))
        assert parity_join.distances(x, y[None])[0] <= len(np.setxor1d(a, b))
        assert parity_join.distances(x, x[None])[0] == 0


def test_groups_are_connected_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = groups(spark.createDataFrame(edges, "doc_a long, doc_b long"), Tables(spark, "groups")).collect()
    assert {(r[0], r[1]) for r in got} == {(x, top(x)) for x in root if top(x) != x}


# 7


def test_mixture_meets_its_quotas(spark):
    rows = [(i, ("a", "b", None)[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2], "t") for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixture.mix(d, {"a": 0.5, "b": 0.25, None: 0.25}, block=8, per_shard=4).collect()
    counts = Counter(r["source"] for r in got)
    assert counts == {"a": 800, "b": 400, None: 400}
    assert len({r["doc_id"] for r in got}) == 1600
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["position"])
    assert sorted(shards) == list(range(50)) and all(sorted(p) == list(range(len(p))) for p in shards.values()) and all(len(p) == 32 for p in shards.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixture.mix(d.repartition(7), {"a": 0.5, "b": 0.25, None: 0.25}, block=8, per_shard=4).collect()), key=str)
    kept = mixture.mixed_documents(d, weights={"b": 1.0}).collect()
    assert len(kept) == 800 and {r["source"] for r in kept} == {"b"}


def test_rare_source_does_not_bound_the_mix(spark):
    counts = {f"s{i}": 50_000 for i in range(20)} | {"null": 1}
    quota = mixture.quotas(counts, {k: n**0.7 for k, n in counts.items()}, sum(counts.values()), 4)
    assert sum(quota.values()) == 1_000_001 and quota["null"] == 4 and min(quota.values()) >= 4
    d = spark.createDataFrame([(i, None if i == 0 else "hot", "t") for i in range(2000)], "doc_id long, source string, text string")
    got = mixture.mix(d, block=8, per_shard=4).collect()
    copies = Counter((r["doc_id"], r["source"]) for r in got)
    assert len(got) == 2000 and copies[0, None] == 4 and len(copies) == 1997 and max(n for k, n in copies.items() if k[0]) == 1
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in shards.values())
    assert Counter(r["source"] for r in mixture.mix(d, {None: 0.5, "hot": 0.5}, total=1000, repeats=10).collect()) == {None: 10, "hot": 990}


def test_splitting_tree_is_a_draw_without_replacement():
    blocks_ = np.array([50, 30, 20])
    shares = []
    for seed in range(200):
        leaves = list(mixture.split((0, 25), np.zeros(3, np.int64), blocks_, 4, seed, 1))
        total = sum(n for _, _, n in leaves)
        assert (total == blocks_).all() and all(n.sum() == 4 for _, _, n in leaves)
        for s in range(3):  # runs of each source follow each other
            ends = 0
            for _, first, n in leaves:
                assert first[s] == ends
                ends += n[s]
        shares.append(leaves[7][2])
    mean, var = np.mean(shares, 0), np.var(shares, 0)
    assert np.allclose(mean, [2, 1.2, 0.8], atol=0.3)
    assert var[0] == pytest.approx(4 * 0.5 * 0.5 * 96 / 99, rel=0.35)


def test_large_counts_are_drawn():
    rng = np.random.default_rng(1)
    blocks_ = np.array([6_000_000_000, 3_000_000_000, 1_000_000_000])
    got = np.array([mixture.draw(rng, blocks_, 10**6) for _ in range(300)])
    assert (got.sum(1) == 10**6).all()
    assert np.allclose(got.mean(0), [600_000, 300_000, 100_000], rtol=1e-3)
    assert got.std(0) == pytest.approx(np.sqrt(10**6 * np.array([0.24, 0.21, 0.09])), rel=0.2)
    first = next(mixture.split((0, 1 << 25), np.zeros(3, np.int64), blocks_, 300, 3, 1 << 24))
    assert first[2].sum() == 300 << 24 and (first[2] <= blocks_).all()
    assert mixture.hypergeometric(rng, 0, 10**10, 5) == 0 and mixture.hypergeometric(rng, 10**10, 0, 5) == 5 and mixture.hypergeometric(rng, 2 * 10**9, 3, 2 * 10**9 + 3) == 2 * 10**9


def test_inversion_is_the_distribution(monkeypatch):
    """The draw for large counts, made for small ones, against the exact probabilities."""
    from math import comb

    class Fixed:
        def __init__(self, x):
            self.x = x

        def random(self):
            return self.x

    good, bad, sample = 30, 50, 20
    exact = np.cumsum([comb(good, k) * comb(bad, sample - k) / comb(80, sample) for k in range(21)])
    source = __import__("inspect").getsource(mixture.hypergeometric).replace("10**9", "0")
    own: dict = {"np": np}
    exec(source, own)
    for x in np.linspace(0.0005, 0.9995, 400):
        assert own["hypergeometric"](Fixed(x), good, bad, sample) == int(np.searchsorted(exact, x, side="right"))


def test_equal_ids_and_null_ids_are_told_apart(spark):
    rows = [(1 if i % 2 else None, "a", f"text {i}") for i in range(600)] + [(1, "a", "same")] * 20
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one = mixture.mixed_documents(d, total=300, block=8, per_shard=4).collect()
    two = mixture.mixed_documents(d.repartition(5), total=300, block=8, per_shard=4).collect()
    assert Counter(one) == Counter(two) and len(one) == 300 and max(Counter(r for r in one if r["text"] != "same").values()) == 1


def test_named_targets_and_the_rest(spark):
    rows = [(i, f"src{i % 7 if i % 3 else 0}", "t") for i in range(4200)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    counts = Counter(r[1] for r in rows)
    got = Counter(r["source"] for r in mixture.mix(d, mixture.WEIGHTS).collect())
    total = sum(got.values())
    share = {s: n**mixture.TEMPERATURE for s, n in counts.items() if s != "src0"}
    want = {"src0": 0.2} | {s: 0.8 * x / sum(share.values()) for s, x in share.items()}
    assert all(abs(got[s] - w * total) <= len(want) for s, w in want.items())
    assert any(counts[s] - got[s] <= 1 for s in counts)


# 8


def page(rng, mark):
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, 5))
    body = "".join(f"<p>{text(rng, rng.randint(8, 40))}.</p>" for _ in range(rng.randint(2, 6)))
    wrap = "article" if mark else "div"
    return f"<html><head><title>x</title></head><body><nav><ul>{nav}</ul></nav><div class=ad>{text(rng, 4)}</div><{wrap}><h1>{text(rng, 5)}</h1>{body}</{wrap}><footer>&copy; {text(rng, 3)}</footer></body></html>"


def test_labeller_learns_pages_without_marks(spark):
    rng = random.Random(9)
    rows = [(i, page(rng, True)) for i in range(80)] + [(1000 + i, page(rng, False)) for i in range(40)] + [(5000, None), (5001, ""), (None, page(rng, False))]
    got = blocks.label(spark.createDataFrame(rows, "page_id long, html string")).collect()
    right = total = 0
    for r in got:
        if r["page_id"] and 1000 <= r["page_id"] < 5000:
            want = len(r["text"].split()) >= 8 or (r["block"] == 6 and len(r["text"].split()) == 5)
            right, total = right + (r["content"] == want), total + 1
    assert total > 300 and right / total > 0.95
    assert not {5000, 5001} & {r["page_id"] for r in got} and None in {r["page_id"] for r in got}


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = blocks.Labeller(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.normal(size=(5, 2, blocks.TAGS + blocks.WORDS + blocks.COUNTS)), rng.integers(0, 2, (5, 2))
    mask = np.ones((5, 2))
    mask[3:, 1] = 0

    def loss():
        p = net._both(x, mask)[3]
        return float(-(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum())

    h, kf, kb, prob = net._both(x, mask, keep=True)
    grad = {k: np.zeros_like(v) for k, v in net.p.items()}
    dz = (prob - y) * mask / mask.sum()
    dh = dz[:, :, None] * net.p["u"]
    net._back(x, kf, "f", dh[:, :, : blocks.HIDDEN], grad)
    net._back(x[::-1], kb, "b", dh[::-1, :, blocks.HIDDEN :], grad)
    for k in ("wf", "rf", "bf", "wb", "rb"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old, e = net.p[k][at], 1e-4
        net.p[k][at] = old + e
        a = loss()
        net.p[k][at] = old - e
        b = loss()
        net.p[k][at] = old
        assert (a - b) / (2 * e) == pytest.approx(grad[k][at], rel=0.05, abs=2e-5), k


def forum(rng, _):
    """A page of other make than those of training, without article or main; gives the page and its content."""
    said = [f"{text(rng, rng.randint(10, 40))}." for _ in range(rng.randint(2, 5))]
    menu = "".join(f"<a class=item href='?{w}'>{w}</a> | " for w in rng.sample(WORDS, 6))
    posts = "".join(f"<table class='post'><tr><td class=body>{s}</td></tr></table>" for s in said)
    return f"<body><table><tr><td id=menu>{menu}</td></tr></table><div class='posts'>{posts}</div><div id='bottom'>{text(rng, 3)} <a href=x>{text(rng, 2)}</a></div></body>", said


def flat(rng, _):
    said = [f"{text(rng, rng.randint(10, 40))}." for _ in range(rng.randint(3, 7))]
    links = "".join(f"<dt><a href='{w}'>{w}</a></dt>" for w in rng.sample(WORDS, 7))
    return f"<dl>{links}</dl><h2>{text(rng, 3)}</h2>" + "".join(f"<blockquote>{s}</blockquote>" for s in said) + f"<small>{text(rng, 4)}</small>", said


@pytest.mark.parametrize("make", [forum, flat])
def test_labeller_reads_pages_of_other_makes(make):
    rng = random.Random(19)
    model = blocks.train([page(rng, True) for _ in range(120)])
    right = total = 0
    for _ in range(40):
        html, said = make(rng, None)
        own = blocks.leaves(html)
        prob = model.predict([blocks.features([own], [True])])[0]
        right += sum((p >= 0.5) == (b[0] in said) for b, p in zip(own, prob))
        total += len(own)
    assert total > 200 and right / total > 0.8  # the net was trained on one make of pages


def test_labeller_does_without_the_marks(tiny):
    """Held-out pages of the tables, with the marks that the labels come from hidden."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{tiny}/pages.parquet").column("html").to_pylist()
    parsed = [own for own in map(blocks.leaves, filter(None, pages)) if any(b[1] and b[1].content for b in own)]
    cut = len(parsed) * 2 // 3
    model = blocks.train([p for p in filter(None, pages)][:cut])
    own = parsed[cut:]
    assert len(own) >= 5
    got = np.concatenate(model.predict([blocks.features([p], [True]) for p in own])) >= 0.5
    want = np.array([bool(b[1] and b[1].content) for p in own for b in p])
    assert (got == want).mean() > 0.95 and 0.05 < want.mean() < 0.95


def test_path_reaches_the_net_whole():
    def vectors(outer, masked=False):
        page = f"<body><{outer}><div class='post-body entry-content'><div class='col-md-8 col-sm-12'><p>some words</p></div></div></{outer}></body>"
        return blocks.features([blocks.leaves(page)], [masked])[:, : blocks.TAGS]

    own = [vectors(x) for x in ("article", "aside", "nav", "footer")]
    assert all((a != b).any() for a, b in itertools.combinations(own, 2))
    assert (vectors("article") != vectors("article", True)).any()
    one = blocks.features([blocks.leaves("<div><p class='a-b-c-d-e-f-g-h'>x</p></div>")], [False])[0, : blocks.TAGS]
    both = blocks.features([blocks.leaves("<p class='a-b-c-d-e-f-g-h'>x</p>")], [False])[0, : blocks.TAGS]
    assert np.abs(one - both).sum() == pytest.approx(0.8)


def test_leaves_of_broken_markup():
    got = blocks.leaves("<div class='a b'>one <b>two<br>three</b><p>four<p>five</div></i> six<script>var x='<p>no</p>'</script><li>seven<!-- no --> &amp; more")
    assert [g[0] for g in got] == ["one two three", "four", "five", "six", "seven & more"]
    assert got[0][1].names() == ("div", "a", "b") and got[3][1] is None
    got = blocks.leaves("<p title=\"a > b class='no'\" class=x>it's <q title=it's>5 < 6</q> <a href='u'>link</a></p><!-- open > <p>no</p>")
    assert [(g[0], g[1].names(), g[2]) for g in got] == [("it's 5 < 6 link", ("p", "x"), 4)]
    assert [g[0] for g in blocks.leaves("one > two <! three <!-- four")] == ["one > two <! three"]


@pytest.mark.parametrize(
    "page",
    ["<a " + "x='1' " * 10_000, "<div" + ' class="a b"' * 10_000 + " text", "<a " * 100_000, '<a b="' * 50_000, "<head>" * 50_000, "a > b" + "<!x " * 100_000, "<script>" * 50_000, "<b>" * 20_000 + "</i>" * 20_000, "<div>" * 5_000 + "x</p>" * 5_000, "<a b='<a c=\"" * 20_000],
    ids=range(10),
)
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    blocks.leaves(page)
    assert time.process_time() - began < 1


# 9


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([128 + len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def integer(x):
    return tlv(2, x.to_bytes(x.bit_length() // 8 + 1, "big"))


def rsa():
    p, q, e = (1 << 521) - 1, (1 << 607) - 1, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    return tlv(0x30, b"".join(map(integer, (0, p * q, e, p, q, d % (p - 1), d % (q - 1), pow(q, -1, p)))).replace(integer(p) + integer(q), integer(d) + integer(p) + integer(q), 1))


def b64url(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def test_secrets_are_confirmed_by_structure(spark):
    rng = random.Random(3)
    key = rsa()
    pkcs8 = tlv(0x30, integer(0) + tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(4, tlv(4, rng.randbytes(32))))
    token = b64url(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()) + "." + b64url(b'{"sub":"1"}') + "." + b64url(rng.randbytes(32))
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", base64.b64encode(key).decode())) + "\n-----END RSA PRIVATE KEY-----"
    rows = [
        (1, f"before\n{pem}\nafter"),
        (2, f"key = {base64.b64encode(pkcs8).decode()} ok"),
        (3, f"Authorization: Bearer {token}."),
        (4, f"hex {pkcs8.hex()} end"),
        (5, "sha " + rng.randbytes(32).hex() + " and " + base64.b64encode(rng.randbytes(60)).decode()),
        (6, "broken " + base64.b64encode(pkcs8[:-3]).decode()),
        (7, b64url(b'{"alg":"HS256"}') + "." + b64url(b"{}") + "." + b64url(rng.randbytes(20))),
        (8, None),
        (9, ""),
        (None, f"é {token}"),
    ]
    got = secrets.secrets(docs(spark, rows)).collect()
    assert [(r["doc_id"], r["kind"]) for r in got] == [(1, "rsa_private_key"), (2, "pkcs8_ed25519_private_key"), (3, "signed_token"), (4, "pkcs8_ed25519_private_key"), (None, "signed_token")]
    texts = dict(rows)
    assert texts[None].encode()[got[4]["start_byte"] : got[4]["end_byte"]].decode() == token


def dsa():
    return tlv(0x30, b"".join(map(integer, (0, (1 << 255) - 19, 101, 7, 55, 1234567))))


def sec1(rng):
    return tlv(0x30, integer(1) + tlv(4, rng.randbytes(32)) + tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))))


def openssh(rng):
    part = lambda x: len(x).to_bytes(4, "big") + x
    return b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(part(b"ssh-ed25519") + part(rng.randbytes(32))) + part(rng.randbytes(120))


def test_planted_secrets_are_found_in_every_encoding(spark):
    rng = random.Random(31)
    wrap = lambda s, n, end="\n": end.join(s[i : i + n] for i in range(0, len(s), n))
    b64 = lambda x: base64.b64encode(x).decode()
    keys = {
        "rsa_private_key": lambda: rsa(),
        "dsa_private_key": lambda: dsa(),
        "ec_private_key": lambda: sec1(rng),
        "pkcs8_ed25519_private_key": lambda: tlv(0x30, integer(0) + tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(4, tlv(4, rng.randbytes(32)))),
        "openssh_private_key": lambda: openssh(rng),
    }
    shapes = [b64, lambda x: x.hex(), lambda x: b64url(x), lambda x: wrap(b64(x), 64), lambda x: wrap(b64(x), 76, "\r\n"), lambda x: wrap(b64(x), 48, "\n    "), lambda x: b64(b64(x).encode()), lambda x: f"-----BEGIN PRIVATE KEY-----\n{wrap(b64(x), 64)}\n-----END PRIVATE KEY-----"]
    noise = [lambda: rng.randbytes(32).hex(), lambda: b64(rng.randbytes(64)), lambda: wrap(b64(rng.randbytes(300)), 64), lambda: b64url(b'{"typ":"x"}') + "." + b64url(b"{}") + "." + b64url(rng.randbytes(32)), lambda: "-----BEGIN CERTIFICATE-----\n" + wrap(b64(rng.randbytes(300)), 64) + "\n-----END CERTIFICATE-----"]
    rows, want = [], set()
    for d, (kind, shape) in enumerate(itertools.product(keys, shapes)):
        key = shape(keys[kind]())
        head = f"{text(rng, 9)} é\n{rng.choice(noise)()}\n\n{rng.choice(['key: ', '', 'x ', '\"'])}"
        rows.append((d, f"{head}{key}\n\n{rng.choice(noise)()}\n {text(rng, 5)}"))
        want.add((d, len(head.encode()), len((head + key).encode()), kind))
        broken = bytearray(keys[kind]())
        broken[1 if kind != "openssh_private_key" else 3] ^= 1
        rows.append((1000 + d, f"{text(rng, 9)} {shape(bytes(broken))} {text(rng, 5)}"))
    rows += [(2000 + i, rng.choice(noise)()) for i in range(40)]
    got = {(r["doc_id"], r["start_byte"], r["end_byte"], r["kind"]) for r in secrets.secrets(docs(spark, rows)).collect()}
    assert got == want


def test_secrets_are_found_by_how_they_begin(spark):
    """After names, between words, in marked or short lines, escaped, and in separated bytes; broken ones aren't."""
    rng = random.Random(32)
    lines = lambda s, n: [s[i : i + n] for i in range(0, len(s), n)]
    b64 = lambda x: base64.b64encode(x).decode()
    bare = lambda x: b64(x).rstrip("=")
    shapes = {
        "KEY_": b64,
        "--key-": b64,
        "0x": lambda x: x.hex(),
        "a": lambda x: x.hex(":"),
        "b ": lambda x: x.hex(" ").upper(),
        "c ": lambda x: ":\n    ".join(lines(x.hex(":"), 45)).replace("::", ":"),
        "d 0x": lambda x: ", 0x".join(lines(x.hex(), 2)),
        "e ": lambda x: "\n".join(lines(b64(x), 24)),
        'f "': lambda x: '"\n    "'.join(lines(b64(x), 60)),
        'g "': lambda x: '\\n"\n "'.join(lines(b64(x), 64)),
        "> ": lambda x: "\n> ".join(lines(b64(x), 64)),
        "+": lambda x: "\n+".join(lines(b64(x), 64)),
        "h=": lambda x: "\\n".join(lines(b64(x), 64)),
        "i=": lambda x: bare(x).replace("+", "%2B").replace("/", "%2F"),
        "j=": lambda x: bare(x).replace("/", "\\/"),
    }
    keys = {"rsa_private_key": rsa, "ec_private_key": lambda: sec1(rng), "pkcs8_ed25519_private_key": lambda: tlv(0x30, integer(0) + tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(4, tlv(4, rng.randbytes(32)))), "openssh_private_key": lambda: openssh(rng)}
    rows, want = [], set()
    for d, (kind, (name, shape)) in enumerate(itertools.product(keys, shapes.items())):
        key, head = shape(keys[kind]()), f"{text(rng, 5)} é\n{name}"
        rows.append((d, f"{head}{key}\nfor {text(rng, 4)}"))
        want.add((d, kind))
        broken = bytearray(keys[kind]())
        broken[1 if kind != "openssh_private_key" else 3] ^= 1
        rows += [(1000 + d, f"{head}{shape(bytes(broken))}\nfor {text(rng, 4)}"), (2000 + d, f"{head}{shape(rng.randbytes(90))}\nfor {text(rng, 4)}")]
    full = tlv(0x30, integer(1) + tlv(4, rng.randbytes(50)) + tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d0301070000")))) + b""
    assert len(b64(full)) % 24 == 0
    rows += [(3000, "\n".join(lines(b64(full), 48)) + "\nword and more"), (3001, "\n".join(lines(b64("\n".join(lines(b64(full), 64)).encode()), 64)) + "\nword")]
    want |= {(3000, "ec_private_key"), (3001, "ec_private_key")}
    got = secrets.secrets(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["kind"]) for r in got} == want and len(got) == len(want)
    at = {d: x.encode() for d, x in rows}
    assert all(at[r["doc_id"]][r["start_byte"] : r["end_byte"]].decode().strip("=") in at[r["doc_id"]].decode() and hashlib.sha256(at[r["doc_id"]][r["start_byte"] : r["end_byte"]]).hexdigest() == r["fingerprint"] for r in got)
    rsa_key = next(r for r in got if r["doc_id"] == 0)
    assert at[0][rsa_key["start_byte"] : rsa_key["end_byte"]].decode() == b64(rsa())


def test_secret_scan_takes_linear_time():
    for t in ("-----BEGIN RSA PRIVATE KEY-----\nabcd\n" * 5_000, "eyJ" * 100_000, "eyJ.a." * 50_000, ("a" * 64 + "\n") * 20_000, "a=" * 200_000, "-----BEGIN " * 30_000):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], ["doc_id", "text"])
        began = time.process_time()
        assert sum(b.num_rows for b in secrets._scan(secrets.MIN_CHARS)([batch])) == 0
        assert time.process_time() - began < 3


# 10


def test_templates_catch_reworded_questions(spark):
    item = "A train leaves the old station at 9 with 120 passengers and reaches Oxford after 45 minutes, how many passengers did Brown count per hour"
    reworded = item.replace("9", "7").replace("120", "350").replace("Oxford", "Leeds").replace("45", "30").replace("Brown", "Smith")
    other = "The committee of the town has read all the letters that people wrote about the new bridge over the river and will answer them soon"
    rng = random.Random(1)
    rows = [(1, f"{text(rng, 50)}. {item}. {text(rng, 30)}"), (2, f"{text(rng, 50)}. {reworded}. {text(rng, 30)}"), (3, text(rng, 200)), (4, other + ". " + text(rng, 20)), (5, None), (6, ""), (None, item), (1, f"{item}")]
    bench = spark.createDataFrame([(10, item), (11, "Who wrote the first letter that the people of the lower valley kept for so long in silence"), (None, other), (12, None), (13, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in templates.leaks(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 10), (2, 10)}
    assert not got[1, 10]["reworded"] and got[2, 10]["reworded"]
    assert sorted((r["doc_id"] for r in templates.without_leaks(docs(spark, rows), bench).collect()), key=str) == sorted([3, 4, 5, 6, None], key=str)


def test_slots_must_agree(spark):
    item = "If 5 men dig 5 holes in 8 days then 5 men with 8 friends dig how many more holes in the same garden"
    same = item.replace("5", "6").replace("8", "9")
    mixed = "If 4 men dig 6 holes in 1 days then 9 men with 7 friends dig how many more holes in the same garden"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"] for r in templates.leaks(docs(spark, [(1, same), (2, mixed)]), bench).collect()}
    assert got == {1}


def test_template_windows_are_brute_force(spark):
    rng = random.Random(12)
    items = {i: text(rng, rng.randint(3, 30)) for i in range(12)}
    texts = {}
    for d in range(60):
        cut = items[rng.randrange(12)].split()
        texts[d] = " ".join([text(rng, 20), *cut[rng.randint(0, 5) : rng.randint(6, 30)], text(rng, 20)])

    def best(doc, item):
        a, b = doc.split(), item.split()
        n = min(8, len(b))
        need = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        have = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
        at = [i for i in range(len(b) - n + 1) if tuple(b[i : i + n]) in have]
        return len(at) / (len(b) - n + 1) if need else 0

    want = {(d, i) for d in texts for i in items if best(texts[d], items[i]) >= 0.5}
    got = {(r["doc_id"], r["item_id"]) for r in templates.leaks(docs(spark, list(texts.items())), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == want and want


def brute_template(t):
    """Word by word: (token, value, whether it is a placeholder)."""
    out, end, before_num, before_digit = [], 0, False, False
    for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", t):
        raw, gap = m[0], t[end : m.start()]
        w, starts = raw.lower(), not out or any(c in '.!?:;|\n"' for c in gap)
        digit = "0" <= w[0] <= "9"
        num = digit or w in templates.NUMBERS
        unit = before_num and w in templates.UNITS
        name = raw[0] != raw[0].lower() and sum(c != c.lower() for c in raw) == 1 and not starts
        value = w
        if before_digit and digit and gap in (".", ","):
            value = (out.pop()[1], w)  # 3.5 is one value
        out.append(("NUM" if num else "UNIT" if unit else "NAME" if name else w, value, num or unit or name))
        end, before_num, before_digit = m.end(), num, digit
    return out


def brute_leaks(texts, items):
    got = {}
    docs_ = {d: brute_template(t) for d, t in texts.items()}
    for item, own in ((i, brute_template(t)) for i, t in items.items()):
        n = min(templates.WINDOW, len(own))
        if not n:
            continue
        count = len(own) - n + 1
        literal = [n - sum(x[2] for x in own[i : i + n]) >= min(templates.LITERALS, (n + 1) // 2) for i in range(count)]
        for d, doc in docs_.items():
            hit, part, other = set(), set(), False
            for at in range(-len(own), len(doc)):
                same = lambda i, k: [x[k] for x in own[i : i + n]] == [x[k] for x in doc[at + i : at + i + n]]  # noqa: E731, B023
                here = [i for i in range(count) if 0 <= at + i <= len(doc) - n and same(i, 0 if literal[i] else 1)]
                slots = {p: (own[p][1], doc[at + p][1]) for i in here if literal[i] for p in range(i, i + n) if own[p][2]}
                votes = defaultdict(Counter)
                for a, b in slots.values():
                    votes[a][b] += 1
                good = {a: b for a, c in votes.items() for b, k in c.items() if sum(x == k for x in c.values()) == 1 and k == max(c.values())}
                clash = {p for p, (a, b) in slots.items() if a != b and good.get(a) != b}
                kept = [i for i in here if not clash & set(range(i, i + n))]
                hit |= set(kept)
                part |= {i for i in kept if literal[i]}
                other |= any(p in slots and slots[p][0] != slots[p][1] for i in kept for p in range(i, i + n))
            few = sum(literal)
            a, b = (len(part), few) if few and len(part) * count >= len(hit) * few else (len(hit), count)
            if a and a / b >= templates.MIN_COVERAGE:
                got[d, item] = (a, b, other)
    return got


def test_templates_are_brute_force(spark):
    rng = random.Random(23)
    names, units = ["Brown", "Émile", "Leeds", "Otto", "NATO", "McKay"], ["km", "hours", "kg"]

    def word():
        return rng.choice([lambda: rng.choice(WORDS), lambda: rng.choice(WORDS), lambda: rng.choice(WORDS), lambda: rng.choice(names), lambda: str(rng.choice([3, 7, 12, "3.5", "1,200", "seven"])), lambda: f"{rng.randint(1, 9)} {rng.choice(units)}"])()

    items = {i: " ".join(word() + rng.choice(["", "", "", "", ".", ","]) for _ in range(rng.choice([2, 5, 9, 14, 25]))) for i in range(14)}
    texts = {}
    for d in range(160):
        words = items[rng.randrange(14)].split()
        for _ in range(rng.choice([0, 0, 0, 1, 3])):  # other numbers, names and units, here and there or throughout
            old = rng.choice(words)
            new = word().split()[0]
            words = [new if x == old else x for x in words] if rng.random() < 0.5 else [new if k == words.index(old) else x for k, x in enumerate(words)]
        cut = words[rng.choice([0, 0, 2]) : rng.choice([30, 30, 12])]
        texts[d] = " ".join([*(word() for _ in range(rng.randint(0, 12))), *cut, *(word() for _ in range(rng.randint(0, 12)))])
    want = brute_leaks(texts, items)
    assert len(want) > 40 and any(r[2] for r in want.values()) and not all(r[2] for r in want.values())
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for parts in (1, 5):
        got = templates.leaks(docs(spark, list(texts.items())).repartition(parts), bench).collect()
        assert {(r["doc_id"], r["item_id"]): (r["windows"], r["item_windows"], r["reworded"]) for r in got} == want


def test_names_do_not_depend_on_neighbours():
    own = ["He asked Émile and Oxford and Игорь and Рим, NATO and Weiß", "the Straße in Köln"]

    def of(texts):
        tok, val, slot, off = templates.template(pa.array(texts, pa.string()))
        return [(tok[a:b].tolist(), val[a:b].tolist(), slot[a:b].tolist()) for a, b in zip(off, off[1:])]

    want = [x for t in own for x in of([t])]
    assert [sum(s) for _, _, s in want] == [5, 2]
    assert of([own[0], "an İstanbul, a ẞ and a \u212a", own[1]])[::2] == want
    assert sum(of(["from İstanbul to Rome and \u212aiel"])[0][2]) == 3


def test_a_clashing_slot_costs_its_windows_only(spark):
    item = "A train leaves the old station at 9 with 120 passengers and reaches Oxford after 45 minutes, how many passengers did Brown count per hour"
    dig = "If 8 days of rain fill the new tank of the town then how long would all of them and 8 friends need to dig a hole in the same garden"
    bench = spark.createDataFrame([(1, item), (2, dig)], "item_id long, text string")
    rows = [(1, item.replace("at 9", "at 45")), (2, item.replace("Oxford", "Brown")), (3, dig.replace("8 friends", "3 friends")), (4, dig.replace("8 days", "2 days").replace("8 friends", "3 friends"))]
    got = {(r["doc_id"], r["item_id"]): r for r in templates.leaks(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2)}
    assert got[1, 1]["coverage"] == got[2, 1]["coverage"] == 1 and got[4, 2]["coverage"] < 1 and all(r["reworded"] for r in (got[1, 1], got[2, 1]))
    assert templates.agreed([(0, 3), (3, 3)], [(1, 8, 8), (4, 8, 3)]) == ([0], False)
    assert templates.agreed([(0, 3), (3, 3), (6, 3)], [(1, 8, 3), (4, 8, 3), (7, 8, 5)]) == ([0, 3], True)


def test_items_of_placeholders_are_found_as_copies(spark):
    items = {1: "12 + 7 * 3 - 5 = ?", 2: "5 km 3 miles 20 feet 8 inches 4 yards 90 cm 12 m", 3: "Der Hund und die Katze der Frau Maier aus Bonn sahen Herrn Otto Weber im Garten", 4: "3, 5, 8, 13, 21, 34, 55, 89, 144"}
    rng = random.Random(4)
    rows = [(d, f"{text(rng, 20)} in {item} {text(rng, 20)}") for d, item in items.items()]
    rows += [(10, "12 + 7 * 3 - 6 = ?"), (11, items[4].replace("13", "14").replace("55", "56")), (12, text(rng, 30) + " 1 2 3 4 5 6 7 8 9")]
    got = templates.leaks(docs(spark, rows), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in items}
    assert all(not r["reworded"] for r in got)
