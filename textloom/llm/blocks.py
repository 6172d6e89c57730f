"""Main-content extraction: a bidirectional LSTM labels the text blocks of a page.

A page becomes the sequence of its leaf blocks. Each block has the hashed tags (and classes and ids) of its path, a hashed bag of its words, and a few
counts; a numpy LSTM reads the sequence in both directions, so each decision sees the whole page, and a logistic layer labels each block.

Silver labels come from pages that mark their content up: blocks within article or main are content, the other ones of
such a page aren't. Those tags are masked in half of the training pages, so that
the model labels pages without them by what else it sees. Training takes TRAIN_PAGES marked-up pages, chosen by hash of page_id;
it is deterministic, and runs on the driver.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd

TRAIN_PAGES = 300
EPOCHS = 12
HIDDEN = 16
TAGS = 24
WORDS = 24
COUNTS = 6
BATCH = 64
U = wd.U
MARKS = ("article", "main")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label".split())
_SKIP = frozenset("script style noscript template svg math head iframe".split())
#: Comments, declarations and tags. A quoted value counts as such after an equals sign only; possessive, so that a tag that never ends is left after one pass.
_TOKEN = re.compile(r"<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^<>])*+)>")
_ATTR = re.compile(r"(?<![^\s\"'])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))|=\s*+(?:\"[^\"]*+\"|'[^']*+')", re.I)
_CLOSED_BY = {"p": frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 section article aside nav header footer main blockquote pre form hr".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}


class Path:
    """A tag below others, with the hashed vectors of the whole path down to it: each step away weighs 0.8 times as much. ``masked`` is the vector without the marks of content; ``content`` tells whether one is on the path."""

    __slots__ = ("content", "entries", "masked", "parent", "vector")

    def __init__(self, parent: Path | None, entries: tuple[str, ...]):
        self.parent, self.entries = parent, entries
        own, rest = (_entries_vector(x) for x in (entries, tuple(x for x in entries if x not in MARKS)))
        zero = _entries_vector(())
        self.vector = own + (0.8 * parent.vector if parent else zero)
        # a tag that is masked as a whole is no step
        self.masked = parent.masked if parent and rest is zero else rest + (0.8 * parent.masked if parent else zero)
        self.content = bool(parent and parent.content) or any(x in MARKS for x in entries)

    def names(self) -> tuple[str, ...]:
        """All entries from the root on."""
        out, at = [], self
        while at:
            out.append(at.entries)
            at = at.parent
        return tuple(x for e in reversed(out) for x in e)


_ENTRIES: dict[tuple[str, ...], np.ndarray] = {(): np.zeros(TAGS, np.float32)}


def _entries_vector(entries: tuple[str, ...]) -> np.ndarray:
    """Hashed entries of one tag: its name, and the parts of its class, id and role; kept, as they repeat."""
    if entries not in _ENTRIES:
        if len(_ENTRIES) > 100_000:
            _ENTRIES.clear()
            _ENTRIES[()] = np.zeros(TAGS, np.float32)
        v = np.zeros(TAGS, np.float32)
        h = wd.scan(pa.array([re.sub(r"\W", "z", x) or "z" for x in entries])).h
        np.add.at(v, (h % U(TAGS)).astype(np.int64), np.where(h >> U(40) & U(1), 1, -1))
        _ENTRIES[entries] = v
    return _ENTRIES[entries]


def leaves(page: str) -> list[tuple[str, Path | None, int]]:
    """Blocks of a page: text, path, and characters within links.

    Inline tags and line breaks don't end a block. Unclosed and stray tags are taken as browsers do: an end tag closes up to its start tag, one without is ignored; what only begins like a tag is text.
    The time grows with the length of the page, whatever is in it.
    """
    out: list = []
    stack: list[tuple[str, Path | None]] = []
    opened: Counter = Counter()
    absent: set[str] = set()
    text: list[str] = []
    linked = [0, 0]  # depth of links, characters

    def flush():
        got = " ".join(entities.unescape("".join(text)).split())
        if got:
            out.append((got, stack[-1][1] if stack else None, min(linked[1], len(got))))
        text.clear()
        linked[1] = 0

    def after(pattern: str, at: int):
        """The match of an end that is looked for; what isn't there isn't looked for again."""
        if pattern in absent:
            return None
        m = re.compile(pattern, re.I).search(page, at)
        if not m:
            absent.add(pattern)
        return m

    def pop():
        opened[stack.pop()[0]] -= 1

    at, n, last = 0, len(page), page.rfind(">") + 1  # past the last one only a comment can begin
    while at < n:
        m = _TOKEN.search(page, at, last) if at < last else None
        if not m:
            rest = page.find("<!--", at)
            n = rest if rest >= 0 else n
        piece = page[at : m.start() if m else n]
        if piece:
            text.append(piece)
            if linked[0]:
                linked[1] += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else n
            continue
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                linked[0] = 0
            if opened[name]:
                if name not in _INLINE:
                    flush()
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _SKIP:
            flush()
            end = after(rf"</{name}\s*+>", at)
            if name == "head":  # its parts are skipped one by one
                end = end or after(r"<body\b", at)
                at = end.end() if end and end[0][1] == "/" else (end.start() if end else at)
            else:
                at = end.end() if end else n
            continue
        if name in _VOID:
            if name == "br":
                text.append(" ")
            elif name == "hr":
                flush()
            continue
        if name not in _INLINE:
            flush()
            while stack and name in _CLOSED_BY.get(stack[-1][0], ()):
                pop()
        if name == "a":
            linked[0] = 1
        if not m[3].endswith("/"):
            above = stack[-1][1] if stack else None
            if name not in _INLINE:
                marks = tuple(w.lower() for k in _ATTR.finditer(m[3]) if k[1] for w in re.split(r"[\s_-]+", k[2] or k[3] or k[4] or "") if w)
                above = Path(above, (name, *marks))
            stack.append((name, above))
            opened[name] += 1
    flush()
    return out


def features(pages: list[list], masked: list[bool]) -> np.ndarray:
    """One row for each block of all pages, in order."""
    blocks = [b for p in pages for b in p]
    n = len(blocks)
    x = np.zeros((n, TAGS + WORDS + COUNTS), np.float32)
    if not n:
        return x
    none = _entries_vector(())
    x[:, :TAGS] = [(b[1].masked if m else b[1].vector) if b[1] else none for p, m in zip(pages, masked) for b in p]
    w = wd.scan(pa.array([b[0] for b in blocks], pa.large_string()))
    row = wd.doc_of(w.off)
    sign = np.where((w.h >> U(40)) & U(1), 1.0, -1.0)
    bag = np.bincount(row * WORDS + (w.h % U(WORDS)).astype(np.int64), weights=sign, minlength=n * WORDS).reshape(n, WORDS)
    count = np.diff(w.off)
    x[:, TAGS : TAGS + WORDS] = bag / np.sqrt(np.maximum(count, 1))[:, None]
    chars = np.array([len(b[0]) for b in blocks])
    x[:, -6] = np.log1p(count) / 3
    x[:, -5] = np.log1p(chars) / 5
    x[:, -4] = [b[2] / len(b[0]) for b in blocks]
    x[:, -3] = [min(b[0].count(".") + b[0].count(","), 20) / 10 for b in blocks]
    lens = [len(p) for p in pages]
    x[:, -2] = np.concatenate([np.arange(k) / max(k, 1) for k in lens if k])
    x[:, -1] = [b[0][-1] in ".!?" for b in blocks]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Bidirectional LSTM with a logistic layer; gates in the order input, forget, output, candidate."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        d, h = TAGS + WORDS + COUNTS, HIDDEN
        self.p = {"u": rng.normal(0, 0.1, 2 * h), "c": np.zeros(1)}
        for k in "fb":
            self.p |= {f"w{k}": rng.normal(0, 1 / np.sqrt(d), (d, 4 * h)), f"r{k}": rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"b{k}": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, k: str, keep: bool):
        """x: (steps, pages, features), in reading order of direction k; states of masked steps don't change."""
        p, h = self.p, HIDDEN
        t, n, d = x.shape
        g = (x.reshape(-1, d) @ p[f"w{k}"] + p[f"b{k}"]).reshape(t, n, 4 * h)
        s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.zeros((t, n, h), np.float32), []
        for i in range(t):
            a = g[i] + s @ p[f"r{k}"]
            gate, cand = _sigmoid(a[:, : 3 * h]), np.tanh(a[:, 3 * h :])
            m = mask[i][:, None]
            c1 = gate[:, h : 2 * h] * c + gate[:, :h] * cand
            th = np.tanh(c1)
            if keep:
                kept.append((gate, cand, s, c, th, m))
            s, c = m * gate[:, 2 * h :] * th + (1 - m) * s, m * c1 + (1 - m) * c
            out[i] = s
        return out, kept

    def _both(self, x, mask, keep=False):
        f, kf = self._run(x, mask, "f", keep)
        b, kb = self._run(x[::-1], mask[::-1], "b", keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        return h, kf, kb, _sigmoid(h @ self.p["u"] + self.p["c"])

    def _back(self, x, kept, k, dout, grad):
        h = HIDDEN
        ds, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        w, r = self.p[f"w{k}"], self.p[f"r{k}"]
        for i in range(len(x) - 1, -1, -1):
            gate, cand, s0, c0, th, m = kept[i]
            ds = ds + dout[i]
            do, own = ds * m * th, ds * m * gate[:, 2 * h :]
            d1 = dc * m + own * (1 - th * th)
            da = np.concatenate([d1 * cand, d1 * c0, do], axis=1) * gate * (1 - gate)
            da = np.concatenate([da, d1 * gate[:, :h] * (1 - cand * cand)], axis=1)
            grad[f"w{k}"] += x[i].T @ da
            grad[f"r{k}"] += s0.T @ da
            grad[f"b{k}"] += da.sum(0)
            ds = ds * (1 - m) + da @ r.T
            dc = dc * (1 - m) + d1 * gate[:, h : 2 * h]

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(xs))
            for lo in range(0, len(order), 16):
                x, mask, y = _padded([xs[i] for i in order[lo : lo + 16]], [ys[i] for i in order[lo : lo + 16]])
                h, kf, kb, prob = self._both(x, mask, keep=True)
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                dz = (prob - y) * mask / mask.sum()
                grad["u"] += np.einsum("tn,tnh->h", dz, h)
                grad["c"] += dz.sum()
                dh = dz[:, :, None] * self.p["u"]
                self._back(x, kf, "f", dh[:, :, :HIDDEN], grad)
                self._back(x[::-1], kb, "b", dh[::-1, :, HIDDEN:], grad)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                for k, g in grad.items():
                    g *= min(1.0, 1.0 / max(norm, 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def predict(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of being content for each block of each page."""
        out: list = [np.zeros(0, np.float32)] * len(xs)
        order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: len(xs[i]))
        lo = 0
        while lo < len(order):
            hi = min(lo + BATCH, len(order))
            while hi > lo + 1 and (hi - lo) * len(xs[order[hi - 1]]) > 50_000:
                hi -= 1
            x, mask, _ = _padded([xs[i] for i in order[lo:hi]], None)
            prob = self._both(x, mask)[3]
            for j, i in enumerate(order[lo:hi]):
                out[i] = prob[: len(xs[i]), j]
            lo = hi
        return out


def _padded(xs, ys):
    t, n = max(len(x) for x in xs), len(xs)
    x, mask, y = np.zeros((t, n, xs[0].shape[1]), np.float32), np.zeros((t, n), np.float32), np.zeros((t, n), np.float32)
    for j, a in enumerate(xs):
        x[: len(a), j], mask[: len(a), j] = a, 1
        if ys is not None:
            y[: len(a), j] = ys[j]
    return x, mask, y


def train(pages: list[str]) -> Labeller | None:
    """A labeller from marked-up pages; None if there are none."""
    parsed = [b for b in map(leaves, pages) if any(x[1] and x[1].content for x in b)]
    if not parsed:
        return None
    both = [(b, m) for b in parsed for m in (False, True)]
    x = features([b for b, _ in both], [m for _, m in both])
    cut = np.cumsum([len(b) for b, _ in both])[:-1]
    ys = [np.array([bool(blk[1] and blk[1].content) for blk in b], np.float32) for b, _ in both]
    model = Labeller()
    model.fit(np.split(x, cut), ys)
    return model


def _marked_up(base: DataFrame, most: int) -> list[str]:
    """The marked-up pages of least hash, at most so many. A bound on the hash, from their number, lets tasks send a few times that many in all, not each so many."""
    marked = base.where(F.lower("html").rlike("<(article|main)[\\s>]")).withColumn("h", F.shiftrightunsigned(F.xxhash64("page_id"), 1))
    n = marked.count()
    part = min(1.0, 4 * most / n) if n else 1.0
    while True:
        few = marked.where(F.col("h") <= min(int(part * (1 << 63)), (1 << 63) - 1)).orderBy("h", "page_id", F.xxhash64("html")).limit(most)
        got = [r[0] for r in few.select("html").collect()]
        if len(got) >= min(most, n) or part >= 1.0:
            return got
        part = min(1.0, part * 4)


def label(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``(page_id, block, text, score, content)`` for each block of each page, block counting from 0.

    The model is trained on at most train_pages of the pages that have an article or main tag. Without such pages all scores are null and
    all blocks count as content. Pages of null or empty html, or without text, have no rows; an empty table gives none. Very long pages are read whole, in time that grows with their length. Each row stands for itself: a null page_id is reported as null, repeated rows
    repeat. Other columns are ignored.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    model = train(_marked_up(base, train_pages))
    weights = model and model.p

    def run(batches):
        net = None
        if weights:
            net = Labeller()
            net.p = weights
        for b in wd.slices(batches, "html", 1 << 20):
            parsed = [leaves(p) if p else [] for p in b.column(1).to_pylist()]
            lens = [len(p) for p in parsed]
            score = None
            if net:
                x = features(parsed, [False] * len(parsed))
                got = net.predict(np.split(x, np.cumsum(lens)[:-1]) if lens else [])
                score = np.concatenate(got) if got else np.zeros(0, np.float32)
            rows = pa.array(np.repeat(np.arange(len(lens)), lens).astype(np.int32))
            n = sum(lens)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), pa.array(np.concatenate([np.arange(k) for k in lens]).astype(np.int32), pa.int32()), pa.array([x[0] for p in parsed for x in p], pa.string()), pa.array(score.astype(np.float32)) if score is not None else pa.nulls(n, pa.float32()), pa.array(score >= 0.5 if score is not None else np.ones(n, bool))],
                ["page_id", "block", "text", "score", "content"],
            )

    return base.mapInArrow(run, "page_id long, block int, text string, score float, content boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: A recurrent net has no SQL form; tests measure its accuracy on held-out pages.
SQL = None
