"""An index on disk: segments of Parquet, published in numbered generations.

A segment is written whole before anything refers to it. A commit is one small manifest, renamed into place under a lock: a reader sees a generation entirely or not
at all, and keeps it for as long as it is retained. A delete is a tombstone that affects segments older than itself.
Segments of a like size merge when there are too many; a merge unites their postings in larger sorted files and drops deleted documents, and analyses no text again.
"""

from __future__ import annotations

import contextlib
import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.analysis import STANDARD, Analyzer
from textloom.operators import index as ix
from textloom.operators.index import Index
from textloom.operators.search import search
from textloom.plans.config import FieldOptions, IndexConfig
from textloom.plans.query import Query

FORMAT = 1
SCHEMAS = {
    "postings": "term string, doc_id long, freq int, positions array<int>, norm float, offsets array<struct<start:int,end:int>>, field string",
    "norms": "doc_id long, length int, norm_byte int, norm float, field string",
    "stats": "term string, doc_freq long, total_term_freq long, field string",
}
#: Seconds after which the lock of a writer that didn't come to an end is taken over.
STALE = 600
#: Tombstones up to which they are sent to all tasks; more are joined by a shuffle.
BROADCAST = 1_000_000
#: How often the latest generation is looked up again, when another writer removes it meanwhile.
RETRIES = 5


@dataclass(frozen=True)
class Tiers:
    """When segments merge: each tier may have ``per_tier`` segments, ``at_once`` times as large as those of the tier below; merged segments have ``most`` bytes at most, and smaller ones than ``floor`` count as that."""

    per_tier: int = 10
    at_once: int = 10
    most: int = 5 << 30
    floor: int = 2 << 20
    reclaim: float = 2.0

    def choose(self, sizes: list[tuple[int, float]]) -> list[int]:
        """Places of the segments that should merge, from (bytes, part of its documents that are deleted) of each; none if there are few enough.

        Bytes count without the deleted part. Of the runs of neighbours in size, the one is chosen that is most even, small and full of deleted documents.
        """
        own = [int(b * (1 - d)) for b, d in sizes]
        order = sorted((k for k in range(len(own)) if own[k] < self.most / 2), key=lambda k: (-own[k], k))
        if len(order) < 2:
            return []
        left, level, allowed = sum(own[k] for k in order), max(self.floor, min(own[k] for k in order)), 0
        while left / level >= self.per_tier:
            allowed += self.per_tier
            left -= self.per_tier * level
            level *= self.at_once
        allowed += math.ceil(left / level)
        if len(order) <= allowed:
            return []
        best: tuple = ()
        for start in range(len(order) - 1):
            run: list[int] = []
            for k in order[start:]:
                if len(run) < self.at_once and sum(own[x] for x in run) + own[k] <= self.most:
                    run.append(k)
            if len(run) < 2:
                continue
            after = sum(max(own[k], self.floor) for k in run)
            before = sum(max(sizes[k][0], 1) for k in run)
            skew = max(own[run[0]], self.floor) / after
            score = skew * after**0.05 * (sum(own[k] for k in run) / before) ** self.reclaim
            if not best or score < best[0]:
                best = (score, run)
        return sorted(best[1]) if best else []


class Conflict(RuntimeError):
    """Another writer published the generation first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, fields: dict[str, FieldOptions], analyzer: Analyzer = STANDARD, doc_id: str = "doc_id", mode: str = "create_or_append", tiers: Tiers = Tiers()):  # noqa: B008
        """mode: create starts from nothing, append needs an index, create_or_append takes either. Options of fields that the index has already merge with those given."""
        self.spark, self.path, self.analyzer, self.doc_id, self.tiers = spark, path.rstrip("/"), analyzer, doc_id, tiers
        latest = self._latest()
        if mode == "append" and not latest:
            raise FileNotFoundError(f"no index in {path}")
        new = {"format": FORMAT, "generation": latest["generation"] if latest else 0, "segments": [], "deletes": [], "clock": 0, "user_data": {}, "fields": {}}
        self.state = latest if latest and mode != "create" else new
        config = IndexConfig()
        for name, options in self.state.get("fields", {}).items():
            config.add(name, FieldOptions(**options))
        for name, options in fields.items():
            config.add(name, options)
        self.fields = config.fields
        self.state["fields"] = {name: asdict(options) for name, options in self.fields.items()}
        if mode == "create":
            self.state["segments"], self.state["deletes"] = [], []
        self._published = json.dumps(self.state)

    # files

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def generations(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def exists(self) -> bool:
        return bool(self.generations())

    def _latest(self) -> dict | None:
        """The latest generation; one that is removed between listing and reading is looked up again."""
        for left in range(RETRIES, -1, -1):
            last = self.generations()
            if not last:
                return None
            try:
                return self._read(last[-1])
            except Exception as e:
                if not left or "FileNotFound" not in f"{type(e).__name__} {e}":
                    raise
        return None

    @contextlib.contextmanager
    def _lock(self):
        """Holds the index's lock; that of a writer which has been gone for STALE seconds is taken over."""
        fs, p = self._fs(f"{self.path}/write.lock")
        try:
            fs.create(p, False).close()
        except Exception as e:
            if not fs.exists(p) or time.time() - fs.getFileStatus(p).getModificationTime() / 1000 < STALE:
                raise Conflict("another writer has the lock") from e
            fs.delete(p, False)
            fs.create(p, False).close()
        try:
            yield
        finally:
            fs.delete(p, False)

    def _read(self, generation: int) -> dict:
        fs, p = self._fs(f"{self.path}/commits/{generation}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        state = json.loads(text)
        if state["format"] != FORMAT:
            raise ValueError(f"format {state['format']} can't be read, only {FORMAT}")
        return state

    # writing

    def add(self, docs: DataFrame) -> None:
        """Writes a segment: documents, postings in runs sorted by term so that a term's pages are few, norms and statistics. doc_id must be unique among live documents."""
        self._index(*self._stored(docs))

    def _stored(self, docs: DataFrame) -> tuple[str, int]:
        """A new segment's folder with its documents, and their number; the plan that they come from runs once."""
        base = f"{self.path}/segments/{uuid.uuid4().hex}"
        docs.where(F.col(self.doc_id).isNotNull()).withColumn("doc_id", F.col(self.doc_id).cast("long")).write.parquet(f"{base}/docs")
        return base, self.spark.read.parquet(f"{base}/docs").count()

    def _index(self, base: str, count: int) -> None:
        if not count:
            fs, p = self._fs(base)
            fs.delete(p, True)
            return
        # read back, so that documents of a plan that isn't deterministic are indexed as they are stored
        built = ix.build(self.spark.read.parquet(f"{base}/docs"), self.fields, "doc_id", self.analyzer)
        self._segment(base, built.postings, built.norms, count)

    def _segment(self, base: str, postings: DataFrame, norms: DataFrame, count: int) -> None:
        """Writes the tables of a segment whose documents are there, and takes it in. Each task writes the postings of the documents that it reads, as they come: nothing is shuffled but counts of terms."""
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for name in (k for k, options in self.fields.items() if options.indexed):
            for kind, rows in (("postings", postings), ("norms", norms)):
                # a folder a field, as partitionBy makes them, but without its sort
                rows.where(F.col("field") == name).drop("field").write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{base}/{kind}/field={escaped(name)}")
        written = self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{base}/postings")
        ix.term_stats(written).write.partitionBy("field").parquet(f"{base}/stats")
        self.state["clock"] += 1
        fs, p = self._fs(base)
        self.state["segments"].append({"path": base, "at": self.state["clock"], "docs": count, "bytes": fs.getContentSummary(p).getLength()})

    def _delete(self, ids: DataFrame) -> None:
        base = f"{self.path}/deletes/{uuid.uuid4().hex}"
        self.state["clock"] += 1
        ids.select(F.col("doc_id").cast("long")).distinct().write.parquet(base)
        self.state["deletes"].append({"path": base, "at": self.state["clock"], "docs": self.spark.read.parquet(base).count()})

    def delete_by_term(self, field: str, term: str) -> None:
        if self.state["segments"]:
            self._delete(self.index().postings.where((F.col("field") == field) & (F.col("term") == term)))

    def delete_by_query(self, query: Query, where: Column | None = None) -> None:
        if self.state["segments"]:
            self._delete(search(self.index(), query, where=where))

    def delete_ids(self, ids: DataFrame) -> None:
        if self.state["segments"]:
            self._delete(ids.where("doc_id is not null"))

    def update(self, docs: DataFrame, field: str | None = None, term: str | None = None) -> None:
        """Deletes by term, or the documents of the same doc_ids, and adds; one commit publishes both."""
        base, count = self._stored(docs)
        if field is None:
            self.delete_ids(self.spark.read.parquet(f"{base}/docs").select("doc_id"))
        else:
            self.delete_by_term(field, term)
        self._index(base, count)

    def commit(self, user_data: dict | None = None) -> int:
        """Publishes what was added and deleted since the last commit; nothing is published twice."""
        if json.dumps(self.state) == self._published and not user_data:
            return self.state["generation"]
        state = self.state | {"generation": self.state["generation"] + 1, "user_data": self.state["user_data"] | (user_data or {})}
        fs, to = self._fs(f"{self.path}/commits/{state['generation']}.json")
        with self._lock():
            last = self.generations()
            if last and last[-1] != self.state["generation"]:
                raise Conflict(f"generation {last[-1]} is newer than {self.state['generation']}")
            _, tmp = self._fs(f"{self.path}/commits/_{uuid.uuid4().hex}")
            out = fs.create(tmp, True)
            out.write(bytearray(json.dumps(state).encode()))
            out.close()
            if fs.exists(to) or not fs.rename(tmp, to):
                fs.delete(tmp, False)
                raise Conflict(f"generation {state['generation']} is there already")
        self.state, self._published = state, json.dumps(state)
        return state["generation"]

    def rollback(self) -> None:
        """Back to the last commit; segments that weren't published go."""
        kept = json.loads(self._published)
        paths = {x["path"] for k in ("segments", "deletes") for x in kept[k]}
        for k in ("segments", "deletes"):
            for x in self.state[k]:
                if x["path"] not in paths:
                    fs, p = self._fs(x["path"])
                    fs.delete(p, True)
        self.state = kept

    def vacuum(self, keep: int = 1) -> None:
        """Removes all generations but the last few, with the files that only they refer to."""
        gens = self.generations()
        used = {x["path"] for g in gens[-keep:] for k in ("segments", "deletes") for x in self._read(g)[k]} | {x["path"] for k in ("segments", "deletes") for x in self.state[k]}
        for g in gens[:-keep]:
            fs, p = self._fs(f"{self.path}/commits/{g}.json")
            fs.delete(p, False)
        for kind in ("segments", "deletes"):
            fs, p = self._fs(f"{self.path}/{kind}")
            if fs.exists(p):
                for s in fs.listStatus(p):
                    if f"{self.path}/{kind}/{s.getPath().getName()}" not in used:
                        fs.delete(s.getPath(), True)

    def compact(self, force: bool = False) -> bool:
        """Merges what ``tiers`` chooses, as long as it chooses any, or all segments by force. Statistics no longer count the deleted documents of merged segments."""
        done = False
        while len(self.state["segments"]) + len(self.state["deletes"]) > 1:
            if force:
                chosen = list(range(len(self.state["segments"])))
            else:
                chosen = self.tiers.choose([(s["bytes"], self._deleted(s)) for s in self.state["segments"]])
            if not chosen:
                break
            self._merge(chosen)
            done = True
            if force:
                break
        return done or force

    def _deleted(self, segment: dict) -> float:
        """Part of a segment's documents that are deleted, as counted when the last delete came."""
        late = [d["path"] for d in self.state["deletes"] if d["at"] > segment["at"]]
        if not late or not segment["docs"]:
            return 0.0
        if segment.get("counted") != len(late):
            ids = self.spark.read.parquet(*late)
            segment["gone"] = self.spark.read.parquet(f"{segment['path']}/docs").join(ids, "doc_id", "left_semi").count()
            segment["counted"] = len(late)
        return segment["gone"] / segment["docs"]

    def _merge(self, places: list[int]) -> None:
        """One segment from several: their documents, norms and postings as they are, without deleted ones. Texts aren't analysed again."""
        old = [self.state["segments"][k] for k in places]
        rest = [s for k, s in enumerate(self.state["segments"]) if k not in places]
        base = f"{self.path}/segments/{uuid.uuid4().hex}"
        self._tables(old, self.state["deletes"], "docs").write.parquet(f"{base}/docs")
        postings, norms = (self._tables(old, self.state["deletes"], kind) for kind in ("postings", "norms"))
        self.state["segments"] = rest
        self._segment(base, postings.sortWithinPartitions("field", "term", "doc_id"), norms, self.spark.read.parquet(f"{base}/docs").count())
        first = min((s["at"] for s in self.state["segments"]), default=0)
        self.state["deletes"] = [d for d in self.state["deletes"] if d["at"] > first]

    # reading

    def is_current(self) -> bool:
        return self.generations()[-1:] == [self.state["generation"]]

    def index(self, generation: int | None = None) -> Index:
        """The index as of a generation, or with what this writer has added since the last. docs holds live documents only, the statistics all until compaction."""
        state = self.state if generation is None else self._read(generation)
        segments = state["segments"]
        if not segments:
            raise FileNotFoundError(f"{self.path} has no documents")

        read = lambda kind: self._tables(segments, state["deletes"], kind)
        stats = read("stats").groupBy("field", "term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total_term_freq").alias("total_term_freq"))
        return Index(read("docs"), read("postings"), read("norms"), max_doc=sum(s["docs"] for s in segments), stats=stats, fields=self.fields)

    def _tables(self, segments: list[dict], deletes: list[dict], kind: str) -> DataFrame:
        """The rows of one kind of table of the segments, without those of deleted documents: one join with all tombstones, each of which holds for older segments."""
        reader = self.spark.read.schema(SCHEMAS[kind]) if kind in SCHEMAS else self.spark.read
        late = [] if kind == "stats" else [d for d in deletes if d["at"] > min(s["at"] for s in segments)]
        parts = [reader.parquet(f"{s['path']}/{kind}") for s in segments]
        if not late:
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        newest = max(d["at"] for d in late)
        live = [p for p, s in zip(parts, segments) if s["at"] > newest]
        aged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("textloom_at", F.lit(s["at"])) for p, s in zip(parts, segments) if s["at"] < newest])
        gone = reduce(DataFrame.unionByName, [self.spark.read.parquet(d["path"]).select("doc_id", F.lit(d["at"]).alias("gone_at")) for d in late])
        gone = gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("gone_at").alias("gone_at"))
        if sum(d.get("docs", BROADCAST + 1) for d in late) <= BROADCAST:
            gone = F.broadcast(gone)  # two numbers a row; else postings and texts would be shuffled for it
        aged = aged.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("gone_at") > F.col("textloom_at")), "left_anti").drop("textloom_at")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [aged, *live])

    def commits(self) -> DataFrame:
        """``(generation, segments, docs, deletes)`` of each generation kept."""
        rows = [(s["generation"], len(s["segments"]), sum(x["docs"] for x in s["segments"]), len(s["deletes"])) for s in map(self._read, self.generations())]
        return self.spark.createDataFrame(rows, "generation long, segments int, docs long, deletes int")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()


def loaded(make: Callable[[], Store], docs: DataFrame) -> Index:
    """An index of docs written and read again."""
    with make() as store:
        store.add(docs)
    return store.index()
