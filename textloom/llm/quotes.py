"""Conversations from messages that quote each other.

Quote levels are counted from leading ``>`` marks. What a message quotes at each level is normalised and cut into sentences, each hashed; so is what each
message says itself. A join on (conversation, hash) links quotes to the messages they come from. The earlier message from which most of the
outermost quoted level comes is the parent; conversations are ordered so that replies follow their parent, and
messages lose their quotes and the lines that introduce them.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Tables

#: A sentence of fewer words says too little of where it comes from; a passage that is shorter as a whole counts as one sentence.
MIN_WORDS = 3
#: Messages of a conversation that one task puts in order; longer ones are put in order by joins.
LONGEST = 100_000
_MARKS = re.compile(r"(?:[ \t]{0,3}>[ \t]?)*+")
_INTRO = re.compile(r"^.{0,200}(wrote|schrieb|a écrit|écrit|escribió|said)\s*:\s*$", re.I)
_DASHES = re.compile(r"^\s*-{2,}\s*(original message|ursprüngliche nachricht|message d'origine|mensaje original)\s*-{2,}\s*$", re.I)


def levels(text: str) -> list[tuple[int, str]]:
    """Each line's quote level and what stands behind the marks."""
    out = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)[0]
        out.append((marks.count(">"), line[len(marks) if marks else 0 :].rstrip("\r")))
    return out


def sentences(passage: str, min_words: int = MIN_WORDS) -> list[str]:
    """Normalised sentences: lower-cased words joined by spaces."""
    cut = [" ".join(re.findall(r"\w+", s.lower())) for s in re.split(r"(?<=[.!?…])\s+|\n\s*\n", passage)]
    good = [s for s in cut if s.count(" ") + 1 >= min_words]
    whole = " ".join(s for s in cut if s)
    return good or ([whole] if whole else [])


def parse(text: str | None, min_words: int = MIN_WORDS) -> tuple[str, list[tuple[int, str]], list[str]]:
    """What the message says itself, its quoted passages with levels, and its own sentences."""
    lines = levels(text or "")
    own, passages = [], []
    for i, (level, line) in enumerate(lines):
        if level == 0:
            nxt = next((v for v, x in lines[i + 1 : i + 3] if x.strip() or v), 0)
            if _DASHES.match(line) or (_INTRO.match(line) and nxt > 0):
                continue
            own.append(line)
        elif passages and passages[-1][0] == level and i and lines[i - 1][0] == level:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
    said = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if passages else text or ""
    return said, [(v, "\n".join(x)) for v, x in passages], sentences(said, min_words)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(min_words: int):
    def run(batches):
        for b in batches:
            rows = [parse(t, min_words) for t in b.column(2).to_pylist()]
            quoted = [[{"level": v, "h": _hash(s)} for v, p in r[1] for s in sentences(p, min_words)] for r in rows]
            kind = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([r[0] for r in rows], pa.string()), pa.array([max([v for v, _ in r[1]], default=0) for r in rows], pa.int32()), pa.array(quoted, kind), pa.array([[_hash(s) for s in r[2]] for r in rows], pa.list_(pa.int64()))], ["conv_id", "turn", "role", "text", "levels", "quoted", "own"])

    return run


def _ordered(batches):
    """Over rows (conv_id, turn, parent) in that order: depth and position of each turn, replies after their parent, siblings by turn."""

    def closed(conv, rows):
        children: dict = {}
        for turn, parent in rows:
            children.setdefault(parent, []).append(turn)
        out, stack = [], [(t, 0) for t in reversed(children.get(None, []))]
        while stack:
            turn, depth = stack.pop()
            out.append((conv, turn, depth, len(out)))
            stack += [(t, depth + 1) for t in reversed(children.get(turn, []))]
        return out

    def batch(rows):
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["conv_id", "turn", "depth", "position"])

    conv, rows, out = None, [], []
    for b in batches:
        for c, t, p in zip(*(x.to_pylist() for x in b.columns)):
            if rows and c != conv:
                out += closed(conv, rows)
                rows = []
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
            conv = c
            rows.append((t, p))
    yield batch(out + (closed(conv, rows) if rows else []))


def _ranked(links: DataFrame, tables: Tables) -> DataFrame:
    """The same for conversations of any length, as joins on (conv_id, turn): each turn is entered and left once on a walk around the tree, and the steps to its end are summed by doubling.

    A turn's position is the number of turns entered before it, its depth that of those entered and not left. The number of rounds is the logarithm of the walk's length.
    """
    kids = Window.partitionBy("conv_id", "reply_to").orderBy("turn")
    tree = links.select("conv_id", "turn", "reply_to", F.lead("turn").over(kids).alias("sibling"))
    first = tree.where("reply_to is not null").groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    tree = tree.join(first, ["conv_id", "turn"], "left")
    # steps of the walk: turn and whether it is left; enter: turns entered from here to the end, level: of these, less those left
    enter = tree.select("conv_id", "turn", F.lit(False).alias("out"), F.coalesce("child", "turn").alias("to"), F.col("child").isNull().alias("to_out"), F.lit(1).cast("long").alias("enter"), F.lit(1).cast("long").alias("level"))
    leave = tree.select("conv_id", "turn", F.lit(True).alias("out"), F.coalesce("sibling", "reply_to").alias("to"), F.col("sibling").isNull().alias("to_out"), F.lit(0).cast("long").alias("enter"), F.lit(-1).cast("long").alias("level"))
    walk, k = tables.write(enter.unionByName(leave), "walk0"), 0
    while walk.where("to is not null").limit(1).count():
        after = walk.select("conv_id", F.col("turn").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("next"), F.col("to_out").alias("next_out"), F.col("enter").alias("more"), F.col("level").alias("deeper"))
        both = walk.join(after, ["conv_id", "to", "to_out"], "left")
        both = both.select("conv_id", "turn", "out", F.col("next").alias("to"), F.coalesce("next_out", F.lit(True)).alias("to_out"), (F.col("enter") + F.coalesce("more", F.lit(0))).alias("enter"), (F.col("level") + F.coalesce("deeper", F.lit(0))).alias("level"))
        k += 1
        walk = tables.write(both, f"walk{k}")
        tables.drop(f"walk{k - 1}")
    sizes = links.groupBy("conv_id").agg(F.count("*").alias("n"))
    walk = walk.where("not out").join(sizes, "conv_id")
    return walk.select("conv_id", "turn", F.negative("level").cast("int").alias("depth"), (F.col("n") - F.col("enter")).cast("int").alias("position"))


def threads(messages: DataFrame, min_words: int = MIN_WORDS, longest: int = LONGEST) -> DataFrame:
    """``(conv_id, turn, role, text, levels, reply_to, linked, depth, position)``: each message without quotes, in reply order within its conversation.

    levels: the deepest quote level of the message. reply_to: the turn it replies to: the earlier message that most of its quoted sentences of level 1 come from, or of
    the next level if none does, the latest of several equal ones (linked is true); without such, the message before it (linked is false); null for the first. depth and position count from 0.

    Quoted sentences of fewer than min_words words tell nothing; a passage that has no longer ones counts as one. A message that quotes nothing keeps its text as it is, however long; an empty table gives no rows. A null text becomes empty. Rows with a null conv_id or turn have no place in an order and are left out; of repeated
    (conv_id, turn), the least (role, text) counts. Other columns are ignored.
    """
    tables = Tables(messages.sparkSession, "threads")
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"), F.col("role").cast("string").alias("role")).where("conv_id is not null and turn is not null")
    one = base.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.text", "m.role")
    kind = "conv_id long, turn long, role string, text string, levels int, quoted array<struct<level:int,h:long>>, own array<long>"
    rows = tables.write(one.mapInArrow(_parsed(min_words), kind), "messages")
    quoted = rows.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.h")
    own = rows.select("conv_id", F.col("turn").alias("source"), F.explode(F.array_distinct("own")).alias("h"))
    hits = quoted.join(own, ["conv_id", "h"]).where("source < turn")
    votes = hits.groupBy("conv_id", "turn", "level", "source").count()
    best = Window.partitionBy("conv_id", "turn").orderBy("level", F.desc("count"), F.desc("source"))
    parents = votes.withColumn("k", F.row_number().over(best)).where("k = 1").select("conv_id", "turn", F.col("source").alias("linked_to"))
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    links = rows.select("conv_id", "turn").withColumn("before", before).join(parents, ["conv_id", "turn"], "left")
    links = tables.write(links.select("conv_id", "turn", F.coalesce("linked_to", "before").alias("reply_to"), F.col("linked_to").isNotNull().alias("linked")), "links")
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = links.groupBy("conv_id").count()
    long = sizes.where(F.col("count") > longest).select("conv_id")
    order = links.join(long, "conv_id", "left_anti").select("conv_id", "turn", "reply_to").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn")
    order = order.mapInArrow(_ordered, "conv_id long, turn long, depth int, position int")
    if long.limit(1).count():
        order = order.unionByName(_ranked(tables.write(links.join(long, "conv_id", "left_semi"), "long"), tables))
    out = rows.select("conv_id", "turn", "role", "text", "levels").join(links, ["conv_id", "turn"]).join(order, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "role", "text", "levels", "reply_to", "linked", "depth", "position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Nested quote levels line by line have no SQL form; tests compare planted conversations.
SQL = None
