"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The weights give each source an exact quota of documents, hence of blocks. A tree splits the vector of block quotas among the output
shards: at each node the left half of the shards gets a multivariate-hypergeometric draw of the node's blocks, the right half
the rest, so each shard's composition is that of a draw without replacement from all blocks and the quotas are met
exactly. The documents of a source are permuted by hash; its blocks are runs of that permutation, dealt to the
shards in order, disjoint. A rare source's permutation is gone through again, up to REPEATS times, so that it doesn't bound the whole mix. Each shard then shuffles its documents.

The top of the tree is split on the driver, until a node has TOP shards; below, executors split each node from a seed of
its own, so the tree can have any number of leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TEMPERATURE = 0.7
#: Times that a document of a rare source may be drawn to meet the source's share of a stated total.
REPEATS = 4
#: Stands in weights for all sources that aren't named.
REST = object()
#: Target weights of the registered query: the largest source gets a fifth of the mix.
WEIGHTS = {"src0": 0.2, REST: 0.8}
BLOCK = 64
PER_SHARD = 32
TOP = 1024
SEED = 20
#: Documents of a source that one window partition ranks, on average.
BUCKET = 8192


def quotas(counts: dict[str, int], weights: dict[str, float], total: int | None = None, repeats: int = 1) -> dict[str, int]:
    """Quotas of the sources at the weights' proportions.

    With a total, they add up to it, or to all that there is: no source bounds the others. A source gives at most ``repeats`` times its count; what
    it lacks of its share goes to the others at their weights. Without one, the quotas are the largest exact ones that the counts allow without repeating a document.
    """
    on = {s: w for s, w in weights.items() if w > 0 and counts.get(s, 0) > 0}
    if not on:
        return {}
    if total is None:
        total = min(counts[s] / w for s, w in on.items())
        return {s: q for s, w in on.items() if (q := min(counts[s], int(total * w + 1e-6))) > 0}
    room = {s: counts[s] * repeats for s in on}
    order = sorted(on, key=lambda s: (room[s] / on[s], s))
    rest = np.cumsum([on[s] for s in reversed(order)])[::-1]
    left = min(total, sum(room.values()))
    out: dict[str, int] = {}
    k = 0
    while k < len(order) and room[order[k]] * rest[k] <= left * on[order[k]]:
        out[order[k]] = room[order[k]]
        left -= room[order[k]]
        k += 1
    share = {s: left * on[s] / rest[k] for s in order[k:]}
    out |= {s: min(int(x), room[s]) for s, x in share.items()}
    lack = left - sum(out[s] for s in share)
    for s in sorted(share, key=lambda s: (int(share[s]) - share[s], s))[:lack]:  # largest remainders
        out[s] += 1
    return {s: q for s, q in out.items() if q > 0}


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among ``sample`` drawn without replacement. For counts beyond numpy's, by inversion over nine standard deviations on either side of the mean, beyond which less than the rounding of a double is left."""
    n = good + bad
    if n < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    mean = sample * (good / n)
    deviation = np.sqrt(mean * (bad / n) * ((n - sample) / (n - 1)))
    lo, hi = max(0, sample - bad, int(mean - 9 * deviation - 10)), min(good, sample, int(mean + 9 * deviation + 10))
    k = np.arange(lo, hi, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (sample - k) / ((k + 1) * (bad - sample + k + 1))))])
    p = np.cumsum(np.exp(log - log.max()))
    return lo + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def draw(rng: np.random.Generator, blocks: np.ndarray, sample: int) -> np.ndarray:
    """A multivariate-hypergeometric draw, source by source."""
    if blocks.sum() < 10**9:
        return rng.multivariate_hypergeometric(blocks, sample, method="marginals")
    out, rest = np.zeros(len(blocks), np.int64), int(blocks.sum())
    for i, n in enumerate(blocks.tolist()):
        rest -= n
        out[i] = hypergeometric(rng, n, rest, sample)
        sample -= int(out[i])
    return out


def _halves(shards: tuple[int, int], blocks: np.ndarray, per_shard: int, seed: int):
    a, b = shards
    mid = (a + b) // 2
    room = min((mid - a) * per_shard, int(blocks.sum()))
    left = draw(np.random.default_rng([seed, a, b]), blocks, room)
    return ((a, mid), left), ((mid, b), blocks - left)


def split(shards: tuple[int, int], first: np.ndarray, blocks: np.ndarray, per_shard: int, seed: int, until: int):
    """Nodes of at most ``until`` shards: their shards, the first block of each source and the blocks of each source."""
    if shards[1] - shards[0] <= until:
        yield shards, first, blocks
        return
    (ls, lb), (rs, rb) = _halves(shards, blocks, per_shard, seed)
    yield from split(ls, first, lb, per_shard, seed, until)
    yield from split(rs, first + lb, rb, per_shard, seed, until)


def _leaves(per_shard: int, seed: int):
    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                rows = []
                for (a, _), first, blocks in split((r.a, r.b), np.array(r.first, np.int64), np.array(r.blocks, np.int64), per_shard, seed, 1):
                    rows += [(s, int(lo), int(lo + n), a) for s, (lo, n) in enumerate(zip(first, blocks)) if n]
                yield pd.DataFrame(rows, columns=["s", "lo", "hi", "shard"]).astype({"s": "int32", "lo": "int64", "hi": "int64", "shard": "int64"})

    return run


def _mixed(docs: DataFrame, kept: list[str], weights, temperature: float, block: int, per_shard: int, seed: int, total: int | None, repeats: int) -> DataFrame | None:
    """Rows (row, shard, position); row has docs' columns ``kept``."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    # what tells rows of one doc_id, or without one, apart; rows that are equal throughout may change places
    content = F.xxhash64(*(f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", key, F.when(F.col("doc_id").isNull(), content)), 1)
    counts = {r[0]: r[1] for r in docs.groupBy(key.alias("k")).count().collect()}
    if weights is None:
        given = {k: float(n) ** temperature for k, n in counts.items()}
        total = sum(counts.values()) if total is None else total
    else:
        given = {"null" if k is None else f"s{k}": float(w) for k, w in weights.items() if k is not REST}
        others = {k: float(n) ** temperature for k, n in counts.items() if k not in given}
        given |= {k: weights.get(REST, 0.0) * x / sum(others.values()) for k, x in others.items()}
    quota = quotas(counts, given, total, repeats)
    if not quota:
        return None
    names = sorted(quota)
    blocks = np.array([-(-quota[s] // block) for s in names], np.int64)
    shards = -(-int(blocks.sum()) // per_shard)
    top = [(a, b, first.tolist(), n.tolist()) for (a, b), first, n in split((0, shards), np.zeros(len(names), np.int64), blocks, per_shard, seed, TOP)]
    nodes = spark.createDataFrame(top, "a long, b long, first array<long>, blocks array<long>").repartition(min(len(top), 1000))
    leaves = nodes.mapInPandas(_leaves(per_shard, seed), "s int, lo long, hi long, shard long")
    leaves = leaves.select("s", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("block"))
    table = spark.createDataFrame([(i, s, quota[s], counts[s]) for i, s in enumerate(names)], "s int, k string, quota long, count long")
    table = F.broadcast(table) if len(names) <= 10_000 else table
    leaves = leaves.join(table, "s").select("k", "block", "shard")

    bits = max(0, int(np.ceil(np.log2(max(1, sum(counts.values()) / BUCKET)))))
    rows = docs.select(F.struct(*(f"`{c}`" for c in kept)).alias("row"), F.col("doc_id").alias("id"), key.alias("k"), h.alias("h"), content.alias("content"))
    bucket = F.shiftrightunsigned("h", 63 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("bucket", bucket)
    sizes = docs.select(key.alias("k"), h.alias("h")).withColumn("bucket", bucket).groupBy("k", "bucket").count()
    sizes = sizes.select("k", "bucket", (F.sum("count").over(Window.partitionBy("k").orderBy("bucket")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("k", "bucket").orderBy("h", "id", "content")) - 1
    rows = rows.withColumn("within", rank).join(sizes, ["k", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    # the runs of a source that is repeated go on through its permutation again
    rows = rows.join(table.select("k", "quota", "count"), "k").where("rank < quota").withColumn("rank", F.explode(F.sequence("rank", F.col("quota") - 1, "count")))
    rows = rows.withColumn("block", F.floor(F.col("rank") / block)).join(leaves, ["k", "block"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "id", "k", "rank"), "k", "rank")
    return rows.select("row", "id", "shard", (F.row_number().over(local) - 1).alias("position"))


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE, block: int = BLOCK, per_shard: int = PER_SHARD, seed: int = SEED, total: int | None = None, repeats: int = REPEATS) -> DataFrame:
    """``(doc_id, source, shard, position)`` of the documents drawn; position counts from 0 within its shard.

    weights maps sources (None for a null source) to shares; sources that aren't in it share that of REST at their counts to the power of temperature, or get none. By default each source's share goes with its
    count to the power of temperature, and the total is the number of documents. With a total, documents of rare sources are drawn up to ``repeats`` times to meet their shares,
    and what a source still lacks goes to the others. Given weights without a total are met exactly, by the largest quotas that repeat no document. All shards have per_shard blocks but the last;
    blocks have ``block`` documents but the last of each source. Each row counts as a document: null doc_ids and repeated rows
    are drawn like others; rows of one doc_id are told apart, and rows without one spread, by a hash of all columns. Texts, however long, count for that only. Of an empty table, or without positive weights, nothing is drawn. Other columns are ignored.
    """
    base = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string")})
    out = _mixed(base, ["doc_id", "source"], weights, temperature, block, per_shard, seed, total, repeats)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, source string, shard long, position int")
    return out.select("row.doc_id", "row.source", "shard", "position")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents drawn by ``mix``, with all their columns, in order of shard and position, whole shards to a partition."""
    how = {"weights": None, "temperature": TEMPERATURE, "block": BLOCK, "per_shard": PER_SHARD, "seed": SEED, "total": None, "repeats": REPEATS} | how
    out = _mixed(docs, docs.columns, **how)
    if out is None:
        return docs.limit(0)
    return out.sortWithinPartitions("shard", "position").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS)


#: Draws from a seeded generator have no SQL form; tests check quotas, disjointness and the tree's distribution.
SQL = None
