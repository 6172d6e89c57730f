"""Indexing of a stream: each micro-batch becomes a segment and a commit."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from textloom.sources.store import Store


def stream_id(store: Store, checkpoint: str) -> str:
    """The identity that a stream keeps for as long as its checkpoint is there."""
    fs, p = store._fs(f"{checkpoint.rstrip('/')}/metadata")
    stream = fs.open(p)
    try:
        text = store.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)["id"]


def latest(batch: DataFrame, doc_id: str, order: Column) -> DataFrame:
    """One row of each doc_id: the one that comes last by order; of equal ones that of the greatest hash of all columns."""
    row_hash = F.xxhash64(*(F.col(f"`{c}`") for c, kind in batch.dtypes if "map<" not in kind))
    # a window moves each row once; max_by of a whole row would sort texts on both sides of the shuffle
    last = Window.partitionBy(F.col(doc_id)).orderBy(order.desc(), row_hash.desc())
    return batch.withColumn("textloom_place", F.row_number().over(last)).where("textloom_place = 1").drop("textloom_place")


def index_stream(stream: DataFrame, store: Store, checkpoint: str, upsert: bool = True, order: Column | None = None, valid: Column | None = None, rejects: str | None = None, **trigger) -> StreamingQuery:
    """Starts indexing a stream into a store; trigger as of DataStreamWriter.trigger, availableNow by default.

    The commit of a batch carries its number under the identity in the stream's checkpoint, so a batch that is replayed after a failure isn't indexed twice, and streams with checkpoints of
    their own don't get in each other's way. With upsert, a document replaces the one of its doc_id; of several in one batch the last by ``order`` counts (without an order, the one of the greatest hash).

    Rows without a doc_id, and those for which ``valid`` isn't true, aren't indexed; they are appended to the table ``rejects``, if given, with the batch's number. A batch that fails otherwise is rolled back whole.
    """

    def one(batch: DataFrame, number: int) -> None:
        name = f"stream {stream_id(store, checkpoint)}"
        if int(store.state["user_data"].get(name, -1)) >= number:
            return
        good = F.col(store.doc_id).isNotNull() & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
        try:
            if rejects:
                # the batch's own folder, so that a replay writes the same rows again and no others
                batch.where(~good).write.mode("overwrite").parquet(f"{rejects.rstrip('/')}/stream={stream_id(store, checkpoint)}/batch={number}")
            batch = batch.where(good)
            if upsert:
                store.update(latest(batch, store.doc_id, F.lit(0) if order is None else order))
            else:
                store.add(batch)
            store.compact()
            store.commit({name: number})
        except Exception:
            store.rollback()
            raise

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
