"""Shared storage, written tables and connected groups."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Folders of all Tables of this process, in the order in which they were made.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir`` of the session.

    Only on a ``local`` master, where there is one machine, a temporary folder
    stands in for an unset setting; elsewhere an unset setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


class Tables:
    """Parquet tables in the shared folder, under one name for each use of an operator.

    Writing a table cuts lineage: later stages reread the files, so the loss of
    an executor never recomputes what came before. ``drop`` removes tables that no later
    plan reads; those that the result reads stay until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
        _MADE.append(self.base)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def made() -> int:
    """How many folders there are so far, for ``sweep``."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int) -> None:
    """Removes the tables of operators that began since then: for when their result is written and no plan reads them any more."""
    sc = spark.sparkContext
    for base in _MADE[since:]:
        path = sc._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    del _MADE[since:]


def groups(edges: DataFrame, tables: Tables, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """Connected groups of an edge list: ``(node, root)`` with root the least node of each group.

    Alternates large-star and small-star steps, each written to the shared folder, until the
    edges stop changing; the number of rounds grows with the logarithm of the longest path.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur, k, before = tables.write(ends, "cc0"), 0, None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        cur = tables.write(small, f"cc{k}")
        tables.drop(f"cc{k - 1}")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
