"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from textloom.operators import search as se
    from textloom.operators.index import build
    from textloom.plans.config import TEXT
    from textloom.plans.query import MUST_NOT, SHOULD, Boolean, Term, should
    from textloom.sources.store import Store

    base = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.checkpoint.dir", base).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def run(name, f, times=2):
        best = None
        for _ in range(times):
            t = time.time()
            f()
            best = min(best or 1e9, time.time() - t)
        took[name] = round(best, 3)
        print(name, took[name], file=sys.stderr, flush=True)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").repartition(2 * int(CPUS))  # one row group, else one task
    T = lambda t: Term(field="text", term=t)
    three = should(T("hash"), T("ingre"), T("und"))
    other = Boolean(clauses=(*three.clauses, (MUST_NOT, T("ung"))))
    try:
        store = Store(spark, f"{base}/index", {"text": TEXT})

        def index():
            store.rollback()
            store.add(docs)

        run("b1_index", index)
        store.commit()
        ix = store.index()
        run("b2_term", lambda: se.top(se.search(ix, T("hash")), 10).collect(), 3)
        run("b3_or3", lambda: se.top(se.search(ix, three), 10).collect(), 3)
        run("b4_or3_not", lambda: se.top(se.search(ix, other), 10).collect(), 3)
        some = [r[0] for r in ix.stats.where("doc_freq between 20 and 200").orderBy("term").limit(300).select("term").collect()]
        batch = spark.createDataFrame([(i // 3, t) for i, t in enumerate(some)], "query_id int, term string")
        run("b5_batch100", lambda: noop(se.search_batch(ix, batch, "text", 10)))
        run("b6_or3_inline", lambda: se.top(se.search(build(docs, {"text": TEXT}), three), 10).collect())
        run("tokenize", lambda: noop(build(docs, {"text": TEXT}).norms))
        run("postings", lambda: noop(build(docs, {"text": TEXT}).postings.select("term", "doc_id", "freq")))
        run("term_stats", lambda: noop(build(docs, {"text": TEXT}).term_stats()))
        run("count", lambda: docs.agg(F.count("*")).collect())
        try:
            from textloom.llm.registry import QUERIES
        except ImportError:
            QUERIES = {}
        for name, (f, _) in QUERIES.items():
            run(name, lambda f=f: noop(f(spark, DIR)), 1)
    finally:
        spark.stop()
        shutil.rmtree(base, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
