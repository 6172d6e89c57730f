"""Registered queries against their SQL, on small tables."""

import pytest

from textloom.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["tokenize_lower", "token_offsets", "postings_positions", "field_length_norm", "index_time_boost", "golden_query", "bool_mixed", "bool_nested", "phrase_query", "fuzzy_query", "multi_field_search", "multi_valued_field", "batch_search", "delete_by_term", "merge_compaction", "merge_tiered", "streaming_upsert", "murmur3_x86_32", "long_token_skip", "segment_names", "packed_sizes", "versions", "utf16_validity", "bit_sets", "bit_set_walk", "string_set", "check_index", "regexp_nested_complement", "rolling_hash", "bit_scalars"]


@pytest.fixture(scope="module")
def duck(tiny):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_is_its_sql(spark, tiny, duck, name):
    f, sql = QUERIES[name]
    got, want = f(spark, tiny).toPandas(), duck.execute(sql).df()
    key = sorted(want.columns)
    assert sorted(got.columns) == key
    rows = lambda p: sorted(map(tuple, p[key].astype(object).values.tolist()), key=str)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 50, out.stderr
