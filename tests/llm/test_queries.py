"""Registered queries against their SQL, and the pipeline's stages."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from wayfare.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


def test_registered():
    q = E.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert q["pipeline"] is P.run
    assert set(queries.SQL) <= set(queries.QUERIES) and set(queries.SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    res = duck.execute(queries.SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(cols, res.fetchall())


@pytest.mark.parametrize("name", ["op8_html_text", "op9_url_filter"])
def test_page_queries_return_every_page(spark, name):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = queries.QUERIES[name](spark, SF)
    assert sorted(r[0] for r in got.select("page_id").collect()) == sorted(r[0] for r in pages.select("page_id").collect())


def test_pipeline(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, seen = docs.columns, []
    for name, stage in P.STAGES:
        out = P.written(stage(spark, docs, SF))
        seen.append((name, {r["doc_id"] for r in out.select("doc_id").collect()}))
        if name != P.STAGES[-1][0]:
            assert out.columns == cols, name
        docs = out
    ids = dict(seen)
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({queries.SQL['op6_quality_rules']}) WHERE kept").fetchall()}
    assert ids["quality_rules"] == kept
    duck.execute("CREATE VIEW all_documents AS SELECT * FROM documents")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM read_parquet('{SF}/documents.parquet') WHERE doc_id IN ({','.join(map(str, kept))})")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    one = {r[0] for r in con.execute(f"SELECT DISTINCT component_id FROM ({queries.SQL['op3_ngram_jaccard']})").fetchall()}
    assert ids["near_duplicates"] == one
    con.execute(f"DELETE FROM documents WHERE doc_id NOT IN ({','.join(map(str, one))})")
    clean = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.SQL['op7_decontaminate']}) WHERE NOT contaminated").fetchall()}
    assert ids["decontaminate"] == clean
    assert ids["mix_sources"] <= clean and ids["shard"] == ids["mix_sources"]
    shards = docs.groupBy("shard").count().collect()
    assert len(shards) == P.SHARDS and max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1
