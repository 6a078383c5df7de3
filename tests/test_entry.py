"""The driver contract: entry runs, and a few queries give DuckDB's rows at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["knn_cosine_topk", "bfs_radius_capped", "cover_ratio_recall", "ppr_topk", "import_two_pass", "subgraph_features_h2", "token_windows", "hll_cardinality", "surrogate_keys"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "documents", "conversations", "benchmark", "labels", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    r = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    want = sorted((tuple(plain(row[names.index(c)]) for c in df.columns) for row in r.fetchall()), key=key)
    assert sorted((tuple(plain(x) for x in row) for row in df.collect()), key=key) == want
