"""The long SQL statements against the operators, where the shared tables do not reach: several blocks, overlaps, deep paths."""

import duckdb
import pytest

from tesserae.llm import licences, mixing, oracles, queries

SF = "/root/testdata/sf0.001"


def same(got, sql, **views):
    con = duckdb.connect()
    for name, rows in views.items():
        con.register(name, rows) if not isinstance(rows, str) else con.sql(f"create view {name} as select * from '{rows}'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert sorted(got.columns) == columns and rows == sorted(want.select(*columns).fetchall(), key=repr)
    return rows


@pytest.mark.parametrize("repetition", [1.05, 1.25])
def test_mixing_over_many_blocks(spark, repetition):
    path = f"{SF}/documents.parquet"
    d = spark.read.parquet(path).select("doc_id", "text", "source")
    got = mixing.mixed_epochs(d, repetition=repetition, block_docs=4)
    got = got.selectExpr("doc_id", "source", "_epoch as epoch", "_block as block", "_position as position", "_tokens as n_tokens")
    rows = same(got, oracles.op9_sql(repetition, 4), documents=path)
    assert len({r[0] for r in rows}) > 1


def test_licences_that_overlap(spark, tmp_path):
    t = licences.TEMPLATES
    texts = [t["AGPL-3.0"][1] + " x " + t["MIT"][0], t["BSD-3-Clause"][1], t["BSD-2-Clause"][1] + " é " + t["Apache-2.0"][1], "Released under the MIT", "", None, "licensed under CC BY 4.0 " * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = same(queries.op10_licence_scan(spark, str(tmp_path)), oracles.op10_sql(), documents=f"{tmp_path}/documents.parquet/*.parquet")
    assert sorted(r[-1] for r in rows) == [0, 0, 0, 1, 1, 2, 2]


def test_url_templates_of_mixed_depth(spark, tmp_path):
    urls = [f"https://H.example/{'abc'[i % 3]}/{i % 2}/x{i}/{i}.html?q" for i in range(60)] + [f"http://h.example/en/{i}" for i in range(30)]
    urls += ["http://a.net", "no url", None, "http://x.org/fr/1", "http://h.example/a/b/c/d/e/f/g/h/1"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(i, i % 2, None if i % 7 == 0 else int(i % 3 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    rows = same(queries.op6_url_filter(spark, str(tmp_path)), oracles.op6_sql(), pages=f"{tmp_path}/pages.parquet/*.parquet", labels=f"{tmp_path}/labels.parquet/*.parquet")
    assert len({r[-2] for r in rows}) > 4
