"""Queries on planted pages give the same rows as their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

PAGES = [
    (1, "<title>A &amp; B&amp</title>"), (2, "<title>&amp;&amp;&am</title>"), (3, "<title>x &lt</title>"), (4, "<title>&quot;a&quot; &#39;b&#39; &amp;lt; &nbsp</title>"), (5, "<title>&#39</title>"), (6, "no title"),
    (7, '<body><h1>Cut &amp</h1> <a href="/a">x</a> 1.250,50 kr</body>'), (8, '<body><a href="b">And &amp; more&lt</a> 30</body>'), (9, '<body><h1>None</h1> 30</body>'),
]


@pytest.mark.parametrize("name", ["entity_decode", "page_listing"])
def test_entities_cut_at_the_end_of_a_title_stay(spark, tmp_path, name):
    rows = [(i, f"https://a.example/x/{i}", html) for i, html in PAGES]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
