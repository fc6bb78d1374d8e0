"""Sections of web pages against their SQL, where several pages have one URL."""

import duckdb

import __spark_entry__ as entry

PAGES = [
    ("http://a.example/x", "<h1>One</h1><p>first</p><h2>Two</h2><p>second</p>"),
    ("http://a.example/x", "<h1>Uno</h1><p>primo</p><p>more</p><h2>Due</h2>"),
    ("http://a.example/x", "<p>no heading at first</p><h3>Three</h3><p>third</p>"),
    ("http://a.example/y?q=1", "<p>intro</p><h1>Same</h1><p>body</p>"),
    ("http://a.example/y?q=1", "<p>intro</p><h1>Same</h1><p>body</p>"),
    ("http://a.example/z/", "<p>only an intro</p>"),
    ("http://a.example/z/", None),
    ("http://a.example/w", "<h1>Alone</h1>text"),
]


def test_pages_of_one_url_are_read_side_by_side(spark, tmp_path):
    for n, order in enumerate((PAGES, PAGES[::-1])):
        rows = [(i, url, html) for i, (url, html) in enumerate(order)]
        own = tmp_path / str(n)
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{own}/pages.parquet")
        con = duckdb.connect()
        con.sql(f"create view pages as select * from '{own}/pages.parquet/*.parquet'")
        want = con.sql(entry.oracle_sql()["page_sections"]).fetchall()
        got = [tuple(r) for r in entry.queries()["page_sections"](spark, str(own)).collect()]
        assert sorted(got) == sorted(want) and len(want) == 8
