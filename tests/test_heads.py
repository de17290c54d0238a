"""Titles, languages and charsets of odd heads: the query and its SQL state one rule."""

import duckdb

from webgrain.plans import registry

HEADS = [
    '<html lang="en"><title>a &quot;b&quot; &#39;c&#x27; &amp;lt;</title><meta charset="utf-8">', "<HTML class=x LANG='de'><TITLE id=1>two\n lines</TITLE><META charset=latin1>", "<html lang=fr><title> </title>", '<html lang="">', "", None,
    "<html lang='a&amp;b'><title>&#0;&#xD800;&#99999999999;&#128512;&#00065; &apos;&nbsp;&eacute;</title>", '<html lang="" x><title>one</title><title>two</title><meta http-equiv=x content="text/html; charset=koi8-r">', "<html\x0blang = \"x\"><title>t\x0b\x0bu</title>",
]


def test_heads(spark, tmp_path):
    # Odd and even ids of each.
    rows = [(2 * i + odd, f"http://h/{i}", h) for i, h in enumerate(HEADS) for odd in (0, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_titles", "merged_metadata"):
        want = con.sql(f"SELECT * FROM ({registry.oracle_sql()[name]}) ORDER BY page_id")
        got = registry.queries()[name](spark, str(tmp_path)).orderBy("page_id").select(*want.columns).collect()
        assert [tuple(r) for r in got] == want.fetchall(), name
