"""Rows of tables: pages of bare tags are read without the parser and give the same, in batches as by the table function."""

import re

import pytest

from webgrain.functions import parts
from webgrain.operators import html

PAGES = [
    "<body><table><caption> order 7</caption><thead><tr><th>line<th>flag<th>&amp;</tr></thead><tbody><tr><td>1<td><b>N</b></tr></tbody></table>",
    "<TABLE><tr><td>a &lt b</TD><td>c<p>d</tr><tr><td>&#65;&copy</table>text<table></table><table><tr><td><table><tr><td>in</table>",
    "x < y <table><tr><td>1</table>",
    "<table><tr><td colspan=2>1<td>2<!-- <td>3 --></table>",
    "<title><table><tr><td>1</table></title><table><tr><td>2 &",
    "",
    None,
]


def test_plain_pages_need_no_parser(monkeypatch):
    plain = [p or "" for p in PAGES if html.PLAIN.fullmatch(p or "")]
    assert len(plain) == 4
    with monkeypatch.context() as m:
        m.setattr(html, "PLAIN", re.compile("(?!)"))
        want = [html.found_tables(p) for p in PAGES]
    assert [html.found_tables(p) for p in PAGES] == want
    monkeypatch.setattr(html.Tree, "feed", lambda *a: pytest.fail("parsed"))
    assert [html.found_tables(p) for p in plain] == [w for p, w in zip(PAGES, want, strict=True) if (p or "") in plain]


def test_rows_in_batches(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id bigint, html string")
    parts.register(spark)
    want = spark.sql("SELECT page_id, t.* FROM {pages} p, LATERAL table_rows(p.html) t", pages=pages).collect()
    got = html.table_rows(pages, "page_id", "html")
    assert sorted(got.collect()) == sorted(want) and len(want) > 5
    assert got.where("page_id < 0").count() == 0 and html.table_rows(pages.limit(0), "page_id", "html").count() == 0
