"""Queries on made rows: each operator on a few rows that show its rules, with the expected rows stated as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webgrain.functions import citations, text, urls
from webgrain.operators import graph, html, records, schedule
from webgrain.plans.registry import golden
from webgrain.sources import providers, web


def rows_sql(columns: str, *rows: tuple) -> str:
    """Expected rows as SQL."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


def typed(sql: str, **types: str) -> str:
    """The same with column types, where a column may be all null or a number needs a width."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in types.items())}) FROM ({sql})"


def made(spark, schema: str, *rows: tuple):
    return spark.createDataFrame(list(rows), schema)


@golden("page_ranges", typed(rows_sql("spec, first, last", ("3", 3, 3), ("2-5", 2, 5), ("4-", 4, 10), ("-3", 1, 3), ("", 1, 10), ("-", 1, 10), ("5-2", None, None), ("0", None, None), ("x", None, None), ("2-99", 2, 10)), first="BIGINT", last="BIGINT"))
def page_ranges(spark, sf_dir):
    specs = ["3", "2-5", "4-", "-3", "", "-", "5-2", "0", "x", "2-99"]
    return made(spark, "spec string", *((s,) for s in specs)).select("spec", text.page_range(F.col("spec"), F.lit(10)).alias("r")).select("spec", "r.first", "r.last")


@golden("normal_dois", typed(rows_sql("raw, doi", ("10.1234/ABC", "10.1234/abc"), ("doi:10.1234/x", "10.1234/x"), ("https://doi.org/10.1000/1%2F2", "10.1000/1/2"), ("http://dx.doi.org/10.1000/q?x=1", None), ("not a doi", None), (None, None)), raw="VARCHAR", doi="VARCHAR"))
def normal_dois(spark, sf_dir):
    raw = ["10.1234/ABC", "doi:10.1234/x", "https://doi.org/10.1000/1%2F2", "http://dx.doi.org/10.1000/q?x=1", "not a doi", None]
    return made(spark, "raw string", *((r,) for r in raw)).select("raw", text.normal_doi(F.col("raw")).alias("doi"))


@golden("found_dois", rows_sql("raw, doi", ("see 10.1234/ab.c, and", "10.1234/ab.c"), ("(10.5555/x)", "10.5555/x"), ("none", None)))
def found_dois(spark, sf_dir):
    raw = ["see 10.1234/ab.c, and", "(10.5555/x)", "none"]
    return made(spark, "raw string", *((r,) for r in raw)).select("raw", text.find_doi(F.col("raw")).alias("doi"))


@golden("arxiv_ids", rows_sql("raw, id", ("https://arxiv.org/abs/2401.00001v2", "2401.00001"), ("arXiv:2401.00001", "2401.00001"), ("http://arxiv.org/pdf/2401.00002v1.pdf", "2401.00002"), ("hep-th/9901001", "9901001"), (" ", None)))
def arxiv_ids(spark, sf_dir):
    raw = ["https://arxiv.org/abs/2401.00001v2", "arXiv:2401.00001", "http://arxiv.org/pdf/2401.00002v1.pdf", "hep-th/9901001", " "]
    return made(spark, "raw string", *((r,) for r in raw)).select("raw", text.normal_arxiv(F.col("raw")).alias("id"))


@golden("url_errors", rows_sql("raw, url, error", ("example.com/a", "https://example.com/a", None), ("//x.org/p", "https://x.org/p", None), ("a b.com", None, "spaces"), ("./x", None, "local path"), ("word", None, "no url"), ("file.pdf", None, "local path"), ("ftp://x.org", None, "scheme"), ("", None, "empty"), ("http://", None, "no host")))
def url_errors(spark, sf_dir):
    raw = ["example.com/a", "//x.org/p", "a b.com", "./x", "word", "file.pdf", "ftp://x.org", "", "http://"]
    return made(spark, "raw string", *((r,) for r in raw)).select("raw", urls.normalize_url(F.col("raw")).alias("n")).select("raw", "n.url", "n.error")


@golden("joined_urls", rows_sql("raw, url", ("/a", "http://h.org/a"), ("b?x=1", "http://h.org/d/b?x=1"), ("../c", "http://h.org/c"), ("https://o.net/", "https://o.net/")))
def joined_urls(spark, sf_dir):
    raw = ["/a", "b?x=1", "../c", "https://o.net/"]
    return made(spark, "raw string", *((r,) for r in raw)).select("raw", urls.normalize_url(F.col("raw"), F.lit("http://h.org/d/e"))["url"].alias("url"))


@golden("canonical_urls", rows_sql("raw, canonical", ("HTTP://User@WWW.Ex.org:80/a/;p?B=2&a=1&utm_source=x#f", "http://ex.org/a?a=1&b=2"), ("https://ex.org:8443//?q=a+b%7E*", "https://ex.org:8443/?q=a+b~%2A"), ("not a url", None)))
def canonical_urls(spark, sf_dir):
    raw = ["HTTP://User@WWW.Ex.org:80/a/;p?B=2&a=1&utm_source=x#f", "https://ex.org:8443//?q=a+b%7E*", "not a url"]
    return made(spark, "raw string", *((r,) for r in raw)).select("raw", urls.canonical_url(F.col("raw"), "drop-tracking").alias("canonical"))


@golden("private_addresses", rows_sql("ip, private", ("10.1.2.3", True), ("8.8.8.8", False), ("192.0.0.9", False), ("192.0.0.1", True), ("172.32.0.1", False), ("::1", True), ("::ffff:10.0.0.1", True), ("2606:4700::1111", False), ("fe80::1", True), ("name", None)))
def private_addresses(spark, sf_dir):
    ips = ["10.1.2.3", "8.8.8.8", "192.0.0.9", "192.0.0.1", "172.32.0.1", "::1", "::ffff:10.0.0.1", "2606:4700::1111", "fe80::1", "name"]
    return made(spark, "ip string", *((i,) for i in ips)).select("ip", urls.private_ip(F.col("ip")).alias("private"))


@golden("fetch_errors", rows_sql("url, error", ("http://localhost/x", "internal name"), ("https://a.internal", "internal name"), ("http://10.0.0.1:80/", "private address"), ("http://[::1]/", "private address"), ("ftp://x.org/", "scheme"), ("http://x.org:99999/", "port"), ("http://x.org/", None)))
def fetch_errors(spark, sf_dir):
    raw = ["http://localhost/x", "https://a.internal", "http://10.0.0.1:80/", "http://[::1]/", "ftp://x.org/", "http://x.org:99999/", "http://x.org/"]
    return made(spark, "url string", *((r,) for r in raw)).select("url", urls.fetch_error(F.col("url")).alias("error"))


@golden("public_hosts", rows_sql("host, public", ("a.org", True), ("b.org", False), ("c.org", False)))
def public_hosts(spark, sf_dir):
    dns = made(spark, "host string, ip string", ("a.org", "8.8.8.8"), ("a.org", "1.1.1.1"), ("b.org", "8.8.8.8"), ("b.org", "10.0.0.2"))
    return graph.public_hosts(made(spark, "host string", ("a.org",), ("b.org",), ("c.org",)), dns)


ROBOTS = "Disallow: /early\nUser-agent: *\nDisallow: /private/\nAllow: /private/open\nCrawl-delay: 2\nUser-agent: grain\nDisallow: /*.zip$\nDisallow: /x # note\nAllow: /x/y"


@golden("robots_allowed", rows_sql("url, allowed", ("http://h/private/a", True), ("http://h/a.zip", False), ("http://h/a.zip?x", True), ("http://h/x/1", False), ("http://h/x/y/2", True), ("http://h", True)))
def robots_allowed(spark, sf_dir):
    rules = web.robots_rules(made(spark, "host string, body string", ("h", ROBOTS)), "grain")
    raw = ["http://h/private/a", "http://h/a.zip", "http://h/a.zip?x", "http://h/x/1", "http://h/x/y/2", "http://h"]
    return web.robots_allowed(made(spark, "host string, url string", *(("h", r) for r in raw)), rules).select("url", "allowed")


@golden("robots_delay", typed(rows_sql("host, delay", ("h", 2.0)), delay="DOUBLE"))
def robots_delay(spark, sf_dir):
    return web.robots_rules(made(spark, "host string, body string", ("h", ROBOTS)), "grain").select("host", "delay").distinct()


RSS = "<rss><channel><title>c</title><item><title>One</title><link>http://a/1</link><pubDate>Mon</pubDate><description><![CDATA[d <b>1</b>]]></description></item><item><title>Two</title><link>http://a/2</link></item></channel></rss>"
ATOM = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="http://a/e"/><updated>2024</updated><summary>s</summary></entry></feed>'


@golden("feed_items", typed(rows_sql("url, pos, title, link, date, total", ("r", 0, "One", "http://a/1", "Mon", 2), ("r", 1, "Two", "http://a/2", None, 2), ("a", 0, "E", "http://a/e", "2024", 1)), pos="INTEGER", total="INTEGER"))
def feed_items(spark, sf_dir):
    return web.feed_items(made(spark, "url string, body string", ("r", RSS), ("a", ATOM), ("n", None))).select("url", "pos", "title", "link", "date", "total")


@golden("feed_links", typed(rows_sql("page_id, pos, href, type", (1, 1, "/f.xml", "application/rss+xml")), page_id="BIGINT", pos="INTEGER"))
def feed_links(spark, sf_dir):
    page = '<link rel="stylesheet" href="/s.css"><link rel="alternate" type="application/rss+xml" href="/f.xml"><link rel="alternate" hreflang="de" href="/de">'
    return html.feed_links(made(spark, "page_id long, html string", (1, page)), "page_id", "html")


@golden("sitemap_urls", typed(rows_sql("root, pos, url", ("s", 0, "http://h/1"), ("s", 1, "http://h/2"), ("s", 2, "http://h/3")), pos="INTEGER"))
def sitemap_urls(spark, sf_dir):
    maps = made(spark, "url string, body string", ("s", "<sitemapindex><sitemap><loc> a </loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc>http://h/1</loc></url><url><loc>http://h/2</loc></url></urlset>"), ("b", "<urlset><url><loc>http://h/2</loc></url><url><loc>http://h/3</loc></url></urlset>"))
    return web.sitemap_urls(maps, made(spark, "url string", ("s",))).drop("truncated")


@golden("sitemaps_in_depth", typed(rows_sql("root, pos, url, truncated", ("http://h/s.xml", 0, "http://h/late", False), ("http://h/s.xml", 1, "http://h/deep.xml", False), ("http://h/s.xml", 2, "http://h/p1", False), ("http://m/s.xml", 0, "http://m/1", True), ("http://m/s.xml", 1, "http://m/2", True)), pos="INTEGER"))
def sitemaps_in_depth(spark, sf_dir):
    """Three hops of index files, the last one's entries being pages, in the order read; relative addresses, a loop, and a cut list."""
    index = lambda *locs: "<?xml version='1.0'?>\n<sitemapindex xmlns='x'>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    urls_ = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    maps = [("http://h/s.xml", index("a.xml", "http://h/b.xml", "/s.xml")), ("http://h/a.xml", index("a2.xml")), ("http://h/b.xml", urls_("late")), ("http://h/a2.xml", index("a3.xml", "u.xml")), ("http://h/u.xml", urls_("p1", "late")), ("http://h/a3.xml", index("deep.xml")), ("http://m/s.xml", urls_(*(f"{i}" for i in (1, 1, 2, 3))))]
    return web.sitemap_urls(made(spark, "url string, body string", *maps), made(spark, "url string", ("http://h/s.xml",), ("http://m/s.xml",)), each=3)


TABLE = "<table><caption>Cap</caption><tr><th>A</th><th colspan=2>B</th></tr><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr><tr><td>4</td></tr></table><table></table><table><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table>"


@golden("html_tables", typed(rows_sql("table_no, name, headers, cells", (0, "Cap", "A|B|", "1,2,3;,4,"), (1, "table-2", "", "xin")), table_no="INTEGER"))
def html_tables(spark, sf_dir):
    t = html.tables(made(spark, "page_id long, html string", (1, TABLE)), "page_id", "html")
    return t.select("table_no", "name", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


HIDDEN = "<body><div hidden>a</div><p>Seen <b>bold</b> <a href='/l'>link</a><p style='display: none'>b</p><noscript>n</noscript><h2>T</h2><ul><li>i<li>j</ul></body>"


@golden("markdown_of_page", typed(rows_sql("label, removed, markdown", ("body", 3, "Seen **bold** [link](/l)\n\n## T\n\n- i\n- j")), removed="INTEGER"))
def markdown_of_page(spark, sf_dir):
    return html.inspect(made(spark, "page_id long, html string", (1, HIDDEN)), "page_id", "html").select("label", "removed", "markdown")


RECORD = "title string, authors array<string>, year string, month string, day string, doi string, url string, venue string, publisher string, abstract string, kind string"
RECORDS = (("A & B", ["Ada Lovelace", "Babbage, C."], "1843", "10", None, "10.1/x_y", None, "Notes", None, "An  abstract", None), ("T", [], None, None, None, None, "http://u", None, "P", None, "proceedings"))


def _records(spark):
    return made(spark, RECORD, *RECORDS).select(F.struct("*").alias("r"))


@golden("bibtex", rows_sql("bibtex", ("@article{lovelace1843,\n  author=Ada Lovelace and Babbage, C.,\n  title=A \\& B,\n  journal=Notes,\n  year=1843,\n  doi=10.1/x\\_y,\n}",), ("@inproceedings{unknown0000,\n  title=T,\n  publisher=P,\n  url=http://u,\n}",)))
def bibtex(spark, sf_dir):
    return _records(spark).select(citations.bibtex(F.col("r")).alias("bibtex"))


@golden("apa", rows_sql("apa", ("Lovelace, A., Babbage, C. (1843). A & B. *Notes* https://doi.org/10.1/x_y",), (". T.  http://u",)))
def apa(spark, sf_dir):
    return _records(spark).select(citations.apa(F.col("r")).alias("apa"))


@golden("mla", rows_sql("mla", ('Ada Lovelace, Babbage, C. "A & B". *Notes*, 1843. doi.org/10.1/x_y',), ('. "T". , . http://u',)))
def mla(spark, sf_dir):
    return _records(spark).select(citations.mla(F.col("r")).alias("mla"))


@golden("csl_json", rows_sql("csl", ('{"type":"article-journal","ID":1,"title":"A & B","DOI":"10.1/x_y","author":[{"family":"Lovelace","given":"Ada"},{"family":"Babbage","given":"C."}],"container-title":["Notes"],"issued":{"date-parts":[[1843,10]]},"abstract":"An abstract"}',)))
def csl_json(spark, sf_dir):
    return _records(spark).where("r.year is not null").select(citations.csl(F.col("r"), F.lit(1)).alias("csl"))


@golden("greedy_dedupe", typed(rows_sql("ord, kept, reason", (1, True, None), (2, False, "doi"), (3, True, None), (4, True, None), (5, False, "url"), (6, False, "hash"), (7, True, None)), ord="INTEGER"))
def greedy_dedupe(spark, sf_dir):
    df = made(spark, "ord int, doi string, url string, title string, snippet string, summary string, description string", (1, "10.1/A", "http://u/1", "t1", "", None, None), (2, " 10.1/a", "http://u/2", "t2", None, None, None), (3, "", "http://www.u/2/", "t3", None, None, None), (4, None, None, None, None, None, None), (5, None, "http://u/2?x=1", "t5", None, None, None), (6, None, "not a url", "t3 ", "", "", ""), (7, None, None, "t2", None, None, None))
    return records.greedy_dedupe(df).select("ord", "kept", "reason")


@golden("merge_scholarly", rows_sql("key, title, sources, conflicts", ("doi:10.1000/a", "One", "x,y", "title=One@x|Uno@y"), (None, "Alone", "y", None), ("arxiv:2401.1", "P", "x,z", None)))
def merge_scholarly(spark, sf_dir):
    schema = "ord int, provider string, source string, id string, doi string, url string, title string, authors string, published string, citations long, arxiv_id string"
    df = made(spark, schema, (1, "x", "x", "1", "10.1000/A", None, "One", "a", None, 3, None), (2, "x", "arxiv", "2401.1v2", None, None, "P", None, None, None, None), (3, "y", "y", "2", None, "https://doi.org/10.1000/a", "Uno", "a", "", None, None), (4, "y", "y", "3", None, None, "Alone", None, None, None, None), (5, "z", "z", "4", None, None, "P", None, None, None, "arXiv:2401.1"))
    # Equal values of the url field count once each, and a missing one is none.
    m = records.merge_scholarly(df)
    c = F.array_join(F.transform(F.map_entries("conflicts"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda v: F.concat_ws("@", v["value"], v["provider"])), "|"))), ";")
    return m.select("key", "canonical.title", F.array_join("sources", ",").alias("sources"), c.alias("conflicts"))


@golden("merge_providers", typed(rows_sql("query_id, place, url", (1, 1, "http://a/1"), (1, 2, "http://b/1"), (1, 3, None)), query_id="INTEGER", place="INTEGER"))
def merge_providers(spark, sf_dir):
    df = made(spark, "query_id int, priority int, rank int, url string", (1, 1, 1, "http://a/1"), (1, 1, 2, "http://b/1"), (1, 2, 1, "http://www.a/1/"), (1, 2, 2, None), (1, 2, 3, "http://c/"))
    return records.merge_providers(df, 3).select("query_id", "place", "url")


@golden("failover", typed(rows_sql("query_id, priority, url", (1, 2, "b")), query_id="INTEGER", priority="INTEGER"))
def failover(spark, sf_dir):
    df = made(spark, "query_id int, priority int, ok boolean, url string", (1, 1, False, None), (1, 2, True, "b"), (1, 3, True, "c"))
    return records.failover(df).select("query_id", "priority", "url")


@golden("open_access_locations", typed(rows_sql("work_id, pos, url, is_best", (1, 1, "b", True), (1, 2, "c", False)), work_id="INTEGER", pos="INTEGER"))
def open_access_locations(spark, sf_dir):
    df = made(spark, "work_id int, best struct<url:string,is_oa:boolean>, locations array<struct<url:string,is_oa:boolean>>", (1, ("b", True), [("a", False), ("b", True), ("c", True), (None, True)]))
    return records.open_access_locations(df)


@golden("cached_or_fetched", typed(rows_sql("url, pos, content, origin", ("a", 1, "A", "cache"), ("b", 2, "B", "fetch"), ("c", 3, None, "missing")), pos="INTEGER"))
def cached_or_fetched(spark, sf_dir):
    pairs = "url string, content string"
    return records.cached_or_fetched(made(spark, "url string, pos int", ("a", 1), ("b", 2), ("c", 3)), made(spark, pairs, ("a", "A")), made(spark, pairs, ("a", "old"), ("b", "B")))


@golden("revalidated", rows_sql("url, content, etag, state", ("a", "A", "1", "confirmed"), ("b", "new", "2", "replaced"), ("c", "C", "1", "stale")))
def revalidated(spark, sf_dir):
    stored = made(spark, "url string, content string, etag string", ("a", "A", "1"), ("b", "B", "1"), ("c", "C", "1"))
    return records.revalidated(stored, made(spark, "url string, status int, content string, etag string", ("a", 304, None, None), ("b", 200, "new", "2")))


@golden("enriched", rows_sql("doi, venue, abstract", ("d", "V", "own"), ("e", None, None)))
def enriched(spark, sf_dir):
    hits = made(spark, "doi string, rank int, venue string, abstract string", ("d", 1, "", "x"), ("d", 2, "V", "y"))
    return records.enriched(made(spark, "doi string, venue string, abstract string", ("d", "", "own"), ("e", None, None)), hits)


@golden("status_summary", typed(rows_sql("status, n", ("ok", 2), ("unreachable", 1), ("blocked", 1), ("error", 0)), n="BIGINT"))
def status_summary(spark, sf_dir):
    return records.status_summary(made(spark, "http_status int, error string", (200, None), (301, None), (404, None), (None, "blocked")))


@golden("retryable", rows_sql("status, verdict", (429, "retry"), (503, "give up"), (404, "no"), (None, "retry")))
def retryable(spark, sf_dir):
    return made(spark, "status int, after double", (429, 1.0), (503, 61.0), (404, None), (None, None)).select("status", text.retry(F.col("status"), F.col("after")).alias("verdict"))


@golden("text_links", rows_sql("links", ("http://a.org/x http://www.b.org",)))
def text_links(spark, sf_dir):
    return made(spark, "t string", ("See http://a.org/x, www.b.org. and http://a.org/x!",)).select(F.array_join(text.text_links(F.col("t")), " ").alias("links"))


@golden("redacted_spans", rows_sql("out", ("ab[redacted: possible prompt injection - score 0.90]ef",)))
def redacted_spans(spark, sf_dir):
    df = made(spark, "t string, s array<struct<start:int,end:int,score:double>>", ("abcdef", [(3, 9, 0.5), (2, 4, 0.9), (7, 9, 0.8)]))
    kept = F.filter("s", lambda x: x["end"] - x["start"] < 6)
    return df.select(text.redacted(F.col("t"), kept).alias("out"))


@golden("fitting_links", typed(rows_sql("n", (2,)), n="INTEGER"))
def fitting_links(spark, sf_dir):
    return made(spark, "s array<bigint>", ([10, 10, 10, 10],)).select(schedule.fitting_links(F.col("s"), 25).alias("n"))


OPENALEX = '{"results":[{"id":"W1","title":"T","doi":"https://doi.org/10.1/a","publication_date":"2024-01-02","authorships":[{"author":{"display_name":"A"}},{"author":{"display_name":""}},{"author":{"display_name":"B"}}],"cited_by_count":5},{"id":"W2","title":"","display_name":"D"}]}'


@golden("provider_records", typed(rows_sql("pos, id, title, url, authors, citations, error", (0, "W1", "T", "https://doi.org/10.1/a", "A, B", "5", None), (1, "W2", "D", "W2", None, None, None), (None, None, None, None, None, None, "invalid body")), pos="INTEGER"))
def provider_records(spark, sf_dir):
    r = providers.records(made(spark, "body string", (OPENALEX,), ("{bad",)), "openalex")
    return r.select("pos", "id", "title", "url", "authors", F.element_at("fields", F.lit("citations")).alias("citations"), "error")


@golden("provider_nvd", rows_sql("id, severity, base_score, published, snippet", ("CVE-2024-1", "HIGH", "7.5", "2024-01-01", "bad thing")))
def provider_nvd(spark, sf_dir):
    body = '{"vulnerabilities":[{"cve":{"id":"CVE-2024-1","published":"2024-01-01T00:00","descriptions":[{"lang":"es","value":"x"},{"lang":"en","value":"bad\\n thing"}],"metrics":{"cvssMetricV31":[{"cvssData":{"baseSeverity":"HIGH","baseScore":7.5}}]}}}]}'
    r = providers.records(made(spark, "body string", (body,)), "nvd")
    return r.select("id", F.element_at("fields", F.lit("severity")).alias("severity"), F.element_at("fields", F.lit("base_score")).alias("base_score"), "published", "snippet")


@golden("statistics_cube", typed(rows_sql("idx, value, geo, year", (0, 1.0, "DE", "2023"), (1, 2.0, "DE", "2024"), (3, 4.0, "FR", "2024")), idx="BIGINT", value="DOUBLE"))
def statistics_cube(spark, sf_dir):
    body = '{"id":["geo","time"],"size":[2,2],"value":{"0":1,"1":2,"3":4},"dimension":{"geo":{"category":{"index":{"DE":0,"FR":1}}},"time":{"category":{"index":{"2023":0,"2024":1}}}}}'
    c = providers.cells(made(spark, "body string", (body,)))
    return c.select(F.col("index").alias("idx"), "value", F.element_at("coords", F.lit("geo")).alias("geo"), F.element_at("coords", F.lit("time")).alias("year"))


@golden("census_rows", typed(rows_sql("pos, name, state", (0, "Ohio", "39"), (1, "Utah", "49")), pos="INTEGER"))
def census_rows(spark, sf_dir):
    c = providers.census(made(spark, "body string", ('[["NAME","state"],["Ohio","39"],["Utah","49"]]',)))
    return c.select("pos", F.element_at("row", F.lit("NAME")).alias("name"), F.element_at("row", F.lit("state")).alias("state"))


@golden("exchange_rates", typed(rows_sql("date, base, quote, rate", ("2024-01-02", "EUR", "USD", 1.1), ("2024-01-02", "EUR", "JPY", 160.0)), rate="DOUBLE"))
def exchange_rates(spark, sf_dir):
    return providers.rates(made(spark, "body string", ('{"date":"2024-01-02","base":"EUR","rates":{"USD":1.1,"JPY":160}}',)))


@golden("csv_series", typed(rows_sql("pos, date, value", (0, "2024-01-01", 1.5), (1, "2024-02-01", None)), pos="INTEGER", value="DOUBLE"))
def csv_series(spark, sf_dir):
    return providers.csv_series(made(spark, "body string", ("DATE,GDP\n2024-01-01,1.5\r\n2024-02-01,.\n",)))


@golden("atom_entries", rows_sql("id, title, doi, authors, category", ("2401.00001", "A title", "10.1/z", "X, Y", "cs.CL")))
def atom_entries(spark, sf_dir):
    body = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.00001v3</id><title>A\n title</title><author><name>X</name></author><author><name>Y</name></author><arxiv:doi>10.1/z</arxiv:doi><arxiv:primary_category term="cs.CL"/><summary>s</summary></entry></feed>'
    return providers.atom_entries(made(spark, "body string", (body,))).select("id", "title", "doi", "authors", "category")


@golden("sdmx_observations", rows_sql("date, value", ("2024-01", "1.5")))
def sdmx_observations(spark, sf_dir):
    body = '<g:Series xmlns:g="x"><g:Obs><g:ObsDimension value="2024-01"/><g:ObsValue value="1.5"/></g:Obs></g:Series>'
    return providers.xml_records(made(spark, "body string", (body,)), *providers.XML["bundesbank"]).select("date", "value")


@golden("focused_crawl", typed(rows_sql("seq, url, depth", (0, "http://s/", 0), (1, "http://s/docs/spark-joins", 1), (2, "http://s/joins/more", 2)), seq="INTEGER", depth="INTEGER"))
def focused_crawl(spark, sf_dir):
    pages = made(spark, "site string, url string, text string", ("s", "http://s/", "spark home"), ("s", "http://s/docs/spark-joins", "spark joins explained"), ("s", "http://s/joins/more", "joins"), ("s", "http://s/pricing", "prices"))
    edges = made(spark, "site string, src string, dst string, anchor string, pos int", ("s", "http://s/", "http://s/pricing", "prices", 0), ("s", "http://s/", "http://s/docs/spark-joins", "Spark joins", 1), ("s", "http://s/docs/spark-joins", "http://s/joins/more", "more joins", 0))
    return graph.focused_crawl(pages, edges, made(spark, "site string, root string, query string", ("s", "http://s/", "spark joins"))).select("seq", "url", "depth")


@golden("level_crawl", typed(rows_sql("root, url, depth", ("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2)), depth="INTEGER"))
def level_crawl(spark, sf_dir):
    edges = made(spark, "src string, dst string", ("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("c", "b"))
    return graph.level_crawl(edges, made(spark, "root string", ("a",)))


@golden("selected_sections", typed(rows_sql("doc_id, total, selected, anchors", (1, 3, 2, "(intro),Joins")), doc_id="BIGINT", total="BIGINT", selected="INTEGER"))
def selected_sections(spark, sf_dir):
    from webgrain.operators import ranking

    md = "About spark joins\n# Other\nnothing here\nJoins\n---\nspark joins spark joins\n"
    s = ranking.split_sections(made(spark, "doc_id long, md string", (1, md)), "doc_id", "md")
    return ranking.select_sections(s, "spark joins", 60).select("doc_id", "total", "selected", F.array_join("anchors", ",").alias("anchors"))


@golden("download_kinds", rows_sql("kind", ("ok",), ("too_small",), ("bot_wall",), ("unexpected_content",), ("invalid_file",)))
def download_kinds(spark, sf_dir):
    df = made(spark, "head string, size long, ctype string", ("%PDF-1.7", 5000, None), ("%PDF-1.7", 10, None), ("<html>Attention required", 5000, "text/html"), ("<html>x", 5000, None), ("zip", 5000, None))
    return df.select(text.download_kind(F.encode("head", "UTF-8"), F.col("size"), F.col("ctype")).alias("kind"))


@golden("dotted_links", typed(rows_sql("pos, href", (0, "http://h/b"), (1, "http://h/a/d/e"), (2, "http://h/c?x=../y"), (3, "http://h/a/x..y")), pos="INTEGER"))
def dotted_links(spark, sf_dir):
    page = "<a href='../b'>1</a><a href='./d/e'>2</a><a href='/q/../c?x=../y'>3</a><a href='x..y'>4</a>"
    return html.links(made(spark, "page_id long, url string, html string", (1, "http://h/a/p", page)), "page_id", "url", "html").select("pos", "href")


@golden("redacted_overlaps", rows_sql("out", ("ab[redacted: possible prompt injection - score 0.90]ef",), ("abc[redacted: possible prompt injection - score 0.50]",)))
def redacted_overlaps(spark, sf_dir):
    """A span that begins inside one before it is passed over; ends beyond the text are cut."""
    df = made(spark, "t string, s array<struct<start:int,end:int,score:double>>", ("abcdef", [(3, 9, 0.5), (2, 4, 0.9), (7, 9, 0.8)]), ("abcdef", [(3, 9, 0.5), (4, 5, 0.9)]))
    return df.select(text.redacted(F.col("t"), F.col("s")).alias("out"))


@golden("record_parts", typed(rows_sql("published, year, month, day, authors", ("2024-03-01", "2024", "03", "01", "A B|C"), ("2024-3", "2024", "3", None, "A, B|C"), ("1999 spring", "1999", None, None, ""), (None, None, None, None, "")), published="VARCHAR", year="VARCHAR", month="VARCHAR", day="VARCHAR"))
def record_parts(spark, sf_dir):
    rows = made(spark, "published string, authors string", ("2024-03-01", "A B, C"), ("2024-3", "A, B; C;"), ("1999 spring", " ,"), (None, None))
    d = citations.date_parts(F.col("published"))
    return rows.select("published", d.alias("d"), F.array_join(citations.author_list(F.col("authors"), True), "|").alias("authors")).select("published", "d.year", "d.month", "d.day", "authors")


@golden("image_endings", typed(rows_sql("kind, ending", ("image/PNG; x=1", "png"), ("image/svg+xml", "svg"), ("text/html", None), (None, None)), ending="VARCHAR"))
def image_endings(spark, sf_dir):
    return made(spark, "kind string", ("image/PNG; x=1",), ("image/svg+xml",), ("text/html",), (None,)).select("kind", text.image_ending(F.col("kind")).alias("ending"))


@golden("path_priors", typed(rows_sql("url, weight", ("http://h/docs/a", 1.15), ("http://h/pricing", 0.85), ("http://h/x", 1.0)), weight="DOUBLE"))
def path_priors(spark, sf_dir):
    return made(spark, "url string", ("http://h/docs/a",), ("http://h/pricing",), ("http://h/x",)).select("url", urls.path_prior(F.col("url")).alias("weight"))


@golden("content_ranges", typed(rows_sql("raw, first, last, total", ("bytes 0-499/1234", 0, 499, 1234), ("bytes 500-999/*", 500, 999, None), ("bytes */1234", None, None, 1234), ("junk", None, None, None), (None, None, None, None)), first="BIGINT", last="BIGINT", total="BIGINT"))
def content_ranges(spark, sf_dir):
    raw = ("bytes 0-499/1234", "bytes 500-999/*", "bytes */1234", "junk", None)
    return made(spark, "raw string", *((r,) for r in raw)).select("raw", text.content_range(F.col("raw")).alias("r")).select("raw", "r.*")


@golden("addresses_v6", rows_sql("ip, private", ("::1", True), ("4000::1", True), ("2606:4700::1111", False), ("2001:4:112::1", False), ("::ffff:8.8.8.8", False), ("::ffff:10.0.0.1", True), ("8.8.8.8", False), ("192.0.0.9", False)))
def addresses_v6(spark, sf_dir):
    ips = ("::1", "4000::1", "2606:4700::1111", "2001:4:112::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "8.8.8.8", "192.0.0.9")
    return made(spark, "ip string", *((i,) for i in ips)).select("ip", urls.private_ip(F.col("ip")).alias("private"))
