"""Queries of the reading operators and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webgrain.functions.text import looks_like_text
from webgrain.functions.urls import let
from webgrain.operators import graph, guard, html, ranking, reading, research
from webgrain.plans.made import made, rows_sql, typed
from webgrain.plans.pages import HEAD_SQL
from webgrain.plans.registry import golden, register, table
from webgrain.session import shared
from webgrain.sources import sinks

_STEP = "(SELECT *, at{0} + CASE WHEN length(w{0}) < 500 THEN total - at{0} WHEN back{0} > 0 AND length(w{0}) - back{0} - 1 > 250 THEN length(w{0}) - back{0} - 1 ELSE 500 END AS at{1} FROM (SELECT *, instr(reverse(w{0}), chr(10) || chr(10)) AS back{0} FROM (SELECT *, substr(md, at{0} + 1, 500) AS w{0} FROM {2})))"
_PARAGRAPHS = "(SELECT doc_id, replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)) AS md, length(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10))) AS total, 0 AS at0 FROM documents)"


@register("sliced_markdown", f"SELECT doc_id, md5(substr(md, 1, at2)) AS content, CAST(at2 AS INTEGER) AS next_offset, at2 < total AS has_more FROM {_STEP.format(1, 2, _STEP.format(0, 1, _PARAGRAPHS))}")
def sliced_markdown(spark, sf_dir):
    md = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n"))
    s = table(spark, sf_dir, "documents").select("doc_id", reading.sliced(md, chunks=2, chars=500).alias("s"))
    return s.select("doc_id", F.md5("s.content").alias("content"), "s.next_offset", "s.has_more")


@golden("slices_of_a_text", typed(rows_sql("start, content, next_offset, has_more", (0, "aaaaaa", 6, True), (6, "\n\nbb", 10, False), (99, "", 10, False), (-5, "aaaaaa", 6, True)), start="INTEGER", next_offset="INTEGER"))
def slices_of_a_text(spark, sf_dir):
    rows = made(spark, "start int, md string", *((o, "aaaaaa\n\nbb") for o in (0, 6, 99, -5)))
    return rows.select("start", reading.sliced(F.col("md"), F.col("start"), chars=9).alias("s")).select("start", "s.content", "s.next_offset", "s.has_more")


@register("absolute_markdown_links", "SELECT page_id, concat('[t](', o, '/x?p=', page_id, ') ![i](/i.png) [f](#a) [m](mailto:a@b.c) [q](', o, '/y \"T\") [abs](http://e.org/z)') AS md FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') AS o FROM pages)")
def absolute_markdown_links(spark, sf_dir):
    md = F.concat(F.lit("[t](/x?p="), F.col("page_id").cast("string"), F.lit(') ![i](/i.png) [f](#a) [m](mailto:a@b.c) [q](/y "T") [abs](http://e.org/z)'))
    once = reading.absolutised(md, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", reading.absolutised(once, F.col("url")).alias("md"))


MODES = ("static", "browser", "auto")
WANTED = {"static": ("static-only",) * 3, "browser": ("browser-first",) * 3, "auto": ("static-only", "browser-only", "auto")}


@golden("fetch_strategies", rows_sql("mode, smart, strategy", *((m, s, WANTED[s][i]) for i, m in enumerate(MODES) for s in MODES)))
def fetch_strategies(spark, sf_dir):
    return made(spark, "mode string, smart string", *((m, s) for m in MODES for s in MODES)).select("mode", "smart", reading.strategy(F.col("mode"), F.col("smart")).alias("strategy"))


@golden("sparse_json", rows_sql("raw, lean", ('{"a":null,"b":[],"c":{},"d":[null,{"e":null}]}', '{"c":{},"d":[null,{}]}'), ('{"a":[[],1],"b":{"c":[{"d":[]}]}}', '{"a":[[],1],"b":{"c":[{}]}}'), ("[]", "[]"), ("no", None)))
def sparse_json(spark, sf_dir):
    raw = ('{"a":null,"b":[],"c":{},"d":[null,{"e":null}]}', '{"a":[[],1],"b":{"c":[{"d":[]}]}}', "[]", "no")
    return made(spark, "raw string", *((r,) for r in raw)).select("raw", reading.sparse(F.col("raw")).alias("lean"))


@register("merged_metadata", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Own' ELSE title END AS title, lang AS language, url AS canonical, 'kept' AS other FROM ({HEAD_SQL})")
def merged_metadata(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    m = html.metadata(pages, "page_id", "url", "html")
    meta = F.create_map(F.lit("title"), F.col("title"), F.lit("language"), F.col("lang"), F.lit("canonical"), F.lit("by the page"))
    own = F.create_map(F.lit("title"), F.when(F.col("page_id") % 2 == 0, "Own").otherwise(""), F.lit("other"), F.lit("kept"), F.lit("language"), F.lit(None).cast("string"))
    out = m.select("page_id", reading.merged_metadata(own, {"meta": meta, "opengraph": F.col("opengraph")}).alias("m")).join(pages.select("page_id", "url"), "page_id")
    # The page's own canonical address goes before the base's; here it stands for the url.
    at = lambda k: F.element_at("m", F.lit(k))
    return out.select("page_id", F.nullif(at("title"), F.lit("")).alias("title"), at("language").alias("language"), F.when(at("canonical") == "by the page", F.col("url")).alias("canonical"), at("other").alias("other"))


@register("search_keys", "SELECT doc_id, sha256(concat(trim(regexp_replace(lower(coalesce(text, '')), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')), '|10|default|merge=concat')) AS key FROM documents".replace("\\\\", "\\"))
def search_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", reading.search_key(F.col("text"), F.lit(10), F.lit(None).cast("string")).alias("key"))


@register("search_cache_hits", """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS at, event_id % 2 = 0 AS put FROM events)
SELECT event_id, EXISTS (SELECT 1 FROM e p WHERE p.put AND p.user_id = e.user_id AND p.at <= e.at AND p.at >= e.at - 86400000000) AS hit FROM e WHERE NOT put""")
def search_cache_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 2 == 0).alias("put"))
    return reading.cache_hits(e, "user_id", "at", F.col("put"), 86_400_000_000).where("not put").select("event_id", "hit")


@register("frontier_best", "SELECT event_type, place, event_id FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS place FROM events) WHERE place <= 200")
def frontier_best(spark, sf_dir):
    return reading.frontier(table(spark, sf_dir, "events"), "event_type", "value", "event_id").select("event_type", "place", "event_id")


SHEETS = "array<struct<title:string,rows:array<array<string>>>>"
BOOK = [("One", [["a", "b,c"], ["1", 'say "x"'], []]), (None, [["only"]]), ("Empty", [])]


@golden("spreadsheet_text", rows_sql("csv, js", ('## One\n\na,"b,c"\n1,"say ""x"""\n\n## Section 2\n\nonly', '[{"sheet":"One","headers":["a","b,c"],"rows":[["1","say \\"x\\""]]},{"sheet":"Section 2","headers":["only"],"rows":[]}]')))
def spreadsheet_text(spark, sf_dir):
    return made(spark, f"s {SHEETS}", (BOOK,)).select(reading.sheet_csv(F.col("s")).alias("csv"), reading.sheet_json(F.col("s")).alias("js"))


@register("extracted_texts", "SELECT concat('d', doc_id, '.', CASE WHEN doc_id % 3 = 0 THEN 'txt' WHEN doc_id % 3 = 1 THEN 'MD' ELSE 'bin' END) AS path, CASE WHEN doc_id % 3 < 2 THEN 'text' END AS kind, CASE WHEN doc_id % 3 < 2 THEN md5(text) END AS text_md5 FROM documents")
def extracted_texts(spark, sf_dir):
    ending = F.when(F.col("doc_id") % 3 == 0, "txt").when(F.col("doc_id") % 3 == 1, "MD").otherwise("bin")
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return reading.extracted(files).select("path", "kind", F.md5("text").alias("text_md5"))


@golden("extracted_kinds", rows_sql("path, kind, text", ("a.html", "page", "# T\n\nx"), ("b.json", "json", '{\n  "a": 1\n}'), ("c.json", "json", "no json"), ("d.txt", "text", "mark"), ("e.pdf", None, None)))
def extracted_kinds(spark, sf_dir):
    rows = (("a.html", "<h1>T</h1><p>x"), ("b.json", '{"a":1}'), ("c.json", "no json"), ("d.txt", "﻿mark"), ("e.pdf", "%PDF"))
    return reading.extracted(made(spark, "path string, content string", *rows).withColumn("content", F.encode("content", "UTF-8")))


@register("fitted_payloads", "SELECT doc_id, CASE WHEN n + 4 <= 1000 THEN 0 WHEN least(n, 500 + 3) + 4 <= 1000 THEN 500 END AS cut FROM (SELECT doc_id, length(t) AS n FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g') AS t FROM documents))")
def fitted_payloads(spark, sf_dir):
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", "")
    out = reading.fitted(F.array(plain), 1000, mark="...")
    return table(spark, sf_dir, "documents").select("doc_id", let(out, lambda o: F.when(~o.contains("..."), 0).otherwise(F.length(o) - 7)).cast("int").alias("cut"))


@golden("fitted_overflow", rows_sql("n, payload", (1, '["aaaa"]'), (9, '{"error":"too large"}')))
def fitted_overflow(spark, sf_dir):
    rows = made(spark, "n int, t array<string>", (1, ["aaaa"]), (9, ["b" * 300] * 9))
    return rows.select("n", reading.fitted(F.col("t"), 500).alias("payload"))


@register("json_payloads", "SELECT doc_id, concat('{\"doc_id\":', doc_id, ',\"lang\":', CASE WHEN lang IS NULL THEN 'null' ELSE concat('\"', lang, '\"') END, ',\"odd\":\"\\u00e9\\ud83d\\ude00\"}') AS payload FROM documents")
def json_payloads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("odd", F.lit("é😀"))
    return docs.select("doc_id", sinks.payload("doc_id", "lang", "odd", ascii_only=True).alias("payload"))


@register("stored_pages", "SELECT page_id, sha256(coalesce(html, '')) AS digest FROM pages")
def stored_pages(spark, sf_dir):
    path = f"{shared(spark)}/store-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").withColumn("content", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    sinks.write_store(pages.select("page_id", "url", "content"), path)
    return sinks.read_store(spark, path).select("page_id", F.sha2("content", 256).alias("digest"))


@register("cached_pages", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'new' ELSE 'old' END AS value FROM pages WHERE url IS NOT NULL")
def cached_pages(spark, sf_dir):
    path = f"{shared(spark)}/cache-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").where("url is not null").withColumn("key", sinks.cache_key(F.concat_ws("|", "url", "page_id")))
    sinks.put_in_cache(spark, pages.select("key", F.lit("stale").alias("value")), path, 0)
    sinks.put_in_cache(spark, pages.select("key", F.lit("old").alias("value")), path, 5000)
    sinks.put_in_cache(spark, pages.where("page_id % 2 = 0").select("key", F.lit("new").alias("value")), path, 9000)
    return sinks.get_from_cache(spark, pages, path, 10_000, 6000).join(pages.select("key", "page_id"), "key").select("page_id", "value")


@golden("cache_keys", rows_sql("raw, key", ("http://a/", "010c2ffe356236164728378f86adb419"), (None, None)))
def cache_keys(spark, sf_dir):
    return made(spark, "raw string", ("http://a/",), (None,)).select("raw", sinks.cache_key(F.col("raw")).alias("key"))


@register("inspected_pages")
def inspected_pages(spark, sf_dir):
    return reading.inspected(table(spark, sf_dir, "pages"), "the thing of reading")


@golden("inspected_made_page", typed(rows_sql("title, markdown, selected, next_offset, has_more, follows", ("T", "# Joins\n\nspark joins [a](http://h/d/a)", 1, None, False, "http://h/d/a:page"), ("U", "x [b](http://h/b.pdf)", 0, 21, False, "http://h/b.pdf:document")), selected="INTEGER", next_offset="INTEGER"))
def inspected_made_page(spark, sf_dir):
    rows = ((1, "http://h/d/", "<html><head><title>T</title></head><body><h1>Other</h1><p>nothing</p><h1>Joins</h1><p>spark joins <a href='a'>a</a></p></body></html>"), (2, "http://h/d", "<html><head><title>U</title></head><body><p>x <a href='b.pdf'>b</a></body></html>"))
    out = reading.inspected(made(spark, "page_id long, url string, html string", *rows), "spark joins")
    return out.select("title", "markdown", "selected", "next_offset", "has_more", F.array_join(F.transform("follow_ups", lambda f: F.concat_ws(":", f["url"], f["type"])), ",").alias("follows"))


META = """<html><head><link rel="manifest" href="/m.json"><link rel="alternate" type="application/json+oembed" href="http://o/?a=1&amp;b=2" title="T"><link type="text/xml+oembed" href="http://o/x"></head>
<body><div itemscope itemtype="http://schema.org/Person"><span itemprop="name">Ann</span><div itemprop="address" itemscope><b itemprop="city">Rome</b></div></div>
<div class="h-card x"><a class="p-name u-url" href="http://ann/">Ann</a><time class="dt-bday" datetime="2000-01-02">then</time></div>
<p typeof="Product"><i property="price" content="5">five</i></p></body></html>"""


@golden("structured_metadata", typed(rows_sql("page_id, microdata, microformats, rdfa, manifest, oembed", (1, '[{"type":["http://schema.org/Person"],"properties":{"name":["Ann"],"address":[{"type":[""],"properties":{"city":["Rome"]}}]}}]', '[{"type":["h-card"],"properties":{"name":["http://ann/"],"url":["http://ann/"],"bday":["2000-01-02"]}}]', '[{"type":["Product"],"properties":{"price":["5"]}}]', "/m.json", "http://o/?a=1&b=2 json T,http://o/x xml"), (2, None, None, None, None, "")), page_id="BIGINT"))
def structured_metadata(spark, sf_dir):
    pages = made(spark, "page_id long, html string", (1, META), (2, None))
    out = html.structured(pages, "page_id", "html").join(html.embeds(pages, "page_id", "html"), "page_id")
    return out.withColumn("oembed", F.array_join(F.transform("oembed", lambda o: F.concat_ws(" ", o["href"], o["format"], o["title"])), ","))


@golden("page_metadata_row", typed(rows_sql("title, description, lang, charset, canonical, og, dc, rels, jsonld", ("A & B", "d", "en", "utf-8", "http://c/", "title=O;type=t", "creator=X", "canonical,icon", 1), (None, None, None, None, "http://v", "", "", "", 0)), jsonld="INTEGER"))
def page_metadata_row(spark, sf_dir):
    page = """<html lang="en"><head><meta charset="utf-8"><title>A &amp; B</title><meta name="description" content="d"><link rel="canonical" href="http://c/"><link rel="icon" href="i"><link rel="icon" href="j">
<meta property="og:title" content="O"><meta property="og:type" content="t"><meta property="og:title" content="second"><meta name="DC.creator" content="X"><script type="application/ld+json">{"@type":"Article"}</script><script type="application/ld+json">{bad</script></head></html>"""
    m = html.metadata(made(spark, "page_id long, url string, html string", (1, "http://u", page), (2, "http://v", None)), "page_id", "url", "html")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return m.select("title", "description", "lang", "charset", "canonical", joined("opengraph").alias("og"), joined("dublin_core").alias("dc"), F.array_join(F.array_sort(F.map_keys("rel_links")), ",").alias("rels"), F.size("jsonld").alias("jsonld"))


@golden("anchor_context_rows", rows_sql("anchor, context", ("Link", "spark,joins,link,words"), ("none", ""), ("", "")))
def anchor_context_rows(spark, sf_dir):
    rows = made(spark, "anchor string, text string", *((a, "far away " * 20 + "spark joins LINK words spark") for a in ("Link", "none", "")))
    return rows.select("anchor", F.array_join(ranking.anchor_context(F.col("text"), F.col("anchor"), around=13), ",").alias("context"))


@golden("untrusted_rows", rows_sql("raw, clean", ("a\u200bb\x07c\td", "abc\td"), ("ﬁ①", "fi1"), (None, None)))
def untrusted_rows(spark, sf_dir):
    from webgrain.functions.text import untrusted

    return made(spark, "raw string", ("a\u200bb\x07c\td",), ("ﬁ①",), (None,)).select("raw", untrusted(F.col("raw")).alias("clean"))


@golden("text_gate_rows", rows_sql("place, is_text", ("head", False), ("middle", False), ("tail", False), ("nowhere", True), ("between", True)))
def text_gate_rows(spark, sf_dir):
    """Control characters in the head, middle or tail window count; between the windows they don't."""
    plain, bad = "word " * 4000, "\x01" * 300
    put = lambda i: plain[:i] + bad + plain[i + 300 :]
    rows = (("head", put(500)), ("middle", put(9900)), ("tail", put(19_000)), ("nowhere", plain), ("between", put(5000)))
    return made(spark, "place string, text string", *rows).select("place", looks_like_text(F.col("text")).alias("is_text"))


@golden("merged_guard_reports", typed(rows_sql("page, scopes, max_score, risk, flagged, chunks_scanned, elapsed_ms, action", (1, "body,title", 0.9123, "high", "3,8,20", 6, 1.7, "redact"), (2, "body", 0.0, "None", "", 1, 0.1, "annotate")), chunks_scanned="BIGINT", max_score="DOUBLE", elapsed_ms="DOUBLE", page="BIGINT"))
def merged_guard_reports(spark, sf_dir):
    rows = ((1, 0, "body", 0.91234, "high", [(20, 0.9), (3, 0.8)], 4, 1.25, "redact"), (1, 1, "title", 0.91234, "medium", [(8, 0.9)], 1, 0.25, "annotate"), (1, 2, "body", 0.5, "low", [], 1, 0.2, "annotate"), (2, 0, "body", 0.0, "low", [], 1, 0.1, "annotate"))
    reports = made(spark, "page long, n int, scope string, max_score double, risk string, flagged array<struct<offset:int,score:double>>, chunks_scanned long, elapsed_ms double, action string", *rows)
    out = guard.merged_reports(reports, "page", "n")
    return out.withColumn("scopes", F.array_join("scopes", ",")).withColumn("flagged", F.array_join(F.col("flagged.offset"), ","))


CLUSTERS = [["deep", "learning", "neural"], ["join", "merge", "learning"]]


@golden("expanded_queries", rows_sql("base, query", ("learning", "learning,deep"), ("join,learning", "join,learning,merge,deep"), ("x", "x"), ("", "")))
def expanded_queries(spark, sf_dir):
    rows = made(spark, "base string", ("learning",), ("join,learning",), ("x",), ("",))
    words = F.filter(F.split("base", ","), lambda w: w != "")
    return rows.select("base", F.array_join(graph.expanded(words, CLUSTERS), ",").alias("query"))


@golden("link_scores", "SELECT * FROM (VALUES (1, 1, round(0.7 * 1.0 / 1.5 + 0.3 * 1 / 3, 9)), (2, 4, round((0.7 * 2.0 / 2.5 + 0.3 * 0.5 / (2.0 + 0.5 + ln(1 + 4.5 / 0.5))) * 1.15, 9)), (3, 1, 0.0)) AS t(id, read, score)")
def link_scores(spark, sf_dir):
    idf = {"spark": 2.0, "docs": 0.5, "join": 1.0}
    rows = ((1, 1, "http://h/x", ["spark", "docs", "new"], ["spark", "join"], ["spark"], ["docs"], idf), (2, 4, "http://h/docs/x", ["spark", "docs", "new"], ["spark", "join"], ["spark"], ["docs"], idf), (3, 1, "http://h/x", [], [], [], [], idf))
    df = made(spark, "id int, read int, url string, label array<string>, query array<string>, base array<string>, topic array<string>, idf map<string,double>", *rows)
    score = graph.weighted_link_score(F.col("url"), F.col("label"), F.col("query"), F.col("base"), F.col("topic"), F.col("idf"), F.col("read"))
    return df.select("id", "read", F.round(score, 9).alias("score"))


@register("requests_by_key", "SELECT event_type, string_agg(concat(user_id, ':', n), ',' ORDER BY n DESC, user_id) AS counts FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def requests_by_key(spark, sf_dir):
    """Requests of each kind by user, most first: one row a user before users meet."""
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "user_id"))).alias("c"))
    return ranked.select("event_type", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["user_id"].cast("string"), (-x["m"]).cast("string"))), ",").alias("counts"))


_HITS = ((1, 0, 0, False, None, None), (1, 1, 0, True, "http://a/?x", "A"), (1, 1, 1, True, "http://a/?y", "again"), (1, 1, 2, True, "http://b/", "B"), (1, 2, 0, True, "http://c/", "C"), (2, 0, 0, True, "http://d/", "D"), (3, 0, 0, True, "http://e/", "E"))
_OLD = ((2, 1, "http://old/", "Old", 100), (3, 1, "http://stale/", "Stale", 0))


def _search(spark, merge: bool):
    answers = made(spark, "query_id int, priority int, rank int, ok boolean, url string, title string", *_HITS)
    old = made(spark, "query_id int, place int, url string, title string, put int", *_OLD).withColumn("put", F.timestamp_seconds("put"))
    return research.searched(answers, old, merge=merge, now=F.timestamp_seconds(F.lit(150)), ttl=60.0)


@golden("searched_failover", rows_sql("query_id, place, url, title, origin", (1, 1, "http://a/?x", "A", "engine"), (1, 2, "http://b/", "B", "engine"), (2, 1, "http://old/", "Old", "cache"), (3, 1, "http://e/", "E", "engine")))
def searched_failover(spark, sf_dir):
    return _search(spark, False)


@golden("searched_merged", rows_sql("query_id, place, url, title, origin", (1, 1, "http://a/?x", "A", "engine"), (1, 2, "http://b/", "B", "engine"), (1, 3, "http://c/", "C", "engine"), (2, 1, "http://old/", "Old", "cache"), (3, 1, "http://e/", "E", "engine")))
def searched_merged(spark, sf_dir):
    return _search(spark, True)


_OF = (("scholarly", 0, "openalex"), ("scholarly", 1, "crossref"), ("legal", 0, "courtlistener"), ("general", 0, "web"))


@golden("category_research", typed(rows_sql("id, category, provider, error, title", (1, "scholarly", "openalex", None, "one"), (1, "scholarly", "openalex", None, "two"), (2, "scholarly", "crossref", None, "c"), (3, "legal", "courtlistener", None, None), (4, "nothing", None, "unknown category", None), (5, None, None, "unknown provider", None), (6, "legal", None, "provider of another category", None), (7, "general", "web", None, None)), error="VARCHAR"))
def category_research(spark, sf_dir):
    asked = ((1, "a peer reviewed journal paper", None, None), (2, "anything", None, "crossref"), (3, "x", "legal", None), (4, "x", "nothing", None), (5, "x", None, "none"), (6, "x", "legal", "crossref"), (7, "hello", None, None))
    found = ((1, "openalex", 0, "one"), (1, "openalex", 1, "two"), (1, "openalex", 2, "cut"), (1, "crossref", 0, "no"), (2, "crossref", 0, "c"), (6, "crossref", 0, "no"))
    providers_ = made(spark, "category string, place int, provider string", *_OF)
    out = research.by_category(made(spark, "id int, query string, category string, provider string", *asked), providers_, made(spark, "id int, provider string, pos int, title string", *found), most=2)
    return out.select("id", "category", "provider", "error", "title")


@register("categories_resolved", "WITH c AS (SELECT doc_id, lang FROM documents) SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'legal' ELSE 'scholarly' END AS category, CASE WHEN lang = 'en' THEN 'courtlistener' ELSE 'crossref' END AS provider FROM c")
def categories_resolved(spark, sf_dir):
    """Every document as a question: to a category by its language, or to a provider."""
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query"), F.when(english, "legal").alias("category"), F.when(~english, "crossref").alias("provider"))
    return research.resolved(asked, made(spark, "category string, place int, provider string", *_OF)).select("id", "category", "provider")
