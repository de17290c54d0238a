"""Queries that give operators of records, feeds and robots files their rows from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from webgrain.functions.urls import domain_of
from webgrain.operators import records
from webgrain.plans.registry import register, table
from webgrain.sources import web


@register("deduplicated_documents", """
WITH RECURSIVE k AS (
  SELECT doc_id, CASE WHEN trim(left(coalesce(text, ''), 30)) <> '' THEN 'h' || trim(left(text, 30)) END AS h, 'u' || source || lang || (n_chars // 20) AS u, row_number() OVER (ORDER BY doc_id) AS n FROM documents
), s AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS reason, CAST([] AS VARCHAR[]) AS seen
  UNION ALL
  SELECT k.n, k.doc_id, CASE WHEN list_contains(s.seen, k.u) THEN 'url' WHEN list_contains(s.seen, k.h) THEN 'hash' END,
    CASE WHEN list_contains(s.seen, k.u) OR coalesce(list_contains(s.seen, k.h), false) THEN s.seen ELSE s.seen || [k.h, k.u] END
  FROM s JOIN k ON k.n = s.n + 1
)
SELECT doc_id, reason IS NULL AS kept, reason FROM s WHERE n > 0
""")
def deduplicated_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("http://"), "source", "lang", F.floor(F.col("n_chars") / 20).cast("string"), F.lit("/"))
    rows = docs.select("doc_id", F.lit(None).cast("string").alias("doi"), url.alias("url"), F.left("text", F.lit(30)).alias("title"), *(F.lit(None).cast("string").alias(c) for c in ("snippet", "summary", "description")))
    return records.greedy_dedupe(rows, order="doc_id").select("doc_id", "kept", "reason")


@register("feed_items_of_documents", """
SELECT doc_id, CAST(p AS INTEGER) AS pos, CASE WHEN p = 0 THEN 'D' || doc_id || ' & ' || lang || ' ’s' ELSE '<' || source || '>' END AS title, 'http://' || source || '/?d=' || doc_id || '&p=' || p AS link,
  CASE WHEN p = 1 THEN nullif(trim(regexp_replace(replace(left(coalesce(text, ''), 200), ']', ' '), '\\s+', ' ', 'g')), '') END AS description, CAST(2 AS INTEGER) AS total
FROM documents, (VALUES (0), (1)) v(p)
""")
def feed_items_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    item = lambda p, title, more: F.concat(F.lit("<item><title>"), title, F.lit("</title><link>http://"), "source", F.lit("/?d="), F.col("doc_id").cast("string"), F.lit(f"&amp;p={p}</link>"), more, F.lit("</item>"))
    head = item(0, F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(" &amp; "), "lang", F.lit(" &#8217;s")), F.lit(""))
    clean = F.replace(F.left(F.coalesce("text", F.lit("")), F.lit(200)), F.lit("]"), F.lit(" "))
    body = item(1, F.concat(F.lit("&lt;"), "source", F.lit("&gt;")), F.concat(F.lit("<description><![CDATA["), clean, F.lit("]]></description>")))
    feeds = docs.select("doc_id", F.concat(F.lit("<rss><channel>"), head, body, F.lit("</channel></rss>")).alias("body"))
    return web.feed_items(feeds, "doc_id").select("doc_id", "pos", "title", "link", "description", "total")


#: A robots file for each host: literal rules, and rules with a star or a closing dollar.
RULES = (("/", True), ("/fr/", False), ("/fr/8", True), ("/*page=", False), ("/*5$", False), ("/*5$", True), ("/e*/2", False), ("/de/1", False), ("/en/?", False), ("/*.html", False), ("/nowhere/", False))


@register("robots_of_pages", f"""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS r FROM pages),
p AS (SELECT page_id, CASE WHEN r = '' OR r[1] = '?' THEN '/' || r ELSE r END AS path FROM u),
v AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {a}, '^{p.replace('?', chr(92) + '?').replace('.', chr(92) + '.').replace('*', '.*')}')" for p, a in RULES)}) v(rule, allow, pattern))
SELECT page_id, coalesce((SELECT v.allow FROM v WHERE regexp_matches(p.path, v.pattern) ORDER BY length(v.rule) DESC, v.allow DESC LIMIT 1), true) AS allowed FROM p
""")
def robots_of_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", domain_of(F.col("url")).alias("host"))
    body = "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for p, a in RULES)
    rules = web.robots_rules(pages.select("host").distinct().withColumn("body", F.lit(body)), "grain")
    return web.robots_allowed(pages, rules).select("page_id", "allowed")
