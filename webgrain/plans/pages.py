"""Queries on web pages: URLs, links, main content, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from webgrain.functions import fixed, urls
from webgrain.operators import html, records
from webgrain.plans.registry import register, table

CANON_SQL = """lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' ||
  regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') ||
  CASE WHEN regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END"""
QUERY_SQL = "list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''))"


@register("canonical_url_drop", f"SELECT page_id, {CANON_SQL} AS canonical FROM pages")
def canonical_url_drop(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url"), "drop").alias("canonical"))


@register("canonical_url_keep", f"SELECT page_id, CASE WHEN len(q) = 0 THEN c ELSE c || '?' || array_to_string(q, '&') END AS canonical FROM (SELECT page_id, {CANON_SQL} AS c, {QUERY_SQL} AS q FROM pages)")
def canonical_url_keep(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url"), "keep").alias("canonical"))


@register("canonical_url_untracked", f"SELECT page_id, CASE WHEN len(q) = 0 THEN c ELSE c || '?' || array_to_string(q, '&') END AS canonical FROM (SELECT page_id, {CANON_SQL} AS c, list_filter({QUERY_SQL}, lambda x: NOT regexp_matches(lower(x), '^({'|'.join(fixed.TRACKING_KEYS)})')) AS q FROM pages)")
def canonical_url_untracked(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url"), "drop-tracking").alias("canonical"))


@register("normalize_url", "SELECT page_id, url, CAST(NULL AS VARCHAR) AS error FROM pages")
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.concat(F.lit(' "<'), F.col("url"), F.lit('>" '))).alias("n")).select("page_id", "n.url", "n.error")


@register("domain_of", "SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS domain FROM pages")
def domain_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.domain_of(F.col("url")).alias("domain"))


@register("classify_link", f"SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '\\.({'|'.join(fixed.DOCUMENT_ENDINGS)})$') THEN 'document' ELSE 'page' END AS kind FROM pages")
def classify_link(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.classify_link(F.col("url")).alias("kind"))


@register("crawl_skip", f"""
SELECT page_id, CASE WHEN regexp_matches(p, '\\.({'|'.join(fixed.ASSET_ENDINGS)})$') THEN 'asset' WHEN regexp_matches(p, '^({'|'.join(fixed.BOILERPLATE_PATHS)})') THEN 'boilerplate' END AS reason
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)
""")
def crawl_skip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.skip_reason(F.col("url")).alias("reason"))


LINKS_SQL = """
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS tag, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) AS pos FROM pages),
l AS (SELECT page_id, pos, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || regexp_extract(tag, 'href="([^"]*)"', 1) AS href, regexp_extract(tag, '>([^<]*)<', 1) AS label FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS n FROM l)
"""


@register("page_links", LINKS_SQL + "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, href, label FROM f WHERE n = 1")
def page_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages"), "page_id", "url", "html")


@register("follow_up_candidates", LINKS_SQL + "SELECT page_id, href AS url, CASE WHEN label = '' THEN '(untitled)' ELSE label END AS title, 'page' AS type FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM f WHERE n = 1) WHERE r <= 3")
def follow_up_candidates(spark, sf_dir):
    return html.follow_ups(html.links(table(spark, sf_dir, "pages"), "page_id", "url", "html"), "page_id", 3)


@register("url_dedupe", f"SELECT min(page_id) AS page_id FROM pages GROUP BY {CANON_SQL}")
def url_dedupe(spark, sf_dir):
    return records.first_seen(table(spark, sf_dir, "pages"), urls.canonical_url(F.col("url"), "drop"), "page_id").select("page_id")


@register("unvisited", f"SELECT page_id FROM pages WHERE {CANON_SQL} NOT IN (SELECT {CANON_SQL} FROM pages WHERE page_id % 3 = 0)")
def unvisited(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return records.unvisited(pages.select("page_id", "url"), pages.where("page_id % 3 = 0").select("url"), query="drop").select("page_id")


def decoded_sql(text: str) -> str:
    """The rule of ``html._unescaped`` as SQL."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " ")):
        text = f"replace({text}, '{entity}', '{char}')"
    code = "TRY_CAST(CASE WHEN lower(n[1]) = 'x' THEN '0' || lower(n) ELSE n END AS BIGINT)"
    char = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr(CAST({code} AS INTEGER)) ELSE chr(65533) END"
    numbers = f"list_distinct(regexp_extract_all({text}, '&#([xX][0-9a-fA-F]+|[0-9]+);', 1))"
    return f"replace(list_reduce(list_prepend({text}, {numbers}), lambda t, n: replace(t, '&#' || n || ';', {char})), '&amp;', '&')"


#: What a page's head says: the first title, the language of the root element and the charset, null where there is none.
_ROOT = "regexp_extract(coalesce(html, ''), '(?is)<html[^>]*>')"
_LANG = "coalesce({}, {}, {})".format(*(f"nullif(regexp_extract({_ROOT}, '(?is)[\\s\\x0B]lang[\\s\\x0B]*=[\\s\\x0B]*{value}', 1), '')" for value in ('"([^"]*)"', "''([^'']*)''", "([^\\s\\x0B\"''>]+)")))
_TITLE = decoded_sql("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")
HEAD_SQL = f"""SELECT page_id, url, CASE WHEN trim(title, ' ') <> '' THEN title END AS title, nullif(trim(lang, ' '), '') AS lang, nullif(charset, '') AS charset FROM (
  SELECT page_id, url, regexp_replace({_TITLE}, '[\\s\\x0B]+', ' ', 'g') AS title, {decoded_sql(_LANG)} AS lang,
    regexp_extract(coalesce(html, ''), '(?is)<meta[^>]*charset[\\s\\x0B]*=[\\s\\x0B]*["'']?([A-Za-z0-9_-]+)', 1) AS charset FROM pages)"""


@register("page_titles", f"SELECT page_id, title, lang, charset FROM ({HEAD_SQL})")
def page_titles(spark, sf_dir):
    m = html.metadata(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return m.select("page_id", "title", "lang", "charset")


@register("page_markdown")
def page_markdown(spark, sf_dir):
    return html.inspect(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "label", "removed", F.sha2("markdown", 256).alias("markdown_sha256"), F.length("markdown").alias("chars"))


@register("page_metadata")
def page_metadata(spark, sf_dir):
    return html.metadata(table(spark, sf_dir, "pages"), "page_id", "url", "html")


@register("safe_names", "SELECT page_id, CASE WHEN s = '' THEN 'asset' ELSE s END AS name FROM (SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 80) AS s FROM pages)")
def safe_names(spark, sf_dir):
    from webgrain.functions import text

    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@register("human_sizes", "SELECT page_id, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS size FROM (SELECT page_id, strlen(html)::DOUBLE AS b FROM pages)")
def human_sizes(spark, sf_dir):
    from webgrain.functions import text

    return table(spark, sf_dir, "pages").select("page_id", text.human_size(F.octet_length("html")).alias("size"))
