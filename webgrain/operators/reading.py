"""Reading pages: slices of a budget, self-contained Markdown, metadata of several origins, payloads that fit, and the plans that join them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions import fixed
from webgrain.functions import text as T
from webgrain.functions.urls import let
from webgrain.operators import html, ranking


def sliced(markdown: Column, offset: Column | int = 0, chunks: int = 1, chars: int = 4000, tokens: int = 0) -> Column:
    """Struct of ``content``, ``next_offset`` and ``has_more``: consecutive chunks of a text from an offset.

    A chunk has at most ``chars`` characters and ends at the last blank line of its
    window if that lies in the window's back half; each is cut to ``tokens`` unless that
    is 0. The next offset counts what was passed over, not what was delivered.
    """
    chars = max(1, chars)
    text = F.coalesce(markdown, F.lit(""))
    total = F.length(text)
    start = F.least(F.greatest(F.lit(offset) if isinstance(offset, int) else offset, F.lit(0)), total).cast("int")

    def step(state: Column, _: Column) -> Column:
        window = F.substring(text, state["at"] + 1, F.lit(chars))
        back = F.position(F.lit("\n\n"), F.reverse(window))
        cut = F.when(back > 0, F.length(window) - back - 1).otherwise(-1)
        end = F.when(F.length(window) < chars, total).otherwise(state["at"] + F.when(cut > chars // 2, cut).otherwise(chars)).cast("int")
        part = F.substring(text, state["at"] + 1, end - state["at"])
        part = T.truncate_twice(part, tokens, chars) if tokens else part
        more = F.struct(F.concat(state["out"], part).alias("out"), end.alias("at"))
        return F.when(state["at"] >= total, state).otherwise(more)

    first = F.struct(F.lit("").alias("out"), start.alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, chunks))), first, step, lambda s: F.struct(s["out"].alias("content"), s["at"].alias("next_offset"), (s["at"] < total).alias("has_more")))


#: An inline link that is no image, with its label, target and title; fixed. Targets that stay as they are.
_LINK = re.compile(r'(?<!!)\[([^\]]*)\]\(([^()\s]+)(?:\s+"([^"]*)")?\)')
_KEPT = ("#", "//", "mailto:", "tel:", "javascript:", "data:", "ftp:")


def absolutised(markdown: Column, base: Column) -> Column:
    """Markdown whose inline links are joined with the page's address; images, fragments and other schemes stay. Doing it twice changes nothing."""

    @F.pandas_udf("string")
    def join(texts: pd.Series, bases: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        def one(text, at):
            def link(m: re.Match) -> str:
                if m[2].lower().startswith(_KEPT) or (full := urljoin(at, m[2])) == m[2]:
                    return m[0]
                return f'[{m[1]}]({full} "{m[3]}")' if m[3] is not None else f"[{m[1]}]({full})"

            return text if not text or at is None or "(" not in text else _LINK.sub(link, text)

        return pd.Series([one(t, b) for t, b in zip(texts, bases, strict=True)], dtype=object)

    return join(markdown, base)


def strategy(fetch_mode: Column, use_smart: Column) -> Column:
    """How a page is fetched: a call's own wish goes before the configured mode."""
    return F.when(use_smart == "static", "static-only").when(use_smart == "browser", "browser-first").when(fetch_mode == "static", "static-only").when(fetch_mode == "browser", "browser-only").otherwise("auto")


def sparse(value: Column) -> Column:
    """JSON without null members and empty arrays, at any depth; empty objects stay. Text that isn't JSON is null."""

    def lean(x):
        if isinstance(x, dict):
            return {k: v for k, w in x.items() if (v := lean(w)) is not None and v != []}
        return [lean(v) for v in x] if isinstance(x, list) else x

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(lean(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return apply(value)


#: Fields of a page's metadata copied into a document's: section, key, name there; fixed.
COPIED = (
    ("meta", "description", "description"), ("meta", "canonical", "canonical"), ("meta", "keywords", "keywords"), ("meta", "language", "language"), ("meta", "robots", "robots"),
    ("opengraph", "title", "og_title"), ("opengraph", "type", "og_type"), ("opengraph", "image", "og_image"), ("opengraph", "description", "og_description"), ("opengraph", "site_name", "og_site_name"), ("opengraph", "url", "og_url"),
    ("twitter", "card", "twitter_card"), ("twitter", "title", "twitter_title"), ("twitter", "description", "twitter_description"), ("twitter", "image", "twitter_image"), ("twitter", "site", "twitter_site"),
)


def merged_metadata(base: Column, meta: dict[str, Column]) -> Column:
    """A map of a document's metadata: its own (``base``, a map), enriched by sections of its page (maps by section name).

    A filled field of the page goes before the base's; but the title of the base stays
    if it has one. Empty and null values are left out of what is copied.
    """
    none = F.create_map().cast("map<string,string>")
    pairs = [F.struct(F.lit(name).alias("k"), F.element_at(meta[section], F.lit(key)).alias("v")) for section, key, name in COPIED if section in meta]
    own = F.coalesce(base, none)
    if "meta" in meta:
        title = F.when(F.coalesce(F.element_at(own, F.lit("title")), F.lit("")) == "", F.element_at(meta["meta"], F.lit("title")))
        pairs.append(F.struct(F.lit("title").alias("k"), title.alias("v")))
    copied = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull() & (p["v"] != "")))
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(copied, k)), copied)


def search_key(query: Column, most: Column, provider: Column, merge: str = "concat") -> Column:
    """The key of a cached search: equal for spellings of one query, results asked, provider and way of merging."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"(?U)\s+", " "))
    return F.sha2(F.concat_ws("|", plain, most.cast("string"), F.coalesce(F.nullif(provider, F.lit("")), F.lit("default")), F.lit(f"merge={merge}")), 256)


def cache_hits(log: DataFrame, key: str, at: str, put: Column, ttl: float) -> DataFrame:
    """``log`` with ``hit``: whether the last result put under the key before a look-up is no older than ``ttl``; null for rows that put."""
    before = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(put, F.col(at)), ignorenulls=True).over(before)
    return log.withColumn("hit", F.when(~put, F.coalesce(F.col(at) - last <= ttl, F.lit(False))))


def frontier(found: DataFrame, crawl: str, score: str, order: str, most: int = 200) -> DataFrame:
    """The best ``most`` candidates of each crawl with their ``place``; ties to the one found first. Tasks keep their own best before they meet."""
    by = Window.partitionBy(crawl).orderBy(F.col(score).desc(), F.col(order))
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def sheet_csv(sheets: Column) -> Column:
    """Sheets (array of ``title`` and ``rows``) as Markdown headings over CSV; cells with commas, quotes or line ends are quoted."""
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    row = lambda r: F.when((F.size(r) == 1) & (F.coalesce(r[0], F.lit("")) == ""), F.lit('""')).otherwise(F.array_join(F.transform(r, cell), ","))
    table = lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n\n"), F.array_join(F.transform(s["rows"], row), "\n"))
    return F.array_join(F.transform(_filled(sheets), table), "\n\n")


def sheet_json(sheets: Column) -> Column:
    """The same as a JSON array of ``sheet``, ``headers`` (the first row) and ``rows``."""
    return F.to_json(F.transform(_filled(sheets), lambda s: F.struct(s["title"].alias("sheet"), s["rows"][0].alias("headers"), F.slice(s["rows"], F.lit(2), F.size(s["rows"])).alias("rows"))))


def _filled(sheets: Column) -> Column:
    named = F.transform(sheets, lambda s, i: F.struct(F.coalesce(F.nullif(s["title"], F.lit("")), F.concat(F.lit("Section "), (i + 1).cast("string"))).alias("title"), F.filter(s["rows"], lambda r: F.size(r) > 0).alias("rows")))
    return F.filter(named, lambda s: F.size(s["rows"]) > 0)


def extracted(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, kind, text`` of files by their ending: pages become Markdown, JSON is written anew, other texts are decoded. Endings that no reader knows are null."""
    from webgrain.sources.web import plain_text, pretty_json

    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ending.isin("html", "htm", "xhtml"), "page").when(ending == "json", "json").when(ending.isin("txt", "md", "csv", "tsv", "xml", "log", "rst"), "text")
    rows = files.select(path, kind.alias("kind"), plain_text(files, content).alias("_t"))
    pages = html.inspect(rows.where("kind = 'page'").select(path, "_t"), path, "_t").select(path, F.lit("page").alias("kind"), F.col("markdown").alias("text"))
    other = rows.where("kind is null or kind <> 'page'").select(path, "kind", F.when(F.col("kind") == "json", pretty_json(F.col("_t"))).when(F.col("kind") == "text", F.col("_t")).alias("text"))
    return pages.unionByName(other)


def fitted(texts: Column, limit: int, floor: int = 240, mark: str = fixed.TRUNCATED, overflow: str = "too large") -> Column:
    """A JSON array of texts (an array) that has at most ``limit`` characters.

    As it is if it fits; else with each text cut to half the limit, a quarter and so on
    down to ``floor``, the first that fits; else an object with an ``error``. So the
    answer is always JSON.
    """
    tries, budget = [], limit
    while budget > floor:
        budget //= 2
        tries.append(budget)
    # A text takes no fewer characters in JSON.
    whole = lambda ts: F.when(F.aggregate(ts, F.lit(0), lambda n, t: n + F.coalesce(F.length(t), F.lit(0))) <= limit, F.to_json(ts))
    cut = lambda ts, n: F.to_json(F.transform(ts, lambda t: F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit(mark))).otherwise(t)))

    def tried(ts: Column, left: list[int], made: Column) -> Column:
        """What was made if it fits, else what is made next; each is made once, and only where those before don't fit."""
        return let(made, lambda m: F.when(F.length(m) <= limit, m).otherwise(tried(ts, left[1:], cut(ts, left[0])) if left else F.to_json(F.struct(F.lit(overflow).alias("error")))))

    return let(texts, lambda ts: tried(ts, tries, whole(ts)))


def inspected(pages: DataFrame, query: str, key: str = "page_id", url: str = "url", page: str = "html", chars: int = 4000, links: int = 20) -> DataFrame:
    """Page inspection in one plan: ``key, title, markdown, selected, next_offset, has_more, follow_ups`` of each page.

    With sections that answer the query, the best of them within ``chars``; else the
    first slice of the whole text. Links in the Markdown are absolute; follow-ups are
    the page's first links.
    """
    read = html.inspect(pages, key, page).join(pages.select(key, url), key)
    text = read.select(key, absolutised(F.col("markdown"), F.col(url)).alias("_md"))
    chosen = ranking.select_sections(ranking.split_sections(text, key, "_md"), query, chars, key).select(key, F.col("markdown").alias("_chosen"), "selected")
    more = html.follow_ups(html.links(pages, key, url, page), key, links).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("url", "type"))).alias("follow_ups"))
    about = html.metadata(pages, key, url, page).select(key, "title")
    s = sliced(F.col("_md"), chars=chars)
    both = text.join(chosen, key, "left").join(more, key, "left").join(about, key, "left").withColumn("_s", s)
    whole = F.col("_chosen").isNull()
    return both.select(key, "title", F.coalesce("_chosen", "_s.content").alias("markdown"), F.coalesce("selected", F.lit(0)).alias("selected"), F.when(whole, F.col("_s.next_offset")).alias("next_offset"), (whole & F.col("_s.has_more")).alias("has_more"), F.coalesce("follow_ups", F.array().cast("array<struct<url:string,type:string>>")).alias("follow_ups"))
