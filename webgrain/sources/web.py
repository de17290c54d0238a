"""Robots files, feeds, sitemaps and plain texts as tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions.urls import joined_url, path_of, robots_pattern
from webgrain.session import saved


def robots_rules(files: DataFrame, agent: str, host: str = "host", body: str = "body") -> DataFrame:
    """``host, pos, allow, path`` and ``delay`` of the group that applies to an agent.

    Every ``User-agent`` line opens a group. An exact name beats a name contained in the
    agent, the first of equals wins; without either the first ``*`` group applies, which
    also gives the delay if the chosen group has none.
    """
    lines = files.select(host, F.posexplode(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n")).alias("pos", "line"))
    clean = F.trim(F.regexp_replace("line", "#.*$", ""))
    parts = lines.select(host, "pos", F.lower(F.trim(F.substring_index(clean, ":", 1))).alias("k"), F.trim(F.regexp_replace(clean, "^[^:]*:", "")).alias("v")).where(F.col("k").isin("user-agent", "allow", "disallow", "crawl-delay"))
    by = Window.partitionBy(host).orderBy("pos")
    grouped = parts.withColumn("g", F.sum((F.col("k") == "user-agent").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("g > 0")
    name = F.lower("v")
    rank = F.when(name == agent.lower(), 3).when(name == "*", 1).when(F.lit(agent.lower()).contains(name), 2)
    groups = grouped.where("k = 'user-agent'").select(host, "g", rank.alias("rank")).where("rank is not null")
    chosen = groups.groupBy(host).agg(F.max(F.struct("rank", (-F.col("g")).alias("g"))).alias("c"), F.min(F.when(F.col("rank") == 1, F.col("g"))).alias("star")).select(host, (-F.col("c.g")).alias("g"), "star")
    delays = grouped.where("k = 'crawl-delay'").groupBy(host, "g").agg(F.min_by(F.col("v").try_cast("double"), "pos").alias("delay"))
    own = chosen.join(delays, [host, "g"], "left").join(delays.select(host, F.col("g").alias("star"), F.col("delay").alias("star_delay")), [host, "star"], "left")
    rules = grouped.where("k in ('allow', 'disallow') and v <> ''").select(host, "g", "pos", (F.col("k") == "allow").alias("allow"), F.col("v").alias("path"))
    return own.join(rules, [host, "g"], "left").select(host, "pos", "allow", "path", F.coalesce("delay", "star_delay").alias("delay"))


def robots_allowed(urls: DataFrame, rules: DataFrame, host: str = "host", url: str = "url") -> DataFrame:
    """``urls`` with ``allowed``: the longest matching rule decides, allow wins a tie, no rule allows.

    A rule is found by its literal beginning, the part before its first star or closing
    dollar: paths are joined with the rules that begin like them, at the lengths that the
    host's rules have. Only those with a star or dollar are then held against the whole
    path. So a host may have any number of rules, and none of them is looked at twice.
    """
    query = F.regexp_extract(url, r"\?[^#]*", 0)
    path = F.concat(F.when(path_of(F.col(url)) == "", "/").otherwise(path_of(F.col(url))), query)
    rows = urls.withColumn("_path", path)
    written = rules.where("path is not null").select(F.col(host).alias("_h"), "allow", "path", F.length("path").alias("n"), F.regexp_extract(F.regexp_replace("path", r"\$$", ""), r"^[^*]*", 0).alias("_begin"))
    written = written.groupBy("_h", "_begin", "path", "n").agg(F.bool_or("allow").alias("allow"))
    lengths = written.groupBy("_h").agg(F.collect_set(F.length("_begin")).alias("_lengths"))
    asked = rows.select(F.col(host).alias("_h"), "_path").distinct().join(lengths, "_h")
    begun = asked.select("_h", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n")).withColumn("_begin", F.substring(F.col("_path"), F.lit(1), F.col("_n")))
    plain = ~F.col("path").contains("*") & ~F.col("path").endswith("$")
    met = begun.join(written, ["_h", "_begin"]).where(plain | F.regexp_like("_path", robots_pattern(F.col("path"))))
    best = met.groupBy("_h", "_path").agg(F.max(F.struct("n", "allow")).alias("_best")).withColumnRenamed("_path", "_p")
    joined = rows.join(best, (F.col(host) == F.col("_h")) & (F.col("_path") == F.col("_p")), "left")
    return joined.select(*urls.columns, F.coalesce("_best.allow", F.lit(True)).alias("allowed"))


def _bare(body: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(body), r"\sxmlns(:\w+)?\s*=\s*\"[^\"]*\"", ""), r"(</?)[A-Za-z0-9]+:", "$1"), r"(?s)<\?.*?\?>|<!DOCTYPE[^>]*>", "")


#: What is read of an RSS, RDF or Atom item; ``_bad`` is filled where it isn't XML.
ITEM = "title string, link array<struct<_VALUE string, _href string, _rel string>>, pubDate string, updated string, published string, date string, description string, summary string, content string, encoded string, _bad string"


def feed_items(feeds: DataFrame, key: str = "url", body: str = "body", most: int = 50) -> DataFrame:
    """``key, pos, title, link, date, description, total`` of RSS, RDF and Atom items; ``total`` counts those beyond ``most`` too.

    A feed is split into its items, and each is read as XML, so a large feed is never a
    tree; references and CDATA are resolved by the reader. Of Atom's links the first
    alternate one counts. What isn't well-formed is read by its tags instead.
    """
    items = F.regexp_extract_all(_bare(F.coalesce(F.col(body), F.lit(""))), F.lit(r"(?s)(<(?:item|entry)\b.*?</(?:item|entry)>)"), F.lit(1))
    each = feeds.select(key, F.size(items).alias("total"), F.posexplode(F.slice(items, 1, most)).alias("pos", "_i"))
    each = each.withColumn("_x", F.from_xml("_i", ITEM, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "valueTag": "_VALUE", "attributePrefix": "_"}))
    each = each.withColumn("_ok", F.col("_x").isNotNull() & F.col("_x._bad").isNull())

    def tidy(text: Column) -> Column:
        return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))

    def one(*names: str) -> Column:
        tagged = [tidy(_entities(F.regexp_extract("_i", rf"(?s)<{n}\b[^>]*>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{n}>", 1))) for n in names]
        read = [tidy(F.col(f"_x.{n}")) for n in names if n != "link"]
        return F.when(F.col("_ok"), F.coalesce(*read)).otherwise(F.coalesce(*tagged)) if read else F.coalesce(*tagged)

    links = F.filter(F.transform("_x.link", lambda x: F.struct(F.coalesce(x["_rel"], F.lit("alternate")).alias("rel"), F.coalesce(tidy(x["_VALUE"]), tidy(x["_href"])).alias("to"))), lambda x: x["to"].isNotNull())
    best = F.coalesce(F.get(F.filter(links, lambda x: x["rel"] == "alternate"), 0)["to"], F.get(links, 0)["to"])
    href = tidy(_entities(F.regexp_extract("_i", r"<link\b[^>]*href\s*=\s*[\"']([^\"']*)[\"']", 1)))
    link = F.when(F.col("_ok"), best).otherwise(F.coalesce(one("link"), href))
    return each.select(key, "pos", one("title").alias("title"), link.alias("link"), one("pubDate", "updated", "published", "date").alias("date"), one("description", "summary", "content").alias("description"), "total")


def _entities(text: Column) -> Column:
    """References of XML in a text that isn't well-formed: the five names, each once."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def sitemap_urls(pages: DataFrame, roots: DataFrame, url: str = "url", body: str = "body", hops: int = 3, fetches: int = 10, each: int = 500, total: int = 1000) -> DataFrame:
    """``root, pos, url, truncated`` of the pages that sitemaps list, through index files up to ``hops`` behind the root.

    ``pages`` holds the sitemaps by address. Sitemaps are read in the order found, level
    by level, each once, at most ``fetches`` a root whether or not they are there;
    ``each`` addresses of one and ``total`` of a root count, relative ones joined with
    the sitemap's. What an index at the last hop lists are pages. ``truncated`` tells that
    one of the last two bounds cut something. All roots go level by level together, so
    the number of jobs is that of the levels.
    """
    text = _bare(F.coalesce(F.col(body), F.lit("")))
    kind = F.regexp_extract(text, r"(?s)^\s*(?:<!--.*?-->\s*)*<(urlset|sitemapindex)\b", 1)
    locs = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))), lambda x: x != "")
    parsed = pages.select(F.col(url).alias("_at"), (kind == "sitemapindex").alias("_index"), locs.alias("_locs")).where(kind != "")
    level = roots.select(F.col(url).alias("root"), F.col(url).alias("_at"), F.array(F.lit(0)).alias("_path"))
    read = found = cuts = None
    for hop in range(hops + 1):
        n = F.row_number().over(Window.partitionBy("root").orderBy("_path"))
        if read is None:
            now = level.withColumn("_n", n)
        else:
            used = read.groupBy("root").agg(F.count("*").alias("_used"))
            fresh = level.join(read.select("root", "_at"), ["root", "_at"], "left_anti")
            now = fresh.withColumn("_n", n).join(used, "root").where(F.col("_n") + F.col("_used") <= fetches).drop("_used")
        now = saved(now.where(F.col("_n") <= fetches).select("root", "_at", "_path"))
        read = now if read is None else read.unionAll(now)
        opened = now.join(parsed, "_at")
        over = opened.where(F.size("_locs") > each).select("root")
        cuts = over if cuts is None else cuts.unionAll(over)
        step = opened.select("root", "_index", "_at", "_path", F.posexplode(F.slice("_locs", 1, each)).alias("_p", "loc"))
        absolute = F.when(F.col("loc").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("loc")).otherwise(joined_url(F.col("loc"), F.col("_at")))
        step = step.select("root", "_index", absolute.alias("loc"), F.concat("_path", F.array("_p")).alias("_path"))
        leaf = ~F.col("_index") if hop < hops else F.lit(True)
        leaves = step.where(leaf).select("root", "loc", F.lit(hop).alias("_hop"), "_path")
        found = leaves if found is None else found.union(leaves)
        level = step.where(F.col("_index")).groupBy("root", "loc").agg(F.min("_path").alias("_path")).select("root", F.col("loc").alias("_at"), "_path")
    first = found.groupBy("root", "loc").agg(F.min(F.struct("_hop", "_path")).alias("_place"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("_place")) - 1
    placed = first.select("root", place.alias("pos"), F.col("loc").alias("url"))
    cut = placed.where(F.col("pos") >= total).select("root").unionAll(cuts).distinct().withColumn("truncated", F.lit(True))
    return placed.where(F.col("pos") < total).join(cut, "root", "left").select("root", "pos", "url", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def plain_text(files: DataFrame, content: str = "content") -> Column:
    """Bytes as text: a byte-order mark goes, bytes that aren't UTF-8 become U+FFFD."""
    return F.regexp_replace(F.make_valid_utf8(F.col(content).cast("string")), "^﻿", "")


def pretty_json(text: Column) -> Column:
    """JSON written anew on several lines, or the text itself where it isn't JSON."""

    @F.pandas_udf("string")
    def written(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
            except (TypeError, ValueError):
                return t

        return texts.map(one)

    return written(text)
