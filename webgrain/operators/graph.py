"""Crawls over a stored link graph, and checks of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions import fixed, urls
from webgrain.operators.ranking import anchor_context, counted
from webgrain.session import saved

DECAY, QUEUE, MOST_PAGES, MOST_DEPTH, TOPIC = 0.7, 200, 50, 5, 40
QUERY_WEIGHT, CONTEXT_WEIGHT, FLAT_UNTIL = 0.7, 0.3, 3


def expanded(base: Column, clusters: list[list[str]]) -> Column:
    """The terms of a query (an array) and words of the clusters that hold one of them, in the order of sorted terms and clusters, at most doubling the query."""
    groups = F.array(*(F.array(*map(F.lit, c)) for c in clusters))
    found = F.flatten(F.transform(F.array_sort(F.array_distinct(base)), lambda t: F.flatten(F.filter(groups, lambda c: F.array_contains(c, t)))))
    return F.concat(base, F.slice(F.array_except(found, base), F.lit(1), F.size(base)))


def weighted_link_score(url: Column, label: Column, query: Column, base: Column, topic: Column, idf: Column, read: Column) -> Column:
    """A link's score with weights: ``idf`` maps words to their weight after ``read`` pages (1 for all before the third).

    ``label`` are the words of anchor, path and anchor context; words of ``query`` that
    are not in ``base`` weigh half. From the third page on, paths of documentation count
    more and those of shops less.
    """
    flat = F.log(1 + (read + 0.5) / 0.5)
    weight = lambda w: F.when(read < FLAT_UNTIL, F.lit(1.0)).otherwise(F.coalesce(F.element_at(idf, w), flat))
    asked = lambda w: weight(w) * F.when(F.array_contains(base, w), 1.0).otherwise(0.5)
    total = lambda ws, of: F.aggregate(ws, F.lit(0.0), lambda a, w: a + of(w))
    share = lambda part, whole, of: F.coalesce(total(part, of) / F.nullif(total(whole, of), F.lit(0.0)), F.lit(0.0))
    score = QUERY_WEIGHT * share(F.array_intersect(label, query), F.array_distinct(query), asked) + CONTEXT_WEIGHT * share(F.array_intersect(label, topic), F.array_distinct(label), weight)
    return score * F.when(read >= FLAT_UNTIL, urls.path_prior(url)).otherwise(1.0)


def words(text: Column) -> Column:
    """A text's words without those that say nothing."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(*fixed.CRAWL_STOPWORDS))


def focused_crawl(pages: DataFrame, edges: DataFrame, roots: DataFrame, most_pages: int = 15, depth: int = 3, least: float = 0.05, same_host: bool = False, clusters: list[list[str]] | None = None) -> DataFrame:
    """Best-first crawls from many roots, all together: ``site, root, kind, seq, url, depth, score``.

    ``pages``: ``site, url, text``; ``edges``: ``site, src, dst, anchor, pos``; ``roots``:
    ``site, root, query``. A round pops each crawl's best candidate (score times 0.7 to
    the depth, then the one found first), reads its page, and scores that page's links:
    by the words of anchor, path and the text around the anchor, weighed by how rare they
    are among the pages the crawl has read, against the query (with words of its
    ``clusters``, which weigh half) and the page's most frequent words. Links to
    documents are collected with their score (``kind`` document) and not read; assets,
    boilerplate paths and, with ``same_host``, other hosts are passed over. A queue keeps
    its best 200; pages that aren't there don't count.

    A round joins each crawl's page of that round only, so there are as many rounds as
    pages are read, at most ``most_pages``, however many crawls and pages there are.
    """
    by = ["site", "root"]
    texts = pages.select(F.col("site"), F.col("url"), F.col("text"))
    base = F.array_distinct(words(F.col("query")))
    crawls = saved(roots.select(*by, base.alias("base"), (expanded(base, clusters) if clusters else base).alias("asked")))
    queue = saved(crawls.select(*by, F.lit(0).cast("long").alias("found"), F.lit(1.0).alias("rank"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"), F.col("root").alias("url")).join(texts.select("site", "url").distinct().withColumn("there", F.lit(True)), ["site", "url"], "left").select(*by, "found", "rank", "depth", "score", "url", F.coalesce("there", F.lit(False)).alias("there")))
    visited = saved(queue.select(*by, "url"))
    corpus = out = documents = None
    for turn in range(min(most_pages, MOST_PAGES)):
        # The best candidate that is there; better ones that are not would have failed.
        best = queue.where("there").groupBy(by).agg(F.max(F.struct("rank", (-F.col("found")).alias("first"), "depth", "score", "url")).alias("b"))
        now = saved(best.select(*by, "b.rank", (-F.col("b.first")).alias("first"), "b.depth", "b.score", "b.url").join(texts, ["site", "url"]).dropDuplicates(by))
        if now.isEmpty():
            break
        done = now.select(*by, F.lit("page").alias("kind"), F.lit(turn).alias("seq"), "url", "depth", "score")
        out = done if out is None else saved(out.unionAll(done))
        left = queue.join(now.select(*by, F.col("rank").alias("r"), "first"), by).where("rank < r or (rank = r and found > first)").drop("r", "first")
        read = now.select(*by, F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
        corpus = saved(read if corpus is None else corpus.unionAll(read))
        topic = counted(now.withColumn("_k", F.concat_ws("\n", *by)).select("_k", "text"), "_k", words(F.col("text")), TOPIC).groupBy("_k").agg(F.collect_list("word").alias("topic"))
        opened = now.where(F.col("depth") < min(depth, MOST_DEPTH)).withColumn("_k", F.concat_ws("\n", *by)).join(topic, "_k", "left").join(crawls, by).select(*by, "url", "text", "depth", "base", "asked", F.coalesce("topic", F.array().cast("array<string>")).alias("topic"))
        links = opened.join(edges.withColumnsRenamed({"src": "url"}), ["site", "url"])
        kind = F.when(urls.classify_link(F.col("dst")) == "document", "document").otherwise("page")
        fine = (F.col("kind") == "document") | (urls.skip_reason(F.col("dst")).isNull() & ((F.lower(urls.domain_of(F.col("dst"))) == F.lower(urls.domain_of(F.col("root")))) | F.lit(not same_host)))
        links = links.withColumn("kind", kind).where(fine)
        path = F.regexp_replace(F.regexp_replace("dst", "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
        around = F.when((F.col("kind") == "page") & (F.coalesce(F.col("anchor"), F.lit("")) != "(untitled)"), anchor_context(F.col("text"), F.col("anchor"))).otherwise(F.array().cast("array<string>"))
        label = F.array_distinct(F.concat(words(F.col("anchor")), words(path), around))
        links = saved(links.select(*by, "url", "depth", "base", "asked", "topic", "kind", "dst", "pos", label.alias("label")).join(visited.withColumnRenamed("url", "dst"), [*by, "dst"], "left_anti"))
        # Weights of the words in question only.
        needed = links.select(*by, F.explode(F.concat("label", "asked")).alias("word")).distinct()
        n = F.lit(turn + 1)
        df = needed.join(corpus, [*by, "word"]).groupBy(*by, "word").agg(F.count("*").alias("df"))
        idf = df.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("word", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("w")))).alias("idf"))
        scored = links.join(idf, by, "left").withColumn("idf", F.coalesce("idf", F.create_map().cast("map<string,double>")))
        score = F.round(weighted_link_score(F.col("dst"), F.col("label"), F.col("asked"), F.col("base"), F.col("topic"), F.col("idf"), n), 12)
        scored = saved(scored.select(*by, "kind", "dst", "pos", (F.col("depth") + 1).alias("depth"), score.alias("score")).where((F.col("score") >= least) | (F.col("kind") == "document")))
        # A document has the score of the link by which it is first seen.
        papers = scored.where("kind = 'document'").groupBy(*by, F.col("dst").alias("url")).agg(F.min_by("score", "pos").alias("score"), F.min("depth").alias("depth"))
        documents = papers if documents is None else documents.unionAll(papers.join(documents, [*by, "url"], "left_anti"))
        documents = saved(documents.select(*by, "url", "score", "depth"))
        first = scored.where("kind = 'page'").groupBy(*by, F.col("dst").alias("url")).agg(F.min(F.struct("pos", "score", "depth")).alias("f")).select(*by, "url", "f.*")
        place = F.row_number().over(Window.partitionBy(*by).orderBy("pos", "url"))
        # Later rounds find later.
        pushed = first.select(*by, (F.lit((turn + 1) << 32) + place).alias("found"), (F.col("score") * F.pow(F.lit(DECAY), F.col("depth"))).alias("rank"), "depth", "score", "url")
        pushed = pushed.join(texts.select("site", "url").distinct().withColumn("there", F.lit(True)), ["site", "url"], "left").select(*by, "found", "rank", "depth", "score", "url", F.coalesce("there", F.lit(False)).alias("there"))
        visited = saved(visited.unionAll(pushed.select(*by, "url")))
        keep = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("rank").desc(), F.col("found").desc()))
        queue = saved(left.unionByName(pushed).withColumn("_n", keep).where(F.col("_n") <= QUEUE).drop("_n"))
    if out is None:
        return saved(queue.where("1 = 0").select(*by, F.lit("page").alias("kind"), F.lit(0).alias("seq"), "url", "depth", "score"))
    return out.unionByName(documents.where(F.col("score") >= least).select(*by, F.lit("document").alias("kind"), F.lit(None).cast("int").alias("seq"), "url", "depth", "score"))


def level_crawl(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """Breadth-first reach, all roots together and level by level: ``root, url, depth``. It is not the best-first order; it scales with the edges."""
    seen = roots.select("root", F.col("root").alias("url"), F.lit(0).alias("depth"))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(edges, front["url"] == edges["src"]).select("root", F.col("dst").alias("url")).distinct()
        front = saved(step.join(seen, ["root", "url"], "left_anti").withColumn("depth", F.lit(level)))
        seen = saved(seen.union(front))
    return seen


def public_hosts(hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """``host, public``: whether every resolved address of a host is public; a host without addresses isn't."""
    private = dns.groupBy("host").agg(F.bool_or(F.coalesce(urls.private_ip(F.col("ip")), F.lit(True))).alias("_p"))
    return hosts.join(private, "host", "left").select("host", (~F.coalesce("_p", F.lit(True))).alias("public"))
