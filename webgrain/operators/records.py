"""De-duplication, merging and the joins that a research pipeline makes of records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions import fixed
from webgrain.functions.text import normal_arxiv, normal_doi
from webgrain.functions.urls import canonical_url, content_hash


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows that are the first of their key; rows without a key all stay.

    The first row of each key is found by an aggregate that tasks begin before the
    shuffle, so a key that very many rows share costs no more than others.
    """
    keyed = df.withColumn("_key", key)
    firsts = keyed.where("_key is not null").groupBy("_key").agg(F.min(order).alias("_first"))
    joined = keyed.join(firsts, "_key", "left")
    return joined.where(F.col("_key").isNull() | (F.col(order) == F.col("_first"))).drop("_key", "_first")


def dedupe_keys(by: tuple[str, ...]) -> dict[str, Column]:
    """The key columns of a result: DOI, canonical URL, hash of title and snippet."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    snippet = F.coalesce(filled("snippet"), filled("summary"), filled("description"), F.lit(""))
    title = F.coalesce(filled("title"), F.lit(""))
    keys = {
        "doi": F.when(F.trim("doi") != "", F.lower(F.trim("doi"))),
        "url": canonical_url(filled("url"), "drop"),
        "hash": F.when((title != "") | (snippet != ""), content_hash(F.concat(F.trim(title), F.lit("||"), F.trim(snippet)))),
    }
    return {k: keys[k] for k in by}


def greedy_dedupe(df: DataFrame, by: tuple[str, ...] = ("doi", "url", "hash"), order: str = "ord", group: str | None = None) -> DataFrame:
    """``df`` with ``kept``, ``reason`` and ``match``: a row is dropped if one of its keys is a key of a row kept before it.

    The rule is sequential (dropped rows claim no keys) but settles in rounds: undecided
    rows that share a key with a kept earlier row are dropped, and those that are the
    first undecided ones of all their keys are kept. A row with one undecided row before
    it is kept if that one is not; such rows are followed to the end of their chain by
    doubling, so a chain of n rows takes a logarithm of n joins. Only (key, order) pairs
    are shuffled. Rows without keys are kept. ``group`` confines keys to a group.
    """
    from webgrain.session import saved

    scope = F.col(group).cast("string") if group else F.lit("")
    keys = dedupe_keys(by)
    rows = saved(df.select("*", *(F.struct(F.lit(k).alias("field"), scope.alias("g"), c.alias("key")).alias(f"_k_{k}") for k, c in keys.items())))
    pairs = saved(rows.select(order, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_k_{k}").alias("k")) for i, k in enumerate(by)))).alias("e")).select(order, "e.i", "e.k").where("k.key is not null"))
    decided = pairs.select(order).distinct().select(order, F.lit(None).cast("boolean").alias("kept"))
    while not decided.where("kept is null").isEmpty():
        decided = saved(decided.join(_verdicts(pairs, decided, order), order, "left").select(order, F.coalesce("kept", "new").alias("kept")))
    winners = pairs.join(decided.where("kept"), order).groupBy("k").agg(F.min(order).alias("winner"))
    hit = pairs.join(winners, "k").where(F.col("winner") < F.col(order)).groupBy(order).agg(F.min(F.struct("i", "k")).alias("hit"))
    out = rows.drop(*(f"_k_{k}" for k in by)).join(decided, order, "left").join(hit, order, "left")
    kept = F.coalesce("kept", F.lit(True))
    return out.select(*df.columns, kept.alias("kept"), F.when(~kept, F.col("hit.k.field")).alias("reason"), F.when(~kept, F.col("hit.k.key")).alias("match"))


def _verdicts(pairs: DataFrame, decided: DataFrame, order: str) -> DataFrame:
    """``order, new`` of rows that ``greedy_dedupe`` can decide now, among them the first of all undecided ones."""
    from webgrain.session import saved

    state = pairs.join(decided, order)
    won = state.where("kept").groupBy("k").agg(F.min(order).alias("winner"))
    open_ = state.where("kept is null").join(won, "k", "left").select(order, "k", F.coalesce(F.col("winner") < F.col(order), F.lit(False)).alias("behind"))
    lost = saved(open_.groupBy(order).agg(F.bool_or("behind").alias("lost")))
    rest = saved(open_.join(lost.where("not lost"), order, "left_semi").select(order, "k"))
    # Of each key the first and the second row; both are minima, so a frequent key is no burden.
    ahead = rest.groupBy("k").agg(F.min(order).alias("a"))
    placed = rest.join(ahead, "k")
    second = placed.where(F.col(order) > F.col("a")).groupBy("k").agg(F.min(order).alias("b"))
    placed = placed.join(second, "k", "left").select(order, F.when(F.col(order) > F.col("a"), F.col("a")).alias("parent"), (F.col(order) > F.coalesce("b", F.col(order))).alias("later"))
    each = placed.groupBy(order).agg(F.min("parent").alias("low"), F.max("parent").alias("high"), F.bool_or("later").alias("later"))
    first = F.col("high").isNull()
    # ``to`` is the row that a row hangs on, and ``same`` if it shares its fate; a row that hangs on none or on several is the end of its chains.
    alone = ~first & ~F.col("later") & (F.col("low") == F.col("high"))
    chain = saved(each.select(order, F.when(alone, F.col("low")).otherwise(F.col(order)).alias("to"), (~alone).alias("same"), first.alias("first")))
    while True:
        on = chain.select(F.col(order).alias("_o"), F.col("to").alias("_to"), F.col("same").alias("_same"))
        longer = saved(chain.join(on, F.col("to") == F.col("_o")).select(order, F.col("_to").alias("to"), (F.col("same") == F.col("_same")).alias("same"), "first", (F.col("_to") != F.col("to")).alias("moved")))
        chain = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    ends = chain.where("first").select(F.col(order).alias("_o"))
    told = chain.join(ends, F.col("to") == F.col("_o")).select(order, F.col("same").alias("new"))
    return lost.where("lost").select(order, F.lit(False).alias("new")).union(told)


def merge_key(record_doi: Column, url: Column, arxiv: Column, source: Column, id_: Column) -> Column:
    """``doi:`` or ``arxiv:`` key of a scholarly record; null keeps it apart."""
    doi = normal_doi(F.coalesce(F.when(record_doi != "", record_doi), url))
    own = normal_arxiv(F.when(F.lower(source) == "arxiv", F.coalesce(F.when(id_ != "", id_), url)))
    found = F.coalesce(normal_arxiv(arxiv), own)
    return F.when(doi.isNotNull(), F.concat(F.lit("doi:"), doi)).when(found.isNotNull(), F.concat(F.lit("arxiv:"), found))


def merge_scholarly(df: DataFrame, order: str = "ord") -> DataFrame:
    """Records of one DOI or arXiv id merged: ``key, canonical, sources, records, conflicts``, one row a group.

    ``df`` has ``ord`` (priority), ``provider, source, id, doi, url, title, authors,
    published, citations, arxiv_id``. The first record is canonical; providers are listed
    once in order; a field with more than one distinct value lists each with the first
    provider that gave it. Records without a key stay alone.
    """
    fields = ("provider", "source", "id", "doi", "url", "title", "authors", "published", "citations")
    keyed = df.withColumn("key", merge_key(F.col("doi"), F.col("url"), F.col("arxiv_id"), F.col("source"), F.col("id")))
    keyed = keyed.withColumn("_group", F.coalesce("key", F.concat(F.lit("row:"), F.col(order).cast("string"))))
    record = F.struct(order, *fields)
    main = keyed.groupBy("_group").agg(F.first("key").alias("key"), F.min_by(record, order).alias("canonical"), F.sort_array(F.collect_list(record)).alias("records"))
    main = main.withColumn("sources", F.array_distinct(F.col("records.provider")))
    values = keyed.select("_group", order, "provider", F.explode(F.map_from_arrays(F.array(*map(F.lit, fixed.CONFLICT_FIELDS)), F.array(*(F.col(c).cast("string") for c in fixed.CONFLICT_FIELDS)))).alias("field", "value"))
    values = values.where("value is not null and value <> ''").groupBy("_group", "field", "value").agg(F.min(F.struct(order, "provider")).alias("w"))
    lists = values.groupBy("_group", "field").agg(F.sort_array(F.collect_list(F.struct(F.col("w")[order].alias("ord"), F.col("w.provider").alias("provider"), "value"))).alias("v"), F.count("*").alias("n")).where("n > 1")
    conflicts = lists.groupBy("_group").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.transform("v", lambda x: F.struct(x["provider"].alias("provider"), x["value"].alias("value"))))))).alias("conflicts"))
    return main.join(conflicts, "_group", "left").select("key", "canonical", "sources", "records", "conflicts")


def open_access_locations(works: DataFrame) -> DataFrame:
    """``work_id, pos, url, is_best`` of the open locations of works: the best first, then the others, each URL once."""
    each = works.select("work_id", F.posexplode(F.concat(F.array("best"), F.coalesce("locations", F.array().cast(works.schema["locations"].dataType)))).alias("pos", "l"))
    fine = each.where("l.url is not null and l.url <> '' and coalesce(l.is_oa, false)")
    seen = fine.groupBy("work_id", "l.url").agg(F.min("pos").alias("pos"))
    return seen.select("work_id", F.row_number().over(Window.partitionBy("work_id").orderBy("pos")).alias("pos"), "url", (F.col("pos") == 0).alias("is_best"))


def merge_providers(results: DataFrame, most: int) -> DataFrame:
    """Results of several providers by priority and rank, each canonical URL once, ``most`` a query; keyless rows stay.

    ``results``: ``query_id, priority, rank, url`` and more. Providers past the first that fill the list add nothing.
    """
    keyed = results.withColumn("_key", canonical_url(F.col("url"), "drop"))
    within = Window.partitionBy("query_id", "_key").orderBy("priority", "rank")
    kept = keyed.withColumn("_n", F.row_number().over(within)).where("_key is null or _n = 1").drop("_n", "_key")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "rank"))
    return kept.withColumn("place", place).where(F.col("place") <= most)


def failover(results: DataFrame) -> DataFrame:
    """The rows of the first provider of each query that succeeded: by the smallest priority whose rows are ``ok``."""
    first = results.where("ok").groupBy("query_id").agg(F.min("priority").alias("priority"))
    return results.join(first, ["query_id", "priority"], "left_semi")


def unvisited(urls: DataFrame, visited: DataFrame, url: str = "url", query: str = "drop-tracking") -> DataFrame:
    """URLs whose canonical form is not among those visited; ``query`` says what of a query string counts."""
    key = canonical_url(F.col(url), query)
    seen = visited.select(canonical_url(F.col(url), query).alias("_key")).distinct()
    return urls.withColumn("_key", key).join(seen, "_key", "left_anti").drop("_key")


def cached_or_fetched(requested: DataFrame, cached: DataFrame, fetched: DataFrame, key: str = "url", order: str = "pos") -> DataFrame:
    """Each requested row with its content from the cache, else from the fetch, in the order of the request."""
    c = cached.select(key, F.col("content").alias("_c"))
    f = fetched.select(key, F.col("content").alias("_f"))
    out = requested.join(c, key, "left").join(f, key, "left")
    source = F.when(F.col("_c").isNotNull(), "cache").when(F.col("_f").isNotNull(), "fetch").otherwise("missing")
    return out.select(*requested.columns, F.coalesce("_c", "_f").alias("content"), source.alias("origin")).orderBy(order)


def revalidated(stored: DataFrame, answers: DataFrame, key: str = "url") -> DataFrame:
    """Stored copies after a conditional request: 304 keeps the copy, 200 replaces it, anything else keeps it as stale."""
    a = answers.select(key, "status", F.col("content").alias("_new"), F.col("etag").alias("_etag"))
    out = stored.join(a, key, "left")
    fresh = F.coalesce(F.col("status") == 200, F.lit(False))
    state = F.when(fresh, "replaced").when(F.col("status") == 304, "confirmed").otherwise("stale")
    return out.select(key, F.when(fresh, F.col("_new")).otherwise(F.col("content")).alias("content"), F.when(fresh, F.col("_etag")).otherwise(F.col("etag")).alias("etag"), state.alias("state"))


def enriched(records: DataFrame, hits: DataFrame, fields: tuple[str, ...] = ("venue", "abstract")) -> DataFrame:
    """Records whose missing fields are filled from the first hit of the same DOI that has them."""
    firsts = hits.groupBy("doi").agg(*(F.min_by(f, F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col("rank"))).alias(f"_{f}") for f in fields))
    out = records.join(firsts, "doi", "left")
    return out.select(*(F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_{c}")).alias(c) if c in fields else c for c in records.columns))


def status_summary(probes: DataFrame) -> DataFrame:
    """How many probed URLs are ok, unreachable, blocked or in error; all four are listed."""
    s = F.col("http_status")
    status = F.when(F.col("error") == "blocked", "blocked").when(F.col("error").isNotNull() | s.isNull(), "error").when(s.between(200, 399), "ok").otherwise("unreachable")
    counts = probes.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    every = probes.sparkSession.createDataFrame([("blocked",), ("error",), ("ok",), ("unreachable",)], "status string")
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
