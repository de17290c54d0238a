"""Research plans: searches over the answers of engines, and questions sent to one provider of their category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.functions.urls import canonical_url
from webgrain.operators import ranking, records


def searched(answers: DataFrame, cached: DataFrame | None = None, merge: bool = False, most: int = 5, now: Column | None = None, ttl: float = 3600.0) -> DataFrame:
    """Search in one plan: ``query_id, place, url, title, origin`` of each query's results.

    ``answers``: ``query_id, priority, rank, ok, url, title``, what engines gave;
    ``cached``: ``query_id, place, url, title, put``, results of earlier searches. Queries
    with results younger than ``ttl`` seconds take those. For the others, with ``merge``
    all engines' results by priority, else those of the first engine that succeeded;
    each address counts once, and ``most`` stay.
    """
    now = F.current_timestamp() if now is None else now
    fresh = cached.where(now.cast("double") - F.col("put").cast("double") <= ttl) if cached is not None else None
    asked = answers if fresh is None else answers.join(fresh.select("query_id").distinct(), "query_id", "left_anti")
    if merge:
        found = records.merge_providers(asked.where("ok"), most).select("query_id", "place", "url", "title")
    else:
        first = records.failover(asked).withColumn("_key", canonical_url(F.col("url"), "drop"))
        seen = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy("rank"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        found = first.withColumn("_n", seen).where("_key is null or _n = 1").withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", "url", "title")
    found = found.withColumn("origin", F.lit("engine"))
    return found if fresh is None else found.unionByName(fresh.where(F.col("place") <= most).select("query_id", "place", "url", "title", F.lit("cache").alias("origin")))


def resolved(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """``requests`` (``id, query, category, provider``) with the category and provider that answer them, or an ``error``.

    ``providers``: ``category, place, provider``, a list of engines that goes to all tasks,
    so that no task gets all requests of a frequent one. A category given is taken as it is, else that which owns the provider given, else that of the query's
    words. Without a provider the category's first one answers.
    """
    every = providers.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("place", "provider"))).alias("_of")).select("category", F.col("_of.provider").alias("_of"))
    owner = providers.groupBy("provider").agg(F.min_by("category", "place").alias("_owner"))
    rows = requests.withColumnRenamed("category", "_category").join(F.broadcast(owner), "provider", "left")
    chosen = F.coalesce(F.col("_category"), F.when(F.col("provider").isNotNull(), F.col("_owner")).otherwise(ranking.category(F.col("query"))))
    rows = rows.withColumn("category", chosen).join(F.broadcast(every), "category", "left")
    error = (
        F.when(F.col("_category").isNotNull() & F.col("_of").isNull(), "unknown category")
        .when(F.col("_category").isNull() & F.col("provider").isNotNull() & F.col("_owner").isNull(), "unknown provider")
        .when(F.col("_of").isNull(), "no provider")
        .when(F.col("provider").isNotNull() & ~F.array_contains("_of", F.col("provider")), "provider of another category")
    )
    return rows.select("id", "query", "category", F.when(error.isNull(), F.coalesce("provider", F.get("_of", F.lit(0)))).alias("provider"), error.alias("error"))


def by_category(requests: DataFrame, providers: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """Category research in one plan: each request with the first ``most`` records of the provider that answers it.

    ``found``: ``id, provider, pos`` and whatever a record has. Requests with an error or
    without records are one row with nulls.
    """
    r = resolved(requests, providers)
    # At most most records of a request and provider go on.
    return r.join(found.where(F.col("pos") < most), ["id", "provider"], "left")
