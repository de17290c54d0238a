"""Queries on the event log as a stream that is stopped and goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webgrain.plans.registry import register, table
from webgrain.streaming import caches

#: The log arrives in so many parts, and the TTL of the cache is six hours.
PARTS, TTL = 3, 6 * 3_600_000


def arriving(spark, sf_dir, key, **more) -> DataFrame:
    """The event log with the part in which each event arrives, by time."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_millis("ts"))
    first, last = events.agg(F.min("at"), F.max("at")).first()
    part = F.least(F.lit(PARTS - 1), F.floor((F.col("at") - F.lit(first)) * PARTS / F.lit((last or 0) - (first or 0) + 1)).cast("int"))
    return events.select(key.alias("key"), "at", F.col("event_id").alias("id"), *(c.alias(n) for n, c in more.items()), part.alias("part"))


@register("streamed_latency_window", """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT event_type, max(event_id) AS newest, CAST(count(*) AS INTEGER) AS n, round(quantile_cont(value * 1000, 0.5), 1) AS p50, round(quantile_cont(value * 1000, 0.95), 1) AS p95, round(quantile_cont(value * 1000, 0.99), 1) AS p99, round(max(value * 1000), 1) AS max
FROM w WHERE r <= 1024 GROUP BY event_type
""")
def streamed_latency_window(spark, sf_dir):
    log = arriving(spark, sf_dir, F.col("event_type"), value=F.col("value"))
    told = caches.replayed(log, lambda s: caches.latency_window(s, 1024), "part", PARTS, "latency-window")
    last = told.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("newest").desc()))).where("r = 1")
    return last.select(F.col("key").alias("event_type"), "newest", "n", *(F.round(c, 1).alias(c) for c in ("p50", "p95", "p99", "max")))


@register("streamed_visited_fifo", """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, event_id FROM e WHERE n <= CASE WHEN c <= 40 THEN c ELSE 20 + (c - 41) % 21 END
""")
def streamed_visited_fifo(spark, sf_dir):
    log = arriving(spark, sf_dir, F.col("user_id"))
    gone = caches.replayed(log, lambda s: caches.visited_fifo(s, 40, 20), "part", PARTS, "visited-fifo")
    return log.select(F.col("key").alias("user_id"), F.col("id").alias("event_id")).join(gone.select(F.col("id").alias("event_id")), "event_id", "left_anti").select("user_id", "event_id")


@register("streamed_ttl_cache", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
c AS (
  SELECT event_id, user_id, r, ms AS stored, false AS hit FROM e WHERE r = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.r, CASE WHEN e.ms - c.stored <= {TTL} THEN c.stored ELSE e.ms END, e.ms - c.stored <= {TTL} FROM c JOIN e ON e.user_id = c.user_id AND e.r = c.r + 1
)
SELECT event_id, hit FROM c
""")
def streamed_ttl_cache(spark, sf_dir):
    log = arriving(spark, sf_dir, F.pmod("user_id", F.lit(16)), item=F.col("user_id"), ts=F.col("ts"))
    return caches.replayed(log, lambda s: caches.ttl_cache(s, TTL), "part", PARTS, "ttl-cache").select(F.col("id").alias("event_id"), "hit")


@register("streamed_verdict_cache", """
SELECT event_id, event_id = first AS computed, first FROM (
  SELECT event_id, first_value(event_id) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS first FROM events)
""")
def streamed_verdict_cache(spark, sf_dir):
    log = arriving(spark, sf_dir, F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256))
    told = caches.replayed(log, lambda s: caches.verdict_cache(s, 7 * 86_400_000), "part", PARTS, "verdict-cache", once=True)
    return told.select(F.col("id").alias("event_id"), "computed", "first")
