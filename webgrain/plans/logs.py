"""Queries on the event log: schedules, quotas, caches, windows, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from webgrain.operators import schedule
from webgrain.plans.registry import register, table

MS = "(epoch_us(ts) // 1000)"


@register("politeness_schedule", f"""
WITH r AS (SELECT event_id, user_id, {MS} AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY {MS}, event_id) - 1 AS rn FROM events)
SELECT event_id, user_id, 3600000 * rn + max(arrival - 3600000 * rn) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS start FROM r
""")
def politeness_schedule(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival"))
    return schedule.politeness(rows, "user_id", "arrival", 3_600_000, "event_id").select("event_id", "user_id", "start")


@register("daily_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def daily_quota(spark, sf_dir):
    return schedule.quota(table(spark, sf_dir, "events"), "user_id", "ts", 2, "day", "event_id").select("event_id", "admitted")


@register("monthly_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) <= 40 AS admitted FROM events")
def monthly_quota(spark, sf_dir):
    return schedule.quota(table(spark, sf_dir, "events"), "user_id", "ts", 40, "month", "event_id").select("event_id", "admitted")


@register("cache_eviction", """
WITH e AS (SELECT event_id AS key, user_id, ts, CAST(floor(abs(value) * 100) AS BIGINT) AS bytes FROM events WHERE epoch(TIMESTAMP '2024-01-31') - epoch(ts) <= 864000),
s AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id ORDER BY ts DESC, key DESC ROWS UNBOUNDED PRECEDING) AS total FROM e)
SELECT key, user_id, bytes FROM s WHERE total <= 20000
""")
def cache_eviction(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.abs("value") * 100).cast("long").alias("bytes"))
    return schedule.evict(entries, F.lit("2024-01-31 00:00:00").cast("timestamp"), 864_000, 20_000, "user_id").select("key", "user_id", "bytes")


@register("latency_window", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1024")
def latency_window(spark, sf_dir):
    return schedule.newest(table(spark, sf_dir, "events"), "event_type", ("ts", "event_id"), 1024).select("event_type", "event_id")


@register("visited_fifo", """
WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, event_id FROM e WHERE n <= CASE WHEN c <= 200 THEN c ELSE 100 + (c - 201) % 101 END
""")
def visited_fifo(spark, sf_dir):
    return schedule.visited_fifo(table(spark, sf_dir, "events"), "event_type", "event_id", 200, 100).select("event_type", "event_id")


@register("latency_percentiles", """
SELECT event_type, round(quantile_cont(value * 1000, 0.5), 1) AS p50, round(quantile_cont(value * 1000, 0.95), 1) AS p95, round(quantile_cont(value * 1000, 0.99), 1) AS p99, round(max(value * 1000), 1) AS max
FROM events GROUP BY event_type
""")
def latency_percentiles(spark, sf_dir):
    return schedule.latency_percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@register("nearest_rank_percentile", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM f WHERE n <= 2000)
SELECT event_type, value AS percentile FROM s WHERE r = round_even(0.95 * (c - 1), 0) + 1
""")
def nearest_rank_percentile(spark, sf_dir):
    return schedule.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", 0.95)


@register("fetch_stats", "SELECT user_id AS key, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(CAST(floor(abs(value)) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY user_id")
def fetch_stats(spark, sf_dir):
    return schedule.fetch_stats(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_type") == "error", F.floor(F.abs("value")).cast("long"))


@register("busiest_keys", "SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 10")
def busiest_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(10)


@register("cache_stats", "SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses, round(count(*) FILTER (event_type = 'view') / count(*), 4) AS hit_rate, CAST(sum(CAST(floor(abs(value)) AS BIGINT)) AS BIGINT) AS bytes FROM events")
def cache_stats(spark, sf_dir):
    return schedule.cache_stats(table(spark, sf_dir, "events"), F.col("event_type") == "view", F.floor(F.abs("value")).cast("long"))


@register("running_idf", """
WITH t AS (SELECT DISTINCT event_id AS seq, event_type AS term FROM events),
d AS (SELECT seq, term, count(*) OVER (PARTITION BY term ORDER BY seq ROWS UNBOUNDED PRECEDING) AS df, seq + 1 AS n FROM t)
SELECT seq, term, df, n, round(CASE WHEN n < 3 THEN 1.0 ELSE ln(1 + (n - df + 0.5) / (df + 0.5)) END, 9) AS idf FROM d
""")
def running_idf(spark, sf_dir):
    from webgrain.operators.ranking import running_document_frequency

    fetched = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("term"))
    out = running_document_frequency(fetched)
    return out.withColumn("idf", F.round("idf", 9))


@register("streamed_politeness", "SELECT event_id, user_id, start FROM (" + f"""
WITH r AS (SELECT event_id, user_id, {MS} AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY {MS}, event_id) - 1 AS rn FROM events)
SELECT event_id, user_id, 3600000 * rn + max(arrival - 3600000 * rn) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS start FROM r""" + ")")
def streamed_politeness(spark, sf_dir):
    from webgrain.streaming.stateful import politeness_once

    return politeness_once(spark, f"{sf_dir}/events.parquet", 3_600_000)


@register("streamed_daily_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_daily_counts(spark, sf_dir):
    from webgrain.streaming.stateful import daily_counts_once

    return daily_counts_once(spark, f"{sf_dir}/events.parquet")


@register("streamed_quota", "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def streamed_quota(spark, sf_dir):
    from webgrain.streaming.stateful import quota_once

    return quota_once(spark, f"{sf_dir}/events.parquet", 2)
