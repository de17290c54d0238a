"""Streams whose keys are many: as many calls of Python as states, and states that go on from batch to batch."""

import datetime
import random
import uuid

import duckdb
from pyspark.sql import functions as F

from webgrain.streaming import stateful

CALLS = "event_id bigint, user_id bigint, ts timestamp"


def calls(n, days=3, users=40, seed=1):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    return [(i, rng.choice([None, -1, *range(users), 2**60, 2**60 + 1]), start + datetime.timedelta(seconds=rng.randrange(days * 86400))) for i in range(n)]


def test_quota_over_batches_and_folders(spark, tmp_path):
    """A folder of several files is read whole, each file is a batch, and ids beyond 2^53 and null keys are told apart."""
    rows = sorted(calls(900), key=lambda r: r[2])
    for k in range(3):
        spark.createDataFrame(rows[k * 300 : k * 300 + 300], CALLS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = stateful._events(spark, f"{tmp_path}/events.parquet")
    assert stream.isStreaming
    for groups, name in ((64, "many"), (1, "one")):
        in_time = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/events.parquet")
        got = stateful.run_once(stateful.quota(in_time, 3, groups), "append")
        assert got.count() == 900, name
        admitted = {(r["user_id"], r["day"]): r["n"] for r in got.where("admitted").groupBy("user_id", "day").agg(F.count("*").alias("n")).collect()}
        told = {(r["user_id"], r["day"]): r["n"] for r in got.groupBy("user_id", "day").agg(F.count("*").alias("n")).collect()}
        assert admitted == {k: min(3, n) for k, n in told.items()}


def test_quota_of_a_folder_is_that_of_its_rows(spark, tmp_path):
    rows = calls(600, seed=2)
    spark.createDataFrame(rows, CALLS).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["event_id"], r["user_id"], r["day"], r["admitted"]) for r in stateful.quota_once(spark, f"{tmp_path}/events.parquet", 2).collect()}
    db = duckdb.connect()
    sql = "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d'), row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 FROM e"
    db.execute("CREATE TABLE e (event_id BIGINT, user_id BIGINT, ts TIMESTAMP)")
    db.executemany("INSERT INTO e VALUES (?, ?, ?)", rows)
    assert got == set(db.execute(sql).fetchall())


def test_quota_makes_no_state_a_key(spark, tmp_path):
    """As many groups as states at most, however many keys a day has."""
    spark.range(3000).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts")).write.parquet(f"{tmp_path}/{uuid.uuid4().hex}/events.parquet")
    path = next(tmp_path.iterdir()) / "events.parquet"
    query = stateful.quota(stateful._events(spark, str(path)), 2, groups=8)
    running = query.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    assert sum(s["numRowsTotal"] for s in running.lastProgress["stateOperators"]) <= 8
