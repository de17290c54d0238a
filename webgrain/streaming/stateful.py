"""Politeness, quotas and counts over unbounded logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webgrain.session import shared


def politeness(stream: DataFrame, gap: int) -> DataFrame:
    """``event_id, user_id, start`` of requests ``event_id, user_id, arrival``: the state of a key is its last start.

    Requests of one batch are taken in arrival order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["arrival", "event_id"])
        starts = []
        for arrival in rows["arrival"]:
            last = int(arrival) if last is None else max(int(arrival), last + gap)
            starts.append(last)
        state.update((last,))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "start": starts})

    return stream.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, start long", "last long", "append", GroupStateTimeout.NoTimeout)


def quota(stream: DataFrame, limit: int, groups: int = 64) -> DataFrame:
    """``event_id, user_id, day, admitted``: the first ``limit`` calls of each key and day of a stream ``event_id, user_id, ts``.

    A day's keys are dealt over ``groups`` states, each of which lists what its keys have
    used: a state of its own for each key would cost a call of Python for every few rows.
    """
    counts = "users array<bigint>, used array<int>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        users, used = state.get if state.exists else ((), ())
        before = pd.Series(used, index=pd.Index(users, dtype="int64"), dtype="int64")
        nth = rows["user"].map(before).fillna(0).astype("int64") + rows.groupby("user").cumcount()
        after = before.add(rows["user"].value_counts(), fill_value=0).clip(upper=limit).astype("int64")
        state.update((after.index.tolist(), after.tolist()))
        yield pd.DataFrame({"event_id": rows["event_id"], "user": rows["user"], "known": key[1], "day": key[0], "admitted": nth < limit})

    # Calls without a user are those of one more user.
    keyed = stream.select("event_id", "ts", F.coalesce("user_id", F.lit(0)).alias("user"), F.col("user_id").isNotNull().alias("known"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("dealt"))
    told = keyed.groupBy("day", "known", "dealt").applyInPandasWithState(step, "event_id long, user long, known boolean, day string, admitted boolean", counts, "append", GroupStateTimeout.NoTimeout)
    return told.select("event_id", F.when(F.col("known"), F.col("user")).alias("user_id"), "day", "admitted")


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """``day, event_type, n`` by tumbling windows of a day; events later than the watermark are dropped."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.col("window.start").alias("day"), "event_type", "n")


def run_once(query: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there, in the shared folder, and return what it wrote."""
    spark = query.sparkSession
    path = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(query.schema).parquet(f"{path}/out")

    def last(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    query.writeStream.foreachBatch(last).option("checkpointLocation", f"{path}/log").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(query.schema).parquet(f"{path}/out")


def _events(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # A single file is read as a stream through its folder and a glob for its name.
    folder, _, name = path.rpartition("/")
    single = all(f.rpartition("/")[2] == name for f in spark.read.parquet(path).inputFiles())
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if single else spark.readStream.schema(schema).parquet(path)


def politeness_once(spark: SparkSession, path: str, gap: int) -> DataFrame:
    events = _events(spark, path).select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival"))
    return run_once(politeness(events, gap), "append")


def daily_counts_once(spark: SparkSession, path: str) -> DataFrame:
    events = _events(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_once(daily_counts(events), "complete")
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


def quota_once(spark: SparkSession, path: str, limit: int) -> DataFrame:
    events = _events(spark, path).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_once(quota(events, limit), "append")
