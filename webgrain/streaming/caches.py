"""Bounded windows and caches over unbounded logs: list, map and value state with timers and time-to-live, in a RocksDB store.

Rows of one key and batch are taken by time and id. What a key keeps is bounded: by
the window, by the list's cut, or by expiry. Batches are bounded by the source.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webgrain.session import shared

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["at", "id"], ignore_index=True)


class LatencyWindow(StatefulProcessor):
    """Keeps the newest ``most`` samples of a key in a list, and tells their percentiles after each batch."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "at bigint, id bigint, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [*self.samples.get(), *in_order(rows)[["at", "id", "value"]].itertuples(index=False, name=None)]
        kept = [(int(a), int(i), float(v)) for a, i, v in sorted(held)[-self.most :]]
        self.samples.put(kept)
        v = np.array([k[2] for k in kept]) * 1000
        p50, p95, p99 = np.percentile(v, [50, 95, 99])
        yield pd.DataFrame({"key": [key[0]], "newest": [kept[-1][1]], "n": [len(kept)], "p50": [p50], "p95": [p95], "p99": [p99], "max": [v.max()]})

    def close(self) -> None:
        pass


class VisitedList(StatefulProcessor):
    """Keeps the ids a key visited in a list; past ``most`` the oldest go until ``keep`` are left, and are told."""

    def __init__(self, most: int, keep: int):
        self.most, self.keep = most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getListState("ids", "id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, gone = [r[0] for r in self.ids.get()], []
        room = self.most + 1 - len(held)
        new = [int(i) for i in in_order(rows)["id"]]
        while len(new) >= room:
            held, new = held + new[:room], new[room:]
            gone += held[: len(held) - self.keep]
            held = held[len(held) - self.keep :]
            room = self.most + 1 - self.keep
        self.ids.put([(i,) for i in held + new])
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(gone), dtype=object if isinstance(key[0], str) else None), "id": pd.Series(gone, dtype="int64")})

    def close(self) -> None:
        pass


class TtlCache(StatefulProcessor):
    """Tells of each request of a cache's keys if it is answered from what was stored within ``ttl``; else it is stored anew.

    What the watermark has left behind by more than ``ttl`` can answer no request that
    is still to come, so a timer takes it out.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getMapState("stored", "item bigint", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = in_order(rows)
        known: dict[int, int | None] = {}
        anew: dict[int, int] = {}
        hits = []
        for item, at in zip(asked["item"].tolist(), asked["at"].tolist(), strict=True):
            if item not in known:
                held = self.stored.getValue((item,))
                known[item] = held[0] if held else None
            hit = known[item] is not None and at - known[item] <= self.ttl
            hits.append(hit)
            if not hit:
                known[item] = anew[item] = at
        # What a batch stores more than once is written once.
        for item, at in anew.items():
            self.stored.updateValue((item,), (at,))
        if not all(hits):
            self.handle.registerTimer(int(asked["at"].max()) + self.ttl + 1)
        yield pd.DataFrame({"id": asked["id"], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for item, at in list(self.stored.iterator()):
            if at[0] + self.ttl < now:
                self.stored.removeKey(item)
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "hit": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


class VerdictCache(StatefulProcessor):
    """Tells of each row of a content if its verdict has to be worked out or is known from an earlier one; forgotten after ``ttl`` milliseconds.

    A state maps many contents to the ids whose verdicts stand: a state of its own for
    each content would cost a call of Python for every few rows.
    """

    def __init__(self, ttl: int, kind: str):
        self.ttl, self.kind = ttl, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", f"content {self.kind}", "id bigint", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = in_order(rows)
        first: dict = {}
        for content, id_ in asked.drop_duplicates("content")[["content", "id"]].itertuples(index=False, name=None):
            held = self.known.getValue((content,))
            first[content] = held[0] if held else int(id_)
            if not held:
                self.known.updateValue((content,), (int(id_),))
        firsts = asked["content"].map(first)
        yield pd.DataFrame({"id": asked["id"], "computed": asked["id"] == firsts, "first": firsts.astype("int64")})

    def close(self) -> None:
        pass


def latency_window(stream: DataFrame, most: int) -> DataFrame:
    """``key, newest, n, p50, p95, p99, max`` after each batch of ``key, at, id, value``; the last row of a key holds."""
    kind = stream.schema["key"].dataType.simpleString()
    return stream.groupBy("key").transformWithStateInPandas(LatencyWindow(most), f"key {kind}, newest bigint, n int, p50 double, p95 double, p99 double, max double", "Append", "None")


def visited_fifo(stream: DataFrame, most: int, keep: int) -> DataFrame:
    """``key, id`` of what leaves the bounded lists of ``key, at, id``."""
    kind = stream.schema["key"].dataType.simpleString()
    return stream.groupBy("key").transformWithStateInPandas(VisitedList(most, keep), f"key {kind}, id bigint", "Append", "None")


def ttl_cache(stream: DataFrame, ttl: int, late: str = "1 hour", groups: int = 16) -> DataFrame:
    """``id, hit`` of requests ``key, at, id, item, ts`` (``at`` and ``ttl`` in milliseconds, ``ts`` the same time as a timestamp).

    The items of a cache don't depend on each other, so they are dealt over ``groups`` states.
    """
    dealt = stream.withColumn("dealt", F.pmod(F.xxhash64("item"), F.lit(groups))).withWatermark("ts", late)
    return dealt.groupBy("key", "dealt").transformWithStateInPandas(TtlCache(ttl), "id bigint, hit boolean", "Append", "EventTime")


def verdict_cache(stream: DataFrame, ttl: int, groups: int = 256) -> DataFrame:
    """``id, computed, first`` of contents ``key, at, id``: the id whose verdict stands, and if it is the row's own. Contents are dealt over ``groups`` states."""
    dealt = stream.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("dealt"), F.col("key").alias("content"), "at", "id")
    return dealt.groupBy("dealt").transformWithStateInPandas(VerdictCache(ttl, stream.schema["key"].dataType.simpleString()), "id bigint, computed boolean, first bigint", "Append", "ProcessingTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def replayed(log: DataFrame, query: Callable[[DataFrame], DataFrame], part: str, parts: int, name: str, once: bool = False) -> DataFrame:
    """A stream's output over a log that arrives in ``parts`` (numbered by the column ``part``): the stream is stopped after each and goes on from its checkpoint with the next.

    So each part is one bounded batch, and all but the first meet state that was read
    back. Streams by processing time never run out of batches, so they take ``once``.
    """
    spark = log.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    columns = [c for c in log.columns if c != part]
    schema = log.select(*columns).schema
    with rocksdb(spark):
        for i in range(parts):
            log.where(F.col(part) == i).select(*columns).write.mode("append").parquet(f"{path}/in")
            out = query(spark.readStream.schema(schema).parquet(f"{path}/in"))
            running = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(**({"once": True} if once else {"availableNow": True})).start()
            running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")
