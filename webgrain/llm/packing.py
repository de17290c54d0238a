"""Best-fit packing of token sequences: packed in each partition, underfull bins merged up a tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.chunks import encoder
from webgrain.llm.common import arrow_schema, pick, shared_path

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
OPEN = f"{PIECE}, open boolean"
#: Pieces packed at a time in a partition; underfull bins that one node of the tree packs.
AT_ONCE, NODE = 200_000, 4096


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit of lengths, longest first: bin and offset of each, and the number of bins.

    The open bins are kept by room left; a bit mask finds the smallest room that is
    enough, so the work is linear in the items.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, at, n = capacity, n, n + 1
        bins[i], offsets[i] = at, capacity - room
        if left := room - size:
            rooms[left].append(at)
            mask |= 1 << left
    return bins, offsets, n


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: all but the first are full."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack_documents(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = "byte_bpe_50k.json", end: int = 2, capacity: int = 1024, slack: int = 8) -> DataFrame:
    """Pack every document's ids, with ``end`` after them, into sequences of at most ``capacity`` tokens.

    One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Null and empty texts have the end id alone; repeated rows are packed each. Only
    documents over ``capacity`` are cut; all pieces but the first are full.

    Each partition packs its own pieces (the texts are not shuffled) and closes bins
    with at most ``slack`` tokens of room. The others, a few a partition, are items of
    the next round: nodes of about ``NODE`` of them pack again, dealt anew each round,
    and bins with less room than the least bin needs fit no other and are closed. It ends
    when one node packed all that was left, or a round saved no bin. Each round is written
    to the shared folder once.
    """
    spark = df.sparkSession
    arrow = arrow_schema(spark, OPEN)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        tail = np.uint32(end).tobytes()
        held: list[tuple] = []
        done = 0

        def packed() -> pa.RecordBatch:
            nonlocal done
            doc, piece, start, length, crc = (list(c) for c in zip(*held, strict=True))
            bins, offsets, n = best_fit(np.array(length), capacity)
            used = np.bincount(bins, np.array(length), n)
            ids = (part << 32) + done + bins
            done += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((doc, piece, start, length, crc, ids, offsets, used[bins] < capacity - slack), arrow, strict=True)], schema=arrow)

        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            for k, ids in zip(keys, enc.encode(texts), strict=True):
                ids += tail
                for p, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    held.append((k, p, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])))
            if len(held) >= AT_ONCE:
                yield packed()
        if held:
            yield packed()

    def merge(round_: int, least: int):
        def node(rows: pd.DataFrame) -> pd.DataFrame:
            used = rows.groupby("sequence_id", sort=True)["length"].sum()
            bins, shifts, n = best_fit(used.to_numpy(np.int64), capacity)
            total = np.bincount(bins, used.to_numpy(), n)
            at = used.index.get_indexer(rows["sequence_id"])
            out = rows.drop(columns=["node"])
            out["sequence_id"] = (round_ << 56) + (int(rows["node"].iloc[0]) << 28) + bins[at]
            out["offset"] = rows["offset"] + shifts[at]
            # No bin of a later round is smaller than the least of this one.
            out["open"] = capacity - total[bins[at]] >= max(slack + 1, least)
            return out

        return node

    rows = pick(df, key=key, text=text).select(F.col("key").cast("long").alias("key"), "text")
    path = shared_path(spark, "packing")
    schema = rows.mapInArrow(local, OPEN).schema
    rows.mapInArrow(local, OPEN).write.parquet(f"{path}/0")
    closed, round_, before, alone = [], 0, 0, False
    while True:
        now = spark.read.schema(schema).parquet(f"{path}/{round_}")
        closed.append(now.where("not open").drop("open"))
        left = now.where("open")
        n, least = left.groupBy("sequence_id").agg(F.sum("length").alias("used")).agg(F.count("*"), F.min("used")).first()
        if not n:
            break
        nodes = -(-n // NODE)
        if alone or (round_ and now.select(F.count_distinct("sequence_id")).first()[0] == before):
            closed.append(left.drop("open"))
            break
        round_, before, alone = round_ + 1, n, nodes == 1
        spread = left.withColumn("node", F.pmod(F.xxhash64("sequence_id"), F.lit(nodes)))
        spread.groupBy("node").applyInPandas(merge(round_, least), OPEN).write.parquet(f"{path}/{round_}")
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out.withColumnRenamed("doc_id", key)
