"""Token ids in Simple-8b words, written in order with per-block offsets, and read back vectorised."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.chunks import encoder
from webgrain.llm.common import arrow_schema, pick, shared_path

# Values and bits of each selector; selector 15 escapes one value of up to 64 bits in the word after it. Fixed values.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64])
#: Ids of a block that starts at a word of its own; ids gathered before a row is written.
BLOCK, ROW = 8192, 1 << 18


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of unsigned ids, and the first word of each block of ``BLOCK`` ids.

    The top four bits of a word select how many values of how many bits it holds. The
    first selector whose values all fit is taken; an id of more than 30 bits goes into a
    word of its own behind an escape. A word never crosses a block's end.
    """
    n = len(ids)
    best = np.full(n, len(COUNTS) - 1, np.int8)
    room = (BLOCK - np.arange(n) % BLOCK).astype(np.int16)
    for s in range(len(COUNTS) - 2, -1, -1):
        c = int(COUNTS[s])
        if c > n:
            continue
        fit, wide = ids < ids.dtype.type(1 << int(BITS[s])), 1
        # Whether the next c ids all fit: windows grow by doubling.
        while wide < c:
            more = min(wide, c - wide)
            fit = fit[:-more] & fit[more:]
            wide += more
        np.copyto(best[: len(fit)], s, where=fit & (room[: len(fit)] >= c))
    ids = np.asarray(ids, np.uint64)
    step = COUNTS[best].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    first = np.array(at, np.int64)
    chosen = best[first] if n else first
    escaped = chosen == len(COUNTS) - 1
    place = np.arange(len(first)) + np.concatenate([[0], np.cumsum(escaped)[:-1]]) if n else first
    words = np.zeros(len(first) + int(escaped.sum()), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    words[place[escaped] + 1] = ids[first[escaped]]
    for s in range(2, len(COUNTS) - 1):
        which = np.flatnonzero(chosen == s)
        if len(which):
            c, b = int(COUNTS[s]), int(BITS[s])
            values = ids[first[which][:, None] + np.arange(c)] << (np.arange(c, dtype=np.uint64) * np.uint64(b))
            words[place[which]] |= np.bitwise_or.reduce(values, axis=1)
    return words, place[np.flatnonzero(first % BLOCK == 0)]


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of these words; all words of a selector are unpacked at once."""
    words = np.asarray(words, np.uint64)
    top = (words >> np.uint64(60)).astype(np.int64)
    is_escape = top == len(COUNTS) - 1
    value = np.zeros(len(words), bool)
    # The word behind an escape is a value, even if its own top bits say escape.
    for i in np.flatnonzero(is_escape):
        if not value[i] and i + 1 < len(words):
            value[i + 1] = True
    at = np.flatnonzero(~value)
    top = top[at]
    place = np.concatenate([[0], np.cumsum(COUNTS[top])])
    out = np.zeros(n, np.uint64)
    for s in range(2, len(COUNTS)):
        which = np.flatnonzero(top == s)
        if not len(which):
            continue
        if s == len(COUNTS) - 1:
            out[place[which]] = words[at[which] + 1]
        else:
            c, b = int(COUNTS[s]), int(BITS[s])
            mask = np.uint64((1 << b) - 1)
            out[place[which][:, None] + np.arange(c)] = (words[at[which]][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(b))) & mask
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """The ids of one block alone."""
    end = offsets[block + 1] if block + 1 < len(offsets) else len(words)
    return decode(words[offsets[block] : end], min(BLOCK, n - block * BLOCK))


FILE = "part int, row int, n_ids bigint, words binary, block_offsets array<int>, doc_ids array<bigint>, doc_tokens array<bigint>"


def write_ids(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", tokenizer: str = "word_bpe_49k.json", end: int = 1) -> None:
    """Encode every whole text, append ``end``, and write the ids in ascending key order.

    The texts are dealt by ranges of the key, and of a hash of the text where a key has
    many rows, and sorted; each partition writes rows of
    Simple-8b words for whole documents (about ``ROW`` ids, more for a longer document),
    with the word offset of each block and the ids' number of each document. Null texts
    have the end id alone; null keys come first; rows of equal key are ordered by their text's XXH64 and by text.
    """
    arrow = arrow_schema(df.sparkSession, FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        tail = np.uint32(end).tobytes()
        raw: list[bytes] = []
        keys: list = []
        size, row = 0, 0

        def written() -> pa.RecordBatch:
            nonlocal size, row
            ids = np.frombuffer(b"".join(raw), "<u4")
            words, offsets = encode(ids)
            out = pa.RecordBatch.from_pylist([{"part": part, "row": row, "n_ids": len(ids), "words": words.astype("<u8").tobytes(), "block_offsets": offsets.tolist(), "doc_ids": list(keys), "doc_tokens": [len(r) // 4 for r in raw]}], schema=arrow)
            raw.clear()
            keys.clear()
            size, row = 0, row + 1
            return out

        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                raw.append(ids + tail)
                keys.append(k)
                size += len(raw[-1]) // 4
                if size >= ROW:
                    yield written()
        if raw:
            yield written()

    rows = pick(df, key=key, text=text).select(F.col("key").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bits", F.xxhash64("text"))
    dealt = rows.repartitionByRange("key", "bits").sortWithinPartitions("key", "bits", "text")
    dealt.select("key", "text").mapInArrow(run, FILE).write.option("compression", "zstd").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, all from the files.

    A document's start is the number of ids of all parts before its own, and of the rows
    and documents before it in its part. Only one number a part (a file) is gathered.
    """
    from pyspark.sql.types import _parse_datatype_string

    files = spark.read.schema(_parse_datatype_string(FILE)).parquet(path)
    # One number a written row (a quarter of a million ids), so a window over them is small.
    from pyspark.sql import Window

    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = files.select("part", "row", "n_ids")
    inside = rows.select("part", "row", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("within"))
    starts = inside.join(parts, "part").select(F.col("part").alias("p"), F.col("row").alias("r"), (F.col("before") + F.col("within")).alias("first"))
    out = "part int, row int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    arrow = arrow_schema(spark, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}
                ids = decode(np.frombuffer(x["words"], "<u8"), x["n_ids"]).astype("<u4")
                tokens = np.array(x["doc_tokens"], np.int64)
                ends = np.cumsum(tokens)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - tokens).tolist(), ends.tolist(), strict=True)]
                n = len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([x["part"]] * n, [x["row"]] * n, x["doc_ids"], ends - tokens, tokens, crc), arrow, strict=True)], schema=arrow)

    docs = files.mapInArrow(run, out)
    return docs.join(starts, (docs["part"] == starts["p"]) & (docs["row"] == starts["r"])).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def ids_round_trip(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = "word_bpe_49k.json", end: int = 1) -> DataFrame:
    """Write the ids of all documents to the shared folder and return what reading them back gives."""
    spark = df.sparkSession
    path = shared_path(spark, "ids")
    write_ids(df, path, text, key, tokenizer, end)
    return read_ids(spark, path).withColumnRenamed("doc_id", key)
