"""Ranked lexical search: MaxScore over shards of the documents.

A shard is a run of documents that fits in a task. Its postings of the asked terms lie
in columns. For each item the lists are opened from the highest upper bound on; as soon
as the lists left can't lift a document that none of the opened ones holds among the
best, they are non-essential: they are only probed, for documents that can still qualify.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm.common import arrow_schema, pick, stored
from webgrain.llm.terms import WORDS_AND_DIGITS, gathered, words

#: Terms of items that are searched for in one pass over the documents (one item's more at most).
ASKED = 200_000
TERMS = "item_id bigint, term string, reps bigint"
FOUND = "item_id bigint, doc_id bigint, score bigint"


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item_id, term, reps`` of each item; rows of one id are one item, but equal rows count once."""
    schema = arrow_schema(items.sparkSession, TERMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1):
            row, term = words(batch.column(1), WORDS_AND_DIGITS)
            table = pa.table({"item_id": batch.column(0).take(pa.array(row)), "term": term}).group_by(["item_id", "term"]).aggregate([([], "count_all")])
            yield from pa.table([table["item_id"], table["term"], table["count_all"].cast(pa.int64())], schema=schema).to_batches()

    rows = pick(items, item_id=key, text=text).select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    return rows.mapInArrow(run, TERMS).groupBy("item_id", "term").agg(F.sum("reps").alias("reps"))


def frequencies(docs: DataFrame) -> DataFrame:
    """``term, docs, terms``: documents that hold each term; in the row of the null term, documents with any term and all their terms with repeats."""
    schema_text = "term string, docs bigint, terms bigint"
    schema = arrow_schema(docs.sparkSession, schema_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1):
            row, term = words(batch.column(1), WORDS_AND_DIGITS)
            known = term.dictionary_encode()
            code = known.indices.to_numpy().astype(np.int64)
            pairs = np.unique(code * len(batch) + row)
            held = np.bincount(pairs // len(batch), minlength=len(known.dictionary)) if len(pairs) else np.zeros(0, int)
            term = pa.concat_arrays([known.dictionary, pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays([term, pa.array(np.append(held, len(np.unique(row))), pa.int64()), pa.array(np.append(0 * held, len(row)), pa.int64())], schema=schema)

    return docs.mapInArrow(run, schema_text).groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms"))


class Shard:
    """Postings of the asked terms over some documents: for each term the places of its documents and their scores for weight one occurrence in the item."""

    def __init__(self, texts: pa.Array, asked: pa.Array, weight: np.ndarray, n_docs: int, n_terms: int):
        row, term = words(texts, WORDS_AND_DIGITS)
        size = max(1, len(texts))
        n = np.bincount(row, minlength=size).astype(np.int64)
        m = 100 - 25 + (25 * n * n_docs) // max(1, n_terms)
        known = term.dictionary_encode()
        place = pc.fill_null(pc.index_in(known.dictionary, value_set=asked), -1).to_numpy().astype(np.int64)
        code = place[known.indices.to_numpy()] if len(term) else np.zeros(0, np.int64)
        key, tf = np.unique((code * size + row)[code >= 0], return_counts=True)
        code, self.at, tf = key // size, key % size, tf.astype(np.int64)
        self.score = weight[code] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.at]))
        self.starts = np.searchsorted(code, np.arange(len(asked) + 1))
        self.bound = np.zeros(len(asked), np.int64)
        full = np.flatnonzero(np.diff(self.starts))
        if len(full):
            self.bound[full] = np.maximum.reduceat(self.score, self.starts[full])
        self.total = np.zeros(size, np.int64)

    def search(self, terms: np.ndarray, reps: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of documents among which are all that can be among the ``k`` best with a score of at least ``least``."""
        bound = self.bound[terms] * reps
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        terms, reps, bound = terms[order], reps[order], bound[order]
        left = int(bound.sum())
        total, opened, least = self.total, [], max(1, least)
        i = 0
        # Essential lists: what is left could lift a document that no opened list holds. Ties may win by their id.
        while i < len(terms) and left >= least:
            a, b = self.starts[terms[i]], self.starts[terms[i] + 1]
            at = self.at[a:b]
            total[at] += reps[i] * self.score[a:b]
            opened.append(at)
            left -= int(bound[i])
            i += 1
            if (i % 4 == 0 or left < 4 * least) and len(total) > k:
                least = max(least, int(np.partition(total, len(total) - k)[len(total) - k]))
        if not opened:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.flatnonzero(total + left >= least)
        found = found[total[found] > 0]
        for t, r, most in zip(terms[i:], reps[i:], bound[i:], strict=True):
            if not len(found):
                break
            a, b = self.starts[t], self.starts[t + 1]
            at = self.at[a:b]
            to = np.searchsorted(at, found)
            hit = at[np.minimum(to, len(at) - 1)] == found
            total[found[hit]] += r * self.score[a:b][to[hit]]
            left -= int(most)
            now = total[found]
            if len(now) > k:
                least = max(least, int(np.partition(now, len(now) - k)[len(now) - k]))
            found = found[now + left >= least]
        score = total[found]
        for at in opened:
            total[at] = 0
        return found[score >= least], score[score >= least]


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id; the greatest number stands for no id and comes last."""
    return np.lexsort((ids, -score))[:k]


def searched(docs: DataFrame, block: list, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item_id, doc_id, score``: of each task the best documents of each item of a block (rows ``item_id, term, reps, weight``)."""
    schema = arrow_schema(docs.sparkSession, FOUND)
    weights = {r["term"]: r["weight"] for r in block}
    numbers = {t: i for i, t in enumerate(sorted(weights))}
    weight = np.array([weights[t] for t in numbers], np.int64)
    items: dict[int | None, list[tuple[int, int]]] = {}
    for r in block:
        items.setdefault(r["item_id"], []).append((numbers[r["term"]], r["reps"]))
    wanted = [(i, *(np.array(x, np.int64) for x in zip(*t, strict=True))) for i, t in items.items()]
    names = list(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, none = pa.array(names, pa.string()), np.zeros(0, np.int64)
        top = [(none, none)] * len(wanted)
        for batch in gathered(batches, 1):
            shard = Shard(batch.column(1), asked, weight, n_docs, n_terms)
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
            for i, (_, terms, reps) in enumerate(wanted):
                old_ids, old = top[i]
                at, score = shard.search(terms, reps, k, int(old[-1]) if len(old) == k else 1)
                if len(at):
                    new_ids, new = np.append(old_ids, ids[at]), np.append(old, score)
                    keep = best(new_ids, new, k)
                    top[i] = new_ids[keep], new[keep]
        ids = np.concatenate([t[0] for t in top])
        item = pa.array([w[0] for w in wanted], pa.int64()).take(pa.array(np.repeat(np.arange(len(top)), [len(t[0]) for t in top])))
        yield pa.RecordBatch.from_arrays([item, pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).max), pa.array(np.concatenate([t[1] for t in top]), pa.int64())], schema=schema)

    return docs.mapInArrow(run, FOUND)


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` highest-scoring documents of each item, ties to the smaller id.

    Each row of ``docs`` is a document: rows repeated are several documents, and both can
    be listed. A null text has no term; a null id (and, alike, the greatest long) is
    listed as null, after other ids of its score. Rows of ``items`` with one id are one
    item, whose texts are put together; equal rows count once. Items without a term that
    occurs give no row, nor do empty tables.

    The documents are read once for their statistics and once for each block of
    ``ASKED`` terms of items; only a block's terms go to the tasks, and only the best
    documents of a task are shuffled.
    """
    spark = docs.sparkSession
    rows = pick(docs, key=key, text=text).select(F.col("key").cast("long").alias("key"), "text")
    terms = stored(item_terms(items, item_key, item_text), "item-terms")
    held = stored(frequencies(rows), "frequencies")
    sums = held.where("term is null").first()
    if sums is None or not sums["docs"]:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    n, total = sums["docs"], sums["terms"]
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("docs") + 1).cast("double")))
    weighted = terms.join(held.where("term is not null").select("term", "docs"), "term").select("item_id", "term", "reps", weight.cast("long").alias("weight")).where("weight > 0")
    asked = stored(blocked(weighted), "asked")
    blocks = [asked.where((F.col("deal") == b["deal"]) & (F.col("part") == b["part"])).collect() for b in asked.select("deal", "part").distinct().orderBy("deal", "part").collect()]
    if not blocks:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = reduce(DataFrame.union, [searched(rows, block, n, total, k) for block in blocks])
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def blocked(weighted: DataFrame) -> DataFrame:
    """The terms of items with a block's ``deal`` and ``part``: its items have at most ``ASKED`` terms, besides its last item."""
    sizes = stored(weighted.groupBy("item_id").agg(F.count("*").alias("n")), "item-sizes")
    deals = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // ASKED))
    dealt = sizes.withColumn("deal", F.pmod(F.xxhash64("item_id"), F.lit(deals)))
    before = Window.partitionBy("deal").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.select(F.col("item_id").alias("i"), "deal", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / ASKED).alias("part"))
    return weighted.join(parts, F.col("item_id").eqNullSafe(F.col("i"))).drop("i")
