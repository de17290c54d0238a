"""Search for a whole table of queries at once: over texts where they lie, or by an inverted index in blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.batches import by_pieces, kind, pieces
from webgrain.functions.text import terms
from webgrain.operators.ranking import counted
from webgrain.session import saved

#: Document numbers of a block, and blocks of each query that are opened first.
SPAN, FIRST = 64, 8
#: What sums of doubles may differ by.
SLACK = 1e-6
#: Terms of queries that are looked for in one pass over the texts, and bytes of a piece of an Arrow batch there.
ASKED, PART = 1 << 19, 1 << 22


def inverted_index(docs: DataFrame, key: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``term, block, n, best, corpus, docs``: for each term and block of ``SPAN`` numbers of documents the ``n`` postings ``doc, weight`` and the highest weight.

    Weights are BM25's without the term's rarity, which a search works out for the terms it
    asks for, with ``corpus`` documents in all. Each text is counted where it is read;
    postings are shuffled and written once, by term and block, so a frequent term is many
    rows.
    """
    found = terms(F.col(text))
    corpus, total = docs.agg(F.count("*"), F.sum(F.size(found))).first()
    mean = F.lit((total / corpus if corpus and total else 0.0) or 1.0)
    rows = docs.select(F.struct(F.col(key).cast("long").alias("doc"), F.size(found).cast("double").alias("dl")).alias("_k"), text)
    tf, dl = F.col("n").cast("double"), F.col("_k.dl")
    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
    each = counted(rows, "_k", found).select(F.col("word").alias("term"), F.floor(F.col("_k.doc") / SPAN).alias("block"), F.col("_k.doc").alias("doc"), weight.alias("weight"))
    lists = each.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("weight").alias("best"), F.collect_list(F.struct("doc", "weight")).alias("docs"))
    return saved(lists.select("term", "block", "n", "best", F.lit(corpus).alias("corpus"), "docs"))


def search_all(index: DataFrame, queries: DataFrame, key: str, text: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best documents of each query (``key, doc, score, rank``), and how many blocks each query met and opened (``key, blocks, opened``).

    A block's bound is the sum of its lists' highest weights. The blocks of highest
    bound are opened first; the k-th score there is what others have to reach, and those
    that can't stay shut. Bounds are read without the postings. Queries are a table of
    any size, and no text of theirs leaves the executors. Ties, after six decimals, go to
    the smaller document. All postings are shuffled for each of these steps, and a row for
    each query and block; ``search_texts`` shuffles neither.
    """
    named = saved(queries.select(F.col(key).alias("q"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term")))
    rarity = index.join(named.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"), F.first("corpus").alias("corpus"))
    idf = F.log(1 + (F.col("corpus") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = saved(named.join(rarity, "term").select("q", "term", idf.alias("idf")))
    bounds = saved(asked.join(index.select("term", "block", "best"), "term").groupBy("q", "block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound")))
    by_bound = Window.partitionBy("q").orderBy(F.col("bound").desc(), "block")
    early = bounds.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= FIRST).select("q", "block")
    first = saved(_scored(index, asked, early))
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc(), "doc")
    least = first.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select("q", F.col("score").alias("least"))
    late = bounds.join(early, ["q", "block"], "left_anti").join(least, "q", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK).select("q", "block")
    late = saved(late)
    best = first.union(_scored(index, asked, late)).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    opened = early.union(late).groupBy("q").agg(F.count("*").alias("opened"))
    met = bounds.groupBy("q").agg(F.count("*").alias("blocks")).join(opened, "q")
    return best.select(F.col("q").alias(key), "doc", "score", "rank"), met.withColumnRenamed("q", key)


def _scored(index: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    lists = blocks.join(asked, "q").join(index.select("term", "block", "docs"), ["term", "block"])
    each = lists.select("q", "idf", F.explode("docs").alias("d")).select("q", "d.doc", (F.col("idf") * F.col("d.weight")).alias("weight"))
    return each.groupBy("q", "doc").agg(_rounded(F.sum("weight")).alias("score"))


def _rounded(score: Column) -> Column:
    return F.round(score, 6)


def search_texts(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_key, doc, score, rank``: the ``k`` best documents of each query by BM25, found without an inverted index.

    Each text is counted where it is read, and what is written of it are the numbers of
    the asked terms that it holds. Then each task scores its documents for all queries,
    and only its ``k`` best of each query are shuffled. Queries are a table of any size:
    by blocks of about ``ASKED`` terms they go through the driver to all tasks, and each
    block reads the texts once.

    Rows of one query key are one query. Rows of documents with one key are one document;
    those of one length count their terms together, those of several add up. Ties, after
    six decimals, go to the smaller document, null last.
    """
    asked = saved(queries.select(F.col(query_key).alias("q"), F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term")).distinct())
    blocks = max(1, -(-asked.count() // ASKED))
    number = F.pmod(F.xxhash64("q"), F.lit(blocks))
    found = reduce(DataFrame.union, [_best_of_block(docs, key, text, asked.where(number == i), k, k1, b) for i in range(blocks)])
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), "doc", "score", "rank")


def _best_of_block(docs: DataFrame, key: str, text: str, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """``q, doc, score``: of each task the ``k`` best documents of each query of a block."""
    block = asked.toArrow()
    words = pc.unique(block["term"])
    words = words.take(pc.sort_indices(words))
    held = saved(_held(docs, key, text, words))
    corpus, total = held.agg(F.count("*"), F.sum("dl")).first()
    mean = F.lit((total / corpus if corpus and total else 0.0) or 1.0)

    def weight(tf: Column) -> Column:
        return tf * F.lit(k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / mean))

    rows, counts = held, held.select(F.explode("codes").alias("code"))
    weighted = rows.select("doc", "codes", F.transform("tfs", weight).alias("weights"))
    again = saved(held.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc").alias("again")))
    if not again.isEmpty():
        same = F.col("doc").eqNullSafe(F.col("again"))
        rows = held.join(again, same, "left_anti")
        each = held.join(again, same, "left_semi").select("doc", "dl", F.explode(F.arrays_zip("codes", "tfs")).alias("p"))
        each = saved(each.groupBy("doc", "dl", F.col("p.codes").alias("code")).agg(F.sum("p.tfs").alias("tf")))
        together = each.groupBy("doc", "code").agg(F.sum(weight(F.col("tf"))).alias("weight")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("code", "weight"))).alias("p"))
        counts = rows.select(F.explode("codes").alias("code")).union(each.select("code"))
        weighted = rows.select("doc", "codes", F.transform("tfs", weight).alias("weights")).union(together.select("doc", "p.code", "p.weight"))
    df, met = np.zeros(len(words)), counts.groupBy("code").agg(F.count("*").alias("df")).toArrow()
    df[met["code"].to_numpy()] = met["df"].to_numpy()
    return _searched(weighted, kind(asked, "q"), block, words, np.log(1 + (corpus - df + 0.5) / (df + 0.5)), k)


def _held(docs: DataFrame, key: str, text: str, words: pa.Array) -> DataFrame:
    """``doc, dl, codes, tfs`` of each text: its number of terms, and which of the sorted words it holds how often."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), terms(F.col(text)).alias("terms"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, size = batch.column("terms"), max(1, len(words))
        term = pc.list_flatten(lists).dictionary_encode()
        code = pc.fill_null(pc.index_in(term.dictionary, value_set=words), -1).to_numpy().astype(np.int64)[term.indices.to_numpy()]
        row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        both, tf = np.unique((row * size + code)[code >= 0], return_counts=True)
        starts = pa.array(np.searchsorted(both, np.arange(batch.num_rows + 1) * size), pa.int32())
        codes, tfs = (pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (both % size, tf))
        return pa.RecordBatch.from_arrays([batch.column("doc"), pc.list_value_length(lists).cast(pa.int64()), codes, tfs], names=["doc", "dl", "codes", "tfs"])

    return by_pieces(rows, "doc bigint, dl bigint, codes array<int>, tfs array<int>", run, PART)


def _searched(weighted: DataFrame, q: str, block: pa.Table, words: pa.Array, idf: np.ndarray, k: int) -> DataFrame:
    """``q, doc, score``: of each task the ``k`` best of its documents (``doc, codes, weights``) for each query of a block (rows ``q, term``)."""
    names = block["q"].combine_chunks().dictionary_encode(null_encoding="encode")
    queries, of = names.dictionary, names.indices.to_numpy()
    code = pc.index_in(block["term"], value_set=words).to_numpy().astype(np.int64)
    order = np.lexsort((code, of))
    code, ends = code[order], np.searchsorted(of[order], np.arange(len(queries) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An unfilled place has a score below that of any document.
        score, doc, none = np.full((len(queries), k), -1.0), np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k), bool)
        for batch in batches:
            for piece in pieces(batch, PART):
                lists = _Lists(piece, idf)
                for i in range(len(queries)):
                    at, points = lists.best(code[ends[i] : ends[i + 1]], k, score[i, -1])
                    if len(at):
                        points, ids, null = np.append(score[i], points), np.append(doc[i], lists.doc[at]), np.append(none[i], lists.none[at])
                        keep = np.lexsort((ids, null, -points))[:k]
                        score[i], doc[i], none[i] = points[keep], ids[keep], null[keep]
            del batch
            pa.default_memory_pool().release_unused()
        full = score >= 0
        yield pa.RecordBatch.from_arrays([queries.take(pa.array(np.nonzero(full)[0])), pa.array(doc[full], mask=none[full]), pa.array(score[full])], names=["q", "doc", "score"])

    return weighted.mapInArrow(run, f"q {q}, doc bigint, score double")


class _Lists:
    """The postings of some documents by the number of their term, with the term's rarity."""

    def __init__(self, piece: pa.RecordBatch, idf: np.ndarray):
        ids, codes = piece.column("doc"), piece.column("codes")
        code = pc.list_flatten(codes).to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        self.row = pc.list_parent_indices(codes).to_numpy()[order]
        self.weight = pc.list_flatten(piece.column("weights")).to_numpy()[order] * idf[code]
        self.starts = np.searchsorted(code, np.arange(len(idf) + 1))
        self.none, self.doc = pc.is_null(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()

    def best(self, codes: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that can be among the ``k`` best with a score of at least ``least``; sums go by the terms' order, so equal texts score alike."""
        total = np.zeros(len(self.doc))
        for a, z in zip(self.starts[codes], self.starts[codes + 1], strict=True):
            if a < z:
                total[self.row[a:z]] += self.weight[a:z]
        at = np.flatnonzero(total > max(0.0, least - SLACK))
        if len(at) > k:
            at = at[total[at] > np.partition(total[at], len(at) - k)[len(at) - k] - SLACK]
        return at, np.floor(total[at] * 1e6 + 0.5) / 1e6
