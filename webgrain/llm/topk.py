"""Exact top-k search with bounds from segment means and deviations, coarse to fine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm.common import pick, stored

#: Vectors and queries that meet in one cell of the grid at most (on average, by hash).
CELL, QUERIES = 16_384, 8192
#: Segments of each level of the bounds, from coarse to fine.
LEVELS = (4, 8, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Of each row, segment means and then deviations, each times the root of the segment's length.

    For any two rows, the inner product is at most the inner product of these: within a
    segment of length l it is l times (product of means + covariance), and a covariance
    is at most the product of deviations. Equivalently the distance is at least that of
    the statistics.
    """
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    mean = np.stack([x[:, p].mean(1) * np.sqrt(len(p)) for p in parts], 1)
    dev = np.stack([x[:, p].std(1) * np.sqrt(len(p)) for p in parts], 1)
    return np.concatenate([mean, dev], 1)


def largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max())


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows with ``q``, exact; those beyond a long are its least or largest number."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if largest(x) * largest(q) * x.shape[1] < 2.0**62:
        return x @ q
    ends = np.iinfo(np.int64)
    return np.array([min(max(v, ends.min), ends.max) for v in x.astype(object) @ q.astype(object)], np.int64)


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k best vectors of each query among these (whole numbers): exact, by bounds first.

    The k coarse-best candidates give a threshold; a candidate whose bound is below it
    at some level can't be among the best and goes. Survivors are scored exactly.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    q, x = queries.astype(np.float64), vectors.astype(np.float64)
    levels = [(statistics(q, s), statistics(x, s)) for s in LEVELS if s < x.shape[1]]
    # Sums of whole numbers up to 2**53 are exact in doubles.
    plain = largest(x) * largest(q) * x.shape[1] < 2.0**53
    # Scores are whole numbers; one half, and more where they are large, covers the rounding of bounds.
    slack = 0.5 + 1e-14 * (x.shape[1] + 8) * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())
    out_q, out_v, out_s = [], [], []
    for start in range(0, len(q), 256):
        at = slice(start, start + 256)
        bound = levels[0][0][at] @ levels[0][1].T if levels else np.full((len(q[at]), len(x)), np.inf)
        for row, qi in enumerate(range(start, min(start + 256, len(q)))):
            own = bound[row]
            others = ids != query_ids[qi]
            few = min(len(x) - 1, 4 * k + 1)
            probe = np.argpartition(-own, few)[: few + 1] if few < len(x) - 1 else np.arange(len(x))
            probe = probe[others[probe]]
            score = x[probe] @ q[qi]
            least = (np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf) - slack[qi]
            left = np.flatnonzero((own >= least) & others)
            for a, b in levels[1:]:
                left = left[b[left] @ a[qi] >= least]
            score = (x[left] @ q[qi]).astype(np.int64) if plain else exact(vectors[left], queries[qi])
            # Ids ascend, so a stable sort by score breaks ties to the smaller id.
            top = np.argsort(~score, kind="stable")[:k]
            out_q.append(np.full(len(top), query_ids[qi]))
            out_v.append(ids[left[top]])
            out_s.append(score[top])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def scaled(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``id`` and ``v``, the components times ``scale`` rounded down; rows with a null id, no vector, or a null or non-finite component are left out."""
    rows = pick(df, id=key, v=vector).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    fine = "v is not null and id is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return rows.where(fine).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def top_k(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The ``k`` rows of highest integer inner product of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id ``every`` divides; candidates all rows but the query's
    own id. Ties go to the smaller id. Rows of one id twice count as two candidates of
    that id and one query (the first by vector). Vectors of several lengths are compared
    with their own length only.

    Of equal vectors only the k+1 smallest ids can be in a result, so others leave
    before the search. Candidates and queries are dealt to a grid of cells, each small
    enough for a task; a cell gives each query its best k, and those meet by query.
    """
    rows = scaled(df, key, vector, scale)
    same = Window.partitionBy("v").orderBy("id")
    rows = stored(rows, "vectors")
    vectors = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n = rows.count()
    across, down = max(1, -(-n // CELL)), max(1, -(-n // (every * QUERIES)))
    pack = lambda d: d.select("id", F.size("v").alias("dim"), "v")
    left = pack(vectors).withColumn("a", F.pmod(F.xxhash64("id"), F.lit(across)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = pack(queries).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def cell(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        return best_of(asked["id"].to_numpy(np.int64), np.stack(asked["v"].to_numpy()).astype(np.int64), candidates["id"].to_numpy(np.int64), np.stack(candidates["v"].to_numpy()).astype(np.int64), k)

    on = ("a", "b", "dim")
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(cell, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
