"""Scanning texts for planted instructions: chunks are scored by a detector, flags merged by scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions import text as T


def scored_chunks(df: DataFrame, key: str, text: str, detector: Callable[[Column], Column], size: int = 900, overlap: int = 120, most: int | None = None) -> DataFrame:
    """``key, start, end, score`` of each overlapping chunk; ``detector`` is an expression or an Arrow function."""
    each = df.select(key, F.explode(T.windows(F.col(text), size, overlap, most)).alias("w"))
    return each.select(key, F.col("w.start").alias("start"), (F.col("w.start") + F.length("w.chunk")).alias("end"), detector(F.col("w.chunk")).alias("score"))


def scored_once(df: DataFrame, key: str, text: str, detector: Callable[[Column], Column], **sizes: int) -> DataFrame:
    """The same for a costly detector: equal chunks are scored once, by their hash."""
    each = df.select(key, F.explode(T.windows(F.col(text), **sizes)).alias("w")).select(key, F.col("w.start").alias("start"), (F.col("w.start") + F.length("w.chunk")).alias("end"), F.sha2("w.chunk", 256).alias("h"), "w.chunk")
    verdicts = each.groupBy("h").agg(F.first("chunk").alias("chunk")).select("h", detector(F.col("chunk")).alias("score"))
    return each.drop("chunk").join(verdicts, "h").drop("h")


def merged(chunks: DataFrame, key: str, threshold: float = 0.7) -> DataFrame:
    """``key, chunks, flags, score, risk, spans``: counts, highest score, and flagged spans in order."""
    flag = F.col("score") >= threshold
    out = chunks.groupBy(key).agg(
        F.count("*").alias("chunks"),
        F.count_if(flag).alias("flags"),
        F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.when(flag, F.struct("start", "end", "score")))).alias("spans"),
    )
    return out.withColumn("risk", F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= threshold, "medium").otherwise("low"))


def merged_reports(reports: DataFrame, key: str, order: str) -> DataFrame:
    """One report for each key of those of its scopes: ``scopes, max_score, risk, flagged, chunks_scanned, elapsed_ms, action``.

    ``reports`` has ``scope, max_score, risk, flagged`` (structs that begin with their
    offset), ``chunks_scanned, elapsed_ms, action``. The risk is that of the highest
    score, the first of equals; without a score above zero it is ``None``. Scopes and the action go by the first report.
    """
    first = F.struct(F.col("max_score"), (-F.col(order)).alias("o"))
    out = reports.groupBy(key).agg(
        F.sort_array(F.collect_set(F.struct(F.col(order), "scope"))).alias("s"),
        F.round(F.greatest(F.max("max_score"), F.lit(0.0)), 4).alias("max_score"),
        F.when(F.max("max_score") > 0, F.max_by("risk", first)).otherwise("None").alias("risk"),
        F.sort_array(F.flatten(F.collect_list("flagged"))).alias("flagged"),
        F.sum("chunks_scanned").alias("chunks_scanned"),
        F.round(F.sum("elapsed_ms"), 1).alias("elapsed_ms"),
        F.min_by("action", order).alias("action"),
    )
    return out.withColumn("scopes", F.array_distinct(F.transform("s", lambda x: x["scope"]))).drop("s")


def scan(df: DataFrame, key: str, text: str, detector: Callable[[Column], Column], threshold: float = 0.7, **sizes: int) -> DataFrame:
    return merged(scored_chunks(df, key, text, detector, **sizes), key, threshold)


def guarded(df: DataFrame, report: DataFrame, key: str, text: str, mode: str = "redact") -> DataFrame:
    """Texts after a scan: ``annotate`` adds the score, ``redact`` replaces flagged spans, ``block`` withholds the text."""
    out = df.join(report.select(key, "spans", F.col("score").alias("guard_score"), "flags"), key, "left")
    hit = F.coalesce(F.col("flags") > 0, F.lit(False))
    value = {"annotate": F.col(text), "redact": T.redacted(F.col(text), F.transform("spans", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["score"].alias("score")))), "block": F.lit(None).cast("string")}[mode]
    return out.withColumn(text, F.when(hit, value).otherwise(F.col(text))).drop("spans", "flags")
