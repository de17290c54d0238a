"""Where results go: lines of JSON, a store of pages with their originals, and a keyed cache, all by Spark's own writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.functions.urls import domain_of


def payload(*columns: str | Column, ascii_only: bool = False) -> Column:
    """A row as one JSON object; with ``ascii_only`` other characters are written as escapes of UTF-16 units."""
    out = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    if not ascii_only:
        return out

    @F.pandas_udf("string")
    def escaped(texts: pd.Series) -> pd.Series:
        def units(c: str) -> str:
            raw = c.encode("utf-16-be", "surrogatepass")
            return "".join(f"\\u{raw[i]:02x}{raw[i + 1]:02x}" for i in range(0, len(raw), 2))

        return texts.map(lambda t: t if t is None or t.isascii() else "".join(c if c.isascii() else units(c) for c in t))

    return escaped(out)


def write_payloads(df: DataFrame, path: str, *columns: str, ascii_only: bool = False) -> None:
    df.select(payload(*columns, ascii_only=ascii_only).alias("value")).write.text(path)


def write_store(pages: DataFrame, path: str, url: str = "url", content: str = "content") -> None:
    """Original bytes and whatever else the rows have, in folders by a hash of the host, so that a host with many pages is many files."""
    pages.withColumn("content", F.col(content)).withColumn("shelf", F.pmod(F.xxhash64(F.lower(domain_of(F.col(url)))), F.lit(64)).cast("int")).write.partitionBy("shelf").parquet(path)


def read_store(spark: SparkSession, path: str, hosts: list[str] | None = None, url: str = "url") -> DataFrame:
    """The store, or the pages of some hosts: only their folders are read."""
    store = spark.read.parquet(path)
    if hosts is None:
        return store.drop("shelf")
    wanted = spark.createDataFrame([(h.lower(),) for h in hosts], "h string").select("h", F.pmod(F.xxhash64("h"), F.lit(64)).cast("int").alias("shelf")).collect()
    return store.where(F.col("shelf").isin(sorted({r["shelf"] for r in wanted})) & F.lower(domain_of(F.col(url))).isin([r["h"] for r in wanted])).drop("shelf")


def cache_key(text: Column) -> Column:
    """The hex BLAKE2b digest of 16 bytes under which a page is cached."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        from hashlib import blake2b

        return values.map(lambda v: None if v is None else blake2b(v.encode(), digest_size=16).hexdigest())

    return digest(text)


def put_in_cache(spark: SparkSession, entries: DataFrame, path: str, at: int) -> None:
    """Add ``key, value`` rows put at a time (milliseconds); each batch is a new set of files that Spark commits at once."""
    entries.select("key", "value", F.lit(at).cast("long").alias("put")).write.mode("append").parquet(path)


def get_from_cache(spark: SparkSession, keys: DataFrame, path: str, now: int, ttl: int) -> DataFrame:
    """``key, value`` of each key's last entry that is no older than ``ttl``; keys without one are left out."""
    last = spark.read.parquet(path).where(F.col("put") >= now - ttl).groupBy("key").agg(F.max_by("value", "put").alias("value"))
    return keys.select("key").distinct().join(last, "key")
