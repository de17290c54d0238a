"""Addresses against tables of networks: 128-bit numbers in the JVM and a longest-prefix join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.functions.urls import address_number


def masked(half: Column, bits: Column) -> Column:
    """A 64-bit half with all but its first ``bits`` bits cleared; below 0 counts as 0 and above 64 as 64."""
    kept = F.least(F.greatest(bits, F.lit(0)), F.lit(64))
    # A shift by 64 would be one by 0.
    return F.when(kept == 0, F.lit(0).cast("long")).otherwise(half.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), 64 - kept)))


def numbered(df: DataFrame, address: Column) -> DataFrame:
    """The table with an address's number as ``n``, as a row of its own so that the plan holds and computes it once."""
    return df.withColumn("n", F.explode(F.array(address_number(address))))


def prefix(number: Column, bits: Column) -> list[Column]:
    """The columns that say an address's first ``bits`` bits."""
    return [number["family"].alias("family"), bits.alias("bits"), masked(number["hi"], bits).alias("hi"), masked(number["lo"], bits - 64).alias("lo")]


def networks(df: DataFrame, network: str = "network", value: str = "value") -> DataFrame:
    """``family, bits, hi, lo, value`` of networks written as ``address/bits``.

    An address without a length is a network of its own; bits beyond the length don't
    matter. Rows that are no network or have no value are left out. Of rows of one network
    the least value counts.
    """
    rows = numbered(df.select(F.split(F.col(network), "/").alias("parts"), F.col(value).alias("value")), F.element_at("parts", 1))
    parts, width = F.col("parts"), F.when(F.col("n.family") == 4, 32).otherwise(128)
    # An IPv4 network may be written inside IPv6.
    given = F.get(parts, F.lit(1)).try_cast("int") - F.when((F.col("n.family") == 4) & F.element_at(parts, 1).contains(":"), 96).otherwise(0)
    rows = rows.where("n is not null and value is not null").select("n", "value", F.when(F.size(parts) == 1, width).when((F.size(parts) == 2) & given.between(0, width), given).alias("given"))
    rows = rows.where("given is not null").select(*prefix(F.col("n"), F.col("given")), "value")
    return rows.groupBy("family", "bits", "hi", "lo").agg(F.min("value").alias("value"))


def longest_prefix(addresses: DataFrame, nets: DataFrame, address: str = "ip") -> DataFrame:
    """Every distinct address with the smallest network it lies in: ``address, bits, value``; nulls where there is none.

    ``nets`` comes from ``networks``. An address meets networks by equal prefixes, one
    row for each length that occurs in its family (32 or 128 and one at most), so the
    work grows with the addresses and not with addresses times networks, and an address
    that many rows share is looked up once. Text that is no address is in no network.
    """
    known = addresses.select(F.col(address).alias("address")).distinct()
    known = numbered(known, F.col("address"))
    # At most two rows, of at most 129 numbers each.
    lengths = nets.groupBy("family").agg(F.collect_set("bits").alias("lengths"))
    asked = known.join(F.broadcast(lengths), F.col("n.family") == F.col("family"), "left").drop("family")
    asked = asked.select("address", "n", F.explode_outer("lengths").alias("length"))
    asked = asked.select("address", *prefix(F.col("n"), F.col("length")))
    hits = asked.join(nets, ["family", "bits", "hi", "lo"], "left").withColumn("hit", F.when(F.col("value").isNotNull(), F.struct("bits", "value")))
    return hits.groupBy("address").agg(F.max("hit").alias("h")).select("address", "h.bits", "h.value")
