"""Sequential state as windows: politeness, quotas, caches, bounded logs, budgets of pieces, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.session import saved


def in_blocks(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows in the order of key and ``order``, cut in even blocks, and the count of each key's rows in each block.

    Rows get their key's digest ``_k``, the block ``_p`` and their number ``_rn`` (from 0) in
    the block; sizes are ``_k, _p, _n, _before``, the last being the key's rows in earlier
    blocks. Blocks are ranges of the sorted table, so a key with most of the rows is many
    blocks, and no task gets more than one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Nulls are a key of their own.
    digest = F.struct(*(F.col(k) for k in keys))
    rows = df.withColumn("_k", digest).repartitionByRange(n, "_k", *order).withColumn("_p", F.spark_partition_id())
    rows = saved(rows)
    inside = Window.partitionBy("_k", "_p").orderBy(*order)
    rows = rows.withColumn("_rn", (F.row_number().over(inside) - 1).cast("long"))
    sizes = rows.groupBy("_k", "_p").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return rows, sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def beside(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows with what is known of their block."""
    named = blocks.withColumnsRenamed({"_k": "_k2", "_p": "_p2"})
    return rows.join(named, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_p") == F.col("_p2"))).drop("_k2", "_p2")


def politeness(df: DataFrame, host: str, arrival: str, gap: int, order: str) -> DataFrame:
    """``start`` of each request: its arrival, or ``gap`` after the previous start of its host, whichever is later.

    ``arrival`` is a long (for example milliseconds). The recurrence has a closed form:
    with rn requests before it, start = gap * rn + the running maximum of arrival - gap * rn.
    It is scanned by blocks: a block is told by its count and its greatest slack, which
    add up over the blocks before, so that no task gets all requests of a host.
    """
    rows, sizes = in_blocks(df, [host], [arrival, order])
    step = F.lit(gap).cast("long")
    slack = F.col(arrival) - step * F.col("_rn")
    inside = Window.partitionBy("_k", "_p").orderBy(arrival, order).rowsBetween(Window.unboundedPreceding, 0)
    tops = rows.groupBy(F.col("_k").alias("_k3"), F.col("_p").alias("_p3")).agg(F.max(slack).alias("_top"))
    blocks = sizes.join(tops, F.col("_k").eqNullSafe(F.col("_k3")) & (F.col("_p") == F.col("_p3"))).drop("_k3", "_p3")
    earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_prior", F.max(F.col("_top") - step * F.col("_before")).over(earlier)).drop("_top", "_n")
    scanned = beside(rows.withColumn("_own", F.max(slack).over(inside)), blocks)
    # greatest() passes over the null of a host's first block.
    start = step * (F.col("_before") + F.col("_rn")) + F.greatest(F.col("_prior"), F.col("_own") - step * F.col("_before"))
    return scanned.withColumn("start", start).select(*df.columns, "start")


def quota(df: DataFrame, key: str, ts: str, limit: int, period: str = "day", order: str | None = None) -> DataFrame:
    """``df`` with ``admitted``: the first ``limit`` calls of each key and UTC period; refused calls use nothing up. Counted by blocks."""
    rows, sizes = in_blocks(df.withColumn("_period", F.date_trunc(period, F.col(ts))), [key, "_period"], [ts, *([order] if order else [])])
    return beside(rows, sizes).withColumn("admitted", F.col("_before") + F.col("_rn") < limit).select(*df.columns, "admitted")


def evict(entries: DataFrame, now: Column, ttl: int, cap: int, group: str | None = None) -> DataFrame:
    """Cache entries that stay: not older than ``ttl`` seconds, and the newest whose sizes fit ``cap`` bytes together.

    ``entries``: ``key, ts timestamp, bytes``. Entries of one time go by key. A cap holds
    for a cache; with many caches, ``group`` names theirs. Bytes are summed by hour first,
    so that no task gets all entries of a cache.
    """
    own = F.col(group) if group else F.lit(0)
    fresh = entries.where(now.cast("double") - F.col("ts").cast("double") <= ttl).withColumn("_g", own).withColumn("_h", F.date_trunc("hour", F.col("ts")))
    hours = fresh.groupBy("_g", "_h").agg(F.sum("bytes").alias("_b"))
    newer = Window.partitionBy("_g").orderBy(F.col("_h").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = hours.select("_g", "_h", F.coalesce(F.sum("_b").over(newer), F.lit(0)).alias("_before")).where(F.col("_before") <= cap)
    by = Window.partitionBy("_g", "_h").orderBy(F.col("ts").desc(), F.col("key").desc())
    inside = F.sum("bytes").over(by.rowsBetween(Window.unboundedPreceding, 0))
    kept = fresh.withColumn("_inside", inside).join(before.withColumnsRenamed({"_g": "_g2", "_h": "_h2"}), F.col("_g").eqNullSafe(F.col("_g2")) & F.col("_h").eqNullSafe(F.col("_h2")))
    return kept.where(F.col("_before") + F.col("_inside") <= cap).select(*entries.columns)


def newest(df: DataFrame, key: str, order: tuple[str, ...], most: int) -> DataFrame:
    """The newest ``most`` rows of each key."""
    by = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def visited_fifo(df: DataFrame, key: str, order: str, most: int = 20_000, keep: int = 10_000) -> DataFrame:
    """A bounded visited list of each key after its last insert: past ``most`` entries, the oldest go until ``keep`` are left.

    The list grows one by one and is cut each time it holds ``most`` + 1, so the number left follows from the total.
    """
    rows, sizes = in_blocks(df, [key], [order])
    whole = Window.partitionBy("_k")
    total, cycle = F.col("_total"), most + 1 - keep
    left = F.when(total <= most, total).otherwise(keep + (total - most - 1) % cycle)
    blocks = sizes.withColumn("_total", F.sum("_n").over(whole)).withColumn("_gone", total - left).where(F.col("_before") + F.col("_n") > F.col("_gone"))
    return beside(rows, blocks).where(F.col("_before") + F.col("_rn") >= F.col("_gone")).select(*df.columns)


def quantiles(df: DataFrame, key: str, value: str, shares: tuple[float, ...], few: int = 10_000, bins: int = 1024) -> DataFrame:
    """``key, share, quantile, n, top``: exact quantiles, linear between ranks, the count and the maximum of each key, by distributed selection.

    The ranks asked for are looked for in a range of values each, at first the key's
    whole one. A histogram of the range, which tasks add up before they meet, tells the
    bin that holds the rank, and that bin is the next range, until at most ``few`` values
    are left or all are equal. So no task ever gets the values of a key. Nulls take no part.
    """
    values = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    ends = values.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = saved(ends)
    at = lambda s: F.lit(s) * (F.col("n") - 1)
    ranks = F.explode(F.array(*(f(at(s)).cast("long") for s in shares for f in (F.floor, F.ceil))))
    open_ = saved(ends.select("k", "lo", "hi", F.col("n").alias("left"), ranks.alias("rank")).distinct().withColumn("target", F.col("rank")))
    done = None
    while True:
        here = F.col("k").eqNullSafe(F.col("k2"))
        closed = open_.where((F.col("left") <= few) | (F.col("lo") == F.col("hi")))
        done = closed if done is None else done.union(closed)
        open_ = open_.where((F.col("left") > few) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"))
        met = values.withColumnRenamed("k", "k2").join(open_, here & F.col("v").between(F.col("lo"), F.col("hi")))
        hist = met.groupBy("k", "target", "rank", place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        up_to = Window.partitionBy("k", "target").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        told = hist.withColumn("end", F.sum("c").over(up_to)).where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("c")))
        open_ = saved(told.select("k", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("c").alias("left"), (F.col("rank") - F.col("end") + F.col("c")).alias("rank"), "target"))
    done = saved(done)
    same = done.where("lo = hi").select("k", "target", F.col("lo").alias("found"))
    met = values.withColumnRenamed("k", "k2").join(done.where("lo < hi"), F.col("k").eqNullSafe(F.col("k2")) & F.col("v").between(F.col("lo"), F.col("hi")))
    sorted_ = met.groupBy("k", "target", "rank").agg(F.sort_array(F.collect_list("v")).alias("vs")).select("k", "target", F.element_at("vs", (F.col("rank") + 1).cast("int")).alias("found"))
    found = saved(same.union(sorted_))
    wanted = ends.select("k", "n", "hi", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    for name, f in (("low", F.floor), ("high", F.ceil)):
        other = found.select(F.col("k").alias("k2"), "target", F.col("found").alias(name))
        wanted = wanted.join(other, F.col("k").eqNullSafe(F.col("k2")) & (f("at").cast("long") == F.col("target"))).drop("k2", "target")
    part = F.col("at") - F.floor("at")
    return wanted.select(F.col("k").alias(key), "share", (F.col("low") + (F.col("high") - F.col("low")) * part).alias("quantile"), "n", F.col("hi").alias("top"))


def latency_percentiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """p50, p95, p99 (linear between ranks) and maximum of each key, in milliseconds with one decimal."""
    shares = (0.5, 0.95, 0.99)
    told = quantiles(df.select(key, (F.col(value) * 1000).alias("_v")), key, "_v", shares)
    each = (F.round(F.max(F.when(F.col("share") == q, F.col("quantile"))), 1).alias(f"p{round(q * 100)}") for q in shares)
    return told.groupBy(key).agg(*each, F.round(F.max("top"), 1).alias("max"))


def nearest_rank(df: DataFrame, key: str, value: str, q: float, most: int = 2000, order: str = "event_id") -> DataFrame:
    """The nearest-rank percentile of each key's first ``most`` samples; ranks round half to even."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= most)
    sized = first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value, order))).withColumn("_c", F.count("*").over(Window.partitionBy(key)))
    return sized.where(F.col("_r") == F.bround(F.lit(q) * (F.col("_c") - 1)) + 1).select(key, F.col(value).alias("percentile"))


def fetch_stats(df: DataFrame, by: Column, error: Column, size: Column) -> DataFrame:
    """Requests, errors and bytes by a key."""
    return df.groupBy(by.alias("key")).agg(F.count("*").alias("requests"), F.count_if(error).alias("errors"), F.sum(size).alias("bytes"))


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """True and false positives and negatives, and the false-positive and detection rates; a rate without cases is zero."""
    tp, fp = F.count_if(predicted & actual), F.count_if(predicted & ~actual)
    fn, tn = F.count_if(~predicted & actual), F.count_if(~predicted & ~actual)
    rate = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    return df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(fp, tn).alias("fp_rate"), rate(tp, fn).alias("detection_rate"))


def cache_stats(df: DataFrame, hit: Column, size: Column) -> DataFrame:
    """Hits, misses, hit rate with four decimals, and bytes."""
    hits, n = F.count_if(hit), F.count("*")
    return df.agg(hits.alias("hits"), (n - hits).alias("misses"), F.when(n > 0, F.round(hits / n, 4)).otherwise(0.0).alias("hit_rate"), F.sum(size).alias("bytes"))


def fit_window(df: DataFrame, key: str, order: str, text: str, budget: int, tokens: Column) -> DataFrame:
    """Pieces of each key that fit a token budget in order: the first that doesn't is ``cut`` to the rest if over ten tokens are left, and ends it.

    Empty pieces are passed over.
    """
    by = Window.partitionBy(key).orderBy(order)
    rows = df.where(F.col(text) != "").withColumn("n_tokens", tokens)
    before = F.coalesce(F.sum("n_tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    fits = F.col("before") + F.col("n_tokens") <= budget
    cut = ~fits & (F.col("before") <= budget) & (F.lit(budget) - F.col("before") > 10)
    return rows.withColumn("cut", cut).withColumn("room", F.lit(budget) - F.col("before")).where(fits | F.col("cut")).drop("before")


def fitting_limit(text: Column, limit: int, budget: int, floor: int = 240) -> Column:
    """The largest of ``limit``, half of it, a quarter and so on down to ``floor`` that keeps a text within ``budget``; null if none does."""
    tries, size = [], limit
    while size > floor:
        tries.append(size)
        size //= 2
    tries.append(floor)
    fine = F.filter(F.array(*map(F.lit, tries)), lambda c: F.least(F.length(text), c) <= budget)
    return F.array_max(fine)


def fitting_links(sizes: Column, budget: int) -> Column:
    """How many links from the front stay within a budget, when half of them go at a time."""
    n = F.size(sizes)
    tries = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.floor(n / F.pow(F.lit(2.0), k)).cast("int"))
    fine = F.filter(tries, lambda m: F.aggregate(F.slice(sizes, F.lit(1), m), F.lit(0).cast("long"), lambda a, x: a + x) <= budget)
    return F.coalesce(F.array_max(fine), F.lit(0))
