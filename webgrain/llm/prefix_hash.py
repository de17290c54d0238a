"""Document fingerprints by prefix polynomial hashes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm.common import map_rows, pick, stored

#: Two prime moduli below 2**31 and their bases; fixed, so fingerprints agree between runs.
MODULI, BASES = (2147483647, 2147483629), (911382323, 972663749)

#: Code points of a span and spans of a fingerprint's sample.
WIDTH, SIZE = 12, 64

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(slot: int, base: int, modulus: int, n: int) -> np.ndarray:
    have = _POWERS[slot]
    while len(have) <= n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), modulus)) % np.uint64(modulus)])
    if n <= 1 << 22:
        _POWERS[slot] = have
    return have


def powers(k: int, n: int) -> np.ndarray:
    """Base k to the powers 0 to n at least, by doubling."""
    return _grown(k, BASES[k], MODULI[k], n)


def inverse_powers(n: int) -> np.ndarray:
    """The inverse of the first base to the powers 0 to n at least."""
    return _grown(2, pow(BASES[0], -1, MODULI[0]), MODULI[0], n)


class PrefixHash:
    """Prefix arrays of a text: the equality of any two spans in constant time, common extensions by binary search.

    ``h[k][i]`` is the sum of c_j * base**j over the first i code points, modulo a prime;
    two moduli make chance equality about 2**-62.
    """

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.pows, self.h = [], []
        for k, m in enumerate(MODULI):
            p = powers(k, self.n)
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * p[: self.n] % np.uint64(m), out=h[1:])
            h %= np.uint64(m)
            self.pows.append(p)
            self.h.append(h)

    def span(self, k: int, start: int, end: int) -> int:
        return (int(self.h[k][end]) - int(self.h[k][start])) % MODULI[k]

    def same(self, start: int, other: PrefixHash, at: int, size: int) -> bool:
        """Whether ``size`` code points from ``start`` equal those of ``other`` from ``at``."""
        for k, m in enumerate(MODULI):
            a, b = self.span(k, start, start + size), other.span(k, at, at + size)
            if start < at:
                a = a * int(other.pows[k][at - start]) % m
            elif at < start:
                b = b * int(self.pows[k][start - at]) % m
            if a != b:
                return False
        return True

    def forward(self, start: int, other: PrefixHash, at: int) -> int:
        """The longest common extension to the right of two places."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(start + low, other, at + low, mid - low):
                low = mid
            else:
                high = mid - 1
        return low

    def backward(self, end: int, other: PrefixHash, at: int) -> int:
        """The longest common extension to the left of two places."""
        low, high = 0, min(end, at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(end - mid, other, at - mid, mid - low):
                low = mid
            else:
                high = mid - 1
        return low

    def windows(self, width: int) -> np.ndarray:
        """The hashes of all spans of ``width`` code points (of a shorter text: of the whole), wherever they stand."""
        if not self.n:
            return np.empty(0, np.uint64)
        width, m = min(width, self.n), np.uint64(MODULI[0])
        h = self.h[0]
        # What a span adds to the prefix sum carries the power of its place, which is divided out; so far differences and powers are below 2**32.
        return (h[width:] + m - h[: len(h) - width]) * inverse_powers(self.n)[: self.n - width + 1] % m

    def sample(self, width: int = WIDTH, size: int = SIZE) -> np.ndarray:
        """The ``size`` smallest distinct mixed hashes of spans, ascending: texts that share spans share those of the sample, wherever they stand."""
        mixed = mix(self.windows(width))
        if len(mixed) > 8 * size:
            # Most of a long text's values can't be among the smallest; where repeats make too few of the others, all are sorted.
            few = np.unique(mixed[mixed < (4 * size << 32) // len(mixed)])
            if len(few) >= size:
                return few[:size]
        return np.unique(mixed)[:size]

    def fingerprint(self) -> str:
        """Length, both hashes of the whole text, and the sample of its spans, in hex."""
        return f"{self.n:x}-{int(self.h[0][-1]):08x}{int(self.h[1][-1]):08x}-" + "".join(f"{v:08x}" for v in self.sample().tolist())


def mix(hashes: np.ndarray) -> np.ndarray:
    """Hashes in another order, one to one below 2**32, so that the smallest are a fair sample."""
    x = hashes.astype(np.uint32)
    for factor in (0x7FEB352D, 0x846CA68B):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


def likeness(a: str, b: str, size: int = SIZE) -> float:
    """How like two texts are by their fingerprints alone, 0 to 1; equal texts 1.

    The ``size`` smallest values of both samples together are a fair sample of all spans
    of either text; the share of them that both have estimates the Jaccard similarity j
    of the texts' spans. Returned is 2j / (1 + j), the shared part of the texts' mean
    length: about one half for texts of one length that share their first halves.
    """
    if a == b:
        return 1.0
    x, y = ({int(s[i : i + 8], 16) for i in range(0, len(s), 8)} for s in (f.rpartition("-")[2] for f in (a, b)))
    both = sorted(x | y)[:size]
    j = sum(v in x and v in y for v in both) / len(both) if both else 0.0
    return 2 * j / (1 + j)


def neighbours(numbers: DataFrame, bits: int = 12, levels: int = 4) -> DataFrame:
    """``own, after``: of each distinct number (of 60 bits) the next larger one; of the largest, the smallest.

    Numbers alike but for their last ``bits`` bits meet in one window, so no window has
    over 2**bits rows, however the numbers lie. A window's largest number is followed by
    the least of the next window, which is found the same way one level up; at the top
    are a few thousand numbers at most.
    """
    if not levels:
        every = Window.orderBy(F.col("own").desc())
        least = F.min("own").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return numbers.select("own", F.coalesce(F.lag("own").over(every), least).alias("after"))
    rows = numbers.select("own", F.shiftright("own", bits).alias("up"))
    leasts = rows.groupBy("up").agg(F.min("own").alias("least"))
    above = neighbours(leasts.select(F.col("up").alias("own")), bits, levels - 1)
    follow = above.join(leasts.withColumnRenamed("up", "after"), "after").select(F.col("own").alias("up"), "least")
    inside = F.lag("own").over(Window.partitionBy("up").orderBy(F.col("own").desc()))
    return rows.withColumn("inside", inside).join(follow, "up").select("own", F.coalesce("inside", "least").alias("after"))


def in_order(df: DataFrame, text: str = "text", key: str = "doc_id", block: int = 128, crowd: int = 10_000) -> DataFrame:
    """Rows ``key, text, extra`` such that in each partition every row is followed by the next one in descending key order.

    Rows meet in blocks of ``block`` neighbouring keys, sorted inside a partition, so no
    task holds the order of the whole table: the texts are shuffled once, and only the
    first text of each block goes a second time (``extra``), to the block before it;
    that of the first block goes to the last. Null texts are empty texts. Rows with a
    null key come last; rows of equal key follow each other by the top 16 bits of their
    text's XXH64 and then by text. A block of over ``crowd`` rows, whose keys are
    repeated or null, is parted by key and those bits, so that a key with a large share
    of the table is many blocks.
    """
    rows = pick(df, key=key, text=text).select(F.col("key").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("key") / block), F.lit(-(1 << 59)))).withColumn("bits", F.shiftrightunsigned(F.xxhash64("text"), 48))
    order = (F.col("key").desc_nulls_last(), F.col("bits"), F.col("text"))
    crowded = stored(rows.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("block", F.lit(True).alias("crowded")), "crowded")
    # Parts of a block ascend in the wanted order.
    within = F.coalesce(block - 1 - F.pmod("key", F.lit(block)), F.lit(0)) * 65536 + F.col("bits")
    if crowded.isEmpty():
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        rows = rows.join(crowded, "block", "left").withColumn("part", F.when(F.col("crowded"), within).otherwise(0)).drop("crowded")
    # One row a part of a block, and none of the texts.
    parts = stored(rows.select("block", "part").distinct(), "parts")
    blocks = neighbours(parts.select(F.col("block").alias("own")).distinct())
    ends = parts.groupBy("block").agg(F.max("part").alias("last"))
    follow = blocks.join(ends.withColumnRenamed("block", "after"), "after").select(F.col("own").alias("block"), F.col("after"), F.col("last"))
    inside = F.lag("part").over(Window.partitionBy("block").orderBy("part"))
    linked = parts.withColumn("inside", inside).join(follow, "block")
    linked = linked.select("block", "part", F.when(F.col("inside").isNull(), F.col("after")).otherwise(F.col("block")).alias("to"), F.coalesce("inside", "last").alias("to_part"))
    # The least of each part in that order, found before the shuffle: larger keys have smaller complements.
    least = F.min(F.struct(F.col("key").isNull().alias("last"), F.bitwise_not("key").alias("complement"), "bits", "text")).alias("h")
    heads = rows.groupBy("block", "part").agg(least).join(linked, ["block", "part"])
    heads = heads.select(F.bitwise_not("h.complement").alias("key"), "h.text", F.col("to").alias("block"), F.col("h.bits").alias("bits"), F.col("to_part").alias("part"), F.lit(True).alias("extra"))
    every = rows.withColumn("extra", F.lit(False)).unionByName(heads)
    return every.repartition("block", "part").sortWithinPartitions("block", "part", "extra", *order).drop("block", "part", "bits")


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how like they are.

    ``near_edited`` and ``near_next`` are the ``likeness`` of the text's fingerprint to
    those of the edited and of the next text. ``same_start`` is the longest common prefix
    of text and edited text, found by binary search in the prefix arrays. One row a row,
    repeated rows too; null texts are empty; nulls and ties of the key are ordered as
    ``in_order`` says.
    """

    def start():
        held: list[tuple] = []

        def row(key, text: str, own: PrefixHash, print_: str, following: str, next_print: str) -> dict:
            new = edited(text, following)
            new_hash = PrefixHash(new)
            new_print = new_hash.fingerprint()
            return {
                "doc_id": key,
                "n_chars": own.n,
                "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
                "fingerprint": print_,
                "edited_fingerprint": new_print,
                "near_edited": likeness(print_, new_print),
                "near_next": likeness(print_, next_print),
                "same_start": own.forward(0, new_hash, 0),
            }

        def apply(x: dict[str, list]) -> dict[str, list]:
            out: list[dict] = []
            for key, text, extra in zip(x["key"], x["text"], x["extra"], strict=True):
                now = PrefixHash(text)
                print_ = now.fingerprint()
                if held and not held[0][4]:
                    out.append(row(*held[0][:4], text, print_))
                held[:] = [(key, text, now, print_, extra)]
            return {c: [r[c] for r in out] for c in COLUMNS}

        return apply

    return map_rows(in_order(df, text, key), SCHEMA, start).withColumnRenamed("doc_id", key)


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_start bigint"
COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_start")
