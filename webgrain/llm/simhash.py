"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into fewer segments than bits may differ, but so many that of
fingerprints within the distance, one segment differs by at most one bit. Each segment
is indexed once for each of its bits with that bit left out; fingerprints that agree
on a variant are candidates, and the whole distance decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm import shingle_join
from webgrain.llm.common import arrow_schema, give_back, map_rows, numbered, pick, stored
from webgrain.llm.components import components

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Members of a variant or key up to which all their pairs are told; of more, a forest is, in blocks of at most so many rows.
FEW, BLOCK = 12, 4096


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def shingles(words: list[str], size: int) -> list[str]:
    """Runs of ``size`` words joined by spaces, repeats included; fewer words give the whole sequence, none give nothing."""
    if not words:
        return []
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):
            total += bits[part : part + 255].sum(0, dtype=np.uint8)
    return total


def fingerprint(text: str | None, size: int = 4, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """A signed 64-bit word for each seed: a bit is 1 if set in over half the shingles' XXH64. Without words all are zero."""
    found = [s.encode() for s in shingles(words_of(text or ""), size)]
    out = []
    for seed in seeds:
        if not found:
            out.append(0)
            continue
        # Each seed hashes anew, so that words of several seeds are independent.
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in found), np.uint64, len(found))
        bits = 2 * bit_counts(hashes) > len(hashes)
        out.append(int(np.packbits(bits, bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """``doc_id`` and ``fp``, an array of one word a seed, of each whole text; null is the empty text."""

    def start():
        return lambda x: {"doc_id": x["key"], "fp": [fingerprint(t, size, seeds) for t in x["text"]]}

    rows = pick(df, key=key, text=text).select(F.col("key").cast("long").alias("key"), "text")
    return map_rows(rows, "doc_id bigint, fp array<bigint>", start)


def variants(segments: int, words: int) -> list[tuple[int, int, int]]:
    """Word, lowest bit and width of each segment: ``segments`` of even width for each word."""
    cuts = np.linspace(0, 64, segments + 1).astype(int)
    return [(w, int(a), int(b - a)) for w in range(words) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def segments_of(unique: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    """The rows once for each segment, with its number, width and value in ``c``."""
    cut = [F.struct(F.lit(s).alias("s"), F.lit(width).alias("width"), F.shiftrightunsigned(F.col("fp")[word], low).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for s, (word, low, width) in enumerate(parts)]
    return unique.select("*", F.explode(F.array(*cut)).alias("c"))


def with_variants(by_segment: DataFrame, *columns: str) -> DataFrame:
    """``key`` and the columns, once for each bit of the segment ``c`` left out: segment number and place in the top bits, then the segment without that bit."""
    by_bit = by_segment.select(*columns, "c.s", "c.value", F.explode(F.sequence(F.lit(0), F.col("c.width") - 1)).alias("i"))
    return by_bit.select(F.expr("(value & ~shiftleft(1L, i)) | shiftleft(s * 64L + i, 48)").alias("key"), *columns)


def near_pairs(group: np.ndarray, ids: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of all pairs of one group (rows lie by group) at ``most`` or fewer bits: neighbours first, then the next but one, and so on."""
    for step in range(1, len(group)):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            return
        hit = same[np.bitwise_count(fps[same] ^ fps[same + step]).sum(1) <= most]
        yield ids[hit], ids[hit + step]


def forest(fps: np.ndarray, near: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected among the fingerprints (rows): each is reached once, so at most one link a row."""
    left = np.arange(len(fps))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(np.bitwise_count(fps[left] ^ fps[at]).sum(1))
            for i in left[hit].tolist():
                yield at, i
                queue.append(i)
            left = left[~hit]


def nearest_forest(fps: np.ndarray, most: int) -> np.ndarray:
    """Links (pairs of places) of ``most`` or fewer bits that connect the same rows as all such links would, the nearest ones: a minimum spanning forest."""
    left = np.arange(1, len(fps))
    best = np.bitwise_count(fps[1:] ^ fps[0]).sum(1)
    parent = np.zeros(len(left), int)
    out = []
    while len(left):
        k = int(best.argmin())
        at = int(left[k])
        if best[k] <= most:
            out.append((int(parent[k]), at))
        # The last one left takes the place of the one reached.
        for a in (left, best, parent):
            a[k] = a[-1]
        left, best, parent = left[:-1], best[:-1], parent[:-1]
        d = np.bitwise_count(fps[left] ^ fps[at]).sum(1)
        closer = d < best
        best[closer], parent[closer] = d[closer], at
    return np.array(out, int).reshape(-1, 2)


def links(unique: DataFrame, parts: list[tuple[int, int, int]], most: int, words: int) -> DataFrame:
    """Links ``u, v`` between rows ``id, fp`` (distinct fingerprints) at ``most`` or fewer bits that share a variant.

    The index is shuffled by variant once. The pairs themselves where few share a
    variant; where many do, a forest that connects the same rows. A variant that very
    many share, which counts of the segments' values tell, is dealt out in pairs of
    blocks, so that no task holds more than two blocks.
    """
    by_segment = segments_of(unique, parts)
    counts = with_variants(by_segment.groupBy("c").agg(F.count("*").alias("n")), "n").groupBy("key").agg(F.sum("n").alias("n"))
    crowded = stored(counts.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "crowded")
    index = with_variants(by_segment, "id", "fp")

    def start() -> Found:
        def found(group: np.ndarray, key: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            sizes = np.bincount(group)
            starts = np.cumsum(sizes) - sizes
            small = np.flatnonzero(((sizes > 1) & (sizes <= FEW))[group])
            yield from near_pairs(group[small], ids[small], fps[small], most)
            for a, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
                grew = np.array(list(forest(fps[a : a + n], lambda d: d <= most)), int).reshape(-1, 2)
                yield ids[a + grew[:, 0]], ids[a + grew[:, 1]]

        return found

    return linked(index, crowded, words, start)


#: Links of some groups, whose rows lie by group: the group's number, key, id and fingerprint of each row.
Found = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def linked(index: DataFrame, crowded: DataFrame, words: int, start: Callable[[], Found]) -> DataFrame:
    """Links ``u, v`` of an index ``key, id, fp``, found within the rows of a key; ``crowded`` keys are dealt out by their ``blocks``. ``start`` is called once a task."""
    arrow = arrow_schema(index.sparkSession, "u bigint, v bigint")
    if crowded.isEmpty():
        many = index.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "fp")
    else:
        many = index.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        many = many.withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
        # A block meets every block once: itself, those before it and those after it.
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "fp")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = start()
        keys, ids, fps = [np.empty((0, 3), np.int64)], [np.empty(0, np.int64)], [np.empty((0, words), np.uint64)]

        def grown(key: np.ndarray, id_: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]).any(1)]))
            found = list(find(group, key[:, 0], id_, fp))
            u, v = (np.concatenate([f[side] for f in found]) if found else np.empty(0, np.int64) for side in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], 1))
            ids.append(batch.column("id").to_numpy(zero_copy_only=False))
            fps.append(batch.column("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words))
            key, id_, fp = np.concatenate(keys), np.concatenate(ids), np.concatenate(fps)
            # The last group may go on in the next batch.
            change = np.flatnonzero((key[1:] != key[:-1]).any(1))
            end = int(change[-1]) + 1 if len(change) else 0
            if end:
                yield grown(key[:end], id_[:end], fp[:end])
            keys, ids, fps = [key[end:]], [id_[end:]], [fp[end:]]
        key, id_, fp = np.concatenate(keys), np.concatenate(ids), np.concatenate(fps)
        if len(key):
            yield grown(key, id_, fp)
        give_back()

    return many.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(grouped, "u bigint, v bigint")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, most: int = 4, seeds: tuple[int, ...] = (42,), segments: int | None = None) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id reachable over links of ``most`` or fewer differing bits.

    One row a row of the table; repeated rows and equal texts are one fingerprint. Null
    texts and texts without words have the fingerprint zero and are linked like any
    other. A null id is kept, and links lead through it, but it is no component's id
    unless it has only nulls.

    By default a word is cut into as many segments as make sure that one differs by at
    most one bit, so no link is missed. With ``segments`` given, or words of more than
    one seed, ``segments`` of each word are indexed, and the chance of missing a link
    depends on the distance.
    """
    parts = variants(segments or most // 2 + 1, len(seeds))
    docs = stored(fingerprints(df, text, key, size, seeds), "fingerprints")
    # A fingerprint stands for its rows, so links lead through those without an id too.
    node = F.col("fp")[0] if len(seeds) == 1 else F.xxhash64("fp")
    unique = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("id", node), "unique")
    found = components(links(unique.select("id", "fp"), parts, most, len(seeds)))
    rooted = unique.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", "least", F.coalesce("root", "id").alias("root"))
    roots = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return docs.join(roots, "fp", "left").select("doc_id", "fp", "component_id")


def hex_word(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


#: The pipeline's stage: documents whose sets of five-word shingles have this similarity or more are copies. Candidates differ in ``most`` of
#: 256 bits (0.8 is expected at 38.8, with a spread of 5.7), and in one of ``deals`` x 12 segments of 20 bits by at most one bit.
STAGE = {"size": 5, "words": 4, "deals": 4, "most": 56, "alike": 0.8}
#: Bits of half a segment of the stage.
HALF = 10
#: Sets and tokens of one block of candidates that are compared with each other, about.
SETS, TOKENS = 2048, 1 << 20
HAS_WORDS = r"[^\x20\x09-\x0D]"


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, in order."""
    found = {xxhash.xxh64_intdigest(s, 42) for s in map(str.encode, shingles(words_of(text or ""), size))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def set_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """Words of a fingerprint in which each distinct shingle counts once; each word mixes the hashes anew."""
    out = np.zeros(words, np.int64)
    for w in range(words):
        h = hashes + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = 2 * bit_counts(h ^ (h >> np.uint64(31))) > len(h)
        out[w] = np.packbits(bits, bitorder="little").view(np.int64)[0]
    return out


def set_digest(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def dealt_halves(words: int, deals: int) -> np.ndarray:
    """The places of the bits of each half segment (rows): all bits are dealt out ``deals`` times anew; the halves of a segment follow each other."""
    rng = np.random.default_rng(7)
    whole = 64 * words // (2 * HALF) * 2 * HALF
    return np.concatenate([rng.permutation(64 * words)[:whole].reshape(-1, HALF) for _ in range(deals)])


def half_values(fps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits of fingerprints (rows of unsigned words) at the places (last axis) as numbers: a row of places for each fingerprint, or a table of them for all."""
    rows = np.arange(len(fps))
    rows, places = (rows, places) if places.ndim == 2 else (rows[:, None], places)
    out = np.zeros(np.broadcast_shapes(rows.shape, places.shape[:-1]), np.int64)
    for k in range(HALF):
        at = places[..., k]
        out |= ((fps[rows, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k
    return out


class Joined:
    """Which links join what a task's links before have not joined; forgets all once it knows many nodes."""

    def __init__(self, most: int = 200_000):
        self.parent: dict[int, int] = {}
        self.most = most

    def top(self, a: int) -> int:
        parent = self.parent
        while (b := parent.setdefault(a, a)) != a:
            parent[a] = parent[b]
            a = b
        return a

    def fresh(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parent) > self.most:
            self.parent.clear()
        keep = []
        for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
            a, b = self.top(a), self.top(b)
            if a != b:
                self.parent[a] = b
                keep.append(k)
        return u[keep], v[keep]


def variant_links(group: np.ndarray, other: np.ndarray, fps: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Links (pairs of places) between rows of a group whose deletion variants of ``other`` agree: of few rows or few links all, else a forest that connects the same rows."""
    for bit in range(HALF):
        # Equal values agree on all variants, so they meet at the first only.
        variant = group << HALF | other & ~(1 << bit)
        order = np.argsort(variant, kind="stable")
        variant = variant[order]
        starts = np.flatnonzero(np.append(True, variant[1:] != variant[:-1]))
        sizes = np.diff(np.append(starts, len(variant)))
        run = np.repeat(np.arange(len(starts)), sizes)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(run)) - 1
        at = np.flatnonzero((left > 0) & (sizes <= 5 * FEW)[run])
        found = [np.empty((0, 2), int)]
        for step in range(1, 5 * FEW):
            at = at[left[at] >= step]
            if not len(at):
                break
            a, b = order[at], order[at + step]
            asked = np.ones(len(a), bool) if not bit else other[a] != other[b]
            a, b, place = a[asked], b[asked], at[asked]
            hit = np.bitwise_count(fps[a] ^ fps[b]).sum(1) <= most
            found.append(np.stack([place[hit], place[hit] + step], 1))
        near = np.concatenate(found)
        dense = np.bincount(run[near[:, 0]], minlength=len(starts)) > FEW * sizes
        yield order[near[~dense[run[near[:, 0]]]]]
        for k in np.flatnonzero(dense):
            own = order[starts[k] : starts[k] + sizes[k]]
            yield own[nearest_forest(fps[own], most)]
        for k in np.flatnonzero(sizes > 5 * FEW):
            own = order[starts[k] : starts[k] + sizes[k]]
            if bit and (other[own] == other[own[0]]).all():
                continue
            yield own[np.array(list(forest(fps[own], lambda d: d <= most)), int).reshape(-1, 2)]


def candidates(unique: DataFrame, words: int, deals: int, most: int) -> DataFrame:
    """Links ``u, v`` that connect the rows ``id, fp`` as all pairs at ``most`` or fewer bits would that share a deletion variant of a dealt segment.

    The variants that leave out a bit of one half of a segment agree on its other half,
    so each row is shuffled once for each half, and its variants are made in the task.
    """
    schema = "id bigint, fp array<bigint>, keys array<bigint>"

    def keys():
        places = dealt_halves(words, deals)

        def apply(x: dict[str, list]) -> dict[str, list]:
            values = half_values(np.array(x["fp"], np.int64).view(np.uint64), places[None])
            return {"id": x["id"], "fp": x["fp"], "keys": list(values | np.arange(len(places), dtype=np.int64) << HALF)}

        return apply

    def start() -> Found:
        places, joined = dealt_halves(words, deals), Joined()

        def found(group: np.ndarray, key: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            # The other half of the segment.
            other = half_values(fps, places[(key >> HALF) ^ 1])
            for pairs in variant_links(group, other, fps, most):
                yield joined.fresh(ids[pairs[:, 0]], ids[pairs[:, 1]])

        return found

    keyed = map_rows(unique.select("id", "fp"), schema, keys)
    # Which keys are crowded decides only how the work is dealt out, so one row in ``rate`` tells.
    most_rows = 8 * BLOCK
    rate = max(1, most_rows // 512)
    some = map_rows(unique.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0).select("id", "fp"), schema, keys)
    counts = some.select(F.explode("keys").alias("key")).groupBy("key").agg((F.count("*") * rate).alias("n"))
    crowded = stored(counts.where(F.col("n") > most_rows).select("key", F.ceil(F.col("n") / most_rows).alias("blocks")), "crowded")
    return linked(keyed.select(F.explode("keys").alias("key"), "id", "fp"), crowded, words, start)


def verified(clusters: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """Links ``u, v`` that connect the sets (``node, tokens``) of each cluster (``node, root``) as all pairs with a similarity of ``alike`` in a hundred would.

    A large cluster is dealt out in pairs of blocks, by its sets and their tokens.
    """
    sizes = clusters.join(sets.select("node", F.size("tokens").alias("n")), "node").groupBy("root").agg(F.ceil(F.greatest(F.count("*") / SETS, F.sum("n") / TOKENS)).alias("blocks"))
    dealt = clusters.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    blocks = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node")
    return shingle_join.within(blocks, sets, alike)


def similar(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, words: int = 4, deals: int = 4, most: int = 56, alike: float = 0.8) -> DataFrame:
    """``id, hash, root`` of each row with words: its key, the XXH64 of its text, and what its group of near-copies has in common.

    Rows of equal shingle sets are alike; other links are found by deletion variants of
    fingerprints and hold only if the sets' exact similarity (Jaccard) is ``alike`` or
    more. Sets are told by a 64-bit digest. What candidates connect is a cluster; all
    sets of a cluster are compared with each other, in tasks of bounded size.
    """
    rows = pick(df, id=key, text=text).select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    rows = rows.where(F.col("text").rlike(HAS_WORDS))

    def sign():
        def apply(x: dict[str, list]) -> dict[str, list]:
            sets = [shingle_set(t, size) for t in x["text"]]
            return {"id": x["id"], "hash": x["hash"], "node": [set_digest(s) for s in sets], "fp": [set_fingerprint(s, words) for s in sets]}

        return apply

    signed = stored(map_rows(rows, "id bigint, hash bigint, node bigint, fp array<bigint>", sign), "signed")
    unique = stored(signed.groupBy("node").agg(F.first("fp").alias("fp")).select(F.col("node").alias("id"), "fp"), "unique")
    clusters = stored(components(candidates(unique, words, deals, most)), "clusters")
    # The sets of the rows in question are made again from their texts.
    asked = signed.join(clusters, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "hash")).alias("r")).select(F.col("r.id").alias("i"), F.col("r.hash").alias("h"))
    texts = rows.join(asked, rows["id"].eqNullSafe(asked["i"]) & (rows["hash"] == asked["h"]), "left_semi").select("text")

    def spell():
        def apply(x: dict[str, list]) -> dict[str, list]:
            sets = [shingle_set(t, size) for t in x["text"]]
            return {"node": [set_digest(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]}

        return apply

    # Repeated rows give their set more than once.
    sets = stored(map_rows(texts, "node bigint, tokens array<bigint>", spell).groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")
    roots = components(verified(clusters, sets, round(100 * alike)))
    return stored(signed.join(roots, "node", "left").select("id", "hash", F.coalesce("root", "node").alias("root")), "similar")


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each group of near-copies one row stays, that of the smallest id.

    Each row is judged by its id and text. Of rows repeated with both one stays. Where
    one id has several texts, each is judged by itself; if they are near-copies, the one
    of the smallest hash stays. Rows without an id are grouped like any other and give
    way to those with one. Rows without words aren't alike: only those repeated with
    their id go.
    """
    found = similar(df, text, key, **(STAGE | settings))
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash")
    keys = found.groupBy("root", "id", "hash").agg(F.count("*").alias("n")).withColumn("row", row)
    judged = keys.join(keys.groupBy("root").agg(F.min("row").alias("stays")), "root")
    gone = F.col("row") != F.col("stays")
    # A null id makes no difference to which row a struct is: structs are equal where both fields are null.
    judged = stored(judged.where(gone | (F.col("n") > 1)).select(F.col("id").alias("i"), F.col("hash").alias("h"), gone.alias("gone")), "judged")
    plain, at = numbered(df)
    rows = plain.withColumn("_id", F.col(at(key)).cast("long")).withColumn("_hash", F.xxhash64(at(text))).withColumn("_words", F.coalesce(F.col(at(text)).rlike(HAS_WORDS), F.lit(False)))
    same = F.col("_id").eqNullSafe(F.col("i")) & (F.col("_hash") == F.col("h"))
    single = rows.where("_words").join(judged, same, "left_anti")
    several = rows.where("_words").join(judged.where("not gone"), same, "left_semi").dropDuplicates(["_id", "_hash"])
    blank = rows.where("not _words")
    blank = blank.where("_id is null").unionAll(blank.where("_id is not null").dropDuplicates(["_id", at(text)]))
    return single.unionAll(several).unionAll(blank).select(*plain.columns).toDF(*df.columns)
