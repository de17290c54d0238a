"""N-gram Jaccard join by a token-group matrix: exact links between documents whose sets of word shingles are alike.

Similar documents are put into groups. A matrix of tokens and groups says which tokens
the members of a group have. A document is compared with a group's members only if
enough of its tokens are in the union of theirs; other groups stay shut. Two sets that
are alike share one of their first tokens in any common order, so only those are looked
up in the matrix, in the order of how rare they are in all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm.common import arrow_schema, pick, stored
from webgrain.llm.components import components
from webgrain.llm.terms import SPACED, gathered, words

#: Counters of tokens (a table of fixed size) that give the common order.
COUNTERS = 20
#: Groups are first looked for by so many keys, each of so many least hashes.
BANDS, LEAST = 4, 3
#: Rows (of two numbers) that are sent to all executors at most; more are shuffled with the texts.
FEW = 500_000
#: Members of a group at most, and documents that are compared with a group in one task.
MEMBERS, ASKING = 256, 2048


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words after which close ones are far apart."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles; fewer words are one shingle, none give the empty set."""
    row, word = words(texts, SPACED)
    known = word.dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in known.dictionary.to_pylist()), np.uint64, len(known.dictionary))
    h = each[known.indices.to_numpy()] if len(word) else np.zeros(0, np.uint64)
    ends = np.searchsorted(row, np.arange(len(texts)), "right")
    odd = np.uint64(0x9E3779B97F4A7C15)
    whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        whole = whole * odd + h[i : i + len(whole)]
    whole = mixed(whole + np.uint64(size))
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= size:
            out.append(np.unique(whole[start : end - size + 1]))
        elif end > start:
            value = np.zeros(1, np.uint64)
            for w in h[start:end]:
                value = value * odd + w
            out.append(mixed(value + np.uint64(end - start)))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def listed(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def digest(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).view(np.int64))


def needed(n: np.ndarray | int, alike: int) -> np.ndarray | int:
    """How many tokens of a set of ``n`` a set must share that is alike: a share of ``alike`` in a hundred, rounded up."""
    return (alike * n + 99) // 100


def signed(rows: DataFrame, size: int) -> DataFrame:
    """One pass over the rows ``id, hash, text``: a row ``id, hash, n, node, keys`` for each, and rows ``at, held`` that count tokens.

    The node is a digest of the row's set, null if that is empty; ``keys`` are equal for
    sets whose least hashes are equal. ``held`` says how often a task saw tokens with
    the ``COUNTERS`` leading bits ``at``.
    """
    text = "id bigint, hash bigint, n bigint, node bigint, keys array<bigint>, at int, held bigint"
    schema = arrow_schema(rows.sparkSession, text)

    def filled(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mixed(np.arange(1, BANDS * LEAST + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in gathered(batches, 2):
            sets = shingle_sets(batch.column(2), size)
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
            keys = []
            for s in sets:
                least = [int((s * seed).min()) for seed in seeds] if len(s) else []
                keys.append([int(np.uint64(xxhash.xxh64_intdigest(repr((b, least[b * LEAST : (b + 1) * LEAST])))).view(np.int64)) for b in range(BANDS)] if len(s) else [])
            n = np.array([len(s) for s in sets], np.int64)
            node = pa.array([digest(s) for s in sets], pa.int64(), mask=n == 0)
            yield filled(len(n), id=batch.column(0), hash=batch.column(1), n=pa.array(n), node=node, keys=pa.array(keys, pa.list_(pa.int64())))
        at = np.flatnonzero(total)
        for part in range(0, len(at), 50_000):
            some = at[part : part + 50_000]
            yield filled(len(some), at=pa.array(some), held=pa.array(total[some]))

    return rows.mapInArrow(run, text)


def token_counts(found: DataFrame) -> np.ndarray:
    """In how many rows tokens are, by the leading ``COUNTERS`` bits of their hash: a table of fixed size over all documents."""
    sums = found.where("at is not null").groupBy("at").agg(F.sum("held").alias("held")).toArrow()
    out = np.zeros(1 << COUNTERS, np.int64)
    out[sums["at"].to_numpy()] = sums["held"].to_numpy()
    return out


def rare_first(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The tokens from rare to frequent, ties by their value: one order for all sets."""
    return tokens[np.lexsort((tokens, counts[(tokens >> np.uint64(64 - COUNTERS)).astype(np.int64)]))]


def first_tokens(texts: DataFrame, size: int, alike: int, counts: np.ndarray) -> DataFrame:
    """``token, node`` of the tokens of each text of which a set that is alike shares one, in the common order."""
    schema = arrow_schema(texts.sparkSession, "token bigint, node bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 0):
            sets = shingle_sets(batch.column(0), size)
            first = [rare_first(s, counts)[: len(s) - needed(len(s), alike) + 1] for s in sets]
            node = np.repeat(np.array([digest(s) for s in sets], np.int64), [len(f) for f in first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)), pa.array(node)], schema=schema)

    return texts.mapInArrow(run, "token bigint, node bigint")


def sets_of(rows: DataFrame, known: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, tokens`` of the asked nodes, made again from the text of one row each."""
    schema = arrow_schema(rows.sparkSession, "node bigint, tokens array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 0):
            sets = shingle_sets(batch.column(0), size)
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), listed(sets).cast(schema.field(1).type)], schema=schema)

    # Written first: how large it is tells whether texts have to be shuffled to meet it.
    asked = stored(known.join(nodes, "node", "left_semi").select(F.col("id").alias("i"), F.col("hash").alias("h")), "asked-rows")
    if asked.count() <= FEW:
        asked = F.broadcast(asked)
    texts = rows.join(asked, rows["id"].eqNullSafe(asked["i"]) & (rows["hash"] == asked["h"]), "left_semi").select("text")
    # Repeated rows give their set more than once.
    return texts.mapInArrow(run, "node bigint, tokens array<bigint>").dropDuplicates(["node"])


class Group:
    """Some sets, side by side, and the union of their tokens."""

    def __init__(self, nodes: np.ndarray, sets: list[np.ndarray]):
        self.nodes, self.sizes = nodes, np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets)
        order = np.argsort(token, kind="stable")
        self.member = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, starts = np.unique(token[order], return_index=True)
        self.starts = np.append(starts, len(token))

    def links(self, tokens: np.ndarray, alike: int) -> np.ndarray:
        """The members that a set is alike to; none are looked at if the union holds too few of its tokens."""
        at = np.searchsorted(self.union, tokens)
        at = at[(at < len(self.union))]
        hit = at[self.union[at] == tokens[: len(at)]]
        if len(hit) < needed(len(tokens), alike):
            return self.nodes[:0]
        lengths = self.starts[hit + 1] - self.starts[hit]
        offset = np.repeat(self.starts[hit] - np.append(0, np.cumsum(lengths)[:-1]), lengths)
        both = np.bincount(self.member[offset + np.arange(lengths.sum())], minlength=len(self.nodes))
        return self.nodes[100 * both >= alike * (self.sizes + len(tokens) - both)]


def banded(known: DataFrame) -> DataFrame:
    """``group, node``: blocks of about ``MEMBERS`` sets with an equal key, the least one of the key in each of them; equal blocks are told once."""
    bands = known.select("node", F.explode("keys").alias("key"))
    keys = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / MEMBERS))
    each = bands.join(keys, "key").select("key", F.pmod(F.xxhash64("node", "key"), "blocks").alias("block"), "node")
    heads = keys.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("head").alias("node"))
    several = stored(each.union(heads).distinct(), "bands")
    # Blocks of the same members have the same mark, by count and by a sum of hashes.
    marks = several.groupBy("key", "block").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).cast("string").alias("sum")).where("n > 1")
    marks = marks.select("key", "block", F.xxhash64("n", "sum").alias("group"))
    return several.join(marks, ["key", "block"]).select("group", "node").distinct()


def within(blocks: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """Links ``u, v`` that connect the sets of each block (``group, node``) as all their links would."""
    arrow = arrow_schema(blocks.sparkSession, "u bigint, v bigint")

    def compare(own: pa.Table) -> pa.Table:
        nodes, sets = own["node"].to_numpy(), [s.values.to_numpy().view(np.uint64) for s in own["tokens"]]
        group, place = Group(np.arange(len(nodes)), sets), np.arange(len(nodes))
        for i, tokens in enumerate(sets):
            found = group.links(tokens, alike)
            joined = np.isin(place, place[np.append(found, i)])
            place[joined] = place[joined].min()
        linked = np.flatnonzero(place != np.arange(len(nodes)))
        return pa.table([pa.array(nodes[linked]), pa.array(nodes[place[linked]])], schema=arrow)

    return blocks.join(sets, "node").groupBy("group").applyInArrow(compare, "u bigint, v bigint")


def opened(asks: DataFrame, members: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """A link ``u, v`` of each asked pair (``node, group``) that has one, exact; ``members`` (``group, member``) says who is in a group.

    A group meets its questions in parts of at most about ``ASKING``, each in one task.
    """
    arrow = arrow_schema(asks.sparkSession, "u bigint, v bigint")
    parts = asks.groupBy("group").agg(F.ceil(F.count("*") / ASKING).alias("parts"))
    dealt = asks.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).select("group", "part", "node")
    each = members.join(parts, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("member").alias("node"))
    left = each.join(sets, "node").toDF("member", "group", "part", "own").select(*(F.col(a).alias(b) for a, b in (("group", "g"), ("part", "p"), ("member", "member"), ("own", "own"))))
    right = dealt.join(sets, "node")

    def compare(own: pa.Table, asking: pa.Table) -> pa.Table:
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if own.num_rows and asking.num_rows:
            spread = lambda column: [s.values.to_numpy().view(np.uint64) for s in column]
            group = Group(own["member"].to_numpy(), spread(own["own"]))
            for node, tokens in zip(asking["node"].to_numpy(), spread(asking["tokens"]), strict=True):
                # A group's members are of one family, so one link stands for all.
                v.append(group.links(tokens, alike)[:1])
                u.append(np.full(len(v[-1]), node))
        return pa.table([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], schema=arrow)

    return left.groupBy("g", "p").cogroup(right.groupBy("group", "part")).applyInArrow(compare, "u bigint, v bigint")


def enough(alike: int) -> str:
    """SQL that tells if ``c`` first tokens that a set of size ``n`` shares with a group of sizes from ``low`` to ``high`` can be enough.

    Common tokens that aren't first tokens of both lie behind the first tokens of one of
    the two, so they are fewer than what that one needs. With the size that the other
    one has, the rest must be among the ``c``. Rounding is allowed for by one.
    """
    a, h = f"greatest(low, n * {alike} div 100)", f"least(high, (n * 100 + {alike - 1}) div {alike})"
    both = lambda m: f"({alike} * (n + {m}) div {100 + alike})"
    share = lambda m: f"(({alike} * {m} + 99) div 100)"
    return f"{a} <= {h} and c >= least({both(a)} - {share('n')}, {both(h)} - {share(h)})"


def alike_sets(rows: DataFrame, known: DataFrame, counts: np.ndarray, size: int, alike: int) -> DataFrame:
    """``node, root`` of sets linked with others, over rows ``id, hash, text``; ``known`` has a row ``id, hash, node, n, keys`` for each set, ``counts`` say how rare tokens are.

    First, sets of equal keys are compared in blocks, which puts most families together.
    What is linked then forms the groups of the matrix, in blocks of
    about ``MEMBERS``; sets and groups of one family need no further comparison, all
    others that share one of their first tokens get one. So no link between families is lost.
    """
    blocks = stored(banded(known), "blocks")
    near = sets_of(rows, known, blocks.select("node").distinct(), size)
    first = stored(within(blocks, stored(near, "sets"), alike), "links")
    family = stored(components(first), "families")

    # Equal texts give their tokens more than once, which changes nothing. Most tokens are of one set alone.
    of_token = Window.partitionBy("token")
    shared = first_tokens(rows.select("text"), size, alike, counts).withColumn("least", F.min("node").over(of_token)).withColumn("most", F.max("node").over(of_token)).where("least <> most").select("token", "node").distinct()
    shared = stored(shared, "shared-tokens").join(family, "node", "left").select("token", "node", F.coalesce("root", "node").alias("family"))
    # A token of one family alone asks for nothing.
    tokens = shared.withColumn("least", F.min("family").over(of_token)).withColumn("most", F.max("family").over(of_token)).where("least <> most").select("token", "node", "family")
    big = stored(family.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    block = tokens.join(big, F.col("family") == F.col("root"), "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / MEMBERS)).join(known.select("node", "n"), "node")
    block = block.select("token", "node", "n", "family", F.coalesce("size", F.lit(1)).alias("size"), F.xxhash64("family", F.pmod(F.xxhash64("node"), "blocks")).alias("group"))
    block = stored(block, "tokens")
    matrix = block.groupBy("token", F.col("group").alias("meets")).agg(F.first("family").alias("of"), F.first("size").alias("among"))
    sizes = block.groupBy(F.col("group").alias("meets")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    # Of two families the smaller one asks.
    asked = block.join(matrix, "token").where("struct(size, family) < struct(among, of)").groupBy("node", "n", "meets").agg(F.count("*").alias("c"))
    asked = stored(asked.join(sizes, "meets").where(enough(alike)).select("node", F.col("meets").alias("group")), "asked")
    members = stored(block.select("group", F.col("node").alias("member")).distinct().join(asked.select("group").distinct(), "group", "left_semi"), "members")
    wanted = asked.select("node").union(members.select("member")).distinct()
    last = opened(asked, members, stored(sets_of(rows, known, wanted, size), "sets"), alike)
    return components(first.union(last))


def rooted(rows: DataFrame, size: int, alike: int) -> DataFrame:
    """``id, hash, n, root`` of each of the rows ``id, hash, text``: how many shingles it has, and what it has in common with all rows that links lead to (null without words)."""
    full = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    signs = stored(signed(rows, size), "signed")
    found = signs.where("at is null")
    unique = found.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "hash")).alias("r"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    unique = stored(unique.select("node", "r.id", "r.hash", "n", "keys"), "nodes")
    roots = alike_sets(full, unique, token_counts(signs), size, alike)
    return found.join(roots, "node", "left").select("id", "hash", "n", F.coalesce("root", "node").alias("root"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, alike: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: the number of its distinct shingles and the smallest id that links lead to, its own included.

    Two rows are linked where the sets of their ``size``-word shingles have a Jaccard
    similarity of ``alike`` in a hundred or more. Equal sets are one node, told by a
    64-bit digest of their 64-bit hashes. Rows without words have no shingles and are
    linked with nothing, so their component is their own id. Rows repeated come back as
    often. A null id names no component unless all its rows have none; links lead through
    such rows like any other.
    """
    rows = pick(docs, id=key, text=text).select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    joined = rooted(rows, size, alike)
    least = joined.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return joined.join(least, "root", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
