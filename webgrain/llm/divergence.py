"""Source divergence audit: how differently the sources of a language use its terms.

Occurrences are sorted by language, term, source and document, and one scan over the
runs gives document frequencies and counts. Each task first sorts and scans what it
reads; the partial runs are dealt out and sorted again, and scanned once by source and
once by term. What pairs of sources and single terms add is then told run by run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm.common import arrow_schema, pick, stored
from webgrain.llm.terms import WORDS, gathered, words

#: Documents of a language that a kept term is in at least, and the scale of the shares.
DOCS, SCALE_STEPS = 3, 3
#: Shares (terms times sources) that are compared at a time.
CELLS = 500_000
RUNS = "lang string, term string, source string, docs bigint, n bigint"
TERM = "lang string, term string, sources array<string>, counts array<bigint>"
OUT = "part string, lang string, source string, item string, value bigint"


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new))


def partial_runs(docs: DataFrame) -> DataFrame:
    """``lang, term, source, docs, n`` of the runs of each part of the documents that a task reads."""
    schema = arrow_schema(docs.sparkSession, RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 2):
            batch = batch.sort_by([("lang", "ascending"), ("source", "ascending")])
            lang, source = (batch.column(c).dictionary_encode().indices.to_numpy().astype(np.int64) for c in (0, 1))
            # Documents lie by language and source, so a document's place stands for both.
            row, term = words(batch.column(2), WORDS)
            known = term.dictionary_encode()
            code = known.indices.to_numpy().astype(np.int64)
            key = (lang[row] * len(known.dictionary) + code) * len(batch) + row
            key, n = np.unique(key, return_counts=True)
            doc, code = key % max(1, len(batch)), key // max(1, len(batch))
            starts = changes(code, source[doc])
            if len(starts):
                first = pa.array(doc[starts])
                docs_in = np.diff(np.append(starts, len(key)))
                term = known.dictionary.take(pa.array(code[starts] % len(known.dictionary)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(first), term, batch.column(1).take(first), pa.array(docs_in), pa.array(np.add.reduceat(n, starts))], schema=schema)

    return docs.mapInArrow(run, RUNS)


def run_starts(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in range(columns)]
    return changes(*codes)


def whole_runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches cut so that no run of the first columns lies in two, with the places where runs begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = run_starts(batch, columns)
        goes_on = held and all(held[-1].column(c)[-1].equals(batch.column(c)[0]) for c in range(columns))
        if goes_on and len(starts) == 1:
            held.append(batch)
            continue
        cut = int(starts[1]) if goes_on else 0
        last = int(starts[-1])
        head = [*held, batch.slice(0, cut)] if goes_on else held
        if head:
            whole = pa.concat_batches(head)
            yield whole, run_starts(whole, columns)
        if last > cut:
            whole = batch.slice(cut, last - cut)
            yield whole, run_starts(whole, columns)
        held = [batch.slice(last)]
    if held:
        whole = pa.concat_batches(held)
        yield whole, run_starts(whole, columns)


def merged_runs(runs: DataFrame) -> DataFrame:
    """The runs of equal language, term and source put together by one scan in their order."""
    schema = arrow_schema(runs.sparkSession, RUNS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums are taken batch by batch, and a run that goes on is carried as its sums alone.
        for whole, starts in whole_runs(summed(batches), 3):
            yield of(whole, starts)

    def of(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        first = pa.array(starts)
        sums = [pa.array(np.add.reduceat(batch.column(c).to_numpy(), starts)) for c in (3, 4)]
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in range(3)), *sums], schema=schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield of(batch, run_starts(batch, 3))

    order = ("lang", "term", "source")
    return runs.repartition(*order).sortWithinPartitions(*order).mapInArrow(scan, RUNS)


def kept_terms(runs: DataFrame) -> DataFrame:
    """``lang, term, sources, counts`` of each term in at least ``DOCS`` documents of its language, by one scan of its runs."""
    schema = arrow_schema(runs.sparkSession, TERM)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_runs(batches, 2):
            ends = np.append(starts[1:], batch.num_rows)
            keep = np.flatnonzero(np.add.reduceat(batch.column(3).to_numpy(), starts) >= DOCS)
            rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(starts[keep], ends[keep], strict=True))]).astype(np.int64)
            offsets = pa.array(np.append(0, np.cumsum(ends[keep] - starts[keep])), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c).take(pa.array(rows))) for c in (2, 4)]
            first = pa.array(starts[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), batch.column(1).take(first), *(x.cast(f.type) for x, f in zip(lists, list(schema)[2:], strict=True))], schema=schema)

    return runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(scan, TERM)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), exact in longs by long division in three steps of a thousand."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(SCALE_STEPS):
        step, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + step
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def parts_of(counts: np.ndarray, seen: np.ndarray, n: np.ndarray, kept: int) -> tuple[Iterator[tuple[str, int, np.ndarray]], np.ndarray, np.ndarray]:
    """What some terms (rows) of a language add, by source (columns): partial pairs beyond those of absent terms, the sources' and the language's shares."""
    p = share(counts, n + kept)
    q = share(counts.sum(1), n.sum() + kept)
    absent = share(np.zeros(len(n), np.int64), n + kept)

    def pairs() -> Iterator[tuple[str, int, np.ndarray]]:
        for a in range(len(n)):
            here = seen[:, a]
            if not here.any():
                continue
            rest, own = p[here], p[here, a][:, None]
            yield "from", a, (apart(own, rest) - apart(absent[a], absent)).sum(0)
            # Terms that both have are told where the other source comes first.
            yield "to", a, np.where(seen[here], 0, apart(rest, own) - apart(absent, absent[a])).sum(0)

    return pairs(), p, q


def partial_parts(terms: DataFrame) -> DataFrame:
    """``part, lang, source, item, value``: partial pairs and terms of each batch of kept terms joined with their language's ``all_sources, totals, kept``."""
    schema = arrow_schema(terms.sparkSession, OUT)

    def out(part: str, lang: str, source: pa.Array, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.repeat(part, n), pa.repeat(lang, n), source, item, pa.array(value, pa.int64())], schema=schema)

    def of(lang: str, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, n, kept = batch.column(4)[0].values, batch.column(5)[0].values.to_numpy(), batch.column(6)[0].as_py()
        step = max(1, CELLS // len(names))
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            row = pc.list_parent_indices(some.column(2)).to_numpy()
            column = pc.index_in(some.column(2).flatten(), value_set=names).to_numpy()
            counts, seen = np.zeros((some.num_rows, len(names)), np.int64), np.zeros((some.num_rows, len(names)), bool)
            counts[row, column], seen[row, column] = some.column(3).flatten().to_numpy(), True
            pairs, p, q = parts_of(counts, seen, n, kept)
            for way, a, value in pairs:
                other = np.flatnonzero((np.arange(len(names)) != a) & (value != 0))
                one, many = pa.repeat(names[a], len(other)), names.take(pa.array(other))
                yield out("pair", lang, *((one, many) if way == "from" else (many, one)), value[other])
            t, s = np.nonzero(seen & (p > q[:, None]))
            yield out("term", lang, names.take(pa.array(s)), some.column(1).take(pa.array(t)), apart(p[t, s], q[t]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)):
                yield from of(lang.as_py(), batch.filter(pc.equal(batch.column(0), lang)))

    return terms.mapInArrow(run, OUT)


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group of documents of one language and source.

    Part ``pair`` tells each other source of the language by how far the group's shares
    of the kept terms are from that source's; part ``term`` the ``top`` terms that the
    group uses more than its language. Nulls are the empty string, each row is a
    document, rows repeated are several documents. A group without terms is compared
    like any other; a language without kept terms has pairs of value 0 and no terms. An
    empty table gives no rows. Counts may reach 9 * 10**15 and values are exact.

    What is held of a language is one entry a source; its pairs, which are returned
    anyway, are the square of that.
    """
    rows = pick(docs, lang=lang, source=source, text=text)
    rows = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = stored(kept_terms(merged_runs(partial_runs(rows))), "kept-terms")
    counts = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("docs")).join(counts, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = stored(groups, "groups")
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    each = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g")).join(kept, "lang", "left")
    header = stored(each.select("lang", F.col("g.source").alias("all_sources"), F.col("g.n").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept")), "languages")
    partial = stored(partial_parts(terms.join(header, "lang").select("lang", "term", "sources", "counts", "all_sources", "totals", "kept")), "partial-parts")
    # Terms that neither of two sources has all add the same.
    absent = F.when(F.col("kept") == 0, 1).otherwise(F.expr("1 + 1000000000 div (n + kept)"))
    other = F.when(F.col("kept") == 0, 1).otherwise(F.expr("1 + 1000000000 div (o.totals + kept)"))
    pairs = groups.join(header, "lang").withColumn("o", F.explode(F.arrays_zip("all_sources", "totals"))).where("source <> o.all_sources")
    pairs = pairs.withColumn("p", absent).withColumn("q", other)
    base = pairs.select("lang", "source", F.col("o.all_sources").alias("item"), F.expr("kept * ((p - q) * (p - q) div q)").alias("value"))
    summed = partial.where("part = 'pair'").select("lang", "source", "item", "value").union(base).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    words_used = partial.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.union(words_used)
