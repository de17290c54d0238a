"""Relevance: term statistics, BM25, sections and their selection, categories, topic words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.batches import by_pieces
from webgrain.functions import fixed
from webgrain.functions.text import terms


def counted(df: DataFrame, key: str, words: Column, most: int | None = None) -> DataFrame:
    """``key, word, n`` of each row's distinct words, the ``most`` frequent ones (ties by word) with their ``rank``.

    Each piece of an Arrow batch is counted by itself, so nothing is shuffled, a long
    text costs no more than its length, and memory doesn't grow with the batch.
    """
    rows = df.select(F.col(key).alias("key"), words.alias("words"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, word string, n bigint, rank int"

    def run(batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = batch.column("words")
        each = pa.table({"row": pc.list_parent_indices(lists), "word": pc.list_flatten(lists)}).group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")])
        each = each.sort_by([("row", "ascending"), ("count_all", "descending"), ("word", "ascending")])
        row = each.column("row").to_numpy()
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row)))) + 1
        out = pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), each.column("word").combine_chunks(), each.column("count_all").combine_chunks().cast(pa.int64()), pa.array(rank, pa.int32())], names=["key", "word", "n", "rank"])
        return out if most is None else out.filter(pa.array(rank <= most))

    return by_pieces(rows, schema, run).withColumnRenamed("key", key)


def term_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf`` of every document, counted without a shuffle."""
    return counted(df, key, terms(F.col(text))).select(key, F.col("word").alias("term"), F.col("n").alias("tf"))


def document_frequencies(df: DataFrame, text: str) -> DataFrame:
    """``term, df`` over the corpus; counted per task before the shuffle."""
    return df.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(df: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``key, score`` of every document for a query; documents without a hit score zero.

    One pass reads the corpus for its size, its average length and the frequency of each
    query term; a second scores each document in its own row. Both stay in the JVM and
    neither shuffles documents.
    """
    spark = df.sparkSession
    asked = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(query))))).collect()]
    docs = df.select(key, terms(F.col(text)).alias("terms"))
    if not asked:
        return docs.select(key, F.lit(0.0).alias("score"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"), *(F.count_if(F.array_contains("terms", q)).alias(f"df{i}") for i, q in enumerate(asked))).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for i, q in enumerate(asked):
        if stats[f"df{i}"]:
            idf = F.log(F.lit(1.0 + (n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
            tf = (F.size("terms") - F.size(F.array_remove("terms", q))).cast("double")
            score = score + F.when(tf == 0, 0.0).otherwise(idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.size("terms") / F.lit(avgdl))))
    return docs.select(key, F.greatest(score, F.lit(0.0)).alias("score"))


def top_ranked(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The ``k`` best rows, ties to the smaller key; each task keeps its own best before they meet."""
    return scored.orderBy(F.col("score").desc(), F.col(key)).limit(k)


#: A title behind number signs, a line under a title, and what may end a line besides its line feed.
_ATX = re.compile(r"#{1,6}[ \t]+([^\n\r\x85\u2028\u2029]+?)(?:[ \t]+#+)?[ \t]*[\r\x85\u2028\u2029]?\Z")
_UNDER = re.compile(r"[ \t]*[=-]{2,}[ \t]*[\r\x85\u2028\u2029]?\Z")
_RULE, _ITEM = re.compile(r"[-=]+[\r\x85\u2028\u2029]?\Z"), re.compile(r"[-*+][ \t]")
_MAY_HEAD = re.compile(r"^(?:#|[ \t]*[=-]{2})", re.MULTILINE)


def _headings(text: str) -> Iterator[tuple[int, str]]:
    """Start and title of each heading, as ``split_sections`` says."""
    if not _MAY_HEAD.search(text):
        return
    at, lines = 0, text.split("\n")
    for i, line in enumerate(lines):
        if found := _ATX.match(line):
            yield at, found[1].strip(" ")
        elif i + 1 < len(lines) and _UNDER.match(lines[i + 1]):
            plain = line.strip(" \t")
            if plain and not _RULE.match(plain) and not _ITEM.match(line):
                yield at, plain
        at += len(line) + 1


def split_sections(df: DataFrame, key: str, markdown: str) -> DataFrame:
    """``key, idx, anchor, text, offset`` of each section of a Markdown text.

    A heading is a line of one to six number signs and a title, or a title line above a
    line of two or more equal signs or dashes (unless the title is blank, a rule or a
    list item). Text before the first heading is ``(intro)`` unless blank; without any
    heading all is; blank texts have no section. Offsets are in code points. Each text's
    lines are read once; texts stay where they are.
    """
    rows = df.where(F.col(markdown).rlike(r"[^\s]")).select(key, F.col(markdown).alias("md"))

    @F.pandas_udf("array<struct<start:int,anchor:string>>")
    def headings(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(_headings(t)))

    marks = headings("md")
    marked = rows.select(key, "md", marks.alias("marks"))
    first = F.coalesce(F.get(F.col("marks"), 0)["start"], F.length("md"))
    intro = F.struct(F.lit(0).alias("start"), F.lit("(intro)").alias("anchor"))
    has_intro = F.left(F.col("md"), first).rlike(r"[^\s]")
    marked = marked.select(key, "md", F.when(has_intro, F.concat(F.array(intro), F.col("marks"))).otherwise(F.col("marks")).alias("marks"))
    each = marked.select(key, "md", "marks", F.posexplode("marks").alias("idx", "mark"))
    end = F.coalesce(F.get(F.col("marks"), F.col("idx") + 1)["start"], F.length("md"))
    return each.select(key, "idx", F.col("mark.anchor").alias("anchor"), F.substring(F.col("md"), F.col("mark.start") + 1, end - F.col("mark.start")).alias("text"), F.col("mark.start").alias("offset"))


def select_sections(sections: DataFrame, query: str, most: int, key: str = "doc_id") -> DataFrame:
    """The sections that answer a query within ``most`` characters: ``key, markdown, total, selected, anchors``.

    Sections are scored by BM25 within their document. The best go first (ties by
    place); the one that no longer fits is cut to what is left and is the last. The
    chosen ones are joined in their old order. Documents without a hit are left out.
    """
    asked = [r[0] for r in sections.sparkSession.range(1).select(F.explode(F.array_distinct(terms(F.lit(query))))).collect()]
    doc = Window.partitionBy(key)
    rows = sections.withColumn("terms", terms(F.col("text")))
    size = F.size("terms").cast("double")
    avgdl = F.avg(size).over(doc)
    score = F.lit(0.0)
    for q in asked:
        tf = (F.size("terms") - F.size(F.array_remove("terms", q))).cast("double")
        n, df = F.count("*").over(doc), F.count_if(F.array_contains("terms", q)).over(doc)
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.when(tf == 0, 0.0).otherwise(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / F.when(avgdl == 0, 1.0).otherwise(avgdl))))
    scored = rows.withColumn("score", score).withColumn("total", F.count("*").over(doc))
    by_score = doc.orderBy(F.col("score").desc(), F.col("idx"))
    before = F.coalesce(F.sum(F.length("text")).over(by_score.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = scored.withColumn("before", before).where((F.col("score") > 0) & (F.col("before") < most) & (F.col("total") > 1))
    cut = F.trim(F.regexp_replace(F.substring(F.col("text"), F.lit(1), F.lit(most) - F.col("before")), r"^\s+|\s+$", ""))
    picked = kept.select(key, "idx", "anchor", "total", cut.alias("text"))
    together = picked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "text", "anchor"))).alias("s"), F.first("total").alias("total"))
    return together.select(key, F.array_join(F.col("s.text"), "\n\n").alias("markdown"), "total", F.size("s").alias("selected"), F.col("s.anchor").alias("anchors"))


def category(text: Column) -> Column:
    """The research category with most distinct keywords in the text; ties to the earlier one, none is ``general``.

    One pass over the text finds all keywords.
    """
    @F.pandas_udf("string")
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(_category)

    # Lower case is the JVM's, so that it is that of the other expressions.
    return best(F.lower(F.coalesce(text, F.lit(""))))


def _inside(c: str) -> bool:
    """Whether a character is part of a word, as Java's Unicode word boundary has it."""
    return c.isalpha() or c == "_" or unicodedata.category(c) in ("Nd", "Nl", "Mn", "Mc", "Me", "Pc") or c in "\u200c\u200d" or "\u24b6" <= c <= "\u24e9"


@cache
def _keywords():
    """An automaton of all keywords, made once a worker; each ends with its number, its length and the categories it is of."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for i, words in enumerate(fixed.CATEGORIES.values()):
        for w in words:
            of.setdefault(w, []).append(i)
    found = ahocorasick.Automaton()
    for number, (w, places) in enumerate(of.items()):
        found.add_word(w, (number, len(w), places))
    found.make_automaton()
    return found, list(fixed.CATEGORIES)


def _category(text: str) -> str:
    automaton, names = _keywords()
    seen, hits = set(), [0] * len(names)
    for end, (number, length, places) in automaton.iter(text):
        # Boundaries are looked at where a keyword ends in the text, and no more once it is known to be there.
        if number not in seen and (end + 1 == len(text) or not _inside(text[end + 1])) and (end + 1 == length or not _inside(text[end - length])):
            seen.add(number)
            for i in places:
                hits[i] += 1
    most = max(hits)
    return names[hits.index(most)] if most else "general"


def topic_words(df: DataFrame, key: str, text: str, most: int = 40) -> DataFrame:
    """``key, word, tf, rank``: the most frequent words of each page, ties by word; counted without a shuffle."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(*fixed.CRAWL_STOPWORDS))
    return counted(df, key, words, most).select(key, "word", F.col("n").alias("tf"), "rank")


def term_hits(text: Column, words: list[str]) -> Column:
    """How many of a text's tokens are among the words."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.size(F.filter(tokens, lambda t: t.isin(*words)))


def anchor_context(text: Column, anchor: Column, around: int = 50, most: int = 8) -> Column:
    """The most frequent words around the first place of an anchor in a text; empty if it isn't there."""
    lower, needle = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.trim(F.coalesce(anchor, F.lit(""))))
    at = F.position(needle, lower)
    start = F.greatest(at - around, F.lit(1))
    part = F.substring(lower, start, at + F.length(needle) + around - start)
    words = F.filter(F.regexp_extract_all(part, F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(*fixed.CRAWL_STOPWORDS))
    counted = F.transform(F.array_distinct(words), lambda w: F.struct((-(F.size(words) - F.size(F.array_remove(words, w)))).alias("n"), w.alias("w")))
    best = F.transform(F.slice(F.array_sort(counted), 1, most), lambda s: s["w"])
    return F.when((needle != "") & (at > 0), best).otherwise(F.array().cast("array<string>"))


def running_document_frequency(fetched: DataFrame, term: str = "term", order: str = "seq", least: int = 3, block: int = 65_536) -> DataFrame:
    """``order, term, df, n, idf`` as of each fetch: documents so far with the term; idf is flat until ``least`` documents.

    ``fetched`` has one row for each distinct term of each fetched page, within one crawl.
    Rows are counted by blocks of ``block`` numbers, and what earlier blocks hold is
    added, so that no task gets all rows of a frequent term.
    """
    rows = fetched.select(F.col(order).alias("_o"), F.col(term).alias("_t"), F.floor(F.col(order) / block).alias("_b"))
    earlier = Window.partitionBy("_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_t", "_b").agg(F.count("*").alias("c"))
    before = counts.select(F.col("_t").alias("_u"), F.col("_b").alias("_k"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("_t", "_b").orderBy("_o"))
    counted = rows.withColumn("inside", inside).join(before, F.col("_t").eqNullSafe(F.col("_u")) & F.col("_b").eqNullSafe(F.col("_k")))
    df = (F.col("before") + F.col("inside")).cast("long")
    n = F.col("_o") + 1
    return counted.select(F.col("_o").alias(order), F.col("_t").alias(term), df.alias("df"), n.alias("n"), F.when(n < least, 1.0).otherwise(F.log(1 + (n - df + 0.5) / (df + 0.5))).alias("idf"))
