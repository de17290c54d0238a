"""Text expressions: terms, windows, gates, identifiers, token budgets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions import fixed
from webgrain.functions.urls import let

CJK = "[぀-ヿ一-鿿가-힯]+"


def terms(text: Column) -> Column:
    """Terms for ranking: lower-case runs of ASCII letters and digits longer than one and no stopwords, then bigrams of CJK runs."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    plain = F.filter(F.regexp_extract_all(lower, F.lit("([a-z0-9]+)"), 1), lambda t: (F.length(t) > 1) & ~t.isin(*fixed.STOPWORDS))
    runs = F.regexp_extract_all(lower, F.lit(f"({CJK})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(plain, pairs)


def windows(text: Column, size: int = 900, overlap: int = 120, most: int | None = None) -> Column:
    """Overlapping windows as structs of ``start`` and ``chunk``; the first that reaches the end is the last. Empty text: none."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    step = max(1, size - overlap)
    n = F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
    if most is not None:
        count = F.least(count, F.lit(most))
    starts = F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), lambda i: i * step)
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, (s + 1).cast("int"), F.lit(size)).alias("chunk")))
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<start:bigint,chunk:string>>"))


def densest_excerpt(text: Column, words: list[str], window: int = 300, step: int = 100) -> Column:
    """The first window with most hits of the words, with marks where it is cut; null if there is no hit."""
    n = F.length(text)
    pattern = "(?<![a-z0-9])(" + "|".join(sorted(w.lower() for w in words)) + ")(?![a-z0-9])"
    # Windows are put together from pieces, as a substring is looked for from the text's beginning on.
    size = math.gcd(window, step)
    cut_up = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))

    def hits(piece: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.size(piece) - 1, F.lit(0)), F.lit(step // size))
        part = lambda i: F.lower(F.array_join(F.slice(piece, i + 1, F.lit(window // size)), ""))
        return F.array_max(F.transform(numbers, lambda i: F.struct(F.regexp_count(part(i), F.lit(pattern)).alias("hits"), (-i * size).alias("at"))))

    return let(let(cut_up, hits), lambda best: _excerpt(text, n, best, window))


def _excerpt(text: Column, n: Column, best: Column, window: int) -> Column:
    at = -best["at"]
    cut = F.substring(text, at + 1, F.lit(window))
    marked = F.concat(F.when(at > 0, "…").otherwise(""), cut, F.when(at + window < n, "…").otherwise(""))
    return F.when((n > 0) & (best["hits"] > 0), marked)


def looks_like_text(text: Column, window: int = 2000, share: float = 0.02) -> Column:
    """Whether the text isn't blank and its head, middle and tail hold few control, format-free or unassigned characters."""
    n = F.length(text)
    half = F.floor(n / 2)
    middle = F.greatest(half - window // 2, F.lit(0)).cast("int")
    bad = r"[^\p{Cc}\p{Cn}\p{Co}\p{Cs}]|[\n\r\t]"

    def few(part: Column) -> Column:
        return (F.length(part) == 0) | (F.length(F.regexp_replace(part, bad, "")) / F.length(part) < share)

    parts = (F.left(text, F.lit(window)), F.substring(text, middle + 1, (F.least(half + window // 2, n) - middle).cast("int")), F.right(text, F.lit(window)))
    out = F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0
    for p in parts:
        out = out & few(p)
    return F.coalesce(out, F.lit(False))


def text_links(text: Column, most: int = 50) -> Column:
    """Distinct links written in a text, in order: closing punctuation goes, ``www.`` gets http."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""((?:https?://|www\.)[^\s<>"')\]}，。…]+)"""), 1)
    clean = F.transform(found, lambda u: F.regexp_replace(u, r"""[.,;:!?…"']+$""", ""))
    return F.slice(F.array_distinct(F.transform(clean, lambda u: F.when(u.startswith("www."), F.concat(F.lit("http://"), u)).otherwise(u))), 1, most)


def untrusted(text: Column) -> Column:
    """Without control and format characters (but line ends and tabs), in normal form KC."""

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: None if v is None else v if v.isascii() else unicodedata.normalize("NFKC", v))

    return compose(F.regexp_replace(text, r"[\p{C}&&[^\n\r\t]]", ""))


def wrapped(text: Column, source: Column) -> Column:
    """An envelope that marks text from outside."""
    return F.concat(F.lit('<untrusted-web-content source="'), source, F.lit(f'">\n{fixed.UNTRUSTED_DIRECTIVE}\n'), text, F.lit("\n</untrusted-web-content>"))


def redacted(text: Column, spans: Column) -> Column:
    """Spans (structs of start, end, score) replaced by a mark with the score; overlapping ones after the first are passed over."""
    n = F.length(text)
    clipped = F.transform(spans, lambda s: F.struct(F.greatest(s["start"], F.lit(0)).alias("start"), F.least(s["end"], n).alias("end"), s["score"].alias("score")))
    ordered = F.array_sort(F.filter(clipped, lambda s: s["start"] < s["end"]))
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.concat(F.lit(fixed.REDACTION), F.format_string("%.2f", s["score"]), F.lit("]"))
        taken = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(acc)

    return F.aggregate(ordered, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, n)))


def normal_doi(text: Column) -> Column:
    """The bare lower-case DOI of a bare one, a ``doi:`` value or a resolver URL; null for anything else."""
    t = F.trim(F.coalesce(text, F.lit("")))
    resolver = r"(?i)^https?://(dx\.|www\.)?doi\.org/+"
    bare = F.when(F.lower(t).startswith("doi:"), F.trim(F.substr(t, F.lit(5)))).when(t.rlike(resolver) & ~t.rlike("[?#]"), F.try_url_decode(F.replace(F.regexp_replace(t, resolver, ""), F.lit("+"), F.lit("%2B")))).otherwise(t)
    return F.when(bare.rlike(r"(?i)^10\.\d{4,9}/\S+$"), F.lower(bare))


def find_doi(text: Column) -> Column:
    """The first DOI in a text without closing punctuation; null if there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"""(?i)(10\.\d{4,9}/[^\s"'<>\]}\)]+)""", 1)
    return F.when(found != "", F.regexp_replace(found, "[.,;:]+$", ""))


def normal_arxiv(text: Column) -> Column:
    """The bare lower-case arXiv id: address, prefix, ``.pdf`` and version go; null if nothing is left."""
    bare = F.regexp_replace(F.trim(F.coalesce(F.try_url_decode(text), text, F.lit(""))), r"(?i)^(https?://arxiv\.org/(abs|pdf)/|arxiv:)", "")
    last = F.regexp_replace(F.substring_index(bare, "/", -1), r"(?i)\.pdf$", "")
    clean = F.lower(F.trim(F.regexp_replace(last, r"(?i)v\d+$", "")))
    return F.when(clean != "", clean)


def safe_name(base: Column, ending: Column | None = None) -> Column:
    """A file name: runs of other characters become a dash, the ends are trimmed, 80 characters at most, ``asset`` if nothing is left."""
    slug = F.left(F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", ""), F.lit(80))
    slug = F.when(slug == "", "asset").otherwise(slug)
    return slug if ending is None else F.when(F.coalesce(ending, F.lit("")) == "", slug).otherwise(F.concat(slug, F.lit("."), ending))


def human_size(size: Column) -> Column:
    """A number of bytes with one decimal, rounded half to even, and a unit of 1024."""
    out = None
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        # Divisions by powers of two are exact, and so is the decimal that is rounded.
        exact = (size.cast("double") / F.lit(float(1024**k))).cast("decimal(38,18)")
        value = F.concat(F.format_string("%.1f", F.bround(exact, 1).cast("double")), F.lit(f" {unit}"))
        last = F.lit(True) if unit == "TB" else size < 1024 ** (k + 1)
        out = F.when(last, value) if out is None else out.when(last, value)
    return out


def image_ending(content_type: Column) -> Column:
    """The file ending that an image's content type names; null for other types."""
    base = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    sub = F.regexp_extract(base, "^image/(.+)$", 1)
    return F.when(base == "image/svg+xml", "svg").when(sub != "", sub)


def page_range(spec: Column, total: Column) -> Column:
    """Struct of ``first`` and ``last`` of ``N``, ``N-M``, ``N-``, ``-M`` or an empty spec, within ``total``; null for anything else."""
    s = F.trim(F.coalesce(spec, F.lit("")))
    a, b = (F.regexp_extract(s, r"^(\d*)\s*-\s*(\d*)$", i) for i in (1, 2))
    single = s.rlike(r"^\d+$")
    first = F.when(single, s.try_cast("long")).when(a == "", F.lit(1).cast("long")).otherwise(a.try_cast("long"))
    last = F.when(single, s.try_cast("long")).when(b == "", total.cast("long")).otherwise(b.try_cast("long"))
    whole = s.isin("", "-")
    ok = whole | ((single | s.rlike(r"^(\d+\s*-\s*\d*|-\s*\d+)$")) & (first >= 1) & (last >= first) & (first <= total))
    return F.when(ok, F.struct(F.when(whole, F.lit(1).cast("long")).otherwise(first).alias("first"), F.least(F.when(whole, total.cast("long")).otherwise(last), total.cast("long")).alias("last")))


def token_count(text: Column) -> Column:
    """Tokens without a vocabulary: a quarter of the characters, at least one; an empty or null text has none."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def bpe_count(text: Column, vocabulary: str) -> Column:
    """Tokens of a text by a vocabulary file of the tokenizers library, without special tokens added; null texts have none."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        for texts in batches:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)], dtype="int32")

    return count(text)


def truncate_tokens(text: Column, limit: int, ellipsis: str = fixed.TOKEN_ELLIPSIS) -> Column:
    """The text if it has at most ``limit`` tokens, else its head with the ellipsis, four characters a token."""
    return F.when(token_count(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(max(0, 4 * limit - len(ellipsis)))), F.lit(ellipsis)))


def truncate_twice(text: Column, tokens: int, chars: int, mark: str = fixed.TRUNCATED) -> Column:
    """First to a number of tokens, then to a number of characters with a mark."""
    once = truncate_tokens(text, tokens)
    return F.when(F.length(once) > chars, F.concat(F.left(once, F.lit(chars)), F.lit(mark))).otherwise(once)


def budget_split(chars: Column, ratio: float) -> Column:
    return F.floor(chars * F.lit(1.0 - ratio)).cast("long")


def download_kind(head: Column, size: Column, content_type: Column, least: int = 1024) -> Column:
    """What a body that should be a PDF is, by size and first bytes: ``ok``, ``too_small``, ``bot_wall``, ``unexpected_content`` or ``invalid_file``."""
    sample = F.lower(F.decode(head, "ISO-8859-1"))
    html = F.lower(F.coalesce(content_type, F.lit(""))).contains("html") | sample.rlike(r"^\s*<html")
    wall = sample.rlike("|".join(fixed.BOT_MARKERS))
    return F.when(size < least, "too_small").when(sample.startswith("%pdf-"), "ok").when(html & wall, "bot_wall").when(html, "unexpected_content").otherwise("invalid_file")


def content_range(header: Column) -> Column:
    """Struct of ``first``, ``last`` and ``total`` of a partial answer's header; what it leaves open is null."""
    pattern = r"(?i)^\s*bytes\s+(?:(\d+)-(\d+)|\*)/(\d+|\*)\s*$"
    part = lambda i: F.regexp_extract(header, pattern, i).try_cast("long")
    return F.struct(part(1).alias("first"), part(2).alias("last"), part(3).alias("total"))


def retry(status: Column, retry_after: Column, longest: float = 60.0) -> Column:
    """``retry``, ``give up`` (told to wait too long) or ``no``; a null status is a transport error."""
    again = status.isNull() | status.isin(408, 425, 429) | status.between(500, 599)
    return F.when(again & (F.coalesce(retry_after, F.lit(0.0)) > longest), "give up").when(again, "retry").otherwise("no")
