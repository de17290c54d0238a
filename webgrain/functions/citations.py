"""Bibliographic records and how they are written: BibTeX, CSL-JSON, and approximate APA and MLA.

A record is a struct column of ``title, authors array<string>, year, month, day, doi,
url, venue, publisher, abstract, kind``, all strings and nullable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def date_parts(published: Column) -> Column:
    """``year, month, day`` as text from an ISO date or a part of one, or the year alone found in it; nulls where missing."""
    iso = r"^\s*(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?"
    part = lambda i: _text(F.regexp_extract(F.coalesce(published, F.lit("")), iso, i))
    return F.struct(part(1).alias("year"), part(2).alias("month"), part(3).alias("day"))


def author_list(authors: Column, is_text: bool) -> Column:
    """Authors as an array without empty ones; a text is split at semicolons, or at commas without them."""
    if is_text:
        semi = authors.contains(";")
        authors = F.when(semi, F.split(authors, ";")).otherwise(F.split(authors, ","))
    return F.coalesce(F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != ""), F.array().cast("array<string>"))


def family_given(author: Column) -> Column:
    """``family`` and ``given``: around the comma, else the last word and those before it."""
    comma = author.contains(",")
    words = F.split(author, " ")
    n = F.size(words)
    family = F.when(comma, F.trim(F.substring_index(author, ",", 1))).otherwise(F.element_at(words, -1))
    given = F.when(comma, F.trim(F.regexp_replace(author, "^[^,]*,", ""))).when(n > 1, F.array_join(F.slice(words, F.lit(1), n - 1), " ")).otherwise("")
    return F.struct(family.alias("family"), given.alias("given"))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([{}&_#])", r"\\$1")


def citation_key(r: Column) -> Column:
    """Eight letters or digits of the first author's last word, lower case, and the year."""
    first = F.coalesce(F.get(r["authors"], 0), F.lit(""))
    word = F.regexp_extract(F.substring_index(first, ",", -1), r"(\S+)\s*$", 1)
    name = F.lower(F.left(F.regexp_replace(word, "[^A-Za-z0-9]", ""), F.lit(8)))
    return F.concat(F.when(name == "", "unknown").otherwise(name), F.coalesce(_text(r["year"]), F.lit("0000")))


def bibtex(r: Column) -> Column:
    """One BibTeX entry. Author names are escaped once each and once more joined, as readers of these entries expect."""
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"  {name}="), value, F.lit(",")))
    entry = F.when(F.coalesce(r["kind"], F.lit("")).contains("proceed"), "inproceedings").otherwise("article")
    authors = F.when(F.size(r["authors"]) > 0, _escaped(F.array_join(F.transform(r["authors"], _escaped), " and ")))
    lines = F.filter(
        F.array(
            F.concat(F.lit("@"), entry, F.lit("{"), citation_key(r), F.lit(",")),
            field("author", authors),
            field("title", _escaped(_text(r["title"]))),
            F.when(_text(r["venue"]).isNotNull(), field("journal", _escaped(_text(r["venue"])))).otherwise(field("publisher", _escaped(_text(r["publisher"])))),
            field("year", _text(r["year"])),
            field("doi", _escaped(_text(r["doi"]))),
            field("url", _escaped(_text(r["url"]))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n}"))


def csl(r: Column, position: Column) -> Column:
    """One CSL-JSON item; ``position`` counts from 1 in the bibliography."""
    given = lambda a: _text(family_given(a)["given"])
    authors = F.transform(r["authors"], lambda a: F.struct(family_given(a)["family"].alias("family"), given(a).alias("given")))
    number = lambda c: c.try_cast("int")
    parts = F.filter(F.array(number(r["year"]), number(r["month"]), F.when(number(r["month"]).isNotNull(), number(r["day"]))), lambda x: x.isNotNull())
    return F.to_json(
        F.struct(
            F.coalesce(r["kind"], F.lit("article-journal")).alias("type"),
            position.cast("long").alias("ID"),
            F.coalesce(r["title"], F.lit("")).alias("title"),
            _text(r["doi"]).alias("DOI"),
            _text(r["url"]).alias("URL"),
            F.when(F.size(r["authors"]) > 0, authors).alias("author"),
            F.when(_text(r["venue"]).isNotNull(), F.array(_text(r["venue"]))).alias("container-title"),
            _text(r["publisher"]).alias("publisher"),
            F.when(number(r["year"]).isNotNull(), F.struct(F.array(parts).alias("date-parts"))).alias("issued"),
            _text(F.regexp_replace(r["abstract"], r"\s+", " ")).alias("abstract"),
        )
    )


def _link(r: Column, resolver: str) -> Column:
    return F.when(_text(r["doi"]).isNotNull(), F.concat(F.lit(f" {resolver}"), _text(r["doi"]))).when(_text(r["url"]).isNotNull(), F.concat(F.lit(" "), _text(r["url"]))).otherwise("")


def apa(r: Column) -> Column:
    """Family names and initials, year, title, venue, link."""

    def one(a: Column) -> Column:
        n = family_given(a)
        initials = F.array_join(F.transform(F.filter(F.split(n["given"], r"\s+"), lambda w: w != ""), lambda w: F.concat(F.left(w, F.lit(1)), F.lit("."))), " ")
        return F.when(initials == "", n["family"]).otherwise(F.concat(n["family"], F.lit(", "), initials))

    year = F.coalesce(F.concat(F.lit("("), _text(r["year"]), F.lit(")")), F.lit(""))
    venue = F.coalesce(F.concat(F.lit("*"), _text(r["venue"]), F.lit("*")), F.lit(""))
    return F.trim(F.concat(F.array_join(F.transform(r["authors"], one), ", "), F.lit(" "), year, F.lit(". "), F.coalesce(r["title"], F.lit("")), F.lit(". "), venue, _link(r, "https://doi.org/")))


def mla(r: Column) -> Column:
    """Authors, quoted title, venue, year, link."""
    authors = F.regexp_replace(F.array_join(r["authors"], ", "), r"\.+$", "")
    title = F.coalesce(F.concat(F.lit('"'), _text(r["title"]), F.lit('"')), F.lit(""))
    venue = F.coalesce(F.concat(F.lit("*"), _text(r["venue"]), F.lit("*")), F.lit(""))
    return F.trim(F.concat(authors, F.lit(". "), title, F.lit(". "), venue, F.lit(", "), F.coalesce(r["year"], F.lit("")), F.lit("."), _link(r, "doi.org/")))
