"""Captured responses of research providers as records of one shape.

A provider is a declaration: where the hits are, and for each field the paths to try.
Bodies are parsed once, in the JVM; a body that isn't valid gives one row with ``error``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE = ("id", "title", "url", "doi", "published", "authors", "snippet")


@dataclass(frozen=True)
class Provider:
    """``hits``: path of the array of hits (``$`` if the body is the array or the only hit); ``core``: for each core field the paths
    to try in order, or an expression of the hit; ``fields``: further fields."""

    hits: str
    core: dict[str, tuple[str, ...] | Callable[[Column], Column]]
    fields: dict[str, tuple[str, ...] | Callable[[Column], Column]] = field(default_factory=dict)
    single: str = "$"
    unlimited: bool = False


def at(hit: Column, *paths: str) -> Column:
    """The first value along the paths that isn't missing or empty, as text."""
    return F.coalesce(*(F.nullif(F.try_variant_get(hit, p, "string"), F.lit("")) for p in paths))


def names(hit: Column, path: str, *inner: str) -> Column:
    """Names of a list of people joined by commas; without one they are left out."""
    items = F.coalesce(F.try_variant_get(hit, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.array_join(F.filter(F.transform(items, lambda a: at(a, *inner) if inner else F.try_variant_get(a, "$", "string")), lambda n: n.isNotNull() & (n != "")), ", ")


def listed(hit: Column, path: str, sep: str = ", ") -> Column:
    return F.array_join(F.filter(F.coalesce(F.try_variant_get(hit, path, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull()), sep)


def plain(text: Column, most: int = 240) -> Column:
    """Without tags, white space collapsed, cut."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\s+", " ")), F.lit(most))


def said(hit: Column, *paths: str) -> Column:
    """As ``at``, for sentences: nothing is the empty text."""
    return F.coalesce(at(hit, *paths), F.lit(""))


def _text(path: str, *more: str) -> Callable[[Column], Column]:
    return lambda h: plain(at(h, path, *more))


def _tagged(prefix: str) -> Callable[[Column], Column]:
    return lambda h: F.array_join(F.transform(F.filter(F.coalesce(F.try_variant_get(h, "$.tags", "array<string>"), F.array().cast("array<string>")), lambda t: t.startswith(prefix)), lambda t: F.substr(t, F.lit(len(prefix) + 1))), ",")


def _pick(values: str, where: str, equals: str, value: str) -> Callable[[Column], Column]:
    """The value of the first entry of a list whose key has a value."""
    return lambda h: at(F.get(F.filter(F.coalesce(F.try_variant_get(h, values, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.lower(F.try_variant_get(x, where, "string")) == equals), 0), value)


_CVSS = ("$.metrics.cvssMetricV31[0]", "$.metrics.cvssMetricV30[0]", "$.metrics.cvssMetricV2[0]")

PROVIDERS: dict[str, Provider] = {
    "openalex": Provider("$.results", {"id": ("$.id",), "title": ("$.title", "$.display_name"), "url": ("$.doi", "$.id"), "doi": ("$.doi",), "published": ("$.publication_date",), "authors": lambda h: names(h, "$.authorships", "$.author.display_name")}, {"citations": ("$.cited_by_count",)}),
    "semanticscholar": Provider("$.data", {"id": ("$.paperId",), "title": ("$.title",), "url": ("$.url",), "doi": ("$.externalIds.DOI",), "published": ("$.publicationDate", "$.year"), "authors": lambda h: names(h, "$.authors", "$.name"), "snippet": _text("$.abstract")}, {"citations": ("$.citationCount",), "year": ("$.year",), "venue": ("$.venue",), "reference_count": ("$.referenceCount",), "open_access_pdf": ("$.openAccessPdf.url",), "fields_of_study": lambda h: listed(h, "$.fieldsOfStudy"), "publication_types": lambda h: listed(h, "$.publicationTypes")}),
    "huggingface": Provider("$", {"id": ("$.id",), "title": ("$.id",), "url": lambda h: F.concat(F.lit("https://huggingface.co/"), at(h, "$.id")), "published": ("$.lastModified",), "authors": ("$.author",)}, {"likes": ("$.likes",), "downloads": ("$.downloads",), "citations": ("$.downloads",), "pipeline_tag": ("$.pipeline_tag",), "library_name": ("$.library_name",), "sha": ("$.sha",), "tags": lambda h: listed(h, "$.tags", ","), "arxiv_ids": _tagged("arxiv:"), "datasets": _tagged("dataset:"), "license": _tagged("license:")}),
    "huggingface-papers": Provider("$", {"id": ("$.paper.id", "$.id"), "title": ("$.paper.title", "$.title"), "url": lambda h: F.concat(F.lit("https://huggingface.co/papers/"), at(h, "$.paper.id", "$.id")), "published": ("$.paper.publishedAt", "$.publishedAt"), "authors": lambda h: F.coalesce(F.nullif(names(h, "$.paper.authors", "$.name"), F.lit("")), names(h, "$.authors", "$.name")), "snippet": _text("$.paper.summary", "$.summary")}, {"citations": ("$.paper.upvotes", "$.upvotes"), "upvotes": ("$.paper.upvotes", "$.upvotes"), "arxiv_id": ("$.paper.id", "$.id")}),
    "open-meteo": Provider("$.results", {"id": lambda h: F.concat_ws(",", at(h, "$.latitude"), at(h, "$.longitude")), "title": ("$.name",), "snippet": lambda h: F.concat_ws(", ", at(h, "$.name"), at(h, "$.country"))}),
    "crossref": Provider("$.message.items", {"id": ("$.DOI",), "title": ("$.title[0]",), "url": ("$.URL",), "doi": ("$.DOI",), "published": lambda h: F.array_join(F.try_variant_get(h, "$.published['date-parts'][0]", "array<string>"), "-"), "authors": lambda h: names(h, "$.author", "$.family", "$.name"), "snippet": _text("$.abstract")}, single="$.message"),
    "github": Provider("$.items", {"id": ("$.full_name", "$.id"), "title": ("$.full_name",), "url": ("$.html_url", "$.url"), "snippet": _text("$.description")}, {"language": ("$.language",), "stars": ("$.stargazers_count",)}),
    "openlibrary": Provider("$.docs", {"id": ("$.key",), "title": ("$.title",), "url": lambda h: F.concat(F.lit("https://openlibrary.org"), at(h, "$.key")), "published": ("$.first_publish_year", "$.first_publish_date", "$.publish_date"), "authors": lambda h: names(h, "$.author_name")}, {"isbn": lambda h: F.left(listed(h, "$.isbn"), F.lit(120))}),
    "doaj": Provider("$.results", {"id": ("$.id",), "title": ("$.bibjson.title",), "doi": _pick("$.bibjson.identifier", "$.type", "doi", "$.id"), "url": ("$.bibjson.link[0].url",), "published": ("$.bibjson.year",), "authors": lambda h: names(h, "$.bibjson.author", "$.name"), "snippet": _text("$.bibjson.abstract")}),
    "pubmed": Provider("$.esearchresult.idlist", {"id": ("$",), "title": lambda h: F.concat(F.lit("PMID "), at(h, "$")), "url": lambda h: F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), at(h, "$"), F.lit("/"))}),
    "nasa": Provider("$.near_earth_objects.*", {"id": ("$.neo_reference_id", "$.id"), "title": ("$.object_name", "$.name"), "url": ("$.nasa_jpl_url",), "published": ("$.close_approach_data[0].close_approach_date",), "snippet": lambda h: F.concat(F.lit("~"), said(h, "$.estimated_diameter.meters.estimated_diameter_max", "$.estimated_diameter.estimated_diameter_max"), F.lit(" m diameter; "), said(h, "$.close_approach_data[0].closest_approach_distance.kilometers"), F.lit(" km closest"))}, {"is_hazardous": ("$.is_potentially_hazardous_asteroid", "$.is_hazardous"), "absolute_magnitude": ("$.absolute_magnitude_h", "$.absolute_magnitude"), "diameter": ("$.estimated_diameter.meters.estimated_diameter_max",)}),
    "nvd": Provider("$.vulnerabilities", {"id": ("$.cve.id",), "title": ("$.cve.id",), "url": lambda h: F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), at(h, "$.cve.id")), "published": lambda h: F.left(at(h, "$.cve.published"), F.lit(10)), "snippet": lambda h: plain(_pick("$.cve.descriptions", "$.lang", "en", "$.value")(h))}, {"severity": tuple(f"$.cve.{m[2:]}.cvssData.baseSeverity" for m in _CVSS) + (f"$.cve.{_CVSS[2][2:]}.baseSeverity",), "base_score": tuple(f"$.cve.{m[2:]}.cvssData.baseScore" for m in _CVSS), "vector": tuple(f"$.cve.{m[2:]}.cvssData.vectorString" for m in _CVSS)}),
    "zenodo": Provider("$.hits.hits", {"id": ("$.id",), "title": ("$.metadata.title",), "url": ("$.links.self_html", "$.links.html"), "doi": ("$.doi", "$.metadata.doi"), "published": ("$.metadata.publication_date",), "authors": lambda h: names(h, "$.metadata.creators", "$.name", "$.person_or_org.name"), "snippet": _text("$.metadata.description")}, {"resource_type": ("$.metadata.resource_type.title.en", "$.metadata.resource_type.title", "$.metadata.resource_type.id")}),
    "softwareheritage": Provider("$", {"id": ("$.url", "$.id"), "title": ("$.url", "$.name"), "url": ("$.url", "$.origin_visits_url"), "published": ("$.date",), "snippet": _text("$.description")}, {"visit_types": lambda h: listed(h, "$.visit_types"), "type": ("$.type",)}),
    "congress": Provider("$.results", {"id": ("$.cgi_id",), "title": ("$.display_name",), "url": ("$.url",), "snippet": lambda h: F.concat(F.coalesce(at(h, "$.title"), F.lit("")), F.lit(" "), F.coalesce(at(h, "$.party"), F.lit("")), F.lit(" — "), F.coalesce(at(h, "$.state"), F.lit("")), F.lit(" "), F.coalesce(at(h, "$.district"), F.lit("")))}, {"chamber": ("$.chamber",), "party": ("$.party",), "state": ("$.state",)}),
    "yahoo": Provider("$.quotes", {"id": ("$.symbol",), "title": ("$.shortname", "$.longName", "$.shortName", "$.symbol"), "url": lambda h: F.concat(F.lit("https://finance.yahoo.com/quote/"), said(h, "$.symbol")), "snippet": lambda h: F.when(at(h, "$.regularMarketPrice", "$.fullExchangeName").isNotNull(), F.concat(said(h, "$.regularMarketPrice"), F.lit(" "), said(h, "$.currency"), F.lit(" ("), said(h, "$.fullExchangeName"), F.lit(")"))).otherwise(F.concat(said(h, "$.shortname", "$.shortName", "$.symbol"), F.lit(" — "), said(h, "$.exchange"), F.lit(" "), said(h, "$.quoteType")))}, {"exchange": ("$.exchange", "$.fullExchangeName"), "quote_type": ("$.quoteType",), "market_cap": ("$.marketCap",), "currency": ("$.currency",), "previous_close": ("$.previousClose",)}, single="$.chart.result[0].meta"),
    "overpass": Provider("$.elements", {"id": ("$.id",), "title": lambda h: F.coalesce(at(h, "$.tags.name"), F.concat_ws(":", at(h, "$.type"), at(h, "$.id"))), "url": lambda h: F.concat(F.lit("https://www.openstreetmap.org/"), at(h, "$.type"), F.lit("/"), at(h, "$.id")), "snippet": lambda h: F.array_join(F.transform(F.slice(F.map_entries(F.coalesce(F.try_variant_get(h, "$.tags", "map<string,string>"), F.create_map().cast("map<string,string>"))), 1, 6), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")}, {"type": ("$.type",), "lat": ("$.lat",), "lon": ("$.lon",)}),
    "courtlistener": Provider("$.results", {"id": ("$.cluster_id",), "title": ("$.caseName", "$.caseNameFull"), "url": lambda h: F.concat(F.lit("https://www.courtlistener.com"), at(h, "$.absolute_url")), "published": ("$.dateFiled",), "snippet": _text("$.caseNameFull", "$.caseName")}),
    "federalregister": Provider("$.results|$.documents", {"id": ("$.document_number",), "title": ("$.title",), "url": ("$.html_url", "$.text_url"), "published": ("$.publication_date", "$.doc_date"), "snippet": _text("$.abstract", "$.excerpt")}, {"document_type": ("$.document_type", "$.type"), "agency": ("$.agency.name", "$.agencies[0].name")}),
    "biorxiv": Provider("$.collection", {"id": ("$.doi",), "title": ("$.title",), "url": lambda h: F.concat(F.lit("https://doi.org/"), at(h, "$.doi")), "doi": ("$.doi",), "published": ("$.date",), "authors": ("$.authors",), "snippet": _text("$.abstract")}, {"server": ("$.server",)}),
    "chemrxiv": Provider("$.data", {"id": ("$.id",), "title": ("$.title",), "url": lambda h: F.coalesce(at(h, "$.url"), F.concat(F.lit("https://chemrxiv.org/engage/chemrxiv/article-details/"), at(h, "$.id"))), "doi": ("$.doi",), "published": ("$.published_on",), "authors": lambda h: names(h, "$.authors", "$.name"), "snippet": _text("$.abstract")}, {"topics": lambda h: names(h, "$.topics", "$.name")}),
    "alphavantage": Provider("$.bestMatches", {"id": ("$['1. symbol']",), "title": ("$['2. name']", "$['1. symbol']"), "snippet": lambda h: F.concat(said(h, "$['2. name']"), F.lit(" — "), said(h, "$['3. type']"), F.lit(" "), said(h, "$['4. region']"))}, {"ticker": ("$['1. symbol']",), "instrument_type": ("$['3. type']",), "currency": ("$['8. currency']",), "match_score": ("$['9. matchScore']",)}),
    "oldp": Provider("$.results", {"id": ("$.slug", "$.id"), "title": lambda h: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", at(h, "$.court.name", "$.court"), at(h, "$.file_number"))), F.lit("")), at(h, "$.slug", "$.title")), "url": lambda h: F.concat(F.lit("https://de.openlegaldata.io/case/"), at(h, "$.slug")), "published": ("$.date",)}, {"court": ("$.court.name",), "file_number": ("$.file_number",), "ecli": ("$.ecli",), "decision_type": ("$.type", "$.decision_type"), "book": ("$.book",), "section": ("$.section",)}),
    "hudoc": Provider("$.results", {"id": ("$.columns.itemid",), "title": ("$.columns.docname",), "url": lambda h: F.concat(F.lit("https://hudoc.echr.coe.int/eng?i="), at(h, "$.columns.itemid")), "published": lambda h: F.left(at(h, "$.columns.kpdate"), F.lit(10))}, {"appno": ("$.columns.appno",), "ecli": ("$.columns.ecli",)}, unlimited=True),
    "govinfo": Provider("$.results", {"id": ("$.granuleId", "$.packageId"), "title": ("$.title",), "url": ("$.download.txtLink", "$.download.pdfLink"), "published": ("$.dateIssued",)}, {"collection": ("$.collectionCode",), "package_id": ("$.packageId",), "granule_id": ("$.granuleId",)}),
    "coingecko": Provider("$.coins", {"id": ("$.id",), "title": ("$.name",), "url": lambda h: F.concat(F.lit("https://www.coingecko.com/en/coins/"), at(h, "$.id"))}, {"symbol": lambda h: F.upper(at(h, "$.symbol")), "market_cap_rank": ("$.market_cap_rank",), "price": ("$.current_price",)}),
    "patentsview": Provider("$.patents", {"id": ("$.patent_number", "$.id"), "title": ("$.patent_title", "$.title"), "url": lambda h: F.concat(F.lit("https://patents.google.com/patent/US"), at(h, "$.patent_number", "$.id")), "published": lambda h: F.left(at(h, "$.patent_date", "$.date"), F.lit(10))}, {"assignee": ("$.assignee_organization", "$.assignee", "$.assignees[0].assignee_organization")}),
    "lens": Provider("$.data", {"id": ("$.lens_id",), "title": lambda h: F.coalesce(at(h, "$.biblio.invention_title[0].text", "$.title"), F.concat_ws(" ", at(h, "$.jurisdiction"), at(h, "$.doc_number"), at(h, "$.kind"))), "url": lambda h: F.concat(F.lit("https://www.lens.org/"), at(h, "$.lens_id")), "published": ("$.date_published",), "authors": lambda h: names(h, "$.biblio.parties.inventors", "$.extracted_name.value", "$.name"), "snippet": _text("$.abstract[0].text", "$.abstract")}, {"jurisdiction": ("$.jurisdiction",), "doc_number": ("$.doc_number",), "kind": ("$.kind",), "doc_key": ("$.doc_key",), "lens_id": ("$.lens_id",), "applicants": lambda h: names(h, "$.biblio.parties.applicants", "$.extracted_name.value", "$.name"), "legal_status": ("$.legal_status.patent_status",)}),
    "worldbank": Provider("$[1]", {"id": ("$.indicator.id",), "title": ("$.indicator.value",), "published": ("$.date",)}, {"value": ("$.value",), "country": ("$.country.value",)}),
    "fred": Provider("$.observations", {"id": ("$.date",), "published": ("$.date",)}, {"value": ("$.value",)}),
    # Search engines.
    "google": Provider("$.items", {"title": ("$.title",), "url": ("$.link",), "snippet": ("$.snippet",)}),
    "bing": Provider("$.webPages.value", {"title": ("$.name",), "url": ("$.url",), "snippet": ("$.snippet",)}),
    "exa": Provider("$.results", {"title": ("$.title",), "url": ("$.url",), "snippet": ("$.text", "$.summary")}),
    "duckduckgo": Provider("$", {"title": ("$.title",), "url": ("$.href", "$.url"), "snippet": ("$.body", "$.snippet")}),
    "ecfr": Provider("$.children", {"id": ("$.identifier",), "title": ("$.label",), "snippet": _text("$.label_description")}, {"type": ("$.type",)}),
}


def records(responses: DataFrame, provider: str, most: int = 20, body: str = "body", kind: str = "search") -> DataFrame:
    """``source, pos, id, title, url, doi, published, authors, snippet, fields, raw, error`` of captured bodies.

    Keeps the columns of ``responses`` but the body. ``kind`` is ``search`` (hits of an
    array, the first ``most``; a negative number leaves so many out at the end) or
    ``fetch`` (one record). Missing and empty values are null.
    """
    p = PROVIDERS[provider]
    keep = [c for c in responses.columns if c != body]
    rows = responses.withColumn("_v", F.try_parse_json(F.col(body)))
    if kind == "fetch":
        hits = F.array(F.try_variant_get("_v", p.single, "variant"))
    elif p.hits.endswith(".*"):
        hits = F.flatten(F.map_values(F.try_variant_get("_v", p.hits[:-2], "map<string,array<variant>>")))
    else:
        own = F.coalesce(*(F.try_variant_get("_v", path, "array<variant>") for path in p.hits.split("|")))
        hits = F.coalesce(own, F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.array(F.col("_v")))) if p.hits == "$" else own
    n = F.size("_hits")
    count = n if p.unlimited or kind == "fetch" else F.least(n, F.lit(most)) if most >= 0 else F.greatest(n + most, F.lit(0))
    rows = rows.select(*keep, F.col("_v").isNull().alias("_bad"), F.coalesce(hits, F.array().cast("array<variant>")).alias("_hits"))
    each = rows.select(*keep, "_bad", F.posexplode_outer(F.slice("_hits", F.lit(1), count)).alias("pos", "_h"))
    value = lambda spec: spec(F.col("_h")) if callable(spec) else at(F.col("_h"), *spec)
    core = [F.nullif(value(p.core[c]), F.lit("")).alias(c) if c in p.core else F.lit(None).cast("string").alias(c) for c in CORE]
    more = F.create_map(*(x for name, spec in p.fields.items() for x in (F.lit(name), value(spec)))) if p.fields else F.create_map().cast("map<string,string>")
    out = each.where("_h is not null or _bad").select(*keep, F.lit(provider).alias("source"), "pos", *core, F.map_filter(more, lambda k, v: v.isNotNull()).alias("fields"), F.to_json("_h").alias("raw"), F.when(F.col("_bad"), "invalid body").alias("error"))
    return out


def cells(responses: DataFrame, body: str = "body", most: int = 50) -> DataFrame:
    """Cells of a JSON-stat cube, the first ``most`` of them by index: ``index, value, coords`` (dimension to category code). The linear index is taken apart by the strides of later dimensions."""
    keep = [c for c in responses.columns if c != body]
    v = responses.withColumn("_v", F.try_parse_json(F.col(body)))
    rows = v.select(*keep, F.try_variant_get("_v", "$.id", "array<string>").alias("_ids"), F.try_variant_get("_v", "$.size", "array<bigint>").alias("_size"), F.try_variant_get("_v", "$.value", "map<string,double>").alias("_values"), F.try_variant_get("_v", "$.dimension", "map<string,variant>").alias("_dim"))
    entries = F.filter(F.transform(F.map_entries("_values"), lambda e: F.struct(e["key"].try_cast("long").alias("index"), e["value"].alias("value"))), lambda e: e["index"].isNotNull())
    # At least one cell is kept.
    each = rows.select("*", F.explode(F.slice(F.array_sort(entries), 1, max(most, 1))).alias("_e")).select("*", "_e.index", "_e.value")

    def coordinate(d: Column, i: Column) -> Column:
        stride = F.aggregate(F.slice("_size", i + 2, F.size("_size")), F.lit(1).cast("long"), lambda a, x: a * x)
        place = F.pmod(F.floor(F.col("index") / stride), F.get(F.col("_size"), i))
        entries = F.map_entries(F.try_variant_get(F.element_at("_dim", d), "$.category.index", "map<string,bigint>"))
        return F.struct(d.alias("key"), F.get(F.filter(entries, lambda e: e["value"] == place), 0)["key"].alias("value"))

    coords = F.map_from_entries(F.transform("_ids", coordinate))
    return each.select(*keep, "index", "value", coords.alias("coords"))


def census(responses: DataFrame, body: str = "body") -> DataFrame:
    """Rows of a table whose first row is the header: ``pos, row`` as a map."""
    keep = [c for c in responses.columns if c != body]
    rows = responses.select(*keep, F.from_json(body, "array<array<string>>").alias("_t"))
    each = rows.select(*keep, F.get("_t", 0).alias("_head"), F.posexplode(F.slice("_t", F.lit(2), F.size("_t"))).alias("pos", "_r"))
    return each.select(*keep, "pos", F.map_from_arrays("_head", "_r").alias("row"))


def rates(responses: DataFrame, body: str = "body") -> DataFrame:
    """Exchange rates: ``date, base, quote, rate`` of a body with a map of quotes."""
    keep = [c for c in responses.columns if c != body]
    rows = responses.select(*keep, F.from_json(body, "date string, base string, rates map<string,double>, quotes map<string,double>").alias("_b"))
    return rows.select(*keep, F.col("_b.date").alias("date"), F.col("_b.base").alias("base"), F.explode(F.coalesce("_b.rates", "_b.quotes")).alias("quote", "rate")).where(F.col("quote").rlike("^[A-Z]{3}$"))


def csv_series(responses: DataFrame, body: str = "body") -> DataFrame:
    """Observations ``pos, date, value`` of a two-column CSV; a dot is a missing value."""
    keep = [c for c in responses.columns if c != body]
    lines = F.filter(F.split(F.trim(body), r"\r?\n"), lambda x: x != "")
    each = responses.select(*keep, F.posexplode(F.slice(lines, F.lit(2), F.size(lines))).alias("pos", "_l"))
    return each.select(*keep, "pos", F.split_part("_l", F.lit(","), F.lit(1)).alias("date"), F.split_part("_l", F.lit(","), F.lit(2)).try_cast("double").alias("value"))


def atom_entries(responses: DataFrame, body: str = "body", most: int = 20) -> DataFrame:
    """Entries of an Atom answer of a preprint server: ``pos, id, title, url, doi, published, authors, category, snippet``. At least one row is kept."""
    keep = [c for c in responses.columns if c != body]
    bare = F.regexp_replace(F.col(body), r"(</?)[A-Za-z0-9]+:|\sxmlns(:\w+)?=\"[^\"]*\"", "$1")
    each = responses.select(*keep, F.posexplode(F.regexp_extract_all(bare, F.lit(r"(?s)(<entry\b.*?</entry>)"), F.lit(1))).alias("pos", "_e")).where(F.col("pos") < max(most, 1))
    one = lambda path: F.nullif(F.trim(F.regexp_replace(F.xpath_string("_e", F.lit(path)), r"\s+", " ")), F.lit(""))
    link = F.coalesce(one("/entry/doi/text()"), F.regexp_replace(one("/entry/link[@title='doi']/@href"), r"^https?://(dx\.)?doi\.org/", ""))
    return each.select(*keep, "pos", F.regexp_replace(F.regexp_replace(one("/entry/id/text()"), r"^https?://arxiv\.org/abs/", ""), r"v\d+$", "").alias("id"), one("/entry/title/text()").alias("title"), one("/entry/id/text()").alias("url"), link.alias("doi"), one("/entry/published/text()").alias("published"), F.array_join(F.xpath("_e", F.lit("/entry/author/name/text()")), ", ").alias("authors"), F.coalesce(one("/entry/primary_category/@term"), one("/entry/category/@term")).alias("category"), F.left(one("/entry/summary/text()"), F.lit(240)).alias("snippet"))


def xml_records(responses: DataFrame, element: str, paths: dict[str, str], body: str = "body") -> DataFrame:
    """``pos`` and a column for each path of every element of a name, whatever its namespace (patent offices, PubMed, SDMX)."""
    keep = [c for c in responses.columns if c != body]
    bare = F.regexp_replace(F.regexp_replace(F.col(body), r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"(</?)[A-Za-z0-9]+:", "$1")
    each = responses.select(*keep, F.posexplode(F.regexp_extract_all(bare, F.lit(rf"(?s)(<{element}\b(?:[^>]*/>|.*?</{element}>))"), F.lit(1))).alias("pos", "_e"))
    return each.select(*keep, "pos", *(F.array_join(F.xpath("_e", F.lit(path)), ", ").alias(name) for name, path in paths.items()))


# Paths of XML answers by provider.
XML = {
    "epo": ("exchange-document", {"publication_number": "//publication-reference/document-id/doc-number/text()", "kind": "//publication-reference/document-id/kind/text()", "date": "//publication-reference/document-id/date/text()", "title": "//invention-title/text()", "applicants": "//applicant/applicant-name/name/text()"}),
    "kipris": ("item", {"application_number": "//applicationNumber/text()", "title": "//inventionTitle/text()", "applicant": "//applicantName/text()", "status": "//registerStatus/text()", "published": "//publicationDate/text()"}),
    "pubmed": ("PubmedArticle", {"id": "//MedlineCitation/PMID/text()", "title": "//ArticleTitle/text()", "family": "//AuthorList/Author/LastName/text()", "given": "//AuthorList/Author/ForeName/text()"}),
    "bundesbank": ("Obs", {"date": "//ObsDimension/@value | //TimeDimension/@value", "value": "//ObsValue/@value"}),
    "bis": ("Obs", {"date": "@TIME_PERIOD | /Obs/@TIME_PERIOD", "value": "@OBS_VALUE | /Obs/@OBS_VALUE"}),
}


def notes(responses: DataFrame, query: Column, body: str = "body") -> DataFrame:
    """``title, snippet`` of answers of a stock service that hold a note instead of matches; without a note the query is the title."""
    v = responses.withColumn("_v", F.try_parse_json(F.col(body))).where(F.coalesce(F.size(F.try_variant_get("_v", "$.bestMatches", "array<variant>")), F.lit(0)) <= 0)
    note = said(F.col("_v"), "$.Note", "$.Information", "$.notes", "$.information")
    return v.select(*(c for c in responses.columns if c != body), F.coalesce(F.nullif(note, F.lit("")), query).alias("title"), note.alias("snippet"))


def latest_day(responses: DataFrame, symbol: Column, body: str = "body") -> DataFrame:
    """The first day of a daily series: ``id, title, date, open, high, low, close, volume, snippet``; none where the answer has no series."""
    v = responses.withColumn("_v", F.try_parse_json(F.col(body)))
    days = F.map_entries(F.try_variant_get("_v", "$['Time Series (Daily)']", "map<string,variant>"))
    # Services list the newest day first; a parsed object is sorted by key.
    rows = v.withColumn("_d", F.element_at(F.array_sort(F.transform(days, lambda e: F.struct(e["key"].alias("date"), F.to_json(e["value"]).alias("day")))), -1)).where("_d is not null")
    rows = rows.withColumn("_o", F.parse_json("_d.day"))
    name = lambda n: F.coalesce(at(F.col("_v"), f"$['Meta Data']['{n}']"), symbol)
    day = {c: said(F.col("_o"), f"$['{i}. {c}']") for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)}
    return rows.select(
        *(c for c in responses.columns if c != body),
        name("2. symbol").alias("id"),
        F.concat(name("1. symbol"), F.lit(" daily close")).alias("title"),
        F.col("_d.date").alias("date"),
        *(c.alias(n) for n, c in day.items()),
        F.concat(F.lit("latest "), F.col("_d.date"), F.lit(": open "), day["open"], F.lit(", close "), day["close"]).alias("snippet"),
    )


def indicator_series(responses: DataFrame, record_id: Column, body: str = "body") -> DataFrame:
    """One record of a world bank answer (paging, then points): ``id, title, observations, pagination, snippet``."""
    v = responses.withColumn("_v", F.try_parse_json(F.col(body)))
    points = F.coalesce(F.try_variant_get("_v", "$[1]", "array<variant>"), F.array().cast("array<variant>"))
    rows = v.withColumn("_p", points)
    first = F.get("_p", F.lit(0))
    dated = F.transform(F.filter("_p", lambda p: F.try_variant_get(p, "$.value", "string").isNotNull()), lambda p: F.concat(said(p, "$.date"), F.lit(":"), F.try_variant_get(p, "$.value", "string")))
    return rows.select(
        *(c for c in responses.columns if c != body),
        F.coalesce(at(first, "$.indicator.id"), record_id).alias("id"),
        F.coalesce(at(first, "$.indicator.value"), record_id).alias("title"),
        F.size("_p").alias("observations"),
        F.to_json(F.try_variant_get("_v", "$[0]", "variant")).alias("pagination"),
        F.concat(F.size("_p").cast("string"), F.lit(" observations; recent: "), F.left(F.array_join(dated, ", "), F.lit(200))).alias("snippet"),
    )


def observation_series(responses: DataFrame, series: Column, body: str = "body") -> DataFrame:
    """One record of a FRED answer, JSON or CSV: ``id, title, url, n, observations`` (the last 50) and a snippet with the last one."""
    v = responses.withColumn("_v", F.try_parse_json(F.col(body)))
    official = F.transform(F.try_variant_get("_v", "$.observations", "array<variant>"), lambda o: F.struct(said(o, "$.date").alias("date"), said(o, "$.value").alias("value")))
    lines = F.split(F.trim(body), r"\r?\n")
    pairs = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.struct(F.trim(F.substring_index(x, ",", 1)).alias("date"), F.when(x.contains(","), F.trim(F.regexp_replace(x, "^[^,]*,", ""))).otherwise("").alias("value")))
    rows = v.withColumn("_o", F.when(F.col("_v").isNotNull(), F.coalesce(official, F.array().cast("array<struct<date:string,value:string>>"))).otherwise(F.filter(pairs, lambda p: (p["date"] != "") & (p["value"] != ""))))
    last = F.when(F.size("_o") > 0, F.concat(F.element_at("_o", -1)["date"], F.lit("="), F.element_at("_o", -1)["value"])).otherwise("n/a")
    return rows.select(
        *(c for c in responses.columns if c != body),
        series.alias("id"),
        F.concat(F.lit("FRED series "), series).alias("title"),
        F.concat(F.lit("https://fred.stlouisfed.org/series/"), series).alias("url"),
        F.size("_o").alias("n"),
        F.slice("_o", F.greatest(F.size("_o") - 49, F.lit(1)), F.lit(50)).alias("observations"),
        F.concat(F.size("_o").cast("string"), F.lit(" observations; last: "), last).alias("snippet"),
    )


def coin_market(responses: DataFrame, coin: Column, body: str = "body") -> DataFrame:
    """The first market of a coin service's answer: ``id, title, url, snippet, symbol, price``; none for an empty answer."""
    v = responses.withColumn("_h", F.try_variant_get(F.try_parse_json(F.col(body)), "$[0]", "variant")).where("_h is not null")
    h, name = F.col("_h"), F.coalesce(at(F.col("_h"), "$.id"), coin)
    price = said(h, "$.current_price")
    return v.select(
        *(c for c in responses.columns if c != body),
        name.alias("id"),
        F.concat(F.coalesce(at(h, "$.name"), coin), F.lit(" $"), price).alias("title"),
        F.concat(F.lit("https://www.coingecko.com/en/coins/"), name).alias("url"),
        F.concat(F.lit("$"), price, F.lit(" (24h "), said(h, "$.price_change_percentage_24h"), F.lit("%), mcap $"), said(h, "$.market_cap")).alias("snippet"),
        at(h, "$.symbol").alias("symbol"),
        price.alias("price"),
    )


def patent_pages(pages: DataFrame, record_id: str = "id", html: str = "html") -> DataFrame:
    """Patent pages of a search engine: ``id, title, url, published, snippet, kind, application_number, filing_date, inventors,
    assignee, pdf_url, claims_count, refs_count, abstract, not_found``. All by expressions on the page's meta tags."""
    h = F.coalesce(F.col(html), F.lit(""))
    attr = lambda t, name: F.regexp_extract(t, rf'(?s)\b{name}="([^"]*)"', 1)
    text = lambda c: F.trim(F.regexp_replace(_unescape(F.regexp_replace(c, "<[^>]*>", " ")), r"\s+", " "))
    tags = F.transform(F.regexp_extract_all(h, F.lit(r"<meta\b[^<>]*>"), F.lit(0)), lambda t: F.struct(attr(t, "name").alias("n"), attr(t, "content").alias("v"), attr(t, "scheme").alias("s")))
    rows = pages.select(F.col(record_id).alias("_rid"), h.alias("_h"), tags.alias("_m"))
    first = lambda keep: F.coalesce(F.get(F.filter(F.col("_m"), lambda m: keep(m) & (m["v"] != "")), F.lit(0))["v"], F.lit(""))
    people = lambda kind: F.filter(F.transform(F.filter(F.col("_m"), lambda m: (m["n"] == "DC.contributor") & (m["s"] == kind)), lambda m: text(m["v"])), lambda n: n != "")
    named = lambda name: text(first(lambda m: m["n"] == name))
    number = text(F.regexp_extract("_h", r'(?s)<dd\b[^<>]*\bitemprop="publicationNumber"[^<>]*>([^<>]*)</dd>', 1))
    canonical = F.get(F.filter(F.regexp_extract_all("_h", F.lit(r"<link\b[^<>]*>"), F.lit(0)), lambda t: t.contains('rel="canonical"')), F.lit(0))
    read = rows.select(
        "_rid",
        number.alias("number"),
        named("DC.title").alias("t"),
        named("citation_patent_number").alias("cited"),
        F.coalesce(F.trim(attr(canonical, "href")), F.lit("")).alias("canonical"),
        F.left(first(lambda m: (m["n"] == "DC.date") & (m["s"] != "dateSubmitted")), F.lit(10)).alias("published"),
        F.left(first(lambda m: (m["n"] == "DC.date") & (m["s"] == "dateSubmitted")), F.lit(10)).alias("filing_date"),
        F.regexp_extract("_h", r'(?s)<meta\b[^<>]*\bitemprop="kindCode"[^<>]*\bcontent="([^"]*)"', 1).alias("kind"),
        named("citation_patent_application_number").alias("application_number"),
        people("inventor").alias("inv"),
        people("assignee").alias("ass"),
        F.trim(first(lambda m: m["n"] == "citation_pdf_url")).alias("pdf_url"),
        F.coalesce(F.regexp_extract("_h", r'(?s)<section\b[^<>]*\bitemprop="claims".*?<span\s+itemprop="count">(\d+)</span>', 1).try_cast("int"), F.lit(0)).alias("claims_count"),
        F.size(F.filter("_m", lambda m: (m["n"] == "DC.relation") & (m["s"] == "references"))).alias("refs_count"),
        F.left(text(F.regexp_extract("_h", r'(?s)<section\b[^<>]*\bitemprop="abstract".*?<div\s+class="abstract">(.*?)</div>', 1)), F.lit(240)).alias("abstract"),
    )
    filled = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in c))
    found = read.withColumn("not_found", filled("number", "t", "cited").isNull()).withColumn("id", filled("number", "cited", "_rid")).withColumn("title", F.coalesce(filled("t"), F.col("id")))
    parties = F.when(F.size("inv") > 0, F.col("inv")).otherwise(F.col("ass"))
    snippet = F.regexp_replace(F.concat("title", F.lit(" — "), F.array_join(F.slice(parties, 1, 3), ", ")), "^[ —]+|[ —]+$", "")
    url = F.coalesce(filled("canonical"), F.concat(F.lit("https://patents.google.com/patent/"), "id", F.lit("/en")))
    five = lambda c: F.array_join(F.slice(c, 1, 5), ", ")
    return found.select("id", "title", url.alias("url"), "published", snippet.alias("snippet"), "kind", "application_number", "filing_date", five("inv").alias("inventors"), five("ass").alias("assignee"), "pdf_url", "claims_count", "refs_count", "abstract", "not_found")


def _unescape(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def articles(responses: DataFrame, body: str = "body") -> DataFrame:
    """Articles of a PubMed answer: ``pos, id, title, authors`` with the authors' given and family names paired."""
    keep = [c for c in responses.columns if c != body]
    each = responses.select(*keep, F.posexplode(F.regexp_extract_all(F.col(body), F.lit(r"(?s)(<PubmedArticle\b.*?</PubmedArticle>)"), F.lit(1))).alias("pos", "_e"))
    people = F.regexp_extract_all("_e", F.lit(r"(?s)(<Author\b.*?</Author>)"), F.lit(1))
    part = lambda a, tag: F.regexp_extract(a, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    name = lambda a: F.trim(F.concat_ws(" ", part(a, "ForeName"), part(a, "LastName")))
    return each.select(*keep, "pos", F.xpath_string("_e", F.lit("//MedlineCitation/PMID/text()")).alias("id"), F.xpath_string("_e", F.lit("//ArticleTitle/text()")).alias("title"), F.array_join(F.filter(F.transform(people, name), lambda n: n != ""), ", ").alias("authors"))


def regulation_parts(responses: DataFrame, part: Column, body: str = "body", levels: int = 8) -> DataFrame:
    """The part of a regulation's tree (``children`` in ``children``) with an identifier: ``identifier, label, section_count``.

    The tree is opened level by level, all answers together; sections are counted below the part.
    """
    keep = [c for c in responses.columns if c != body]
    now = responses.select(*keep, F.array(F.try_parse_json(F.col(body))).alias("_n"), part.alias("_want"), F.lit(None).cast("string").alias("_in"), F.lit(None).cast("string").alias("_label"))
    found = None
    for _ in range(levels):
        each = now.select(*keep, "_want", "_in", "_label", F.explode("_n").alias("_v"))
        kind, name = at(F.col("_v"), "$.type"), at(F.col("_v"), "$.identifier")
        own = F.col("_in").isNull() & (kind == "part") & (name == F.col("_want"))
        each = each.withColumn("_at", F.when(own, name).otherwise(F.col("_in"))).withColumn("_l", F.when(own, said(F.col("_v"), "$.label")).otherwise(F.col("_label"))).withColumn("_section", (kind == "section").cast("int"))
        level = each.where("_at is not null").select(*keep, F.col("_at").alias("identifier"), F.col("_l").alias("label"), F.coalesce("_section", F.lit(0)).alias("s"))
        found = level if found is None else found.unionAll(level)
        now = each.select(*keep, F.try_variant_get("_v", "$.children", "array<variant>").alias("_n"), "_want", F.col("_at").alias("_in"), F.col("_l").alias("_label"))
    return found.groupBy(*keep, "identifier", "label").agg(F.sum("s").alias("section_count"))
