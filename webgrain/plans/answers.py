"""Queries on captured answers of research providers: a full hit and a sparse one each, with the expected records as SQL."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from webgrain.plans.made import made, rows_sql, typed
from webgrain.plans.registry import golden, register, table
from webgrain.session import shared
from webgrain.sources import answers, providers

COLUMNS = ("id", "title", "url", "doi", "published", "authors", "snippet")
N = None


def answer(name: str, body, *rows: tuple, field: str | None = None, most: int = 20, kind: str = "search", suffix: str = "") -> None:
    """Register a query that reads one captured answer; ``rows`` are its records' core columns, and one of the further fields if named."""
    columns = ("pos", *COLUMNS, *((field,) if field else ()))
    sql = rows_sql(", ".join(columns), *((i, *r) for i, r in enumerate(rows)))
    sql = typed(sql, pos="INTEGER", **{c: "VARCHAR" for c in columns[1:]})

    def query(spark, sf_dir):
        out = providers.records(made(spark, "body string", (json.dumps(body),)), name, most=most, kind=kind)
        more = [F.element_at("fields", F.lit(field)).alias(field)] if field else []
        return out.select("pos", *COLUMNS, *more)

    golden(f"answer_{name.replace('-', '_')}{suffix}", sql)(query)


answer("semanticscholar", {"data": [{"paperId": "p1", "title": "T", "url": "u", "externalIds": {"DOI": "10.1/a"}, "publicationDate": "2024-01-02", "year": 2024, "authors": [{"name": "A B"}, {"name": None}, {"name": "C"}], "abstract": "<b>An</b>  abstract", "venue": "V", "citationCount": 3}, {"paperId": "p2", "title": None, "year": 2020, "authors": []}]},
       ("p1", "T", "u", "10.1/a", "2024-01-02", "A B, C", "An abstract", "V"), ("p2", N, N, N, "2020", N, N, N), field="venue")
answer("huggingface", [{"id": "org/m", "author": "org", "lastModified": "2024-05-01", "likes": 5, "tags": ["arxiv:2401.1", "license:mit", "x", "arxiv:2402.2"]}, {"id": "m2"}],
       ("org/m", "org/m", "https://huggingface.co/org/m", N, "2024-05-01", "org", N, "2401.1,2402.2"), ("m2", "m2", "https://huggingface.co/m2", N, N, N, N, ""), field="arxiv_ids")
answer("huggingface-papers", [{"paper": {"id": "2401.1", "title": "P", "publishedAt": "2024", "authors": [{"name": "A"}], "summary": "s", "upvotes": 7}}, {"id": "2402.2", "title": "Q", "authors": [{"name": "B"}]}],
       ("2401.1", "P", "https://huggingface.co/papers/2401.1", N, "2024", "A", "s", "7"), ("2402.2", "Q", "https://huggingface.co/papers/2402.2", N, N, "B", N, N), field="upvotes")
answer("open-meteo", {"results": [{"name": "Rome", "country": "Italy", "latitude": 41.9, "longitude": 12.5}, {"name": "X"}]}, ("41.9,12.5", "Rome", N, N, N, N, "Rome, Italy"), (N, "X", N, N, N, N, "X"))
answer("crossref", {"message": {"items": [{"DOI": "10.1/X", "title": ["T1", "T2"], "URL": "http://u", "published": {"date-parts": [[2024, 3, 1]]}, "author": [{"family": "F", "given": "G"}, {"name": "Team"}], "abstract": "<jats:p>Ab</jats:p>"}, {"DOI": "10.2/Y"}]}},
       ("10.1/X", "T1", "http://u", "10.1/X", "2024-3-1", "F, Team", "Ab"), ("10.2/Y", N, N, "10.2/Y", N, N, N))
answer("github", {"items": [{"full_name": "o/r", "html_url": "http://h", "description": "d", "language": "Rust", "stargazers_count": 0}, {"id": 7, "url": "http://api", "description": None}]},
       ("o/r", "o/r", "http://h", N, N, N, "d", "0"), ("7", N, "http://api", N, N, N, N, N), field="stars")
answer("openlibrary", {"docs": [{"key": "/works/1", "title": "B", "first_publish_year": 1999, "author_name": ["A", "", "C"], "isbn": ["1", "2"]}, {"key": "/works/2", "publish_date": "2001"}]},
       ("/works/1", "B", "https://openlibrary.org/works/1", N, "1999", "A, C", N, "1, 2"), ("/works/2", N, "https://openlibrary.org/works/2", N, "2001", N, N, ""), field="isbn")
answer("doaj", {"results": [{"id": "i", "bibjson": {"title": "T", "identifier": [{"type": "issn", "id": "1"}, {"type": "DOI", "id": "10.1/d"}], "link": [{"url": "http://l"}], "year": "2020", "author": [{"name": "A"}], "abstract": "ab"}}, {"id": "j", "bibjson": {}}]},
       ("i", "T", "http://l", "10.1/d", "2020", "A", "ab"), ("j", N, N, N, N, N, N))
answer("pubmed", {"esearchresult": {"idlist": ["11", "22"]}}, ("11", "PMID 11", "https://pubmed.ncbi.nlm.nih.gov/11/", N, N, N, N), ("22", "PMID 22", "https://pubmed.ncbi.nlm.nih.gov/22/", N, N, N, N))
answer("nasa", {"near_earth_objects": {"2024-01-01": [{"neo_reference_id": "9", "object_name": "Rock", "nasa_jpl_url": "http://j", "estimated_diameter": {"meters": {"estimated_diameter_max": 12}}, "close_approach_data": [{"close_approach_date": "2024-01-01", "closest_approach_distance": {"kilometers": "77"}}], "is_hazardous": True}]}},
       ("9", "Rock", "http://j", N, "2024-01-01", N, "~12 m diameter; 77 km closest", "true"), field="is_hazardous")
answer("zenodo", {"hits": {"hits": [{"id": 5, "doi": "10.5/z", "metadata": {"title": "Z", "publication_date": "2022", "creators": [{"name": "A"}, {"person_or_org": {"name": "B"}}], "description": "<p>d</p>", "resource_type": {"title": "Dataset"}}, "links": {"self_html": "http://s"}}, {"id": 6, "metadata": {"doi": "10.6/y"}, "links": {"html": "http://t"}}]}},
       ("5", "Z", "http://s", "10.5/z", "2022", "A, B", "d", "Dataset"), ("6", N, "http://t", "10.6/y", N, N, N, N), field="resource_type")
answer("softwareheritage", [{"url": "http://g", "visit_types": ["git", "hg"]}, {"id": "swh:1", "name": "n", "origin_visits_url": "http://v"}], ("http://g", "http://g", "http://g", N, N, N, N, "git, hg"), ("swh:1", "n", "http://v", N, N, N, N, ""), field="visit_types")
answer("congress", {"results": [{"cgi_id": "M1", "display_name": "Doe", "url": "http://c", "title": "Rep.", "party": "X", "state": "OH", "district": 3, "chamber": "House"}]}, ("M1", "Doe", "http://c", N, N, N, "Rep. X — OH 3", "House"), field="chamber")
answer("yahoo", {"quotes": [{"symbol": "A", "shortname": "Acme", "exchange": "NYQ", "quoteType": "EQUITY", "marketCap": 10}, {"symbol": "B"}]}, ("A", "Acme", "https://finance.yahoo.com/quote/A", N, N, N, "Acme — NYQ EQUITY", "10"), ("B", "B", "https://finance.yahoo.com/quote/B", N, N, N, "B —  ", N), field="market_cap")
answer("yahoo", {"chart": {"result": [{"meta": {"symbol": "A", "longName": "Acme Inc", "shortName": "Acme", "regularMarketPrice": 1.5, "currency": "USD", "fullExchangeName": "NYSE", "previousClose": 1.4}}]}}, ("A", "Acme Inc", "https://finance.yahoo.com/quote/A", N, N, N, "1.5 USD (NYSE)", "1.4"), field="previous_close", kind="fetch", suffix="_fetch")
answer("overpass", {"elements": [{"type": "node", "id": 1, "lat": 1.5, "lon": 2.5, "tags": {"amenity": "cafe", "name": "C"}}, {"type": "way", "id": 2}]}, ("1", "C", "https://www.openstreetmap.org/node/1", N, N, N, "amenity=cafe, name=C", "1.5"), ("2", "way:2", "https://www.openstreetmap.org/way/2", N, N, N, N, N), field="lat")
answer("courtlistener", {"results": [{"cluster_id": 3, "caseName": "A v. B", "absolute_url": "/o/3/", "dateFiled": "2001-02-03", "caseNameFull": "A versus B"}, {"cluster_id": 4, "caseName": "", "caseNameFull": "C"}]}, ("3", "A v. B", "https://www.courtlistener.com/o/3/", N, "2001-02-03", N, "A versus B"), ("4", "C", N, N, N, N, "C"))
answer("federalregister", {"documents": [{"document_number": "d1", "title": "R", "html_url": "http://f", "publication_date": "2024-01-01", "abstract": "a", "type": "Rule", "agencies": [{"name": "EPA"}]}]}, ("d1", "R", "http://f", N, "2024-01-01", N, "a", "EPA"), field="agency")
answer("biorxiv", {"collection": [{"doi": "10.1101/1", "title": "T", "date": "2024-01-01", "authors": "A; B", "abstract": "x", "server": "biorxiv"}]}, ("10.1101/1", "T", "https://doi.org/10.1101/1", "10.1101/1", "2024-01-01", "A; B", "x", "biorxiv"), field="server")
answer("chemrxiv", {"data": [{"id": "c", "title": "T", "doi": "10.2/c", "published_on": "2024", "authors": [{"name": "A"}], "topics": [{"name": "Org"}]}]}, ("c", "T", "https://chemrxiv.org/engage/chemrxiv/article-details/c", "10.2/c", "2024", "A", N, "Org"), field="topics")
answer("alphavantage", {"bestMatches": [{"1. symbol": "IBM", "2. name": "Big", "3. type": "Equity", "4. region": "US", "8. currency": "USD", "9. matchScore": "1.0"}, {"1. symbol": "X"}]}, ("IBM", "Big", N, N, N, N, "Big — Equity US", "1.0"), ("X", "X", N, N, N, N, " —  ", N), field="match_score")
answer("oldp", {"results": [{"slug": "bgh-1", "court": {"name": "BGH"}, "file_number": "I 1/2", "date": "2020-01-01", "ecli": "E", "type": "Urteil"}, {"id": 4, "title": "T"}]}, ("bgh-1", "BGH I 1/2", "https://de.openlegaldata.io/case/bgh-1", N, "2020-01-01", N, N, "Urteil"), ("4", "T", N, N, N, N, N, N), field="decision_type")
answer("hudoc", {"results": [{"columns": {"itemid": "001-1", "docname": "D", "kpdate": "2020-01-01T00:00:00", "appno": "1/20"}}]}, ("001-1", "D", "https://hudoc.echr.coe.int/eng?i=001-1", N, "2020-01-01", N, N, "1/20"), field="appno", most=0)
answer("govinfo", {"results": [{"packageId": "P", "granuleId": "G", "title": "T", "download": {"pdfLink": "http://p"}, "dateIssued": "2020", "collectionCode": "FR"}, {"packageId": "P2"}]}, ("G", "T", "http://p", N, "2020", N, N, "FR"), ("P2", N, N, N, N, N, N, N), field="collection")
answer("coingecko", {"coins": [{"id": "bitcoin", "name": "Bitcoin", "symbol": "btc", "market_cap_rank": 1}]}, ("bitcoin", "Bitcoin", "https://www.coingecko.com/en/coins/bitcoin", N, N, N, N, "BTC"), field="symbol")
answer("patentsview", {"patents": [{"patent_number": "1", "patent_title": "T", "patent_date": "2020-01-01T0", "assignees": [{"assignee_organization": "O"}]}, {"id": "2", "title": "U", "date": "2021"}]}, ("1", "T", "https://patents.google.com/patent/US1", N, "2020-01-01", N, N, "O"), ("2", "U", "https://patents.google.com/patent/US2", N, "2021", N, N, N), field="assignee")
answer("lens", {"data": [{"lens_id": "L", "jurisdiction": "US", "doc_number": "1", "kind": "A", "date_published": "2020", "biblio": {"invention_title": [{"text": "T"}], "parties": {"inventors": [{"extracted_name": {"value": "I"}}], "applicants": [{"name": "Ap"}]}}, "abstract": [{"text": "ab"}]}, {"lens_id": "M", "jurisdiction": "EP", "doc_number": "2", "kind": "B"}]}, ("L", "T", "https://www.lens.org/L", N, "2020", "I", "ab", "Ap"), ("M", "EP 2 B", "https://www.lens.org/M", N, N, N, N, ""), field="applicants")
answer("worldbank", [{"page": 1}, [{"indicator": {"id": "I", "value": "V"}, "date": "2020", "value": 5, "country": {"value": "X"}}, {"date": "2019", "value": None}]], ("I", "V", N, N, "2020", N, N, "5"), (N, N, N, N, "2019", N, N, N), field="value")
answer("ecfr", {"children": [{"identifier": "1", "label": "Part 1", "label_description": "d", "type": "part"}]}, ("1", "Part 1", N, N, N, N, "d", "part"), field="type")
# A negative number leaves out so many at the end.

answer("github", {"items": [{"full_name": "a"}, {"full_name": "b"}]}, ("a", "a", N, N, N, N, N), most=-1, suffix="_but_last")


def text_query(name: str, columns: str, rows: list[tuple], **types: str):
    return golden(name, typed(rows_sql(columns, *rows), **types) if types else rows_sql(columns, *rows))


@text_query("stock_notes", "title, snippet", [("slow down", "slow down"), ("acme", "")])
def stock_notes(spark, sf_dir):
    return providers.notes(made(spark, "body string", ('{"bestMatches":[],"Note":"slow down"}',), ("{}",), ('{"bestMatches":[{"1. symbol":"X"}]}',)), F.lit("acme")).select("title", "snippet")


@text_query("stock_day", "id, title, date, close, snippet", [("IBM", "IBM daily close", "2024-01-03", "12", "latest 2024-01-03: open 11, close 12")])
def stock_day(spark, sf_dir):
    body = {"Meta Data": {"2. symbol": "IBM"}, "Time Series (Daily)": {"2024-01-03": {"1. open": "11", "4. close": "12"}, "2024-01-02": {"1. open": "9"}}}
    return providers.latest_day(made(spark, "body string", (json.dumps(body),), ("{}",)), F.lit("IBM")).select("id", "title", "date", "close", "snippet")


@text_query("indicator_series", "id, title, observations, pagination, snippet", [("I", "V", 3, '{"page":1}', "3 observations; recent: 2020:5, 2018:4.5"), ("SP", "SP", 0, None, "0 observations; recent: ")], observations="INTEGER")
def indicator_series(spark, sf_dir):
    points = [{"indicator": {"id": "I", "value": "V"}, "date": "2020", "value": 5}, {"date": "2019", "value": None}, {"date": "2018", "value": 4.5}]
    return providers.indicator_series(made(spark, "body string", (json.dumps([{"page": 1}, points]),), ('{"message":"x"}',)), F.lit("SP"))


@text_query("observation_series", "id, title, n, kept, snippet", [("GDP", "FRED series GDP", 60, 50, "60 observations; last: d59=59"), ("GDP", "FRED series GDP", 2, 2, "2 observations; last: 2024-03-01=3"), ("GDP", "FRED series GDP", 0, 0, "0 observations; last: n/a")], n="INTEGER", kept="INTEGER")
def observation_series(spark, sf_dir):
    official = json.dumps({"observations": [{"date": f"d{i}", "value": str(i)} for i in range(60)]})
    out = providers.observation_series(made(spark, "body string", (official,), ("DATE,GDP\n2024-01-01,1.5\r\n2024-02-01,\n2024-03-01,3\n",), ("{}",)), F.lit("GDP"))
    return out.select("id", "title", "n", F.size("observations").alias("kept"), "snippet")


@text_query("coin_market", "id, title, url, snippet", [("bitcoin", "Bitcoin $5", "https://www.coingecko.com/en/coins/bitcoin", "$5 (24h -1.5%), mcap $9"), ("eth", "eth $", "https://www.coingecko.com/en/coins/eth", "$ (24h %), mcap $")])
def coin_market(spark, sf_dir):
    bodies = ('[{"id":"bitcoin","name":"Bitcoin","current_price":5,"price_change_percentage_24h":-1.5,"market_cap":9}]', '[{"x":1}]', "[]")
    return providers.coin_market(made(spark, "body string", *((b,) for b in bodies)), F.lit("eth")).select("id", "title", "url", "snippet")


PATENT = """<html><head><link rel="canonical" href="https://patents.google.com/patent/US1B2/en"><meta name="DC.title" content="A &amp; B"><meta name="DC.date" content="2019-01-02" scheme="dateSubmitted"><meta name="DC.date" content="2020-03-04 x">
<meta name="DC.contributor" content="Ann" scheme="inventor"><meta name="DC.contributor" content="Corp" scheme="assignee"><meta name="DC.relation" content="US0" scheme="references"><meta name="DC.relation" content="US2" scheme="references"><meta name="citation_patent_application_number" content="US16/1"></head>
<body><dd itemprop="publicationNumber">US1B2</dd><meta itemprop="kindCode" content="B2"><section itemprop="abstract"><h2>x</h2><div class="abstract">An  <b>abstract</b></div></section><section itemprop="claims"><span itemprop="count">7</span></section></body></html>"""


@text_query("patent_pages", "id, title, url, published, snippet, kind, filing_date, inventors, assignee, claims_count, refs_count, abstract, not_found",
            [("US1B2", "A & B", "https://patents.google.com/patent/US1B2/en", "2020-03-04", "A & B — Ann", "B2", "2019-01-02", "Ann", "Corp", 7, 2, "An abstract", False), ("US9", "US9", "https://patents.google.com/patent/US9/en", "", "US9", "", "", "", "", 0, 0, "", True)], claims_count="INTEGER", refs_count="INTEGER")
def patent_pages(spark, sf_dir):
    out = providers.patent_pages(made(spark, "id string, html string", ("q", PATENT), ("US9", None)))
    return out.drop("application_number", "pdf_url")


@text_query("articles_authors", "id, title, authors", [("1", "T", "Ada Lovelace, Team")])
def articles_authors(spark, sf_dir):
    body = "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T</ArticleTitle><AuthorList><Author><LastName>Lovelace</LastName><ForeName>Ada</ForeName></Author><Author><LastName>Team</LastName></Author><Author/></AuthorList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"
    return providers.articles(made(spark, "body string", (body,))).select("id", "title", "authors")


@text_query("regulation_parts", "identifier, label, section_count", [("60", "Part 60", 3)], section_count="BIGINT")
def regulation_parts(spark, sf_dir):
    s = {"type": "section", "identifier": "s"}
    tree = {"type": "title", "children": [{"type": "part", "identifier": "1", "children": [s]}, {"type": "chapter", "children": [{"type": "part", "identifier": "60", "label": "Part 60", "children": [s, {"type": "subpart", "children": [s, s]}]}]}]}
    return providers.regulation_parts(made(spark, "body string", (json.dumps(tree),)), F.lit("60")).select("identifier", "label", "section_count")


@text_query("sparse_cells", '"index", value, geo', [(60, 1.5, "c0"), (70, 2.5, "c10")], index="INTEGER", value="DOUBLE")
def sparse_cells(spark, sf_dir):
    """Cells far out in a sparse cube count as cells, not by their place."""
    body = {"id": ["time", "geo"], "size": [2, 60], "value": {"60": 1.5, "70": 2.5, "119": 3}, "dimension": {"time": {"category": {"index": {"t0": 0, "t1": 1}}}, "geo": {"category": {"index": {f"c{i}": i for i in range(60)}}}}}
    out = providers.cells(made(spark, "body string", (json.dumps(body),)), most=2)
    return out.select(F.col("index").cast("int").alias("index"), "value", F.element_at("coords", F.lit("geo")).alias("geo"))


answer("google", {"items": [{"title": "T", "link": "http://l", "snippet": "s"}, {"link": None}]}, (N, "T", "http://l", N, N, N, "s"), (N,) * 7)
answer("bing", {"webPages": {"value": [{"name": "T", "url": "http://u", "snippet": "s"}]}}, (N, "T", "http://u", N, N, N, "s"))
answer("exa", {"results": [{"title": "T", "url": "http://u", "text": "body"}]}, (N, "T", "http://u", N, N, N, "body"))
answer("duckduckgo", [{"title": "T", "href": "http://u", "body": "s"}, {"title": "U", "url": "http://v", "snippet": "t"}], (N, "T", "http://u", N, N, N, "s"), (N, "U", "http://v", N, N, N, "t"))


STORED_SQL = """
SELECT doc_id AS request, lang AS provider, 'D' || doc_id AS title, 'http://' || source || '/' || doc_id AS url, substr(coalesce(text, ''), 1, 20) AS snippet
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL
"""


def _stored(spark, sf_dir):
    """The documents as answers of search engines, one for each language, in a store of their own; fetched a minute apart."""
    answers.register(spark)
    item = F.struct(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("http://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("link"), F.concat(F.lit("<b>"), F.replace(F.left(F.coalesce("text", F.lit("")), F.lit(20)), F.lit("<"), F.lit(" ")), F.lit("</b>")).alias("snippet"))
    docs = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("doc_id") * 60_000_000)
    rows = docs.select(F.col("lang").alias("provider"), F.col("doc_id").alias("request"), at.alias("fetched_at"), F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    path = f"{shared(spark)}/answers-{uuid.uuid4().hex}"
    rows.write.format("answers").mode("append").save(path)
    return spark.read.format("answers").load(path)


@register("stored_answers", "SELECT request, provider, title, url FROM (" + STORED_SQL + ")")
def stored_answers(spark, sf_dir):
    """All answers, written to a store and read back as records."""
    return providers.records(_stored(spark, sf_dir), "google").select("request", "provider", "title", "url")


@register("stored_answers_of_engines", "SELECT request, provider, title, url FROM (" + STORED_SQL + ") WHERE provider IN ('de', 'fr') AND request * 60 >= (SELECT max(doc_id) * 30 FROM documents)")
def stored_answers_of_engines(spark, sf_dir):
    """The later answers of two engines: the files of others and earlier ones are not read."""
    stored = _stored(spark, sf_dir)
    half = table(spark, sf_dir, "documents").agg(F.max("doc_id") * 30).first()[0] or 0
    since = datetime.fromtimestamp(1_700_000_000 + half, timezone.utc)
    chosen = stored.where(F.col("provider").isin("de", "fr") & (F.col("fetched_at") >= F.lit(since)))
    return providers.records(chosen, "google").select("request", "provider", "title", "url")
