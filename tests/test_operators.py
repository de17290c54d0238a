"""Operators outside the training-data subpackage, held against plain versions."""

import math
import os
import random
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from webgrain.functions import fixed
from webgrain.operators import graph, html, ranking, records, schedule


def test_markdown_keeps_whole_tables(spark):
    rows = [[f"r{i}", f"v{i}"] for i in range(700)]
    article = "é word " * 2000
    page = "<body><table><tr><th>k</th><th>v</th></tr>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in rows) + f"</table><table><tr><td>{article}</td></tr></table></body>"
    got = html.inspect(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id", "html").first()["markdown"]
    want = "\n".join(["| k | v |", "| --- | --- |", *(f"| {a} | {b} |" for a, b in rows)]) + f"\n\n|  |\n| --- |\n| {article.strip()} |"
    assert got == want
    # The table extraction keeps the reference's caps.
    first, second = html.tables(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id", "html").orderBy("table_no").collect()
    assert len(first["rows"]) == 499 and len(second["rows"][0][0].encode()) <= 1000


@pytest.mark.parametrize("block", [7, 100, 65_536])
def test_running_document_frequency_of_all_events(spark, sf, block):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS seq", "event_type AS term")
    out = ranking.running_document_frequency(events, block=block)
    got = {(r["seq"], r["term"]): (r["df"], r["n"]) for r in out.collect()}
    sofar, want = Counter(), {}
    for seq, term in duckdb.sql(f"SELECT event_id, event_type FROM '{os.path.join(sf, 'events')}.parquet' ORDER BY 1").fetchall():
        sofar[term] += 1
        want[seq, term] = (sofar[term], seq + 1)
    assert got == want


def test_running_document_frequency_windows_are_by_block(spark):
    rows = spark.range(10).selectExpr("id AS seq", "concat('t', id % 3) AS term")
    plan = ranking.running_document_frequency(rows)._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan.split("row_number() windowspecdefinition(", 1)[1].split("ASC", 1)[0]
    assert "_t#" in ranked and "_b#" in ranked


def test_greedy_dedupe_is_the_sequential_rule(spark):
    """Chains of shared keys, rows without keys, and groups, against the plain rule."""
    rng = random.Random(6)
    key = lambda k: f"{k}{rng.randrange(25)}" if rng.random() < 0.6 else None
    rows = [(i, key("10.1/d"), (lambda u: u and f"http://h/{u}")(key("u")), key("t"), None) for i in range(150)]
    frame = spark.createDataFrame(rows, "ord int, doi string, url string, title string, snippet string").selectExpr("*", "null AS summary", "null AS description")
    got = {r["ord"]: r["kept"] for r in records.greedy_dedupe(frame).collect()}
    seen, want = set(), {}
    for i, doi, url, title, _ in rows:
        keys = {("doi", doi), ("url", url), ("title", title)}
        keys = {k for k in keys if k[1] is not None}
        want[i] = not keys & seen
        if want[i]:
            seen |= keys
    assert got == want


def test_evict_by_hours(spark):
    rows = [(f"k{i}", i * 700, (i * 37) % 90 + 1) for i in range(300)]
    frame = spark.createDataFrame(rows, "key string, s long, bytes long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for cap in (0, 50, 3000, 10**6):
        got = {r["key"] for r in schedule.evict(frame, F.timestamp_seconds(F.lit(300 * 700)), 150_000, cap).collect()}
        want, total = set(), 0
        for k, s, b in reversed(rows):
            if 300 * 700 - s <= 150_000:
                total += b
                want |= {k} if total <= cap else set()
        assert got == want


def test_a_long_text_is_counted_in_a_batch(spark):
    """Linear work: 40,000 words, most of them distinct."""
    text = " ".join(f"w{i % 30000}" for i in range(40_000))
    frame = spark.createDataFrame([(1, text), (2, None), (3, "spark Spark")], "k long, t string")
    start = time.time()
    got = {(r["k"], r["term"]): r["tf"] for r in ranking.term_frequencies(frame, "k", "t").collect()}
    assert time.time() - start < 20
    want = Counter((1, w) for w in text.split()) + Counter({(3, "spark"): 2})
    assert got == dict(want)


def test_headings_are_found_by_line(spark):
    md = "intro\n# A #\ntext\r\nTitle\n---\nmore\n- item\n---\n---\n===\n#no\n## B\u2028"
    rows = ranking.split_sections(spark.createDataFrame([(1, md), (2, "no heading"), (3, " ")], "k long, md string"), "k", "md").orderBy("k", "idx").collect()
    assert [(r["k"], r["anchor"], r["offset"]) for r in rows] == [(1, "(intro)", 0), (1, "A", 6), (1, "Title", 18), (1, "B", md.index("## B")), (2, "(intro)", 0)]
    assert "".join(r["text"] for r in rows if r["k"] == 1) == md


def test_bpe_counts_are_the_librarys(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    from webgrain.functions import text

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", text.bpe_count(F.col("text"), path).alias("n")).collect()
    tokenizer = Tokenizer.from_file(path)
    assert [r["n"] for r in rows] == [len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows]


def plain_crawl(text, links, root, query, most, depth, least, clusters=()):
    """One crawl by the rules, a page at a time."""
    stop = set(fixed.CRAWL_STOPWORDS)
    said = lambda t: [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in stop]
    top = lambda ws, k: [w for w, _ in sorted(Counter(ws).items(), key=lambda x: (-x[1], x[0]))[:k]]
    base = set(said(query))
    added = [w for t in sorted(base) for c in clusters if t in c for w in c if w not in base]
    asked = base | set(list(dict.fromkeys(added))[: len(base)])
    queue, seen, df, out, papers, n, found = [(1.0, 0, 0, 1.0, root)], {root}, Counter(), [], {}, 0, 0
    while queue and n < most:
        queue.sort(key=lambda q: (-q[0], q[1]))
        _, _, level, score, url = queue.pop(0)
        if url not in text:
            continue
        out.append((n, url, level, round(score, 9)))
        n += 1
        df.update(set(said(text[url])))
        if level >= depth:
            continue
        topic = set(top(said(text[url]), 40))
        idf = lambda w: 1.0 if n < 3 else math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
        half = lambda w: idf(w) * (1.0 if w in base else 0.5)
        for dst, anchor in links.get(url, ()):
            if dst in seen:
                continue
            path = re.sub("^[a-z]+://[^/]*", "", dst)
            paper = dst.endswith(".pdf")
            at = text[url].lower().find(anchor.lower().strip()) if anchor.strip() and not paper else -1
            near = top(said(text[url].lower()[max(0, at - 50) : at + len(anchor.strip()) + 50]), 8) if at >= 0 else []
            label = set(said(anchor)) | set(said(path)) | set(near)
            share = lambda a, b, f: sum(map(f, a)) / t if (t := sum(map(f, b))) else 0.0
            s = 0.7 * share(label & asked, asked, half) + 0.3 * share(label & topic, label, idf)
            s *= (1.15 if path.startswith(fixed.LIKED_PATHS) else 0.85 if path.startswith(fixed.DISLIKED_PATHS) else 1.0) if n >= 3 else 1.0
            if paper:
                papers.setdefault(dst, round(s, 9))
            elif not path.startswith(tuple(fixed.BOILERPLATE_PATHS)) and s >= least:
                seen.add(dst)
                found += 1
                queue.append((s * 0.7 ** (level + 1), found, level + 1, s, dst))
    return out, {u: s for u, s in papers.items() if s >= least}


def test_focused_crawl_against_one_page_at_a_time(spark):
    rng = random.Random(31)
    vocab = [f"w{i}" for i in range(40)] + ["spark", "joins", "docs"]
    names = [f"http://h/{rng.choice(('docs', 'x', 'pricing'))}/{rng.choice(vocab)}-{i}" for i in range(30)]
    links = {u: [(rng.choice([*names, "http://h/gone", "http://h/p.pdf", "http://h/login/x"]), " ".join(rng.choices(vocab, k=2))) for _ in range(6)] for u in names}
    text = {u: " ".join(rng.choices(vocab, k=40) + [a for _, a in links[u][:3]]) for u in names}
    clusters = [["spark", "w1", "w2"], ["joins", "w3"]]
    roots = [(names[0], "spark joins"), (names[1], "w5 docs spark"), ("http://h/gone", "spark")]
    pages = spark.createDataFrame([("s", u, t) for u, t in text.items()], "site string, url string, text string")
    edges = spark.createDataFrame([("s", u, d, a, i) for u, ls in links.items() for i, (d, a) in enumerate(ls)], "site string, src string, dst string, anchor string, pos int")
    got = graph.focused_crawl(pages, edges, spark.createDataFrame([("s", *r) for r in roots], "site string, root string, query string"), most_pages=5, depth=3, clusters=clusters).collect()
    for root, query in roots:
        own = [r for r in got if r["root"] == root]
        want, papers = plain_crawl(text, links, root, query, 5, 3, 0.05, clusters)
        assert sorted((r["seq"], r["url"], r["depth"], round(r["score"], 9)) for r in own if r["kind"] == "page") == want
        assert {r["url"]: round(r["score"], 9) for r in own if r["kind"] == "document"} == papers
    assert sum(r["kind"] == "page" for r in got) == 10
