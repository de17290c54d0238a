"""Work that grows no faster than the input: pieces of batches, windows, payloads, joins with short lists, states of many keys."""

import datetime
import json
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webgrain.functions import text
from webgrain.operators import html, ranking, reading, research
from webgrain.plans import registry
from webgrain.streaming import caches


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces():
    from webgrain.batches import pieces

    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (10, 5000, 0, 3, 900, 900, 100, 0)]})
    got = list(pieces(batch, 1000))
    assert [x for p in got for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.nbytes <= 1000 or p.num_rows == 1 for p in got) and len(got) > 3
    assert [p.num_rows for p in pieces(batch.slice(0, 0))] == [0]


def test_words_and_pages_over_many_pieces(spark, monkeypatch):
    """A batch of over a megabyte is counted and read in several pieces, with the same rows."""
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["spark", "joins", "grain", "web", "x1"], k=rng.choice([0, 3, 4000]))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (300, None)], "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["term"]): r["tf"] for r in ranking.term_frequencies(df, "doc_id", "text").collect()}
    assert got == {(i, w): n for i, t in enumerate(texts) for w, n in Counter(t.split()).items()}
    top = {(r["doc_id"], r["word"]): (r["tf"], r["rank"]) for r in ranking.topic_words(df, "doc_id", "text", 2).collect()}
    assert top == {(i, w): (n, k) for i, t in enumerate(texts) for k, (n, w) in enumerate(((n, w) for w, n in sorted(Counter(t.split()).items(), key=lambda x: (-x[1], x[0]))[:2]), 1)}
    pages = df.select("doc_id", F.concat(F.lit("<body><p>"), "text").alias("html"))
    read = html.inspect(pages, "doc_id", "html")
    assert "MapInArrow" in plan(read) and {r["doc_id"]: r["markdown"] for r in read.collect()} == {**dict(enumerate(texts)), 300: ""}
    for query in (ranking.term_frequencies(df, "doc_id", "text"), read):
        assert "MapInArrow" in plan(query)


def test_densest_excerpt(spark):
    words = ["with", "from"]
    rng = random.Random(2)
    texts = [None, "", "with", "x" * 99 + "with", "x" * 299 + " with", "ab😀 from" * 90, "a\nfrom\n" * 60]
    texts += ["".join(rng.choices(["with", "from ", " ", "é", "x", "😀", "\n", "With"], k=rng.randint(1, 900))) for _ in range(60)]

    def plain(t):
        hits = [(-sum(w in words for w in re.findall("[a-z0-9]+", t[s : s + 300].lower())), s) for s in range(0, len(t or ""), 100)]
        if not hits or min(hits)[0] == 0:
            return None
        s = min(hits)[1]
        return ("…" if s else "") + t[s : s + 300] + ("…" if s + 300 < len(t) else "")

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.densest_excerpt(F.col("t"), words).alias("e")).collect()
    assert [(r["t"], r["e"]) for r in rows] == [(t, plain(t)) for t in texts]
    # Windows are put together from pieces: no substring within a loop over the text.
    assert "transform(substring" not in (p := plan(spark.createDataFrame([("a",)], "t string").select(text.densest_excerpt(F.col("t"), words)))) and "regexp_extract_all" in p


def test_fitted(spark):
    texts = [None, [], ["a"], ['"' * 400], ["é" * 900, None, "b"], ["x" * 996], ["x" * 997], ["y" * 400] * 2, ["z" * 300] * 9, ["\n" * 450]]

    def plain(ts):
        if ts is None:
            return '{"error":"too large"}'
        dump = lambda ts: json.dumps(ts, ensure_ascii=False, separators=(",", ":"))
        tries = [dump(ts), *(dump([t if t is None or len(t) <= n else t[:n] + "..." for t in ts]) for n in (500, 250, 125))]
        return next((t for t in tries if len(t) <= 1000), '{"error":"too large"}')

    df = spark.createDataFrame([(t,) for t in texts], "t array<string>").select("t", reading.fitted(F.col("t"), 1000, mark="...").alias("p"))
    assert [r["p"] for r in df.collect()] == [plain(t) for t in texts]
    # Nothing is spelt out twice.
    assert plan(df.select("p")).count("to_json") <= 5


def test_lists_of_providers_are_broadcast(spark):
    requests = spark.range(100).selectExpr("id", "'q' query", "CASE WHEN id % 2 = 0 THEN 'legal' END category", "CASE WHEN id % 2 = 1 THEN 'p' END provider")
    providers = spark.createDataFrame([("legal", 0, "l"), ("other", 0, "p")], "category string, place int, provider string")
    out = research.resolved(requests, providers)
    chosen = plan(out)
    assert "SortMergeJoin" not in chosen and chosen.count("BroadcastHashJoin") == 2, chosen
    assert {(r["category"], r["provider"]) for r in out.collect()} == {("legal", "l"), ("other", "p")}


def test_articles_are_read_once(spark, sf):
    out = registry.queries()["article_of_documents"](spark, sf)
    assert plan(out).count("ArrowEvalPython") == 1 and "Join" not in plan(out)


@pytest.mark.parametrize("groups", [1, 8])
def test_caches_of_many_keys(spark, groups):
    """States hold many keys: first ids and hits are those of each key by itself, over three batches."""
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    # Times are those of the timestamps.
    began = int(start.replace(tzinfo=datetime.UTC).timestamp()) * 1000
    rows = [(f"c{rng.randrange(60)}", began + i * 1000, i, i // 100, start + datetime.timedelta(seconds=i), rng.randrange(30)) for i in range(300)]
    log = spark.createDataFrame(rows, "key string, at bigint, id bigint, part int, ts timestamp, item bigint")
    told = caches.replayed(log.select("key", "at", "id", "part"), lambda s: caches.verdict_cache(s, 86_400_000, groups), "part", 3, "verdicts", once=True)
    first = {}
    for key, _, i, *_ in rows:
        first.setdefault(key, i)
    assert {(r["id"], r["computed"], r["first"]) for r in told.collect()} == {(i, first[k] == i, first[k]) for k, _, i, *_ in rows}
    asked = log.withColumn("key", F.lit(0).cast("bigint"))
    got = caches.replayed(asked, lambda s: caches.ttl_cache(s, 40_000, groups=groups), "part", 3, "ttl")
    stored, want = {}, set()
    for _, at, i, _, _, item in rows:
        hit = item in stored and at - stored[item] <= 40_000
        stored[item] = stored[item] if hit else at
        want.add((i, hit))
    assert {(r["id"], r["hit"]) for r in got.collect()} == want


def test_postings_are_written_once(spark, monkeypatch):
    from webgrain.operators import postings

    written = []
    monkeypatch.setattr(postings, "saved", lambda df: written.append(df.columns) or df)
    index = postings.inverted_index(spark.createDataFrame([(1, "spark joins"), (2, "spark")], "doc_id long, text string"), "doc_id", "text")
    assert len(written) == 1 and {(r["term"], r["n"]) for r in index.collect()} == {("spark", 2), ("joins", 1)}
