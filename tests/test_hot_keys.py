"""Scans, quantiles, searches and categories where one key holds most rows, against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webgrain.functions import fixed
from webgrain.operators import postings, ranking, schedule


@pytest.fixture(scope="module")
def log(spark):
    """Half of all requests are of one host; some have no host, some come at the same time."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 4 + [None, "a", "b", "c"]), rng.randint(0, 5000) * 10, rng.choice([None, 1.0, rng.random()])) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "id long, host string, at long, value double").repartition(6)


def by_host(rows):
    out = defaultdict(list)
    for i, host, at, _ in rows:
        out[host].append((at, i))
    return {h: sorted(x) for h, x in out.items()}


def test_politeness_in_blocks(log):
    rows, frame = log
    want = {}
    for host, asked in by_host(rows).items():
        last = None
        for at, i in asked:
            last = at if last is None else max(at, last + 7)
            want[i] = last
    got = schedule.politeness(frame, "host", "at", 7, "id")
    assert got.columns == [*frame.columns, "start"]
    assert {r["id"]: r["start"] for r in got.collect()} == want


def test_a_hot_key_is_many_blocks(log):
    rows, frame = log
    _, sizes = schedule.in_blocks(frame, ["host"], ["at", "id"])
    blocks = sizes.withColumn("host", F.col("_k.host")).collect()
    assert sum(b["_n"] for b in blocks) == len(rows)
    assert len([b for b in blocks if b["host"] == "hot"]) > 1 and max(b["_n"] for b in blocks) < len(rows) / 3


def test_quota_and_visited_in_blocks(spark, log):
    rows, frame = log
    stamped = frame.withColumn("ts", F.timestamp_millis(F.col("at") * 10_000))
    day, want = Counter(), {}
    for at, i, host in sorted((at, i, h) for i, h, at, _ in rows):
        day[host, at * 10_000 // 86_400_000] += 1
        want[i] = day[host, at * 10_000 // 86_400_000] <= 20
    assert {r["id"]: r["admitted"] for r in schedule.quota(stamped, "host", "ts", 20, "day", "id").collect()} == want
    left = set()
    for host in by_host(rows):
        held = []
        for i in sorted(i for i, h, _, _ in rows if h == host):
            held.append(i)
            if len(held) > 150:
                held = held[-60:]
        left.update(held)
    assert {r["id"] for r in schedule.visited_fifo(frame, "host", "id", 150, 60).collect()} == left


@pytest.mark.parametrize("few,bins", [(10_000, 1024), (20, 7)])
def test_quantiles_by_selection(spark, log, few, bins):
    rows, frame = log
    got = {(r["host"], r["share"]): (r["quantile"], r["n"], r["top"]) for r in schedule.quantiles(frame, "host", "value", (0.0, 0.25, 0.5, 0.99, 1.0), few, bins).collect()}
    for host in {r[1] for r in rows}:
        v = np.array([r[3] for r in rows if r[1] == host and r[3] is not None])
        for share in (0.0, 0.25, 0.5, 0.99, 1.0):
            quantile, n, top = got[host, share]
            assert quantile == pytest.approx(np.quantile(v, share), abs=1e-12) and n == len(v) and top == v.max()
    assert schedule.quantiles(frame.where("1 = 0"), "host", "value", (0.5,)).collect() == []


def test_blocks_stay_shut(spark):
    rng = random.Random(4)
    vocab = [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(4000)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(5, 60))) for _ in range(2500)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9000, None), (9001, "")], "doc_id long, text string")
    asks = [(i, " ".join(rng.choices(vocab, k=3))) for i in range(12)] + [(50, "nowhere"), (51, None)]
    best, met = postings.search_all(postings.inverted_index(docs, "doc_id", "text"), spark.createDataFrame(asks, "q long, text string"), "q", "text", 5)
    words = [Counter(t.split()) for t in texts]
    df = Counter(w for c in words for w in c)
    n, mean = len(texts) + 2, sum(sum(c.values()) for c in words) / (len(texts) + 2)
    want = []
    for q, text in asks:
        scores = []
        for d, c in enumerate(words):
            hit = [w for w in set((text or "").split()) if c[w]]
            if hit:
                s = sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in hit)
                scores.append((-round(s, 6), d))
        want += [(q, d, pytest.approx(-s, abs=2e-6), r) for r, (s, d) in enumerate(sorted(scores)[:5], 1)]
    assert sorted(map(tuple, best.select("q", "doc", "score", "rank").collect()), key=lambda r: (r[0], r[3])) == want
    seen = met.agg(F.sum("blocks"), F.sum("opened")).first()
    assert seen[1] < seen[0]


def test_categories_in_one_pass(spark):
    words = [w for words in fixed.CATEGORIES.values() for w in words]
    rng = random.Random(8)
    texts = ["", None, "a Patent application", "_patent patents9 xpatent", "Prior-Art prior art", "é patenté patent́", "case law; case-law", *words]
    texts += [rng.choice([" ", "-", "_", ".", "é", ""]).join(rng.choices([*words, "x", "9", "Ünion"], k=rng.randint(1, 12))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = []
    for i, (name, known) in enumerate(fixed.CATEGORIES.items()):
        lower = F.lower(F.coalesce("t", F.lit("")))
        hits = [lower.rlike(rf"(?U)\b\Q{w}\E\b").cast("int") for w in known]
        plain.append(F.struct(sum(hits[1:], hits[0]).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*plain))
    rows = frame.select("t", ranking.category(F.col("t")).alias("got"), F.when(best["hits"] > 0, best["name"]).otherwise("general").alias("want")).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows]


def plain_greedy(rows):
    seen, kept = set(), {}
    for i, keys in sorted(rows):
        kept[i] = not (set(keys) & seen)
        if kept[i]:
            seen |= set(keys)
    return kept


@pytest.mark.parametrize("kind", ["chain", "mixed", "hot"])
def test_greedy_dedupe_settles(spark, kind):
    """Each row of a chain shares a key with the one before it; rounds grow with the logarithm of its length."""
    from webgrain.operators import records

    rng = random.Random(2)
    if kind == "chain":
        rows = [(i, [f"u{i}", f"u{i + 1}"]) for i in range(3000)]
    elif kind == "mixed":
        rows = [(i, [f"u{rng.randrange(120)}", f"v{rng.randrange(120)}"]) for i in range(400)]
    else:
        rows = [(i, ["same" if i % 3 else f"u{i % 50}", f"v{i % 40}"]) for i in range(900)]
    order = {k: n for n, k in enumerate(sorted({k for _, keys in rows for k in keys}))}
    data = [(i, f"10.1/{order[a]}", None, f"t{b}" if kind != "chain" else None, None, None, None) for i, (a, b) in rows]
    if kind == "chain":
        # Both ends of a link are in the same space of keys: a DOI here is a DOI there.
        data = [(i, f"10.1/{i // 2}", f"http://h/{(i + 1) // 2}", None, None, None, None) for i, _ in rows]
        rows = [(i, [f"d{i // 2}", f"u{(i + 1) // 2}"]) for i, _ in rows]
    frame = spark.createDataFrame(data, "ord int, doi string, url string, title string, snippet string, summary string, description string")
    got = {r["ord"]: r["kept"] for r in records.greedy_dedupe(frame).collect()}
    assert got == plain_greedy(rows)
