"""Ranked search, source divergence and the Jaccard join, held against plain versions and SQL."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from webgrain.llm import divergence, lexical, queries, shingle_join, terms

ODD = ["", None, " ", "a", "Two  words\x00two-WORDS", "é É ñ1 1ñ", "\x1c sep\x85arated\xa0here", "日本語 テキスト 😀", "x " * 3000, "one two three four", "ONE two  three\tfour", "one two three four five six"]
LOWER = {c: c + 32 for c in range(65, 91)}


def found(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: [(v is not None, v) for v in r])


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_source_divergence", "op13_jaccard_join"])
def test_against_sql(spark, sf, sql, name):
    got = queries.queries()[name](spark, sf)
    want = sql.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert found(got.select(*want.columns)) == sorted(want.fetchall(), key=lambda r: [(v is not None, v) for v in r])


def test_words():
    for table, pattern in ((terms.WORDS, "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), (terms.WORDS_AND_DIGITS, "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"), (terms.SPACED, "[^\x20\x09-\x0d]+")):
        row, word = terms.words(pa.array(["head", *ODD])[1:], table)
        want = [(i, w) for i, t in enumerate(ODD) for w in re.findall(pattern, (t or "").translate(LOWER))]
        assert list(zip(row.tolist(), word.to_pylist())) == want


def test_gathered_batches_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(terms, "BYTES", 50)
    monkeypatch.setattr(terms, "ROWS", 4)
    texts = [ODD[i % len(ODD)] if i % 7 else "long " * 30 for i in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:b], pa.string())], names=["t"]) for a, b in ((0, 1), (1, 30), (30, 30), (30, 60))]
    got = list(terms.gathered(iter(batches), 0))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows <= 4 and (b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(0).to_pylist()) <= 50) for b in got)


def plain_ranking(docs, items, k):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    held = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    asked = defaultdict(Counter)
    for i, t in set(items):
        asked[i].update(cut(t))
    for item, words in asked.items():
        scores = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // max(1, total)
            s = sum(reps * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w, reps in words.items() if c[w])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize("asked", [200_000, 3])
def test_ranking(spark, monkeypatch, asked):
    monkeypatch.setattr(lexical, "ASKED", asked)
    monkeypatch.setattr(terms, "ROWS", 37)
    rng = random.Random(5)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 120)))) for i in range(300)]
    docs += [(400 + i, t) for i, t in enumerate(ODD)] + [(3, docs[3][1]), (7, docs[3][1]), (None, docs[3][1])]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 30)))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "nowhere"), (93, docs[3][1]), (93, docs[3][1]), (93, "w1 W1"), (None, "one two")]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, TEXT string").repartition(3)
    got = lexical.rank_documents(frame, spark.createDataFrame(items, "item_id bigint, text string"), k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == plain_ranking(docs, items, 5)


def test_ranking_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    asks = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.rank_documents(none, asks).collect() == []
    assert lexical.rank_documents(one, asks.where("item_id = 0")).collect() == []
    assert lexical.rank_documents(one.withColumn("text", one["text"].substr(0, 0)), asks).collect() == []


def test_few_lists_are_opened():
    """A rare term's documents are all that can be among the best, so the common term's list is probed only."""
    texts = pa.array(["rare common"] * 5 + ["common"] * 500)
    shard = lexical.Shard(texts, pa.array(["common", "rare"]), np.array([1, 5000]), 505, 510)
    at, score = shard.search(np.array([0, 1]), np.array([1, 1]), 5, 1)
    assert sorted(at.tolist()) == [0, 1, 2, 3, 4] and len(set(score.tolist())) == 1
    assert not shard.total.any()


def plain_audit(docs):
    docs = [tuple(x or "" for x in r) for r in docs]
    cut = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(LOWER))
    df, counts, groups = Counter(), Counter(), sorted({(lang, s) for lang, s, _ in docs})
    for lang, source, text in docs:
        words = cut(text)
        df.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in df.items() if x == lang and n >= 3]
        sources = [s for x, s in groups if x == lang]
        n = {s: sum(counts[lang, s, w] for w in kept) for s in sources}
        p = {(s, w): 1 + 10**9 * (counts[lang, s, w] + 1) // (n[s] + len(kept)) for s in sources for w in kept}
        q = {w: 1 + 10**9 * (sum(counts[lang, s, w] for s in sources) + 1) // (sum(n.values()) + len(kept)) for w in kept}
        for a in sources:
            pairs = [(-sum((p[a, w] - p[b, w]) ** 2 // p[b, w] for w in kept), b.encode(), b) for b in sources if b != a]
            words = [(-((p[a, w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if counts[lang, a, w] and p[a, w] > q[w]]
            out += [(lang, a, "pair", b, -v, r) for r, (v, _, b) in enumerate(sorted(pairs), 1)]
            out += [(lang, a, "term", w, -v, r) for r, (v, _, w) in enumerate(sorted(words)[:200], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(terms, "ROWS", 11)
        monkeypatch.setattr(divergence, "CELLS", 40)
    rng = random.Random(6)
    vocab = [w + x for w in "aA é zz Q ñß \U0001f600 ".split() for x in ("", "b", "c", "bb")]
    docs = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", None, "", "\U0001f600"]), " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for _ in range(150)]
    docs += [("xx", "only", t) for t in ODD] + [("yy", "s", "lone"), ("yy", "t", None), ("en", "silent", None), ("en", "silent", "  ")] + [("en", "s1", "many same")] * 5
    frame = spark.createDataFrame([(*r, "clash", 1) for r in docs], "lang string, source string, text string, TEXT string, n int").repartition(5)
    got = divergence.audit_sources(frame)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(docs)
    assert divergence.audit_sources(frame.where("1 = 0")).collect() == []


def test_shares_are_exact_for_great_counts():
    rng = random.Random(1)
    counts = [0, 1, 10**15, *(rng.randrange(9 * 10**15) for _ in range(200))]
    totals = [c + rng.randrange(1, 10**12) for c in counts]
    got = divergence.share(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals)]


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_join(docs):
    sets = plain_sets([t for _, t in docs])
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in holders[x] if j > i)
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[top(j)] = top(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(top(i), []).append(d)
    return sorted(((d, len(sets[i]), min((x for x in least[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)), key=lambda r: [(v is not None, v) for v in r])


def edits(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("members", [256, 4])
def test_join(spark, monkeypatch, members):
    """Families whose neighbours are near the threshold, a passage in all texts, chains, and odd rows."""
    monkeypatch.setattr(shingle_join, "MEMBERS", members)
    monkeypatch.setattr(shingle_join, "ASKING", 8 * members)
    rng = random.Random(9)
    new = lambda n: [f"v{rng.randrange(10**5)}" for _ in range(n)]
    passage = new(60)
    texts = []
    for size, copies, most in ((400, 120, 12), (60, 80, 3), (30, 60, 2), (200, 40, 5), (12, 30, 1)):
        base = new(size)
        texts += [edits(rng, base, rng.randint(0, most)) for _ in range(copies)]
    chain = new(150)
    for _ in range(60):
        chain = edits(rng, chain, 2)
        texts.append(chain)
    texts += [passage + new(rng.randint(3, 80)) for _ in range(120)] + [new(rng.randint(1, 9)) for _ in range(40)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(2000 + i, t) for i, t in enumerate(ODD)]
    # The only way from one half to the other leads through a row without an id.
    way = new(100)
    steps = [way]
    for _ in range(2):
        steps.append([f"s{len(steps)}", *steps[-1][:90], "t"])
    docs += [(3001, " ".join(steps[0])), (None, " ".join(steps[1])), (3002, " ".join(steps[2])), (None, "no id at all"), (5, docs[5][1]), (5, docs[6][1])]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, text string, TEXT string, node int").repartition(4)
    got = shingle_join.jaccard_components(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(got) == plain_join(docs)
    assert shingle_join.jaccard_components(frame.where("1 = 0")).collect() == []


def test_sets_and_order():
    sets = shingle_join.shingle_sets(pa.array(ODD), 5)
    plain = plain_sets(ODD)
    assert [len(s) for s in sets] == [len(p) for p in plain]
    same = lambda x: [[i for i, b in enumerate(x) if set(a) == set(b)] for a in x]
    assert same([s.tolist() for s in sets]) == same(plain)
    counts = np.zeros(1 << shingle_join.COUNTERS, np.int64)
    tokens = np.array([5, 1 << 62, 9], np.uint64)
    counts[0] = 3
    assert shingle_join.rare_first(tokens, counts).tolist() == [1 << 62, 5, 9]


def test_shut_groups_are_not_opened():
    group = shingle_join.Group(np.array([10, 20]), [np.arange(0, 10, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64)])
    assert group.links(np.arange(0, 10, dtype=np.uint64), 80).tolist() == [10]
    assert group.links(np.arange(100, 110, dtype=np.uint64), 80).tolist() == []
    # The union holds enough, no member does.
    assert group.links(np.arange(2, 13, dtype=np.uint64), 80).tolist() == []
