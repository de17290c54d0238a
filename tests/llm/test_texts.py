"""Operators over texts, held against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webgrain.llm import chunks, common, packing, pieces, pii, prefix_hash, quality, simhash, simple8b
from webgrain.llm.common import tokenizer_path

DOCS = "doc_id bigint, text string, TEXT string, n_tokens int, fingerprint string, key int"
ODD = [
    "", None, " ", "a", "  two  spaces ", "x" * 5000, "one two three", "one two three", "line\nbreak\tand tab", "日本語 テキスト 😀 é é",
    "<|endoftext|> and <|startoftext|>", "▁mark a▁b", "\x00nul \x85 next\u2028line", "İstanbul ΑΣ ΑΣ.", "word " * 3000, "12345 678 9.10", "don't we'll 's",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7, "f", 1) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None), (3, "a", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, extra string, n_tokens int, fingerprint string, key int").withColumnRenamed("extra", "TEXT")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_are_the_librarys_ids(name, real):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab cdE  \n.,'s12é日 ") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts = [t or "" for t in ODD] + made + [r["text"] for r in real.limit(60).collect()]
    tok = library(name)
    got = chunks.encoder(name).encode(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t[:60]


def test_pieces_are_the_librarys_ids():
    from sentencepiece import SentencePieceProcessor

    sp, codec = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), pieces.codec()
    rng = random.Random(2)
    made = ["".join(rng.choice("abcdefgh THE \n\t▁é日😀12.,! ") for _ in range(rng.randint(1, 90))) for _ in range(1200)]
    for t in [*ODD, *made]:
        ids = sp.encode(t or "")
        assert codec.encode(t) == ids
        assert codec.decode(ids) == sp.decode(ids)
        assert ",".join(e[1] for e in codec.entries(t)) == ",".join(map(str, ids))
    for _ in range(300):
        ids = [rng.randint(0, 600) for _ in range(15)]
        assert codec.decode(ids) == sp.decode(ids)


def test_piece_operators(docs, empty):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = sorted(map(tuple, pieces.piece_digests(docs).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = sp.encode(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert got == sorted(want, key=str)
    encoded = pieces.encode_pieces(docs)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(encoded).collect()}
    assert back[9] == ODD[9] and back[0] == "" and back[1] == ""
    assert pieces.piece_digests(empty).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 240, 8192, 8193, 50_000):
        for top in (1, 2, 50, 49408, 1 << 31, 1 << 62):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            words, offsets = simple8b.encode(ids)
            assert (simple8b.decode(words, n) == ids).all()
            for b in range(len(offsets)):
                assert (simple8b.decode_block(words, offsets, n, b) == ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()
    mixed = np.array([5, (15 << 60) + 3, 0, (1 << 64) - 1, 7], np.uint64)
    words, _ = simple8b.encode(mixed)
    assert (simple8b.decode(words, 5) == mixed).all()


def test_ids_round_trip(docs, empty):
    tok = library("word_bpe_49k.json")
    got = sorted(map(tuple, simple8b.ids_round_trip(docs).collect()), key=lambda r: r[1])
    want, start = [], 0
    bits = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + 2**63) % 2**64
    for r in sorted(docs.collect(), key=lambda r: (r[0] is not None, r[0] or 0, bits(r[1]), r[1] or "")):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert simple8b.ids_round_trip(empty).count() == 0


def check_packing(got, texts, capacity=1024):
    tok = library("byte_bpe_50k.json")
    by_doc, places = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == capacity for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist()
        assert sum(n for _, n in own) <= capacity
    total = sum(r["length"] for r in got)
    return len(places), -(-total // capacity)


def test_packing(real, docs, empty):
    got = packing.pack_documents(real.repartition(5)).collect()
    n, least = check_packing(got, {r["doc_id"]: r["text"] for r in real.collect()})
    assert n <= least * 1.03 + 1
    odd = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack_documents(odd).collect(), {r[0]: r[1] for r in odd.collect()})
    assert packing.pack_documents(docs).count() >= docs.count()
    assert packing.pack_documents(empty).count() == 0


def test_packing_over_several_rounds(real, monkeypatch):
    monkeypatch.setattr(packing, "NODE", 16)
    got = packing.pack_documents(real.repartition(12)).collect()
    n, least = check_packing(got, {r["doc_id"]: r["text"] for r in real.collect()})
    # Near what one packing of all pieces makes, even if nodes see sixteen bins each.
    lengths = np.array([r["length"] for r in got])
    assert n <= max(least, packing.best_fit(lengths, 1024)[2]) * 1.06


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, most=4):
    ids = list(fps)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("few", [12, 1])
def test_simhash(spark, real, few, monkeypatch):
    """With few = 1 all links come from forests; blocks of 8 make groups meet in pairs of blocks."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", 4096 if few > 1 else 8)
    base = real.where("doc_id < 120").select("doc_id", "text").collect()
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in base]
    for k in range(60):  # a tight group, so many share variants
        w = base[0][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edited"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, ""), (2001, None), (2002, " \n"), (2003, base[1][1]), (2003, base[1][1])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    fps = {d: plain_fingerprint(t) for d, t in rows}
    want = plain_components(fps)
    assert len(got) == len(rows)
    for r in got:
        assert r["fp"][0] % (1 << 64) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]


def test_simhash_odd_rows(docs, empty):
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("middle", [2, None])
def test_simhash_links_lead_through_rows_without_an_id(spark, monkeypatch, middle):
    """Three fingerprints, the first and the last eight bits apart, with one between them."""
    fps = spark.createDataFrame([(1, [0]), (middle, [0b1111]), (3, [0b11111111]), (None, [-1])], "doc_id bigint, fp array<bigint>")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: fps)
    got = sorted((r["fp"][0], r["component_id"]) for r in simhash.near_duplicates(fps.withColumn("text", F.lit(""))).collect())
    assert [(f, c) for f, c in got if f >= 0] == [(0, 1), (15, 1), (255, 1)] and got[0] == (-1, None)


def test_drop_near_duplicates(spark, real):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    docs = [" ".join(rng.choice(vocab) for _ in range(300)) for _ in range(60)]
    rows, copies = [(i, t) for i, t in enumerate(docs)], 0
    for i, t in enumerate(docs[:40]):
        w = t.split()
        for at in rng.sample(range(300), 3 if i % 2 else 5):  # similarity of five-word shingles 0.85 to 0.9
            w[at] = rng.choice(vocab)
        rows.append((1000 + i, " ".join(w)))
        copies += 1
    rows += [(3000, None), (3001, ""), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame).collect()}
    assert set(range(60)) | {3000, 3001, None} <= kept
    assert len([d for d in kept if d and 1000 <= d < 2000]) <= 1


def edited(rng, words, alike, vocab):
    """A text whose set of five-word shingles has about this similarity to that of the words: five shingles go with each far edit."""
    size = len(words) - 4
    out = list(words)
    for at in range(2, 5 * round(size * (1 - alike) / (1 + alike) / 5), 5):
        out[at] = rng.choice(vocab)
    return out


def jaccard(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("few", [12, 1])
def test_similar_is_exact(spark, few, monkeypatch):
    """Against brute force: pairs at 0.8 or more are found, none below is dropped; a common line many times over makes no copies."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", 4096 if few > 1 else 8)
    rng = random.Random(17)
    vocab = [f"w{i}" for i in range(20000)]
    rows, near, far = [], set(), set()
    for i in range(400):
        a = [rng.choice(vocab) for _ in range(304)]
        b = edited(rng, a, (0.6, 0.65, 0.7, 0.75, 0.82, 0.85, 0.9)[i % 7], vocab)
        rows += [(i, " ".join(a)), (1000 + i, " ".join(b))]
        (near if jaccard(a, b) >= 0.8 else far).add(1000 + i)
    short = "one two three four five six seven eight"
    rows += [(3000, short), (3001, short[:-5] + "nine")]  # three of four shingles in common: 0.6
    line = "all rights are reserved by us"
    rows += [(4000 + k, " ".join([line] * 40 + [rng.choice(vocab) for _ in range(30)])) for k in range(3)]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(near) > 150 and len(far) > 200
    assert far | set(range(400)) | {3000, 3001, 4000, 4001, 4002} <= kept
    assert len(near & kept) <= 0.02 * len(near)


def test_similar_in_a_large_family(spark):
    """Texts edited from one, most pairs just below 0.8: the groups are those of all pairs at 0.8 or more."""
    rng = random.Random(31)
    base = [f"w{rng.randrange(3000)}" for _ in range(404)]
    texts = []
    for k in range(500):
        words = list(base)
        for at in rng.sample(range(404), rng.randint(4, 8)):
            words[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{rng.randrange(3000)}" for _ in range(200)) for _ in range(20)]
    sets = [{t.split()[i] + " " + " ".join(t.split()[i + 1 : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    place = list(range(len(texts)))

    def top(i):
        while place[i] != i:
            i = place[i]
        return i

    for i, j in near:
        a, b = sorted((top(i), top(j)))
        place[b] = a
    rows = [(i, t) for i, t in enumerate(texts)]
    groups = {}
    for r in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        groups.setdefault(r["root"], set()).add(r["id"])
    want = {}
    for i in range(len(texts)):
        want.setdefault(top(i), set()).add(i)
    assert len(near) > 1000 and len(want) < len(texts)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_drop_near_duplicates_by_row(spark):
    """Repeated rows, rows without an id and ids with two texts, each with and without copies."""
    rng = random.Random(23)
    made = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(120))
    a, b, c, d, e, f = (made() for _ in range(6))
    rows = [(5, a), (5, a), (5, a), (9, a)]  # repeated, and a copy of it
    rows += [(None, b), (None, b), (None, b + " more")]  # near-copies without an id
    rows += [(3, c), (7, c), (7, d)]  # 7 has a copy of 3 and a clean text
    rows += [(None, e), (8, e)]  # a copy with an id
    rows += [(6, f), (6, f + " more")]  # one id, two near-copies
    rows += [(20, ""), (20, ""), (21, ""), (None, " "), (None, " "), (22, None)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, other int")
    got = simhash.drop_near_duplicates(frame)
    assert got.columns == frame.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    near_b, near_f = {(None, b), (None, b + " more")} & set(kept), {(6, f), (6, f + " more")} & set(kept)
    assert len(near_b) == len(near_f) == 1
    want = [(5, a), (3, c), (7, d), (8, e), *near_b, *near_f, (20, ""), (21, ""), (None, " "), (None, " "), (22, None)]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_nearest_forest():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 12, (80, 4)).astype(np.uint64)
    for most in (8, 14, 18):
        pairs = [(i, j) for i in range(80) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]).sum() <= most]
        groups = []
        for links in (pairs, simhash.nearest_forest(fps, most).tolist()):
            root = list(range(80))
            for i, j in links:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
            groups.append(root)
        assert groups[0] == groups[1]


def test_variant_links():
    """Values that differ in one bit share a variant, in two none do; other groups don't meet."""
    fps = np.zeros((5, 4), np.uint64)
    group, other = np.array([0, 0, 0, 1, 2]), np.array([0b0, 0b100, 0b111, 0b0, 0b0])
    links = np.concatenate(list(simhash.variant_links(group, other, fps, 56)))
    assert sorted(map(sorted, links.tolist())) == [[0, 1]]


def test_candidates_connect_by_variants_in_few_rows(spark):
    """Rows near each other come back as links that connect them, not as a row for each key; none lead to rows that are far."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, 256)
    near = [base ^ (rng.random(256) < 0.07) for _ in range(300)]
    far = list(rng.integers(0, 2, (40, 256)))
    fps = [np.packbits(b.astype(bool)).view(np.int64).tolist() for b in near + far]
    rows = spark.createDataFrame(list(enumerate(fps)), "id bigint, fp array<bigint>")
    links = [(r["u"], r["v"]) for r in simhash.candidates(rows, 4, simhash.STAGE["deals"], 56).collect()]
    assert len(links) <= 4 * 299  # four tasks
    place = list(range(340))
    for u, v in links:
        place = [place[v] if x == place[u] else x for x in place]
    assert len(set(place[:300])) == 1 and len(set(place)) == 41


def test_verified_in_blocks(spark, monkeypatch):
    """A cluster dealt out in pairs of blocks has the links of all its pairs, and no others."""
    monkeypatch.setattr(simhash, "SETS", 4)
    sets = [(i, list(range(2 * i, 2 * i + 20))) for i in range(30)] + [(30, list(range(500, 520)))]
    frame = spark.createDataFrame(sets, "node bigint, tokens array<bigint>")
    links = simhash.verified(frame.selectExpr("node", "0L AS root"), frame, 80).collect()
    place = list(range(31))
    for r in links:
        place = [place[r["v"]] if x == place[r["u"]] else x for x in place]
    assert len(set(place[:30])) == 1 and len(set(place)) == 2


def test_prefix_hash():
    rng = random.Random(5)
    texts = ["", "a", "ab" * 30] + ["".join(rng.choice("abé😀") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for a in texts:
        ha = prefix_hash.PrefixHash(a)
        for b in rng.sample(texts, 20):
            hb = prefix_hash.PrefixHash(b)
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            want = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
            assert ha.forward(i, hb, j) == want
            want = next((k for k in range(min(i, j)) if a[i - 1 - k] != b[j - 1 - k]), min(i, j))
            assert ha.backward(i, hb, j) == want
            assert (ha.fingerprint() == hb.fingerprint()) == (a == b)

    for a in texts:
        for width in (1, 5, 12, 100):
            want = {sum((ord(c) + 1) * pow(prefix_hash.BASES[0], j, prefix_hash.MODULI[0]) for j, c in enumerate(w)) % prefix_hash.MODULI[0] for w in plain_windows(a, width)}
            assert set(prefix_hash.PrefixHash(a).windows(width).tolist()) == want


def plain_windows(t, width):
    return {t[i : i + width] for i in range(max(1, len(t) - width + 1))} if t else set()


def test_likeness_is_near_the_shared_spans():
    """Against brute force over all spans, with moved, inserted and replaced passages; the fingerprints alone decide."""
    rng = random.Random(15)
    off = []
    for n in (5, 60, 700, 6000):
        for _ in range(25):
            a, b = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for _ in "ab")
            i = rng.randint(0, n)
            for c in (a[:i] + b[i:], a[i:] + a[:i], a[:i] + b[: n // 5] + a[i:], b, a + a):
                x, y = plain_windows(a, prefix_hash.WIDTH), plain_windows(c, prefix_hash.WIDTH)
                j = len(x & y) / len(x | y)
                got = prefix_hash.likeness(*(prefix_hash.PrefixHash(t).fingerprint() for t in (a, c)))
                assert 0 <= got <= 1 and (a != c or got == 1)
                off.append(abs(got - 2 * j / (1 + j)))
    assert max(off) < 0.3 and sum(off) / len(off) < 0.04
    # Repeats: few distinct spans in a long text.
    assert prefix_hash.likeness(*(prefix_hash.PrefixHash(t).fingerprint() for t in ("ab" * 9000, "ab" * 8000))) == 1
    assert prefix_hash.likeness(*(prefix_hash.PrefixHash(t).fingerprint() for t in ("", "abc"))) == 0


def test_neighbours(spark):
    rng = random.Random(4)
    numbers = {*range(-5, 5000, 3), *(rng.randrange(-(1 << 56), 1 << 56) for _ in range(300)), -(1 << 60)}
    order = sorted(numbers)
    got = prefix_hash.neighbours(spark.createDataFrame([(n,) for n in numbers], "own bigint")).collect()
    assert sorted(map(tuple, got)) == list(zip(order, [*order[1:], order[0]], strict=True))
    assert prefix_hash.neighbours(spark.createDataFrame([(7,)], "own bigint")).first()["after"] == 7


def plain_edits(rows):
    bits = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) >> 48
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), bits(r[1]), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        f = [prefix_hash.PrefixHash(x).fingerprint() for x in (t, e, n)]
        same = next((k for k in range(len(t)) if t[k] != e[k : k + 1]), len(t))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f[0], f[1], prefix_hash.likeness(f[0], f[1]), prefix_hash.likeness(f[0], f[2]), min(same, len(e))))
    return out


def test_edit_fingerprints(spark, real, docs, empty):
    for frame in (real.select("doc_id", "text"), common.pick(docs, doc_id="doc_id", text="text"), real.select((F.col("doc_id") * 977 - 5000).alias("doc_id"), "text")):
        got = sorted(map(tuple, prefix_hash.edit_fingerprints(frame).collect()), key=str)
        assert got == sorted(plain_edits([tuple(r) for r in frame.collect()]), key=str)
    one = spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")
    assert prefix_hash.edit_fingerprints(one).first()["near_next"] == 1.0
    assert prefix_hash.edit_fingerprints(empty).count() == 0


def test_repeated_and_null_keys_are_parted(spark):
    """One key and null each hold a third of the rows: their blocks are many parts, and the order is still that of one list."""
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))) for k in [7] * 60 + [None] * 60 + list(range(-30, 30))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    ordered = prefix_hash.in_order(frame, crowd=20)
    lists = ordered.withColumn("p", F.spark_partition_id()).collect()
    after = {}
    for a, b in zip(lists, lists[1:]):
        if a["p"] == b["p"] and not a["extra"]:
            after.setdefault((a["key"], a["text"]), []).append((b["key"], b["text"]))
    bits = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 48
    want = {}
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), bits(r[1]), r[1]))
    for a, b in zip(line, [*line[1:], line[0]]):
        want.setdefault(a, []).append(b)
    assert {k: sorted(v, key=str) for k, v in after.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert sum(r["extra"] for r in lists) > 60


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(EMAIL, t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(IP, t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, t):
        d = re.sub(r"\D", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        out += [(m.start(), m.end(), "card")] if 14 <= len(d) <= 19 and s % 10 == 0 else []
    out += [(m.start(), m.end(), "phone") for m in re.finditer(PHONE, t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans():
    rng = random.Random(6)
    made = ["".join(rng.choice(["a", "b.", "@", "1", "22", ".", "-", " ", "+", "(", ")", "@x.y", "4111111111111111", "+1 555 123 4567", "10.0.0.1", "é"]) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    for t in made + [t or "" for t in ODD]:
        assert pii.base_spans(t) == plain_spans(t), t


def test_field_adds_other_spellings_only_beside_a_base_span():
    model = pii.trained()
    text = "Card 4111 1111 1111 1111 was used; later 4111.1111.1111.1111 again. Number 90210 and 12345678."
    base = pii.base_spans(text)
    assert [text[a:b] for a, b, _ in pii.added_spans(text, base, model)] == ["4111.1111.1111.1111"]
    clean = "Order 12345678 of 2024-05-06, call (555) 123-4567 or 4111.1111.1111.1111, @home v1.2.3"
    assert not pii.added_spans(clean, pii.base_spans(clean), model)


@pytest.mark.parametrize(
    "text, want",
    [
        # Two mentions side by side are over nineteen digits together.
        ("card 4111 1111 1111 1111 again as 4111.1111.1111.1111, 555.123.4567 end", {"4111.1111.1111.1111"}),
        ("card 4111 1111 1111 1111 again as 4111.1111.1111.1111 12/2027 end", {"4111.1111.1111.1111"}),
        ("card 4111 1111 1111 1111, 4111.1111.1111.1111, 20240101 end", {"4111.1111.1111.1111"}),
        # Addresses of fewer than seven digits, also beside their plain form.
        ("host 10.0.0.1 is the same as 10[.]0[.]0[.]1 here", {"10[.]0[.]0[.]1"}),
        ("host 10.0.0.1 (10[.]0[.]0[.]1) here", {"10[.]0[.]0[.]1"}),
        ("hosts 8.8.8.8 and then 10[.]0[.]0[.]1, 8[.]8[.]8[.]8 here", {"8[.]8[.]8[.]8"}),
    ],
)
def test_mentions_side_by_side(text, want):
    base = pii.base_spans(text)
    assert {text[a:b] for a, b, _ in pii.added_spans(text, base, pii.trained())} == want


def test_mentions_are_parts():
    rng = random.Random(12)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789 ., .-()[]/+@a") for _ in range(rng.randint(0, 90)))
        spans = pii.mentions(text, pii.base_spans(text))
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert pii.mentions("10[.]0[.]0[.]1, 1, 2, 3, 4") == [(0, 14)]
    assert pii.mentions("1 2 " * 30) == []
    text = "4111.1111.1111.1111, 555.123.4567"
    assert [text[a:b] for a, b in pii.mentions(text)] == text.split(", ")


def test_zero_padded_parts_and_many_base_spans():
    text = "0" * 400 + "10.0.0.1 and 300.1.1.1 and " + "1" * 400 + ".1.1.1"
    assert pii.base_spans(text) == plain_spans(text) and pii.base_spans(text)[0][2] == "ip"
    # Many base spans before and around a mention.
    text = "10.0.0.1 " * 40 + "10[.]0[.]0[.]1 " + "10.0.0.1 " * 40
    base = pii.base_spans(text)
    assert [text[a:b] for a, b, _ in pii.added_spans(text, base, pii.trained())] == ["10[.]0[.]0[.]1"]


def test_covers():
    rng = random.Random(14)
    for _ in range(500):
        cut = sorted(rng.sample(range(100), 12))
        found = list(zip(cut[::2], cut[1::2]))
        base = sorted((a, a + rng.randint(1, 30), rng.choice(pii.KINDS)) for a in rng.sample(range(100), 5))
        for (a, b), got in zip(found, pii.covers(found, base)):
            kinds = [k for s, e, k in base if s < b and e > a]
            assert got in kinds if kinds else got is None


def every_labelling(model, x, ends):
    import itertools

    k, total = len(pii.LABELS), 0.0
    out = np.zeros((len(x), k))
    for y in itertools.product(range(k), repeat=len(x)):
        score = sum((x[i] @ model.unary)[v] for i, v in enumerate(y)) + sum(table[y[i], y[j]] for table, pairs in zip(model.pair, ends) for i, j in pairs)
        for i, v in enumerate(y):
            out[i, v] += np.exp(score)
        total += np.exp(score)
    return out / total


def test_marginals_against_all_labellings():
    """Exact on trees; close where skip edges close loops."""
    rng = np.random.default_rng(5)
    pairs = lambda *e: np.array(e, int).reshape(-1, 2)
    for _ in range(6):
        model = pii.SkipChain(rng.normal(size=(4, 5)), *(t + t.T for t in rng.normal(size=(3, 5, 5)) / 2))
        x = rng.normal(size=(5, 4))
        for ends in ((pairs((0, 1), (1, 2)), pairs((0, 3)), pairs((3, 4))), (pairs(), pairs(), pairs())):
            assert np.abs(model.marginals(x, *ends) - every_labelling(model, x, ends)).max() < 1e-4
        loop = (pairs((0, 1), (1, 2), (2, 3)), pairs((0, 2)), pairs((1, 3), (0, 4)))
        assert np.abs(model.marginals(x, *loop) - every_labelling(model, x, loop)).max() < 0.2
    # On the trained model, with a mention that only its far twin supports.
    model, text = pii.trained(), "call +1 (212) 555-4567 now " + "and so on " * 9 + "or 212.555.4567 or " + "and so on " * 9 + "12345678"
    base = pii.base_spans(text)
    found = pii.mentions(text, base)
    x = np.array([pii.node_features(text[a:b], c) for (a, b), c in zip(found, pii.covers(found, base))])
    assert len(found) == 3
    with_skip, ends = model.marginals(x, *pii.edges(text, found)), pii.edges(text, found)
    assert np.abs(with_skip - every_labelling(model, x, ends)).max() < 1e-3
    alone = model.marginals(x, ends[0], pairs(), pairs())
    assert with_skip[1, 4] > 0.9 and alone[1, 0] > 0.9  # the skip edge decides


def test_field_precision_and_recall_in_real_texts(real):
    """Spellings that no pattern finds, planted far from their plain form into texts of the table; others planted without one."""
    model, rng = pii.trained(), np.random.default_rng(21)
    texts = [r["text"] for r in real.where("length(text) > 600").limit(150).collect()]
    right = wrong = missed = 0
    for text in texts:
        before = pii.added_spans(text, pii.base_spans(text), model)
        assert not before, "nothing is added to texts as they are"
        kind = pii.KINDS[rng.integers(4)]
        plain, other = pii._entity(rng, kind)
        if len(pii.digits_of(other)) == 7:
            continue  # a local number without its area is left alone more often
        alone = pii._entity(rng, pii.KINDS[rng.integers(4)])[1]
        words = text.split(" ")
        third = len(words) // 3
        made = " ".join([*words[:third], plain, *words[third : 2 * third], other, *words[2 * third :], "and", alone])
        got = [(made[a:b], k) for a, b, k in pii.added_spans(made, pii.base_spans(made), model)]
        hit = [g for g in got if g[1] == kind and (g[0] in other or other in g[0])]
        right, wrong, missed = right + bool(hit), wrong + len(got) - len(hit), missed + (not hit)
    assert right > 80 and right / (right + missed) >= 0.95 and wrong <= 0.02 * right


def test_personal_data(docs, empty, spark):
    got = pii.find_personal_data(docs).collect()
    assert len(got) == docs.count() and pii.find_personal_data(empty).count() == 0
    frame = spark.createDataFrame([(1, "mail a.b@c.de or +1 555 123 4567", "k", 3), (2, None, None, None)], "doc_id bigint, text string, spans string, n_chars bigint")
    rows = {r["doc_id"]: r for r in pii.redact(frame).collect()}
    assert rows[1]["text"] == "mail [EMAIL] or [PHONE]" and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["text"] is None


def test_quality(spark, sf, docs, empty):
    sf = sf.replace("sf0.001", "sf0.01")
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(frame, labels).collect()
    assert len(rows) == frame.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    odd = quality.score_quality(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score_quality(empty, labels).count() == 0
    assert quality.score_quality(docs, labels.where("1 = 0")).count() == docs.count()
    assert quality.keep_quality(frame, labels).count() == sum(r["predicted"] for r in rows)


def test_quality_scores_are_the_networks(spark, sf):
    """Against the network spelled out: bucket vectors averaged over all words and n-grams, then a softmax; also on a text too long to be learned from."""
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    long = spark.createDataFrame([(-5, "some words of a long text " * 900)], "doc_id bigint, text string")
    texts = {r["doc_id"]: r["text"] or "" for r in frame.select("doc_id", "text").unionByName(long).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    ids = [d for d in truth if d in texts and len(texts[d]) <= quality.TRAIN_CHARS]
    by_hash = lambda d: (xxhash.xxh64_intdigest(np.int64(d).tobytes(), 42) + 2**63) % 2**64
    ids.sort(key=by_hash)
    vectors, weights, bias = quality.train([texts[d] for d in ids], [truth[d] for d in ids])
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(frame.select("doc_id", "text").unionByName(long), labels).collect()}
    value = lambda raw: sum((c + 1) * pow(quality.WEIGHT, i, 1 << 64) for i, c in enumerate(raw)) % (1 << 64)
    bucket = lambda v, kind: (v + kind) % (1 << 64) * 0xD6E8FEB86659FD93 % (1 << 64) >> 48
    for d, t in [*texts.items()][:60] + [(-5, texts[-5])]:
        found = []
        for w in t.split() or [""]:
            raw = f" {w} ".encode()
            found += [bucket(value(w.encode()), 0)] + [bucket(int.from_bytes(raw[i : i + n], "big"), n) for n in quality.GRAMS for i in range(len(raw) - n + 1) if b" " not in raw[i + 1 : i + n - 1]]
        words = [value(w.encode()) for w in t.split() or [""]]
        found += [bucket((v - u) % (1 << 64), 1) for u, v in zip(words, words[1:])]
        z = vectors[found].mean(0) @ weights + bias
        assert abs(got[d] - np.exp(z[1]) / np.exp(z).sum()) < 1e-4


def test_quality_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    scorer = quality.Scorer(rng.normal(size=quality.BUCKETS), 0.1)
    texts = [*ODD, "é  a\u2003b\x1cc", "x" * 3_000_000, "a b " * 400_000]
    alone = [scorer.scores([t])[0] for t in texts]
    assert scorer.scores(texts) == alone and scorer.scores(texts[::-1]) == alone[::-1] and scorer.scores([]) == []


def test_quality_learns_from_one_text_an_id(spark, sf):
    """Repeated rows of an id are one text to learn from; an id with both labels is none; order and repeats of rows change no score."""
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    plain = {r["doc_id"]: r["score"] for r in quality.score_quality(frame, labels).collect()}
    again = frame.unionAll(frame).unionAll(frame).repartition(7)
    both = labels.unionAll(labels).unionAll(spark.createDataFrame([(-9, 0), (-9, 1)], "doc_id bigint, quality int"))
    contrary = again.unionAll(spark.createDataFrame([(-9, "with both labels " * 50)], "doc_id bigint, text string"))
    got = quality.score_quality(contrary, both.repartition(5)).where("doc_id >= 0").distinct().collect()
    assert {r["doc_id"]: r["score"] for r in got} == plain and len(got) == len(plain)


def test_quality_long_texts_take_no_place_from_others(spark, monkeypatch):
    """Where most texts of a class are too long to be learned from, the others are learned from all the same."""
    monkeypatch.setattr(quality, "TRAIN_ROWS", 5)
    rows = [(i, "bad words " * (3000 if i % 4 else 3), 0) for i in range(40)] + [(i, "good text here " * 3, 1) for i in range(40, 80)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append(labels) or (np.zeros((quality.BUCKETS, 2)), np.zeros((2, 2)), np.zeros(2)))
    quality.fit(frame, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int"))
    short = sum(1 for i, _, y in rows if y == 0 and i % 4 == 0 and zlib.crc32(str(i).encode()) % 4 != 2)
    assert seen[0].count(0) == min(5, short) > 0 and seen[0].count(1) == 5


@pytest.mark.parametrize("name", ["quality classifier", "simhash near-dedup", "personal data"])
def test_stages_keep_clashing_columns_repeats_and_empty_tables(spark, sf, docs, empty, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, sf)
    assert got.columns == docs.columns
    kept, had = got.toDF(*"abcdef").collect(), docs.toDF(*"abcdef").collect()
    assert {r[0] for r in kept} <= {r[0] for r in had} and all(r[2] in ("clash", None) for r in kept)
    if name == "personal data":
        assert len(kept) == len(had)
    if name == "simhash near-dedup":
        # Texts without words and one of each other group; id 6 and 7 say the same, id 3 says "a" and once more under its own id.
        assert {r[0] for r in kept} == set(range(len(ODD))) - {7} | {None}
    again = stage(spark, docs.unionAll(docs), sf).count()
    assert again == (len(kept) if name == "simhash near-dedup" else 2 * len(kept))
    assert stage(spark, empty, sf).count() == 0 and stage(spark, empty, sf).columns == docs.columns


def test_a_key_of_many_rows_is_many_parts_of_the_written_ids(spark):
    rows = [(7, f"text {i}") for i in range(400)]
    path = common.shared_path(spark, "ids-test")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # the table is small
    try:
        simple8b.write_ids(spark.createDataFrame(rows, "doc_id bigint, text string"), path)
    finally:
        spark.conf.unset(coalesce)
    assert spark.read.parquet(path).select("part").distinct().count() > 1


def test_registered_queries_against_plain_versions(spark, sf, real):
    """Each query as it is registered, on its whole table."""
    from sentencepiece import SentencePieceProcessor

    from webgrain.llm import queries

    texts = {r["doc_id"]: r["text"] for r in real.select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    # op4
    n, least = check_packing(queries.op4_best_fit_packing(spark, sf).collect(), texts)
    assert n <= least * 1.03 + 1
    # op5
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    roots = plain_components(fps)
    assert {tuple(r) for r in queries.op5_simhash_near_dedup(spark, sf).collect()} == {(d, f"{fps[d]:016x}", roots[d]) for d in texts}
    # op7
    for r in queries.op7_personal_data(spark, sf).collect():
        base = plain_spans(texts[r["doc_id"]] or "")
        said = [f"{k}:{a}:{b}" for a, b, k in base]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == sha(",".join(said)) and set(said) <= set(r["spans"].split(",") if r["spans"] else [])
    # op8
    tok, at = library("word_bpe_49k.json"), 0
    got = {r["doc_id"]: tuple(r) for r in queries.op8_token_ids(spark, sf).collect()}
    for d in sorted(texts):
        ids = [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        assert got[d] == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    # op9
    sp = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in queries.op9_sentencepiece(spark, sf).collect():
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    # op10
    assert sorted(map(tuple, queries.op10_document_fingerprints(spark, sf).collect()), key=str) == sorted(plain_edits(list(texts.items())), key=str)
    # op3
    scored = queries.op3_quality_classifier(spark, sf).collect()
    assert {r["doc_id"] for r in scored} == set(texts) and len(scored) == len(texts)
