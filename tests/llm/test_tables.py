"""Archives, search, conversations, and the pipeline."""

import gzip
import hashlib
import io

import duckdb
import numpy as np
import pytest

from webgrain.llm import chat, queries, topk, warc
from webgrain.llm.common import shared_path


def same(frame, sql, sf, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql)
    cols = sorted(want.columns)
    assert sorted(frame.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_archives_against_sql(spark, sf):
    same(queries.op1_warc_normaliser(spark, sf), queries.OP1_SQL, sf, ["pages"])


def pages(spark):
    big = "x" * 200
    rows = [(1, "http://a/", big, "z"), (2, "http://b/\r\nX: y", big, "z"), (3, None, "short", None), (4, "u", "short", None), (5, "u", None, None), (6, "u", "", None), (7, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\n", None), (-8, "u", big, None), (7, "v", "é" * 60 + "\r\n\r\nWARC/1.1\r\n", None), (None, "n", big, None), (9, "u", "y" * 3_000_000, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")


@pytest.mark.parametrize("few", [100_000, -1])
def test_archives(spark, few, monkeypatch):
    monkeypatch.setattr(warc, "FEW", few)
    frame = pages(spark)
    got = sorted((tuple(r) for r in warc.archive_round_trip(frame).collect()), key=str)
    want = []
    first = {}
    for r in frame.collect():
        data = (r["html"] or "").encode()
        if r["page_id"] is not None and len(data) >= 100:
            first[data] = min(first.get(data, r["page_id"]), r["page_id"])
    for r in frame.collect():
        data = (r["html"] or "").encode()
        refers = first[data] if len(data) >= 100 and r["page_id"] is not None and first[data] != r["page_id"] else None
        want.append((r["page_id"], len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(frame.where("1 = 0")).count() == 0


def test_normalised_archives_are_one_member_a_record(spark):
    path = shared_path(spark, "test-warc")
    frame = pages(spark)
    assert warc.largest_payload(frame) == 3_000_000
    warc.write_archives(warc.with_revisits(frame.repartition(2)), f"{path}/whole", 3_000_000)
    warc.normalise(spark, f"{path}/whole", f"{path}/out")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/out/archives").select("path", "content").collect()
    index = spark.read.parquet(f"{path}/out/index").collect()
    assert sum(len(list(warc.parse(iter([gzip.decompress(f["content"])])))) for f in files) == len(index) == 11
    for line in index:
        content = next(f["content"] for f in files if f"archive={line['archive']}/" in f["path"].replace("%3D", "="))
        record = gzip.GzipFile(fileobj=io.BytesIO(content[line["start"] : line["start"] + line["size"]])).read()
        assert [h["warc-record-id"] for h, _ in warc.parse(iter([record]))] == [line["record_id"]]
    # Of some records only, by the index.
    asked = spark.createDataFrame([("<urn:page:9>",), ("<urn:page:7>",), ("<urn:page:404>",), ("<urn:page:7>",)], "id string")
    got = sorted((r["record_id"], bytes(r["payload"])) for r in warc.read_records(spark, f"{path}/out", asked).collect())
    text = ("é" * 60 + "\r\n\r\nWARC/1.1\r\n").encode()
    assert got == [("<urn:page:7>", text), ("<urn:page:7>", text), ("<urn:page:9>", b"y" * 3_000_000)]


def test_members_are_found_by_their_lengths():
    records = [b"", b"a" * 70_000, bytes(range(256)) * 9]
    made = [warc.member(r) for r in records]
    assert [gzip.decompress(m) for m in made] == records
    found = list(warc.members(b"".join(made) + b"\0"))
    assert found == [(0, len(made[0])), (len(made[0]), len(made[1])), (len(made[0]) + len(made[1]), len(made[2]))]
    untold = [m[:16] + bytes(8) + m[24:] for m in made]  # as of members over 32 bits
    assert list(warc.members(b"".join(untold))) == found
    with pytest.raises(ValueError):
        list(warc.members(gzip.compress(b"other")))


def test_archives_are_bounded_by_bytes(spark):
    """With records of all classes in one partition, no archive holds over 64 MiB of payloads unless one record does."""
    path = shared_path(spark, "test-bounds")
    frame = spark.range(4200).selectExpr("id AS page_id", "'u' AS url", "concat(id, repeat('x', CASE WHEN id % 60 = 0 THEN 1500000 WHEN id % 40 = 1 THEN 70000 ELSE 50 END)) AS html").coalesce(1)
    warc.write_archives(warc.with_revisits(frame), f"{path}/whole", warc.largest_payload(frame))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/whole").select("content")
    sizes = [sum(map(len, warc.inflate(r["content"]))) for r in files.toLocalIterator()]
    assert max(sizes) < 65 << 20 and len(sizes) == 4 + 2 + 9


def test_parse_in_small_pieces():
    record = warc.record_bytes({"WARC-Type": "response", "Content-Length": "5"}, b"\r\n\r\nz") * 3
    for step in (1, 2, 7, 1000):
        got = list(warc.parse(record[i : i + step] for i in range(0, len(record), step)))
        assert [p for _, p in got] == [b"\r\n\r\nz"] * 3
    with pytest.raises(ValueError):
        list(warc.parse(iter([record[:-8]])))


def test_top_k_against_sql(spark, sf):
    same(queries.op2_exact_top_k(spark, sf), queries.OP2_SQL, sf, ["embeddings"])


@pytest.mark.parametrize("cell", [16_384, 16])
def test_top_k(spark, cell, monkeypatch):
    monkeypatch.setattr(topk, "CELL", cell)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=20).round(2)]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # one vector many times: ties
    rows += [(2000, None), (2050, [float("nan")] * 20), (2100, [None] + [1.0] * 19), (None, [1.0] * 20), (2150, [float("inf")] + [0.0] * 19)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string")
    got = sorted(tuple(r) for r in topk.top_k(frame).collect())
    fine = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in fine if i % 50 == 0):
        best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(frame.where("vec_id < 3")).count() == 2
    assert topk.top_k(frame.where("1 = 0")).count() == 0


def test_top_k_of_large_components_several_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(9e7, 9.5e7, 6).tolist()) for i in range(60)]  # scores over 2**53
    rows += [(100 + i, rng.integers(-(1 << 40), 1 << 40, 3).tolist()) for i in range(60)]  # over 2**63
    rows += [(300 + i % 3, rng.integers(-5, 5, 2).tolist()) for i in range(9)]  # repeated ids
    frame = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(frame).collect())
    whole = [(i, [int(np.floor(256 * (x / 256))) for x in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        own = min(v for i, v in whole if i == q)
        score = lambda v: min(max(sum(a * b for a, b in zip(own, v)), -(1 << 63)), (1 << 63) - 1)
        best = sorted((-score(v), i) for i, v in whole if i != q and len(v) == len(own))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == want


def plain_chat(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.instruct([(r, x)])) for _, r, x in turns)))
    return sorted(out, key=str)


def test_conversations(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    want = plain_chat([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows.collect()] + [(-7, *t) for t in chat.HOSTILE[1]])
    assert sorted((tuple(r) for r in queries.op6_chat_formatting(spark, sf).collect()), key=str) == want
    odd = [(1, 0, "user", "a\\[INST]"), (1, 1, "assistant", "</s>\\"), (2, 0, None, None), (2, 0, "assistant", ""), (3, None, "role\n[INST]x", "[/INST]</s>\n<s>"), (3, 5, "assistant", "\ue000 [[INST]/INST]"), (None, 1, "assistant", "x"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same")]
    frame = spark.createDataFrame([(*o, 1) for o in odd], "conv_id bigint, turn bigint, role string, text string, formatted int")
    key = [(c, -1 if t is None else t, r, x) for c, t, r, x in odd]
    assert sorted((tuple(r) for r in chat.read_back(chat.format_conversations(frame)).collect()), key=str) == plain_chat(key)
    assert chat.format_conversations(frame.where("1 = 0")).count() == 0


def test_templates_that_say_so_are_rendered_in_blocks():
    """The same spans as from all prefixes, in linear work; what a template says of itself is checked."""
    turns = [("user" if k % 2 == 0 else "assistant", f"said {k} " * (k % 5)) for k in range(700)]
    assert chat.spans(turns, chat.instruct) == chat.prefixes(turns, chat.instruct)
    sizes = []

    def headed(t):
        sizes.append(len(t))
        return "<<" + chat.instruct(t)

    want = chat.prefixes(turns, headed)
    assert chat.spans(turns, headed) == want
    sizes.clear()
    headed.additive = True
    assert chat.spans(turns, headed) == want and chat.spans([], headed) == ("", [])
    assert sum(sizes) < 2 * 35 * len(turns) + 2 * len(turns)

    def numbered(t):
        return "".join(f"{k}. {r}: {x}\n" for k, (r, x) in enumerate(t))

    assert chat.spans(turns, numbered) == chat.prefixes(turns, numbered)
    numbered.additive = True
    with pytest.raises(chat.HistoryRewritten):
        chat.spans(turns, numbered)


@pytest.mark.parametrize("n", [138, 200, 300, 700])
def test_rewriting_is_told_at_any_length(n):
    """A template that writes other marks for one number of turns alone."""

    def once(t):
        return chat.instruct(t).replace("<s>", "<S>") if len(t) == 137 else chat.instruct(t)

    with pytest.raises(chat.HistoryRewritten):
        chat.spans([("user", str(k)) for k in range(n)], once)


def test_templates_that_rewrite_history():
    def counting(turns):
        return f"{len(turns)} turns\n" + "".join(f"{r}: {x}\n" for r, x in turns)

    with pytest.raises(chat.HistoryRewritten):
        chat.spans([("user", "a"), ("assistant", "b")], counting)
    assert chat.escape("[INST]") == "[\\INST]" and chat.unescape(chat.escape("\\[INST]</s>")) == "\\[INST]</s>"


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert 0 < len(rows) <= before.count()
        before = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in before.collect()}


def test_archives_over_several_row_groups(spark):
    """Members of one archive that lie in several row groups, each read as a split of its own, still make one file."""
    frame = spark.range(1500).selectExpr("id AS page_id", "concat('http://a/', id) AS url", "concat_ws(' ', transform(sequence(1, 30), i -> sha2(concat(id, '-', i), 256))) AS html").coalesce(1)
    conf, hadoop = "spark.sql.files.maxPartitionBytes", spark._jsc.hadoopConfiguration()
    was = spark.conf.get(conf)
    path = shared_path(spark, "split")
    warc.write_archives(warc.with_revisits(frame, "page_id", "html", "url").coalesce(1), f"{path}/whole", 4096)
    try:
        spark.conf.set(conf, "64k")
        hadoop.set("parquet.block.size", "65536")
        warc.normalise(spark, f"{path}/whole", f"{path}/out")
    finally:
        spark.conf.set(conf, was)
        hadoop.unset("parquet.block.size")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/out/archives").selectExpr("regexp_extract(path, '/archive=([^/]+)/', 1) AS archive")
    assert files.count() == files.distinct().count()
    got = warc.read_archives(spark, f"{path}/out").select(warc.page_of("record_id").alias("page_id"), "payload_digest")
    want = frame.selectExpr("page_id", "sha2(html, 256) AS payload_digest")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
