"""Many queries over texts: what is written and shuffled stays below the texts, and odd keys give SQL's rows."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from webgrain import session
from webgrain.operators import postings
from webgrain.plans import registry

NAME = "bm25_of_many_queries"


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_less_disk_than_texts(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared", lambda _: f"file://{tmp_path}")
    texts = sum(len(t.encode()) for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist() if t)
    before = shuffled(spark)
    assert registry.queries()[NAME](spark, sf).count() == 400
    written = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert 0 < written and written + shuffled(spark) - before < texts


@pytest.mark.parametrize("asked,part", [(1 << 19, 1 << 22), (7, 400)])
def test_odd_keys_as_in_sql(spark, tmp_path, monkeypatch, asked, part):
    """Null and repeated keys of documents and queries, texts without terms, ties; over one block of queries and many, whole batches and small pieces."""
    monkeypatch.setattr(postings, "ASKED", asked)
    monkeypatch.setattr(postings, "PART", part)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 20]))) for _ in range(300)]
    docs = [(rng.choice([None, *range(-5, 120)]), t) for t in texts] + [(i + 500, texts[i]) for i in range(60)] + [(2**63 - 1, "w1 w2"), (900, None), (901, ""), (902, "the of")]
    asks = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(25)] + [(3, "w1 w5"), (3, "w1 w5"), (None, "w2 w3"), (None, "w7"), (60, "nowhere"), (61, None), (62, "the")]
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", asks)):
        pq.write_table(pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), tmp_path / f"{name}.parquet", row_group_size=50)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}.parquet'")
    got = registry.queries()[NAME](spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()[NAME])
    assert got.columns == want.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    got, want = sorted(map(tuple, got.collect()), key=order), sorted(want.fetchall(), key=order)
    assert [(q, d, r) for q, d, _, r in got] == [(q, d, r) for q, d, _, r in want]
    assert [s for _, _, s, _ in got] == pytest.approx([s for _, _, s, _ in want], abs=1.1e-6)


def test_no_documents_or_terms(spark):
    docs, asks = spark.createDataFrame([(1, "spark joins")], "doc_id long, text string"), spark.createDataFrame([("a", "spark"), ("b", "the")], "q string, text string")
    search = lambda d, a: [tuple(r) for r in postings.search_texts(d, "doc_id", "text", a, "q", "text").collect()]
    assert search(docs.where("1 = 0"), asks) == search(docs, asks.where("1 = 0")) == search(docs, asks.where("q = 'b'")) == []
    assert search(docs, asks) == [("a", 1, pytest.approx(0.287682), 1)]
