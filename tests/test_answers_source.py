"""The store of answers: filters reach it, failed writes leave nothing, a stream reads each commit once."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webgrain.sources import answers

ROWS = [("a", 1, datetime(2024, 1, 1), "x"), ("b", 2, datetime(2024, 2, 1), "y" * 100_000), (None, 3, None, None), ("a", 4, datetime(2024, 3, 1), ""), ("ü/..", 5, datetime(1960, 1, 1, 0, 0, 0, 7), "é")]


@pytest.fixture
def store(spark, tmp_path):
    answers.register(spark)
    path = f"file://{tmp_path}/store"
    for r in ROWS:
        spark.createDataFrame([r], answers.SCHEMA).coalesce(1).write.format("answers").mode("append").save(path)
    return path


def files(path):
    return sorted(os.listdir(path.removeprefix("file://")))


def test_read_back_and_prune(spark, store):
    read = spark.read.format("answers").load(store)
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(read.collect()) == key(ROWS)
    for condition, want, parts in [
        (F.col("provider") == "a", {1, 4}, 2),
        (F.col("provider").isin("a", "b"), {1, 2, 4}, 3),
        ((F.col("provider") == "a") & (F.col("provider") == "b"), set(), 0),
        (F.col("provider") == "ü/..", {5}, 1),
        (F.col("fetched_at") >= datetime(2024, 2, 1), {2, 4}, 2),
        (F.col("fetched_at") > datetime(2024, 2, 1), {4}, 2),
        (F.col("fetched_at") == datetime(2024, 2, 1), {2}, 1),
        ((F.col("fetched_at") < datetime(2024, 2, 1)) & (F.col("provider") == "a"), {1}, 1),
        (F.col("fetched_at").isNull(), {3}, 5),
        (F.col("provider").isNull(), {3}, 5),
        (F.col("provider") != "a", {2, 5}, 5),
        ((F.col("provider") == "a") | (F.col("request") == 2), {1, 2, 4}, 5),
    ]:
        chosen = read.where(condition)
        assert {r["request"] for r in chosen.collect()} == want, str(condition)
        assert chosen.rdd.getNumPartitions() <= max(parts, 1), str(condition)


def test_plan_shows_the_pushed_filter(spark, store, capsys):
    spark.read.format("answers").load(store).where("provider = 'a'").explain("formatted")
    assert "EqualTo(provider,a)" in capsys.readouterr().out.replace(" ", "")


def test_failed_write_leaves_nothing(spark, store):
    before, rows = files(store), spark.read.format("answers").load(store).count()
    wrong = F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.lit("x"))
    bad = spark.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("provider"), F.col("id").alias("request"), F.current_timestamp().alias("fetched_at"), wrong.alias("body"))
    with pytest.raises(Exception, match="broken"):
        bad.withColumn("provider", (F.col("request") % 7).cast("string")).write.format("answers").mode("append").save(store)
    assert files(store) == before and spark.read.format("answers").load(store).count() == rows
    with pytest.raises(Exception, match="appended"):
        bad.write.format("answers").mode("overwrite").save(store)
    with pytest.raises(Exception, match="columns"):
        spark.range(1).write.format("answers").mode("append").save(store)


def test_files_are_rolled_and_empty_tables_write_nothing(spark, tmp_path, monkeypatch):
    answers.register(spark)
    path = f"file://{tmp_path}/empty"
    spark.createDataFrame([], answers.SCHEMA).write.format("answers").mode("append").save(path)
    assert spark.read.format("answers").load(path).count() == 0
    monkeypatch.setattr(answers, "FILE_BYTES", 1000)
    monkeypatch.setattr(answers, "GROUP_BYTES", 300)
    rows = [{"provider": "p", "request": i, "fetched_at": None, "body": "x" * 90} for i in range(50)]
    writer = answers.AnswersWriter(path)
    lost, got = writer.write(iter(rows)), writer.write(iter(rows))
    assert len(got.files) > 3 and sum(f.rows for f in got.files) == 50
    writer.commit([got, None])
    assert sorted(os.listdir(f"{tmp_path}/empty/{writer.folder}")) == sorted(os.path.basename(f.name) for f in got.files) and lost.files
    assert spark.read.format("answers").load(path).count() == 50


def test_stream_reads_each_commit_once(spark, store, tmp_path):
    def run():
        stream = spark.readStream.format("answers").load(store)
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/at").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r["request"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [1, 2, 3, 4, 5]
    spark.createDataFrame([("c", 6, None, "z")], answers.SCHEMA).write.format("answers").mode("append").save(store)
    assert run() == [1, 2, 3, 4, 5, 6] and run() == [1, 2, 3, 4, 5, 6]
