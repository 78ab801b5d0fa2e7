"""Streams with state against the same rows at once."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from orrery.operators import changes
from orrery.streaming import incremental, stateful

RAW = "id long, kind string, source_id long, lang string, fetched_at timestamp, payload string"


def versions(n=160, seed=3):
    rng, at, out = random.Random(seed), dt.datetime(2024, 5, 1), []
    for i in range(1, n + 1):
        at += dt.timedelta(minutes=rng.choice([0, 7, 600]))
        record = {"status": rng.choice(["Returning Series", "Ended", "Canceled", "Released", "Planned"]), "release_date": rng.choice(["", "2024-06-01", "2024-07-01"]), "seasons": [{"season_number": k, "air_date": "2024-09-01"} for k in range(rng.randrange(4))]}
        out.append((i, rng.choice(["tv", "movie"]), rng.randrange(6) if rng.random() < 0.95 else None, rng.choice(["", "fr"]), at, rng.choice([json.dumps(record)] * 9 + ["not json", None])))
    return out


def plain(frame):
    return sorted(map(tuple, frame.select("id", "kind", "source_id", "lang", "type", "day", "title").collect()), key=repr)


def run(spark, folder, known=None):
    rows = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    stateful.append_batches(stateful.derive_stream(rows, known), f"{folder}/out", f"{folder}/mark").awaitTermination()
    return plain(spark.read.parquet(f"{folder}/out"))


def test_batches_equal_all_at_once(spark, tmp_path):
    rows = versions()
    cuts, rng = [0, 50, 110, 160], random.Random(1)
    for k in range(3):
        part = rows[cuts[k] : cuts[k + 1]]
        rng.shuffle(part)  # a key's rows of a batch come in any order
        spark.createDataFrame(part, RAW).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        got = run(spark, tmp_path)  # and every batch is a restart from the checkpoint
        assert got == plain(changes.derive(spark.createDataFrame(rows[: cuts[k + 1]], RAW)))
    assert len(got) > 40
    late = [(900, "tv", 1, "", dt.datetime(2020, 1, 1), json.dumps({"status": "Ended"}))]
    spark.createDataFrame(late, RAW).write.parquet(f"{tmp_path}/in/late")
    assert run(spark, tmp_path) == got


def test_versions_before_the_stream_count(spark, tmp_path):
    rows = versions(90, 8)
    spark.createDataFrame(rows[60:], RAW).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    got = run(spark, tmp_path, spark.createDataFrame(rows[:60], RAW))
    assert got == plain(changes.derive(spark.createDataFrame(rows, RAW), above=60)) and len(got) > 5


def test_a_batch_reads_what_it_brings(spark, tmp_path):
    """New keys without end: later batches read no more state than earlier ones, and nothing of the table."""
    for k in range(5):
        spark.range(k * 2000, k * 2000 + 2100).selectExpr("id", "cast(id as string) as digest").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    rows = spark.readStream.schema("id long, digest string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = incremental.append_new(rows, f"{tmp_path}/out", ["id"], f"{tmp_path}/mark")
    query.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("id").distinct().count() == 10_100
    read = [p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesRead"] for p in query.recentProgress if p["numInputRows"]]
    assert len(read) == 5 and read[4] <= read[1] + 200
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [2100] * 5


def test_rows_without_a_key_and_other_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (1, "c")], "id long, digest string")
    rows.write.parquet(f"{tmp_path}/in")
    for mark in ("one", "two", "two"):
        incremental.append_new(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["id"], f"{tmp_path}/{mark}").awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    spark.range(2, 4).select("id", F.lit("x").alias("digest")).write.mode("append").parquet(f"{tmp_path}/in")
    incremental.append_new(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["id"], f"{tmp_path}/one").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
