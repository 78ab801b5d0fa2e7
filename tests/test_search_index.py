"""The stored index against scanned texts, through changes, merges and failures."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from orrery.operators import fulltext
from orrery.sources import search_index
from orrery.sources.search_index import ScannedTexts, SearchIndex

WORDS = "wire wireless the élite été indien apple apples a day of thrones throne 7 42 straße œuvre naïve x".split()
QUERIES = ["the wire", "ete", "42", "nothing at all", "a a"]


def texts(rng, ids):
    return {i: None if rng.random() < 0.05 else " ".join(rng.choices(WORDS, k=rng.randrange(12))) + rng.choice(["", ".", " " + "y" * 25]) for i in ids}


def answers(source, rating="rating"):
    every = [fulltext.search(source, q, rating).select(F.lit(q).alias("q"), "id", F.round("score", 9).alias("score")) for q in QUERIES]
    found = reduce(lambda a, b: a.unionByName(b), every).collect()
    found += fulltext.match_phrase(source, ["a", "day"]).select(F.lit("a day").alias("q"), "id", "times").collect()
    return sorted(map(tuple, found)), sorted(map(tuple, fulltext.prefix_forms(source).collect()))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, float(i % 9) if i % 4 else None) for i, t in rows.items()], "id long, text string, rating double")


def test_index_follows_its_documents(spark, tmp_path):
    rng = random.Random(11)
    index, rows = SearchIndex(spark, f"file://{tmp_path}/index"), texts(rng, range(120))
    with pytest.raises(LookupError):
        len(index)
    index.build(frame(spark, rows), "id", "text", ["rating"])
    assert len(index) == 120 and answers(index) == answers(ScannedTexts(frame(spark, rows), "id", "text"))
    changed = texts(rng, rng.sample(range(140), 30))
    rows |= changed
    index.upsert(frame(spark, changed))
    gone, again = rng.sample(sorted(rows), 10), texts(rng, [3, 5, 200])
    rows = {i: t for i, t in rows.items() if i not in gone or i in again} | again
    index.upsert(frame(spark, again), removed=spark.createDataFrame([(i,) for i in gone if i not in again], "id long"))
    want = answers(ScannedTexts(frame(spark, rows), "id", "text"))
    assert len(index) == len(rows) and len(index.manifest()["segments"]) > 1 and answers(index) == want
    index.merge(all_=True)
    assert len(index.manifest()["segments"]) == 1 and answers(index) == want and index.sweep() == []


def test_small_segments_are_merged(spark, tmp_path, monkeypatch):
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    index.build(frame(spark, {i: f"wire {i}" for i in range(60)}), "id", "text", ["rating"])
    monkeypatch.setattr(search_index, "SEGMENTS", 3)
    for k in range(4):
        index.upsert(frame(spark, {100 + k: f"wire new{k}"}))
    assert len(index.manifest()["segments"]) <= 3 and len(index) == 64
    index.upsert(frame(spark, {i: "other words" for i in range(40)}))  # most of the first segment is dead
    assert all(s["dead"] <= 0.3 * s["documents"] for s in index.manifest()["segments"])
    assert {r.id for r in fulltext.match_all(index, ["wire"]).collect()} == set(range(40, 60)) | set(range(100, 104))


def test_a_write_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    index.build(frame(spark, {1: "the wire", 2: "apple"}), "id", "text", ["rating"])
    before = index.manifest(), answers(index)

    def fail(content):
        raise OSError("the power went")

    monkeypatch.setattr(index.pointer, "replace", fail)
    for write in (lambda: index.upsert(frame(spark, {1: "apple"})), lambda: index.build(frame(spark, {3: "x"}), "id", "text", ["rating"])):
        with pytest.raises(OSError):
            write()
    monkeypatch.undo()
    assert (index.manifest(), answers(index)) == before
    assert len(index.sweep()) >= 3 and answers(index) == before[1] and index.sweep() == []


def test_synchronise(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    rows = spark.createDataFrame([(1, "old wire", "2026-01-01 00:00:00"), (2, "the day", "2026-01-02 00:00:00"), (3, "new apple", "2026-01-05 00:00:00")], "id long, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    index.build(rows.where("id < 3"), "id", "text")
    with pytest.raises(LookupError):
        index.synchronise(rows, "at", "2026-01-06")
    index.build(rows.where("id < 3"), "id", "text", mark="2026-01-03")
    index.synchronise(rows, "at", "2026-01-06")
    assert index.manifest()["mark"] == "2026-01-06" and {r.id for r in fulltext.match_all(index, ["ap"]).collect()} == {3}
    later = rows.withColumn("text", F.lit("wire at last")).withColumn("at", F.lit("2026-01-07").cast("timestamp")).where("id = 2")
    index.synchronise(later, "at", "2026-01-08", removed=spark.createDataFrame([(1,)], "id long"))
    assert {r.id for r in fulltext.match_all(index, ["wire"]).collect()} == {2} and len(index) == 2


def test_searches_read_buckets_of_their_words(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    index.build(frame(spark, texts(random.Random(2), range(300))), "id", "text", ["rating"])
    plan = fulltext.match_all(index, ["wir", "thr"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(bucket" in s and "GreaterThanOrEqual(token" in s and "text" not in s.split("ReadSchema")[1] for s in scans)


def test_empty_index_and_odd_rows(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    index.build(spark.createDataFrame([], "id long, text string, rating double"), "id", "text", ["rating"])
    assert len(index) == 0 and fulltext.search(index, "wire").collect() == []
    odd = spark.createDataFrame([(None, "wire", 1.0), (5, "wire one", 1.0), (5, "wire two", 1.0), (6, None, 2.0), (7, "wire " * 50_000, 1.0)], "id long, text string, rating double")
    index.upsert(odd)
    assert len(index) == 3 and {r.id for r in fulltext.match_all(index, ["wire"]).collect()} == {5, 7}
    assert {r.id: len(r.places) for r in index.exact("wire").collect()} == {5: 1, 7: 50_000}
