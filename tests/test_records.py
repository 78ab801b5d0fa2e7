"""Nested records and the legacy import on hand-made rows."""

import datetime as dt
import json
import time

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import records, regression
from orrery.sources import legacy_import


def parsed(spark, schema, **fields):
    return spark.createDataFrame([(json.dumps(fields),)], "j string").select(F.from_json("j", schema).alias("r"))


def test_credits(spark):
    frame = parsed(
        spark, f"cast array<{records.MEMBER}>, crew array<{records.CREW}>",
        cast=[{"id": 1, "name": "A", "roles": [{"character": "X", "episode_count": 3}]}, {"id": None, "name": "ghost"}, {"id": 2, "name": "B", "character": "Y", "order": 7, "total_episode_count": 9}],
        crew=[
            {"id": 5, "name": "few", "jobs": [{"job": "Director", "episode_count": 2}]}, {"id": 6, "name": "many", "jobs": [{"job": "Director", "episode_count": 1}], "total_episode_count": 8},
            {"id": 7, "name": "assistant", "jobs": [{"job": "Assistant Director", "episode_count": 9}]}, {"id": 8, "name": "film", "job": "Director"}, {"id": 9, "name": "writer", "job": "Writer"}, {"id": None, "job": "Director"},
        ],
    )
    row = frame.select(records.cast_of(F.col("r.cast")).alias("cast"), records.directors_of(F.col("r.crew")).alias("directors")).first()
    assert [(m.id, m.character, m.credit, m.episodes) for m in row.cast] == [(1, "X", 0, 3), (2, "Y", 7, 9)]
    assert [(m.id, m.episodes) for m in row.directors] == [(6, 8), (5, 2), (8, None)]
    edges = records.credit_edges(frame.select(F.lit(4).alias("w"), records.cast_of(F.col("r.cast")).alias("c")), "w", "c", "ACTED")
    assert sorted(map(tuple, edges.collect())) == [(1, 4, "ACTED", 0), (2, 4, "ACTED", 7)]


def test_offers_and_images(spark):
    frame = parsed(
        spark, "w map<string,array<struct<provider_name:string,display_priority:int>>>, b array<struct<file_path:string,vote_count:int>>, s array<int>",
        w={"buy": [{"provider_name": "z", "display_priority": 2}, {"provider_name": "y", "display_priority": 1}], "flatrate": [{"provider_name": "n"}], "rent": []},
        b=[{"file_path": "/b", "vote_count": 1}, {"file_path": "/a", "vote_count": 1}, {"file_path": " ", "vote_count": 9}, {"file_path": "/c", "vote_count": 5}, {"file_path": "/d"}], s=list(range(11)),
    )
    row = frame.select(records.offers(F.col("r.w")).alias("o"), records.backdrops(F.col("r.b"), 3).alias("b"), records.evenly(F.col("r.s"), 4).alias("e"), records.evenly(F.col("r.s"), 20).alias("all")).first()
    assert [(o.kind, list(o.providers)) for o in row.o] == [("flatrate", ["n"]), ("buy", ["y", "z"])]
    assert list(row.b) == ["/c", "/a", "/b"] and list(row.e) == sorted({round(i * 10 / 3) for i in range(4)}) and len(row.all) == 11


def test_facts_have_no_empty_keys(spark):
    frame = parsed(spark, "facts struct<countries:array<string>,languages:array<string>,filmed:array<string>,set_in:array<string>,qid:string,imdb:string,tvmaze:string>", facts={"countries": ["FR"], "languages": [], "filmed": ["Lyon"], "qid": "Q1", "tvmaze": "x"})
    got = frame.select("r.facts").select(records.series_facts("facts").alias("f")).first().f
    assert json.loads(got["pays"]) == ["FR"] and json.loads(got["lieux"]) == [{"type": "tournage", "nom": "Lyon"}] and json.loads(got["ids"]) == {"wikidata": "Q1"} and set(got) == {"pays", "lieux", "ids"}
    zero = spark.range(1).select(records.facts({"n": F.lit(0), "s": F.lit(""), "x": F.lit(None)}).alias("f")).first().f
    assert zero == {"n": "0"}


def test_books(spark):
    works = spark.createDataFrame([(1, "Title", None), (2, " ", 1990)], "work int, title string, year int")
    sources = spark.createDataFrame(
        [(1, "wikidata", "", None, {"annee": "1951"}), (1, "openlibrary", "fr", "short", None), (1, "openlibrary", "en", "longer text", None), (1, "wikipedia", "ar", "x" * 50, None), (1, "wikipedia", "en", "article", None), (2, "wikidata", "", None, {"titre": "Found"})],
        "work int, source string, lang string, content string, facts map<string,string>",
    )
    rows = {r.work: r for r in records.assemble_books(works, sources, ["fr", "en"]).collect()}
    assert (rows[1].year, rows[1].overview, rows[1].article_lang, sorted(rows[1].languages)) == (1951, "longer text", "en", ["ar", "en", "fr"])
    assert (rows[2].title, rows[2].year, rows[2].overview, list(rows[2].languages)) == ("Found", 1990, None, [])


def test_anchors(spark):
    prompt = "1. humour — how funny\nAnchors: Chernobyl = 1, The Office=9.5, broken.\n2. dream — x\n no anchors\n"
    told = lambda text: [tuple(a) for a in spark.createDataFrame([(text,)], "p string").select(records.anchors_of("p").alias("a")).first().a]
    assert told(prompt) == [("humour", "chernobyl", 1.0), ("humour", "theoffice", 9.5)]
    odd = "Anchors: lost = 1\n  1. a — x\nmore\n\nAnchors: A=B = -2, A = 1e1, C = x, D\nAnchors: late = 1\n2. b — y\n3. c — z\nAnchors: É! = 3.5..\n12. a — again\nAnchors: A = 4, a = 5"
    assert told(odd) == [("c", "", 3.5), ("a", "a", 5.0)] and told("") == []
    scores = spark.createDataFrame([(1, "humour", 2.0)], "work int, axis string, value double")
    gaps = records.anchor_gaps(scores, spark.createDataFrame([(1, "Chernobyl!")], "work int, title string"), spark.createDataFrame([("humour", "chernobyl", 1.0)], "axis string, title string, wanted double"))
    assert [r.gap for r in gaps.collect()] == [1.0]
    specs = spark.createDataFrame([("openai/text-3@512",), ("local:/a/b/pupil/",), ("local:pupil",), (records.OWN_ENCODER,), ("other/x",), (None,)], "s string")
    assert [r.l for r in specs.select(records.encoder_label("s").alias("l")).collect()] == ["text-3@512", "pupil", "pupil", records.OWN_LABEL, "other/x", None]


def test_anchors_of_a_long_rubric_are_read_once(spark):
    """5,000 pieces on an axis; read once each, not once for every other piece (by the minute)."""
    pieces = ", ".join(f"Work {i % 4000} = {i}" for i in range(5000))
    frame = spark.createDataFrame([(f"1. a — x\nAnchors: {pieces}.",)], "p string").select(records.anchors_of("p").alias("a"))
    began = time.monotonic()
    told = [tuple(a) for a in frame.first().a]
    assert time.monotonic() - began < 20
    assert told == [("a", f"work{i % 4000}", float(i)) for i in range(1000, 5000)]


def test_ablation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5))
    y = np.clip(5 + x[:, 0] * 2, 1, 10)
    rows = [(i, "a", float(t), [float(v) for v in r], [0.0, *map(float, r[1:])]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    got = records.ablation(spark.createDataFrame(rows, "work long, axis string, value double, with_section array<double>, without_section array<double>")).first()
    assert got.with_it < 0.2 < got.without_it and got.shifted > 1


def test_ablation_covers_all_works(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    y = np.clip(5 + x[:, 0] + rng.normal(size=900) * np.where(np.arange(900) % 3, 0.1, 2), 1, 10)
    rows = [(i, "a", float(t), [float(v) for v in r], [0.0, *map(float, r[1:])]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    got = records.ablation(spark.createDataFrame(rows, "work long, axis string, value double, with_section array<double>, without_section array<double>")).first()
    without = x * [0, 1, 1]
    error = lambda z: np.abs(np.clip(regression.ridge_predictions(z, y), 1, 10) - y).mean()
    assert got.works == 900 and np.allclose([got.with_it, got.without_it], [error(x), error(without)], atol=1e-6)


def test_legacy_import(spark):
    works = spark.createDataFrame([(1, 100, ["x"], 2000), (2, None, ["L'Île"], 2001), (3, None, ["Twin"], 2000), (4, None, ["Far"], 1990), (5, 999, ["x"], None)], "v1_id int, id int, titles array<string>, year int")
    catalogue = spark.createDataFrame([(100, "x", 2000), (101, "ile", 2000), (102, "twin", 2000), (103, "Twin", 2001), (104, "far", 1995)], "id int, name string, year int")
    matched = legacy_import.match_works(works, catalogue)
    assert {r.v1_id: r.id for r in matched.collect()} == {1: 100, 2: 101, 3: None, 4: None, 5: None}
    tops = spark.createDataFrame([("m", 1, [2, 3, 1, 2])], "member string, list int, items array<int>")
    assert sorted((r.work, r["rank"]) for r in legacy_import.import_positions(tops, matched).collect()) == [(100, 3), (101, 1)]
    seen = spark.createDataFrame([("m", 1, dt.date(2024, 2, 1)), ("m", 1, dt.date(2023, 1, 1))], "member string, v1_id int, at date")
    assert [str(r.at) for r in legacy_import.import_discoveries(seen, matched).collect()] == ["2023-01-01"]
    reviews = spark.createDataFrame([(1, "m", "<p>good</p>", None), (2, "n", "yes", 1), (3, "o", "<br>", 1), (4, "p", "no", 9)], "v1_id int, member string, text string, reply_to_v1 int")
    assert {r.v1_id: (r.text, r.reply_to) for r in legacy_import.import_reviews(reviews).collect()} == {1: ("good", None), 2: ("yes", 1), 4: ("no", None)}
