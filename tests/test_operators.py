"""Operators on hand-made rows: nulls, ties, duplicates, malformed input."""

import datetime as dt
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import scalars as S
from orrery.sources.search_index import ScannedTexts
from orrery.operators import changes, dossier, fulltext, graph, latest, paging, regression, similarity
from orrery.sources import readers, sinks
from orrery.streaming import incremental


def value(spark, column, **cells):
    kinds = {str: "string", int: "long", float: "double", type(None): "string", dict: "map<string,string>", list: "array<double>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("v")).first()["v"]


# ---------------------------------------------------------------- scalars
def test_rating_is_null_without_votes(spark):
    assert value(spark, S.weighted_rating("a", "v"), a=8.0, v=0) is None
    assert value(spark, S.weighted_rating("a", "v"), a=8.0, v=50) == pytest.approx(7.25)


@pytest.mark.parametrize("title, key", [("L'Île aux enfants", "ile aux enfants"), ("  The  Wire!", "wire"), ("Das Boot", "boot"), ("Œuvre", "oeuvre"), ("???", None), (None, None), ("a", "a")])
def test_title_key(spark, title, key):
    assert value(spark, S.title_key("t"), t=title) == key


def test_text_functions(spark):
    assert value(spark, S.cut_at_sentence("t", 20), t="One. Two three. Four five six.") == "One. Two three."
    assert value(spark, S.cut_at_sentence("t", 5), t="abcdefghij") == "abcde"
    assert value(spark, S.cut_at_sentence("t", 50), t="short. text") == "short. text"
    assert value(spark, S.plain_text("t"), t="<p>Tom &amp; Ana</p>\n<br/> &#39;x&#39;") == "Tom & Ana 'x'"
    assert value(spark, S.plain_text("t"), t="<br>") is None
    assert value(spark, S.safe_date("t"), t="2024-02-30") is None
    assert value(spark, S.safe_date("t"), t="2024-02-29T10:00") == dt.date(2024, 2, 29)
    assert value(spark, S.safe_int("t"), t=" ") is None and value(spark, S.safe_int("t"), t="12") == 12
    assert value(spark, S.first_year("t"), t="first printed 1899, again 2001") == 1899
    assert value(spark, S.tag_country("t"), t="pt-BR") == "BR" and value(spark, S.tag_country("t"), t="fr") is None
    assert value(spark, S.human_bytes("n"), n=1536) == "1.5 KB"


def test_folding_and_entities(spark):
    assert value(spark, S.fold("t"), t="ếﬁ１２άẞŒ Ærø łódź İ") == "efi12αssoe aero lodz i"
    assert value(spark, S.fold("t"), t="Plain ASCII") == "plain ascii" and value(spark, S.fold("t"), t=None) is None
    assert value(spark, S.title_key("t"), t="L’été ｄｅ １９９８") == "ete de 1998"
    assert value(spark, S.plain_text("t"), t="&eacute;&#233;&#xE9;&nbsp;&amp;lt;<b>x</b>&unknown;") == "ééé &lt; x &unknown;"
    assert value(spark, S.canonical_json("t"), t='{"b": [1, {"z": "a\\"b", "a": null}], "a": "é"}') == '{"a":"é","b":[1,{"a":null,"z":"a\\"b"}]}'
    assert value(spark, S.canonical_json("t"), t="not json") is None
    assert value(spark, S.sorted_map_json("m"), m={"b": 'say "x"', "a": None}) == '{"a":null,"b":"say \\"x\\""}'
    assert value(spark, S.publication_year("t"), t="printed 0999, June 12001995") == 1200 and value(spark, S.publication_year("t"), t="in 1066") == 1066
    assert value(spark, S.publication_year("t"), t="none") is None


def test_redaction(spark):
    key = "0123456789abcdef0123456789abcdef"
    got = value(spark, S.redact_secrets("t"), t=f"GET /x?api_key={key}&password={key}&token=short end")
    assert got == "GET /x?api_key=01234.....89abcdef&password=***&token=*** end"
    assert value(spark, S.redact_dsn("t"), t="postgresql://me:secret@db:5432/app?x=1") == "postgresql://me:***@db:5432/app"


def test_clamps(spark):
    assert value(spark, S.clamp_score("x"), x=0.2) == 1.0 and value(spark, S.clamp_score("x"), x=7.26) == 7.3
    assert value(spark, S.clamp_verdict("x"), x="12") == 10 and value(spark, S.clamp_verdict("x"), x="?") is None
    assert value(spark, S.clamp_confidence("x"), x="?") == 0.0 and value(spark, S.clamp_confidence("x"), x="0.987") == 0.99
    assert value(spark, S.unit("x"), x=[0.0, 0.0]) is None and value(spark, S.unit("x"), x=[3.0, 4.0]) == [0.6, 0.8]
    assert value(spark, S.pick_language("m", ["fr", "en"]), m={"en": "b", "fr": " ", "de": "c"}) == "b"
    assert value(spark, S.sorted_map_json("m"), m={"b": "2", "a": "1"}) == '{"a":"1","b":"2"}'


def test_work_states(spark):
    rows = [(None, None, 1, 0, "absent"), (1, None, 1, 0, "error"), (1, 1, 0, 0, "series_only"), (1, 1, 2, None, "lang_missing"), (1, 1, 2, 1, "partial"), (1, 1, 2, 2, "complete")]
    frame = spark.createDataFrame(rows, "seen int, ok int, expected int, done int, want string")
    assert frame.where(S.work_state(F.col("seen"), F.col("ok"), F.col("expected"), F.col("done")) != F.col("want")).count() == 0


# ---------------------------------------------------------------- history
def test_latest_breaks_ties_by_id(spark):
    frame = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (2, 1, 3, None)], "k int, t int, id int, v string")
    assert sorted(map(tuple, latest.latest_per_key(frame, ["k"], ["t", "id"]).select("k", "id", "v").collect())) == [(1, 2, "b"), (2, 3, None)]


def test_upsert_policies_and_replay(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "id int, name string, n int")
    new = spark.createDataFrame([(1, "A", 9), (3, "C", 3)], "id int, name string, n int")
    once = latest.upsert(old, new, ["id"], keep_first=("name",))
    assert sorted(map(tuple, once.collect())) == [(1, "a", 9, "updated"), (2, "b", 2, "kept"), (3, "C", 3, "inserted")]
    again = latest.upsert(once.drop("change"), new, ["id"], keep_first=("name",)).drop("change")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.drop("change").collect()))
    filled = latest.upsert(old, new, ["id"], fill_only=("name", "n")).drop("change")
    assert (1, "a", 9) in set(map(tuple, filled.collect()))
    assert latest.insert_new(once.drop("change"), new, ["id"]).count() == 0
    assert sorted(r.id for r in latest.replace_keys(old, new, ["id"]).collect()) == [1, 2, 3]


def test_assign_keys_continues(spark):
    known = spark.createDataFrame([("x", 5)], "natural string, pivot long")
    got = {r.natural: r.pivot for r in latest.assign_keys(known, spark.createDataFrame([("x",), ("y",), ("z",), (None,), ("y",)], "natural string"), "natural", "pivot").collect()}
    assert got["x"] == 5 and sorted(got.values()) == [5, 6, 7] and set(got) == {"x", "y", "z"}


# ---------------------------------------------------------------- paging
def test_nulls_last_both_ways(spark):
    frame = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0), (4, 5.0)], "id int, r double")
    assert [r.id for r in frame.orderBy(*paging.nulls_last([("r", True)], "id")).collect()] == [3, 4, 2, 1]
    assert [r.id for r in frame.orderBy(*paging.nulls_last([("r", False)], "id")).collect()] == [2, 4, 3, 1]
    assert [r.id for r in paging.page(frame, [("r", True)], "id", 1, 2).orderBy("position").collect()] == [4, 2]
    with pytest.raises(ValueError):
        paging.page(frame, [], "id", 9_999, 2)


def test_samples(spark):
    frame = spark.range(10).withColumn("k", F.lit(1))
    spaced = [r.id for r in paging.evenly_spaced(frame, ["k"], [F.col("id")], 4).orderBy("id").collect()]
    assert spaced == sorted({round(i * 9 / 3) for i in range(4)})
    assert [r.id for r in paging.stride_sample(frame, ["k"], [F.col("id")], 3).orderBy("id").collect()] == [0, 3, 6]
    buckets = [r.bucket for r in paging.buckets_by_position(frame, ["k"], [F.col("id")], 4).orderBy("id").collect()]
    assert buckets == [1, 1, 2, 2, 3, 3, 4, 4, 4, 4]


def test_keyed_rank_equals_a_window(spark):
    rng = np.random.default_rng(13)
    rows = [(None if k == 0 else int(k), int(v), i) for i, (k, v) in enumerate(zip(rng.choice([0, 1, 1, 1, 2], 500), rng.integers(0, 40, 500), strict=True))]
    frame = spark.createDataFrame(rows, "k int, v int, id long").repartition(7)
    got = sorted(((r.id, r._i, r._n) for r in paging.keyed_rank(frame, ["k"], [F.col("v").desc(), F.col("id")]).collect()))
    want = []
    for key in (None, 1, 2):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want += [(r[2], n, len(own)) for n, r in enumerate(own)]
    assert got == sorted(want)
    assert [r.position for r in paging.global_rank(frame, [F.col("v"), F.col("id")]).orderBy("v", "id").collect()] == list(range(500))
    tenths = paging.decile_sample(frame.limit(0), [F.col("id")], 3)
    assert tenths.collect() == []
    picked = [(r.id, r.decile) for r in paging.decile_sample(spark.range(27), [F.col("id")], 1).orderBy("id").collect()]
    assert picked == [(2 * d, d + 1) for d in range(10)]


def test_previous_versions_of_a_key_that_holds_most_rows(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([1, 1, None]), k, rng.choice([k, None])) for k in range(3000)]
    rng.shuffle(rows)
    want, last = {}, {}
    for a, b, k, v in sorted(rows, key=lambda r: r[2]):
        want[k] = last.get((a, b), (None, None))
        last[a, b] = (k, v)
    frame = spark.createDataFrame(rows, "a string, b int, k long, v long").repartition(7)
    for most in (10**6, 100):
        got = latest.previous_version(frame, ["a", "b"], ["k"], ["k", "v"], most)
        assert got.columns == ["a", "b", "k", "v", "prev_k", "prev_v"] and {r.k: (r.prev_k, r.prev_v) for r in got.collect()} == want
    assert latest.previous_version(frame.limit(0), ["a"], ["k"], ["v"]).collect() == []


# ---------------------------------------------------------------- graph
def test_suggestions(spark):
    edges = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 12, 1), (3, 11, 2), (3, 12, None), (3, 13, 1), (4, 99, 1)], "member long, work long, rank int")
    me = spark.createDataFrame([(1,)], "member long")
    assert [(r.neighbour, r.common) for r in graph.neighbours(edges, me).orderBy("place").collect()] == [(2, 1), (3, 1)]
    got = [(r.work, r.neighbours, r.strength) for r in graph.suggestions(edges, me, edges.where("member = 1")).orderBy("place").collect()]
    assert got == [(12, 2, 3.0), (13, 1, 5.0)]


# ---------------------------------------------------------------- search
def test_search(spark):
    scan = lambda frame: ScannedTexts(frame, "id", "text")
    docs = spark.createDataFrame([(1, "The Wire", 8.0), (2, "Wireless wire", 9.0), (3, "Élite du Wire", None), (4, "nothing", 1.0)], "id long, text string, rating double")
    assert {r.id for r in fulltext.match_all(scan(docs), ["wir"]).collect()} == {1, 2, 3}
    assert {r.id for r in fulltext.match_all(scan(docs), ["wir", "eli"]).collect()} == {3}
    assert [(r.id, r.times) for r in fulltext.match_phrase(scan(docs), ["the", "wire"]).collect()] == [(1, 1)]
    best = fulltext.search(scan(docs), "the wire", "rating").orderBy(F.desc("score")).first()
    assert best.id == 1
    assert {r.id for r in fulltext.search(scan(docs), "4").collect()} == {4}
    more = spark.createDataFrame([(1, "été indien"), (2, "Apple a day"), (3, "apple"), (4, "x" * 25), (5, "x" * 25 + "y"), (6, None)], "id long, text string")
    ids = lambda q: {r.id for r in fulltext.search(scan(more), q).collect()}
    assert ids("ÉTÉ") == {1} and ids("a") == {2} and ids("ap") == {2, 3} and ids("x" * 25) == {4} and ids("x" * 20) == {4, 5} and ids("?!") == set()
    scores = {r.id: r.score for r in fulltext.search(scan(more), "apple").collect()}
    idf = np.log(1 + (6 - 2 + 0.5) / 2.5)
    assert scores == pytest.approx({2: 4 * idf / 2.2, 3: 4 * idf / 2.2})


def test_encoders(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4))
    y = np.clip(5 + x[:, 0] * 2, 1, 10)
    rows = [(e, a, i, [float(v) for v in r[:d]], float(t)) for e, d, lost in (("good", 4, 0), ("blind", 3, 1)) for a, n in (("p", 80), ("few", 9)) for i, (r, t) in enumerate(zip(np.roll(x, -lost, axis=1)[:n], y[:n], strict=True))]
    got = regression.compare_encoders(spark.createDataFrame([*rows, ("none", "p", 1, [1.0], 5.0)], "encoder string, axis string, work long, embedding array<double>, value double")).orderBy("place").collect()
    assert [(r.encoder, r.dims, r.axes) for r in got] == [("good", 4, 1), ("blind", 3, 1), ("none", None, 0)] and got[0].mae < 0.2 < got[1].mae and got[2].mae is None
    kept = spark.createDataFrame([(1, "a", "good"), (2, "old", "good"), (3, "c", "blind")], "work long, sha string, encoder string")
    dossiers = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "work long, sha string")
    assert sorted(r.work for r in regression.missing_vectors(dossiers, kept, "good").collect()) == [2, 3]


# ---------------------------------------------------------------- events
def record(**fields):
    import json

    return json.dumps(fields)


def test_event_diff(spark):
    day = dt.datetime(2024, 5, 2)
    raw = [
        (1, "tv", 7, "", dt.datetime(2024, 5, 1), record(status="Returning Series", seasons=[{"season_number": 1, "air_date": "2020-01-01"}, {"season_number": 0, "air_date": ""}])),
        (2, "tv", 7, "", day, record(status="Ended", last_air_date="2024-04-30", seasons=[{"season_number": n, "air_date": a} for n, a in ((0, ""), (1, "2020-01-01"), (2, "2024-09-01"), (3, ""))], next_episode_to_air={"air_date": "2024-09-01"})),
        (3, "tv", 7, "", dt.datetime(2024, 5, 3), record(status="Ended", last_air_date="2024-04-30", seasons=[{"season_number": n, "air_date": ""} for n in (1, 2, 3)], next_episode_to_air={"air_date": "2024-09-01"})),
        (4, "movie", 8, "", dt.datetime(2024, 5, 1), record(status="Planned", release_date="")),
        (5, "movie", 8, "", day, record(status="Planned", release_date="2024-06-01")),
        (6, "movie", 8, "", dt.datetime(2024, 6, 2), record(status="Released", release_date="2024-06-01")),
        (7, "tv", 9, "", day, "not json"),
    ]
    frame = spark.createDataFrame(raw, "id long, kind string, source_id long, lang string, fetched_at timestamp, payload string")
    got = sorted((r.id, r.type, str(r.day), r.title) for r in changes.derive(frame).collect())
    assert got == [
        (2, "date_diffusion", "2024-09-01", "Prochain épisode le 01/09/2024"),
        (2, "diffusion_terminee", "2024-04-30", "Diffusion terminée"),
        (2, "saison_annoncee", "2024-09-01", "Saisons 2 et 3 annoncées"),
        (5, "sortie", "2024-06-01", "Sortie le 01/06/2024"),
        (6, "sortie", "2024-06-01", "Film sorti"),
    ]
    assert {r.id for r in changes.derive(frame, above=5).collect()} == {6}


# ---------------------------------------------------------------- dossier
def test_dossier(spark):
    rows = spark.createDataFrame([(1, "A", " ", None)], "id int, title string, plot string, extra string")
    made = dossier.assemble(rows, "id", [("TITLE", F.col("title")), ("PLOT", F.col("plot")), ("EXTRA", F.col("extra"))]).first()
    assert made.dossier == "TITLE: A\n\nMATERIAL: TITLE" and made.chars == len(made.dossier) and not made.enough
    entries = spark.sql("select array(struct('en' lang, 'GB' country, 'x' overview), struct('en' lang, 'US' country, ' ' overview), struct('fr' lang, 'FR' country, 'y' overview)) e")
    assert entries.select(dossier.english_translation(F.col("e")).alias("p")).first().p.overview == "x"


# ---------------------------------------------------------------- vectors and regression
def test_nearest_measures_differ(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.9, 0.3]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert similarity.nearest(frame, F.col("vec_id") == 0, 1, "euclid").first().id == 2
    assert similarity.nearest(frame, F.col("vec_id") == 0, 1, "cosine").first().id == 1


def test_ridge_recovers_a_linear_rule(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = np.clip(5.5 + x @ np.array([1, -0.8, 0.5, 0, 0, 0.2]) + rng.normal(size=300) * 0.1, 1, 10)
    rows = [(i, "a", [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    rows += [(i, "few", [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x[:20], y[:20], strict=True))]
    made = regression.train_ridge(spark.createDataFrame(rows, "work long, axis string, embedding array<double>, value double")).set_index("axis")
    assert made.loc["a", "mae_cv"] < 0.2 and made.loc["a", "trained_on"] == 300 and np.allclose(made.loc["a", "coef"][:3], [1, -0.8, 0.5], atol=0.1)
    assert made.loc["few", "slope"] == 1.0
    assert np.isclose(np.clip(regression.ridge_predictions(x, y), 1, 10).std(), y.std(), rtol=0.2)


def near_means(x, y, k):
    """Each row's guess from the k most similar rows of other folds, row by row."""
    n = len(y)
    folds = n if n <= regression.ALONE else regression.FOLDS
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    likeness, out = unit @ unit.T, []
    for i in range(n):
        others = np.flatnonzero(np.arange(n) % folds != i % folds)
        best = others[np.lexsort((others, -likeness[i, others]))[:k]]
        weights = likeness[i, best] - likeness[i, best[-1]]
        out.append(np.average(y[best], weights=weights) if weights.sum() > 1e-12 else y[best].mean())
    return np.array(out)


def test_curved_scores_favour_curved_models():
    rng = np.random.default_rng(1)
    x = rng.choice([-1.0, 1.0], size=(200, 2)) + rng.normal(size=(200, 2)) * 0.15
    y = np.where(x[:, 0] * x[:, 1] > 0, 8.0, 3.0)
    error = lambda g: np.abs(np.clip(g, 1, 10) - y).mean()
    assert error(regression.ridge_predictions(x, y)) > 2
    assert all(error(g) < 0.8 for g in (near_means(x, y, 10), regression.kernel_predictions(x, y), regression.network_predictions(x, y)))


def test_predict_drops_no_axis(spark):
    weights = spark.range(1001).selectExpr("cast(id as string) as axis", "5.0D as intercept", "array(1.0D) as coef")
    vectors = spark.createDataFrame([(1, [2.0])], "vec_id long, embedding array<double>")
    for most in (1000, 1001):
        got = similarity.predict(vectors, weights, max_axes=most).collect()
        assert len({r.axis for r in got}) == len(got) == 1001 and {r.prediction for r in got} == {7.0}


def test_model_comparison_covers_all_works(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 4))
    y = np.clip(5 + x[:, 0] + np.tanh(x[:, 1] * 2) + rng.normal(size=700) * 0.3, 1, 10)
    rows = [(i, axis, [float(v) for v in r], float(t)) for axis, n in (("a", 700), ("b", 300), ("few", 20)) for i, (r, t) in enumerate(zip(x[:n], y[:n], strict=True))]
    frame = spark.createDataFrame(rows, "work long, axis string, embedding array<double>, value double")
    got = {(r.axis, r.model): r for r in regression.compare_models(frame).collect()}
    assert {k: r.works for k, r in got.items()} == {(axis, m): n for axis, n in (("a", 700), ("b", 300), ("few", 20)) for m in ("ridge", "kernel", "network", "neighbours")}
    for axis, n in (("a", 700), ("b", 300), ("few", 20)):
        u, t = x[:n], y[:n]
        near = {k: near_means(u, t, k) for k in regression.NEIGHBOURS if k < n}
        want = {"ridge": regression.ridge_predictions(u, t), "neighbours": min(near.values(), key=lambda g: np.abs(np.clip(g, 1, 10) - t).mean())}
        want |= {"kernel": regression.kernel_predictions(u, t), "network": regression.network_predictions(u, t)}
        for model, g in want.items():
            g, r = np.clip(g, 1, 10), got[axis, model]
            assert np.allclose([r.mae, r.spread, r.correlation], [np.abs(g - t).mean(), g.std() / t.std(), np.corrcoef(g, t)[0, 1]], atol=1e-3), (axis, model)
    assert got["a", "kernel"].mae < 0.5


def test_row_index(spark):
    frame = spark.createDataFrame([(k, i) for k in "ab" for i in (5, 9000, 12, 8999)], "k string, id long")
    got = sorted((r.k, r.i, r.id) for r in regression.row_index(frame, ["k"], "id").collect())
    assert got == [(k, n, i) for k in "ab" for n, i in enumerate((5, 12, 8999, 9000))]


# ---------------------------------------------------------------- sources and sinks
def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"id": 1, "name": "x"}\n\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in readers.json_lines(spark, str(tmp_path / "a.json.gz"), "id long, name string").collect()) == [1, 2]
    (tmp_path / "t.tsv").write_text("id\tname\n1\tx y\n")
    assert [tuple(r) for r in readers.tab_separated(spark, str(tmp_path / "t.tsv"), "id long, name string").collect()] == [(1, "x y")]
    assert readers.newest_file(spark, f"file://{tmp_path}", ["none", "t.tsv"]).endswith("t.tsv") and readers.newest_file(spark, f"file://{tmp_path}", ["none", "t.tsv"], strict=True) is None
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>http://x</link><category>b</category><category>a</category><description>&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;</description></item></channel></rss>")
    item = readers.feed_items(spark, str(tmp_path / "f.xml")).first()
    assert (item.title, item.guid, item.tags, item.summary) == ("A", "http://x", ["a", "b"], "Hi & bye")


def test_versioned_table(spark, tmp_path):
    table = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    for n in (1, 2, 3):
        assert table.write(spark.range(n)) == n and table.read().count() == n
    (tmp_path / "t" / "v-failed").mkdir()
    (tmp_path / "t" / "CURRENT.draft").write_text("half")
    assert len(table.versions()) == 2 and table.read().count() == 3
    names = lambda: sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith("."))
    assert table.sweep() == ["CURRENT.draft", "v-failed"] and names() == sorted(["CURRENT", *table.versions()])
    before = table.versions()
    with pytest.raises(Exception, match="broken"):
        table.write(spark.range(5).select(F.raise_error(F.lit("broken")).alias("x")))
    assert table.versions() == before and table.read().count() == 3


def test_upsert_takes_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a", 1)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "b", 1), (2, "c", 3), (2, "d", 2), (1, "x", 0), (None, "lost", 9)], old.schema)
    got = latest.upsert(old, new, ["id"], order=["n"])
    assert sorted((r.id, r.name, r.change) for r in got.collect()) == [(1, "x", "updated"), (2, "c", "inserted")]
    assert latest.upsert_counts(got).first().asDict() == {"read": 2, "inserted": 1, "updated": 1}
    assert latest.upsert(old, new, ["id"]).count() == 2


def test_fetch_state(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    empty = spark.createDataFrame([], "k string, last_fetched_at timestamp, last_success_at timestamp, last_changed_at timestamp, attempts long, last_status int, last_error string")
    visit = "k string, at timestamp, status int, changed boolean, error string"
    first = latest.mark_fetch(empty, spark.createDataFrame([("a", day(1), 200, True, None), ("b", day(1), 500, False, "down")], visit), ["k"], ["at"])
    then = latest.mark_fetch(first, spark.createDataFrame([("a", day(3), 404, False, "gone"), ("a", day(2), 204, False, None), ("c", day(2), 200, False, None)], visit), ["k"], ["at"])
    got = {r.k: (r.last_fetched_at, r.last_success_at, r.last_changed_at, r.attempts, r.last_status, r.last_error) for r in then.collect()}
    assert got == {"a": (day(3), day(2), day(1), 3, 404, "gone"), "b": (day(1), None, None, 1, 500, "down"), "c": (day(2), day(2), None, 1, 200, None)}


def test_scores_and_weights(spark):
    scores = spark.createDataFrame([(1, "r1", "x", 5.0, 0.5)], "work long, rubric string, axis string, value double, confidence double")
    judged = spark.createDataFrame([(1, "r1", {"x": (6.0, 0.9), "y": (None, 0.1)})], "work long, rubric string, scores map<string,struct<score:double,confidence:double>>")
    got = sorted((r.axis, r.value) for r in latest.append_scores(scores, judged).where("value is not null").collect())
    assert got == [("x", 5.0), ("x", 6.0)] and latest.append_scores(scores, judged).count() == 3
    journal = spark.createDataFrame([], "prompt_sha256 string, prompt string, rubric string, weights map<string,struct<intercept:double,coef:array<double>,trained_on:long>>, trained_at timestamp")
    trained = lambda n: spark.createDataFrame([("r1", "x", 1.0, [0.5], n), ("r1", "y", 2.0, [0.1], n)], "rubric string, axis string, intercept double, coef array<double>, trained_on long")
    one = latest.journal_weights(journal, trained(10), "p", "2024-01-01")
    two = latest.journal_weights(latest.journal_weights(one, trained(20), "q", "2024-01-02"), trained(30), "p", "2024-01-03")
    assert sorted((r.prompt, str(r.trained_at)[:10], r.weights["y"].trained_on) for r in two.collect()) == [("p", "2024-01-03", 30), ("q", "2024-01-02", 20)]


def test_corpus_export(spark, tmp_path):
    entries = spark.createDataFrame([(1, "a"), (2, "old")], "work long, sha string")
    now = spark.createDataFrame([(1, "a"), (2, "new")], "work long, sha string")
    assert sinks.export_corpus(entries, now, f"{tmp_path}/c") == {"written": 1, "stale": 1}
    assert spark.read.json(f"{tmp_path}/c").count() == 1
    sinks.export_ids(entries, "work", f"{tmp_path}/ids")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/ids").collect()) == ["1", "2"]


# ---------------------------------------------------------------- streaming
def test_stream_appends_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, digest string")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        incremental.append_new(stream, f"{tmp_path}/out", ["id"], f"{tmp_path}/mark").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    rows.where("id = 2").union(spark.createDataFrame([(3, "c")], rows.schema)).write.mode("append").parquet(f"{tmp_path}/in")
    incremental.append_new(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["id"], f"{tmp_path}/mark").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_replayed_batches_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, digest string")
    rows.write.parquet(f"{tmp_path}/in")
    for mark in ("one", "two"):  # a lost checkpoint: the first batch is written again
        incremental.append_new(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["id"], f"{tmp_path}/{mark}").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_marks_and_summaries(spark):
    marks = spark.createDataFrame([("tv", dt.datetime(2024, 1, 1))], "universe string, mark timestamp")
    assert incremental.advance_mark(marks, "tv", "2024-02-01", complete=False).collect() == marks.collect()
    moved = incremental.advance_mark(incremental.advance_mark(marks, "tv", "2024-02-01", complete=True), "film", "2024-03-01", complete=True)
    assert sorted((r.universe, r.mark.month) for r in moved.collect()) == [("film", 3), ("tv", 2)]
    now, made = [0.0], []

    def make():
        made.append(1)
        return spark.range(3)

    cache = incremental.SummaryCache(60, most=5, clock=lambda: now[0])
    for at in (0, 59, 61):
        now[0] = at
        assert len(cache.get("k", make)) == 3
    assert len(made) == 2
    cache.clear()
    cache.get("k", make)
    assert len(made) == 3
    with pytest.raises(ValueError):
        cache.get("wide", lambda: spark.range(6))


def test_stream_windows(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 10:05:00' + make_interval(0, 0, 0, 0, 0, id * 20) ts, 'x' kind from range(6)")
    events.write.parquet(f"{tmp_path}/in")
    query = incremental.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "ts", ["kind"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == sorted(r.n for r in incremental.windowed_counts(events, "ts", ["kind"]).collect()) == [3, 3]


def test_changed_since_needs_a_mark(spark):
    with pytest.raises(ValueError):
        incremental.changed_since([], "id", "t", None)
