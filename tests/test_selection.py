"""Medians by selection, first rows and best images of groups that are too large to gather."""

import random
import statistics

from pyspark.sql import functions as F

from orrery.operators import dossier, records, selection
from orrery.sources.readers import chosen_show, first_article, first_articles, show_images


def test_medians_equal_sorted_positions(spark):
    rng = random.Random(2)
    groups = {
        "even": [rng.gauss(0, 100) for _ in range(3000)], "odd": [rng.randrange(50) * 1.0 for _ in range(1501)], "one": [7.0], "two": [1.0, 4.0], "same": [3.0] * 900,
        "far": [10.0 ** rng.randrange(-300, 300) * rng.choice([-1, 1]) for _ in range(801)], "near": [1 + k * 2.0**-52 for k in range(1000)], "zeros": [0.0] * 5 + [-1e-300, 1e-300], "ends": [float("inf")] * 4 + [float("-inf")] * 3 + [1.0, 2.0], None: [5.0, 6.0, 7.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("even", None), ("none", None), ("odd", float("nan"))]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r["median"] for r in selection.median(frame, ["k"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}
    picks = selection.at_places(frame, ["k"], "v", {"first": F.lit(0), "last": F.expr("n - 1"), "beyond": F.expr("n"), "third": F.expr("n div 3")}).collect()
    for r in picks:
        v = sorted(groups[r.k])
        assert (r.n, r["first"], r["last"], r.beyond, r.third) == (len(v), v[0], v[-1], None, v[len(v) // 3])
    assert selection.median(frame.limit(0), ["k"], "v").collect() == []


def test_medians_of_whole_numbers_in_one_group(spark):
    frame = spark.range(100_001).selectExpr("1 as a", "'x' as b", "cast(id * id % 99991 as int) as v")
    want = sorted(k * k % 99991 for k in range(100_001))[50_000]
    got = selection.median(frame, ["a", "b"], "v").collect()
    assert [tuple(r) for r in got] == [(1, "x", float(want))]


def test_first_articles_equal_the_gathered_ones(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), k, rng.choice([True, False, None]), rng.choice([None, "", "  ", f"text {k}"])) for k in range(80)] + [("only blank", 90, False, " "), ("missing", 91, True, "x")]
    frame = spark.createDataFrame(rows, "k string, n int, missing boolean, extract string")
    pages = F.transform(F.array_sort(F.collect_list(F.struct("n", "missing", "extract"))), lambda p: F.struct(p["missing"].alias("missing"), p["extract"].alias("extract")))
    want = {r.k: r.e for r in frame.groupBy("k").agg(pages.alias("p")).select("k", first_article("p")["extract"].alias("e")).where("e is not null").collect()}
    assert {r.k: r.extract for r in first_articles(frame, ["k"], "n").collect()} == want and len(want) == 4


def test_english_rows_equal_the_gathered_ones(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(12), k, rng.choice(["en", "fr", None]), rng.choice(["US", "GB", None]), rng.choice([None, "", " ", f"o{k}"])) for k in range(120)]
    frame = spark.createDataFrame(rows, "k int, n int, lang string, country string, overview string")
    listed = frame.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "lang", "country", "overview"))), lambda e: F.struct(e["lang"].alias("lang"), e["country"].alias("country"), e["overview"].alias("overview"), e["n"].alias("n"))).alias("e"))
    want = {r.k: r.n for r in listed.select("k", dossier.english_translation(F.col("e"))["n"].alias("n")).where("n is not null").collect()}
    assert {r.k: r.n for r in dossier.english_rows(frame, ["k"], "n", "n").collect()} == want


def test_top_images_equal_the_gathered_ones(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(5), rng.choice([f"/{k % 40}", "", None]), rng.choice([None, 0, 3, rng.randrange(9)])) for k in range(300)]
    frame = spark.createDataFrame(rows, "k int, file_path string, vote_count int")
    want = {r.k: r.p for r in frame.groupBy("k").agg(F.collect_list(F.struct("file_path", "vote_count")).alias("b")).select("k", records.backdrops(F.col("b")).alias("p")).collect()}
    plan = records.top_images(frame, ["k"])
    assert {r.k: r.paths for r in plan.collect()} == want
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_show_images_and_choice(spark):
    rows = spark.createDataFrame([('{"image": {"original": "o", "medium": "m"}}',), ('{"image": {"original": "", "medium": "m"}}',), ('{"image": null}',), ("{}",), ("not json",), (None,)], "p string")
    assert [[i.url for i in r.i] if r.i else r.i for r in rows.select(show_images("p").alias("i")).collect()] == [["o"], ["m"], [], [], [], []]
    found = '[{"show": {"id": 1, "externals": {"imdb": null}}}, {"show": null}, {"show": {"id": 2, "externals": {"imdb": "tt9"}}}, {"show": {"id": 3, "externals": {"imdb": "tt9"}}}]'
    asked = spark.createDataFrame([(found, "tt9"), (found, "tt1"), (found, ""), (found, None), ("{}", "tt9"), (None, "tt9")], "p string, imdb string")
    assert [r.c for r in asked.select(chosen_show("p", "imdb").alias("c")).collect()] == [2, None, None, None, None, None]


def test_facts_of_books_libraries_and_shows(spark):
    book = spark.sql("select named_struct('year', 1951, 'countries', array('FR'), 'languages', array(), 'site_links', 0, 'authors', array(named_struct('qid', 'Q1', 'name', ''), named_struct('qid', '', 'name', cast(null as string)), named_struct('qid', cast(null as string), 'name', 'A')), 'qid', 'Q9', 'olid', '') as facts")
    assert book.select(records.book_facts().alias("f")).first().f == {"annee": "1951", "pays": '["FR"]', "sitelinks": "0", "auteurs": '[{"qid":"Q1"},{"nom":"A"}]', "ids": '{"wikidata":"Q9"}'}
    library = "named_struct('title', 'T', 'olid', 'OL1W', 'by_language', array(named_struct('langue', 'fr', 'nombre', 2L, 'isbn', cast(null as string), 'annee', 1990)), 'total', {}, 'without_language', cast(null as long), 'truncated', true) as facts"
    rows = spark.sql("select " + library.format("2L")).union(spark.sql("select " + library.format("0L")))
    assert [r.f for r in rows.select(records.library_facts().alias("f")).collect()] == [
        {"titre": "T", "editions": '{"par_langue":[{"langue":"fr","nombre":2,"annee":1990}],"total":2,"sans_langue":0,"tronque":true}', "ids": '{"openlibrary":"OL1W"}'},
        {"titre": "T", "ids": '{"openlibrary":"OL1W"}'},
    ]
    show = "named_struct('id', '{}', 'name', 'S', 'premiered', '{}', 'status', '{}', 'country', '{}', 'network', 'N', 'days', array({}), 'time', '', 'episodes', {}, 'dated', 1, 'told', 0, 'imdb', 'tt1') as facts"
    rows = spark.sql("select " + show.format("5", "2020-01-01", "Cancelled", "US", "'Monday'", 3)).union(spark.sql("select " + show.format("x", "soon", "In Development", "", "", 0)))
    assert [r.f for r in rows.select(records.show_facts().alias("f")).collect()] == [
        {"titre": "S", "annee": "2020", "statut": "annulee", "pays": '["US"]', "diffuseur": "N", "calendrier": '{"jours":["Monday"]}', "episodes": '{"total":3,"dates":1,"resumes":0}', "ids": '{"tvmaze":5,"imdb":"tt1"}'},
        {"titre": "S", "diffuseur": "N", "ids": '{"imdb":"tt1"}'},
    ]
