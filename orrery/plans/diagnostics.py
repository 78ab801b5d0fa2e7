"""Diagnostics of scores (V15-V17) and recipes of the graph (G11) on the text and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import diagnostics, graph, records, regression
from orrery.plans.base import Tables, query
from orrery.plans.vectors import _SCALED, _scaled

_WORKS = "works AS (SELECT d.doc_id AS work, 10 * n_chars AS chars, CASE WHEN lang = 'en' THEN 5 * n_chars ELSE 0 END AS article_chars, CASE WHEN lang = 'en' THEN 4 * n_chars END AS article_start, CASE WHEN quality IS NOT NULL THEN quality + n_chars % 7 / 10 END AS error FROM documents d LEFT JOIN labels USING (doc_id))"


def _works(t: Tables) -> DataFrame:
    """Documents, ten times as long, as works; English ones hold an article."""
    en, n = F.col("lang") == "en", F.col("n_chars")
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("work"), (10 * n).alias("chars"), F.when(en, 5 * n).otherwise(0).alias("article_chars"), F.when(en, 4 * n).alias("article_start"), (F.col("quality") + n % 7 / 10).alias("error"))


_SEEN = "CASE WHEN article_start IS NULL THEN 0 ELSE greatest(0, least(12000 - article_start, article_chars)) END"


@query("v16_matter_summary", f"WITH {_WORKS}, s AS (SELECT *, greatest(0, chars - 12000) AS lost, {_SEEN} AS seen FROM works) SELECT count(*) AS works, count(*) FILTER (lost > 0) AS cut, round(sum(lost) / sum(chars), 3) AS share_lost, count(*) FILTER (article_chars > 0) AS articles, count(*) FILTER (article_chars > 0 AND seen >= article_chars) AS whole, count(*) FILTER (article_chars > 0 AND seen > 0 AND seen < article_chars) AS partly, count(*) FILTER (article_chars > 0 AND seen = 0) AS unseen, count(*) FILTER (chars < 6000) AS from_0, count(*) FILTER (chars >= 6000 AND chars < 12000) AS from_6000, count(*) FILTER (chars >= 12000 AND chars < 20000) AS from_12000, count(*) FILTER (chars >= 20000) AS from_20000, round(corr(chars, error) FILTER (error IS NOT NULL), 2) AS correlation FROM s")
def matter_summary(t: Tables) -> DataFrame:
    return diagnostics.matter_summary(_works(t))


@query("v16_error_by_quartile", f"WITH {_WORKS}, r AS (SELECT *, row_number() OVER (ORDER BY chars, work) - 1 AS i, count(*) OVER () AS n FROM works WHERE error IS NOT NULL) SELECT least(4, i // (n // 4) + 1) AS quartile, count(*) AS works, min(chars) AS chars_min, max(chars) AS chars_max, round(avg(error), 3) AS mae FROM r GROUP BY 1")
def error_by_quartile(t: Tables) -> DataFrame:
    return diagnostics.error_by_quartile(_works(t))


@query("v16_neighbourhood", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT b.vec_id AS work, b.label, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id = 0), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, work) AS place FROM n) SELECT work, round(score, 3) AS cosine, place, (SELECT CASE WHEN abs(label + 1 - 5.5) > abs((label + 1) / 2 + 1 - 5.5) THEN 'label' WHEN abs(label + 1 - 5.5) = abs((label + 1) / 2 + 1 - 5.5) THEN 'label' ELSE 'half' END FROM embeddings WHERE vec_id = 0) AS axis, CASE WHEN (SELECT abs(label + 1 - 5.5) >= abs((label + 1) / 2 + 1 - 5.5) FROM embeddings WHERE vec_id = 0) THEN label + 1.0 ELSE (label + 1) / 2 + 1 END AS value FROM r WHERE place <= 10")
def neighbourhood(t: Tables) -> DataFrame:
    """One work's ten nearest, with their scores on its worst predicted axis."""
    from orrery.plans.vectors import _scored

    found = diagnostics.neighbourhood(t.embeddings, _scored(t).select("work", "axis", "value", F.lit(5.5).alias("predicted")), 0)
    return found.withColumn("place", F.col("place").cast("long"))


@query("v17_genre_gap", "WITH x AS (SELECT 'chars' AS axis, n_chars::DOUBLE AS value, lang IN ('en', 'fr') AS has FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'half', n_chars / 2, lang = 'de' FROM documents WHERE lang IS NOT NULL) SELECT axis, count(*) FILTER (has) AS with_genre, round(avg(value) FILTER (has), 2) AS mean_with, round(avg(value) FILTER (NOT has), 2) AS mean_without, round(avg(value) FILTER (has) - avg(value) FILTER (NOT has), 2) AS gap FROM x GROUP BY 1")
def genre_gap(t: Tables) -> DataFrame:
    return diagnostics.genre_gap(_lengths(t), _genres(t), _expected(t))


def _lengths(t: Tables) -> DataFrame:
    axes = F.create_map(F.lit("chars"), F.col("n_chars").cast("double"), F.lit("half"), F.col("n_chars") / 2)
    return t.documents.select(F.col("doc_id").alias("work"), F.explode(axes).alias("axis", "value"))


def _genres(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("work"), F.upper("lang").alias("genre"))


def _expected(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("chars", "én"), ("chars", "Fr"), ("half", "de")], "axis string, genre string")


@query("v17_orphan_genres", "SELECT lang AS genre, count(*) AS works FROM documents WHERE lang NOT IN ('en', 'fr', 'de') GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 8")
def orphan_genres(t: Tables) -> DataFrame:
    return diagnostics.orphan_genres(_genres(t), _expected(t))


@query("v17_counter_judge", "SELECT 'quality' AS axis, count(*) AS works, round(avg(abs(quality - (1 - toxic))), 2) AS mean_gap FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def counter_judge(t: Tables) -> DataFrame:
    """The newest of two verdicts counts."""
    scores = t.labels.select(F.col("doc_id").alias("work"), F.lit("quality").alias("axis"), F.col("quality").alias("value"))
    verdict = lambda at, value: t.labels.select(F.col("doc_id").alias("work"), F.lit(at).alias("at"), F.lit("quality").alias("axis"), value.alias("value"))
    return diagnostics.counter_judge(scores, verdict(2, 1 - F.col("toxic")).unionByName(verdict(1, F.col("toxic"))))


@query("v17_anchor_summary", "WITH a AS (SELECT * FROM (VALUES ('size', 'red widget', 4.0), ('size', 'smallring', 9.0), ('size', 'nosuch', 1.0), ('price', 'bluebolt', 2.0), ('mood', 'nosuch', 2.0)) x(axis, k, wanted)), n AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k, min(p_partkey) AS work FROM part GROUP BY 1), s AS (SELECT p_partkey AS work, 'size' AS axis, p_size / 5 AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice / 500 FROM part), g AS (SELECT a.axis, n.work, s.value - a.wanted AS gap FROM a JOIN n ON n.k = replace(a.k, ' ', '') JOIN s ON s.work = n.work AND s.axis = a.axis) SELECT a.axis, count(*) AS declared, coalesce(max(f.found), 0) AS found, max(f.mean_gap) AS mean_gap, max(f.worst) AS worst FROM a LEFT JOIN (SELECT axis, count(*) AS found, round(avg(abs(gap)), 2) AS mean_gap, arg_max(work, (abs(gap), -work)) AS worst FROM g GROUP BY 1) f ON f.axis = a.axis GROUP BY 1")
def anchor_summary(t: Tables) -> DataFrame:
    """Anchors as a rubric writes them; of several works of one title the first counts."""
    anchors = t.spark.createDataFrame([("size", "Red Widget!", 4.0), ("size", "small-ring", 9.0), ("size", "nosuch", 1.0), ("price", "Blue Bolt", 2.0), ("mood", "nosuch", 2.0)], "axis string, title string, wanted double")
    titles = t.part.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("work"))
    axes = F.create_map(F.lit("size"), F.col("p_size") / 5, F.lit("price"), F.col("p_retailprice") / 500)
    scores = t.part.select(F.col("p_partkey").alias("work"), F.explode(axes).alias("axis", "value"))
    return diagnostics.anchor_summary(anchors, records.anchor_gaps(scores, titles, anchors))


@query("v15_encoders")
def encoders(t: Tables) -> DataFrame:
    """Whole vectors against their first half as another encoder."""
    from orrery.plans.vectors import _scored

    whole = _scored(t)
    half = whole.withColumn("embedding", F.slice("embedding", 1, 32)).withColumn("encoder", F.lit("half"))
    return regression.compare_encoders(whole.withColumn("encoder", F.lit("whole")).unionByName(half))


@query("v15_missing_vectors", "SELECT doc_id AS work, sha256(text) AS sha FROM documents WHERE doc_id NOT IN (SELECT d.doc_id FROM documents d JOIN labels USING (doc_id) WHERE quality = 1)")
def missing_vectors(t: Tables) -> DataFrame:
    """Vectors are kept by text and encoder; those of a stale text or of another encoder are to be made."""
    dossiers = t.documents.select(F.col("doc_id").alias("work"), F.sha2("text", 256).alias("sha"))
    labels = t.labels.select(F.col("doc_id").alias("work"), "quality")
    kept = dossiers.join(labels, "work").select("work", F.when(F.col("quality") == 1, F.col("sha")).otherwise("stale").alias("sha"), F.lit("mine").alias("encoder"))
    return regression.missing_vectors(dossiers, kept.unionByName(dossiers.withColumn("encoder", F.lit("other"))), "mine")


_PAIRS = f"{_SCALED}, s AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e), c AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.size, q.size AS own, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM s q JOIN s e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM c)"


@query("g11_nearest_works", f"WITH {_SCALED}, d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, id, round(distance, 5) AS distance, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + distance * distance), 9) DESC, id) AS place FROM d) WHERE place <= 5")
def nearest_works(t: Tables) -> DataFrame:
    """The five nearest in the scale of the scores."""
    found = graph.nearest_works(_scaled(t), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "id", F.round("distance", 5).alias("distance"), F.col("place").cast("long").alias("place"))


@query("g11_same_colour", f"WITH {_PAIRS} SELECT query_id, id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM p WHERE rn <= 50 AND size > own) WHERE place <= 5")
def same_colour(t: Tables) -> DataFrame:
    """Like directions, stronger ones only."""
    found = graph.same_colour(_scaled(t), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("g11_colour_and_links", f"WITH {_PAIRS}, k AS (SELECT p.query_id, p.id, p.score, (p.query_id % 13 = p.id % 13)::INT + (p.query_id % 7 = p.id % 7)::INT AS links FROM p JOIN embeddings a ON a.vec_id = p.query_id JOIN embeddings b ON b.vec_id = p.id WHERE rn <= 200 AND a.label % 3 = b.label % 3) SELECT query_id, id, round(score, 6) AS score, links::BIGINT AS links, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, links DESC, id) AS place FROM k) WHERE place <= 10")
def colour_and_links(t: Tables) -> DataFrame:
    """Like directions that share a genre, by the people they share."""
    genres = t.embeddings.select(F.col("vec_id").alias("work"), (F.col("label") % 3).alias("genre"))
    people = t.embeddings.select(F.col("vec_id").alias("work"), F.explode(F.array(F.col("vec_id") % 13, F.col("vec_id") % 7 + 100)).alias("person"))
    found = graph.same_colour_and_links(_scaled(t), F.col("vec_id") % 100 == 0, genres, people)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "links", F.col("place").cast("long").alias("place"))
