"""Full-text search over the postings of an index or of a scanned table.

A source answers `exact(word)` and `prefix(prefix)` with (key, places): `sources.search_index.SearchIndex`
reads them from its buckets, `ScannedTexts` finds them in the texts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import fold
from orrery.functions.unicode import fold_text

SHORTEST, LONGEST = 2, 20
K1 = 1.2
PHRASE_BOOST, ID_BOOST, DEFAULT_RATING = 3.0, 10.0, 5.0


def tokens(text):
    """Folded words of letters and digits."""
    return F.filter(F.split(F.regexp_replace(fold(text), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def query_words(query: str) -> list[str]:
    """The different words of a query, folded like the texts."""
    return list(dict.fromkeys(re.findall("[a-z0-9]+", fold_text(query))))


def prefix_forms(source) -> DataFrame:
    """(prefix, key, tf): every word's prefixes of 2 to 20 characters and the word itself, counted per document."""
    ends = F.sequence(F.lit(SHORTEST), F.least(F.length("token"), F.lit(LONGEST)))
    forms = F.when(F.length("token") < SHORTEST, F.array("token")).otherwise(F.array_distinct(F.array_append(F.transform(ends, lambda n: F.substring(F.col("token"), F.lit(1), n)), F.col("token"))))
    counted = source.postings().select(source.key, F.size("places").cast("long").alias("tf"), F.explode(forms).alias("prefix"))
    return counted.groupBy("prefix", source.key).agg(F.sum("tf").alias("tf"))


def _together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _weighed(tf: DataFrame, source) -> DataFrame:
    """tf (term, key, tf) with idf; the table of terms has a row a query word."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(source.total())).select("term", idf.alias("idf"))
    return tf.join(F.broadcast(weights), "term")


def _counts(source, word: str, prefix: bool) -> DataFrame:
    """(term, key, tf) of one query word: a document's words that start so, or are it."""
    found = source.prefix(word) if prefix and SHORTEST <= len(word) <= LONGEST else source.exact(word)
    tf = found.groupBy(found.columns[0]).agg(F.sum(F.size("places")).alias("tf"))
    return tf.select(F.lit(word).alias("term"), found.columns[0], "tf")


def match_all(source, query: list[str]) -> DataFrame:
    """Documents in which every query word starts some word (or is one, if it is shorter than SHORTEST or longer than LONGEST).

    The score is BM25 without length norms: idf * tf / (tf + K1).
    """
    query = list(dict.fromkeys(query))
    tf = _together([_counts(source, q, True) for q in query])
    scored = _weighed(tf, source).groupBy(tf.columns[1]).agg(F.count("*").alias("terms"), F.sum(F.col("idf") * F.col("tf") / (F.col("tf") + K1)).alias("score"))
    return scored.where(F.col("terms") == len(query)).select(tf.columns[1], "score")


def match_phrase(source, phrase: list[str]) -> DataFrame:
    """T4: documents with the phrase's words at consecutive places, and how often: places moved back by their word's, and met."""
    places = {w: source.exact(w) for w in dict.fromkeys(phrase)}
    key = next(iter(places.values())).columns[0]
    moved = _together([places[w].select(key, F.expr(f"transform(places, p -> p - {at})").alias("starts")) for at, w in enumerate(phrase)])
    met = moved.groupBy(key).agg(F.collect_list("starts").alias("lists")).where(F.size("lists") == len(phrase))  # a list a word of the phrase
    common = F.aggregate(F.slice("lists", 2, len(phrase)), F.element_at("lists", 1), F.array_intersect)
    return met.select(key, F.size(common).cast("long").alias("times")).where("times > 0")


def score_phrase(source, phrase: list[str]) -> DataFrame:
    """BM25 of a phrase of whole words: the sum of its words' idf, times its own frequency's share."""
    df = _together([source.exact(w).agg(F.count("*").alias("df")).select(F.lit(phrase.count(w)).alias("times"), "df") for w in dict.fromkeys(phrase)])
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    whole = df.crossJoin(F.broadcast(source.total())).agg(F.sum(idf * F.col("times")).alias("idf"))
    found = match_phrase(source, phrase)
    return found.crossJoin(F.broadcast(whole)).select(found.columns[0], (F.col("idf") * F.col("times") / (F.col("times") + K1)).alias("score"))


def search(source, query: str, rating: str | None = None) -> DataFrame:
    """Clauses of which one must match, their scores times their boosts added up, times the rating.

    All words as prefixes; the words as a phrase (boost PHRASE_BOOST); a numeric query as the id, whose own score is 1 (boost ID_BOOST).
    """
    phrase = re.findall("[a-z0-9]+", fold_text(query))
    stored = source.documents()
    key = source.key
    found = []
    if phrase:
        found += [match_all(source, phrase), score_phrase(source, phrase).select(key, (F.col("score") * PHRASE_BOOST).alias("score"))]
    if query.strip().isdigit():
        found.append(stored.where(F.col(key) == int(query)).select(key, F.lit(ID_BOOST).alias("score")))
    if not found:
        return stored.where(F.lit(False)).select(key, F.lit(0.0).alias("score"))
    scored = _together(found).groupBy(key).agg(F.sum("score").alias("score"))
    if rating:
        scored = scored.join(stored.select(key, rating), key).select(key, (F.col("score") * F.coalesce(rating, F.lit(DEFAULT_RATING))).alias("score"))
    return scored

