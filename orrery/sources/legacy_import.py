"""Import of an older export in phases (K19, J10, J11, W11, W12): every phase is a table that replays to itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import plain_text, title_key
from orrery.operators.latest import first_per_key


def match_works(works: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(v1_id, id): by external id if it is known, else by normalised title and a year within one if exactly one candidate fits.

    works: v1_id, id (nullable), titles (array), year; catalogue: id, name, year. Works without a match have a null id.
    """
    known = catalogue.select("id").distinct().withColumn("_known", F.lit(True))
    direct = works.join(known, "id", "left").select("v1_id", F.when(F.col("_known"), F.col("id")).alias("direct"), "titles", "year")
    asked = direct.where("direct is null and year is not null").select("v1_id", F.explode("titles").alias("t"), "year")
    asked = asked.select("v1_id", title_key("t").alias("k"), F.explode(F.sequence(F.col("year") - 1, F.col("year") + 1)).alias("year")).where("k is not null").distinct()
    found = asked.join(catalogue.select("id", title_key("name").alias("k"), "year"), ["k", "year"]).groupBy("v1_id").agg(F.min("id").alias("one"), F.max("id").alias("other"))
    return direct.join(found.where("one = other"), "v1_id", "left").select("v1_id", F.coalesce("direct", "one").alias("id"))


def import_positions(tops: DataFrame, matched: DataFrame) -> DataFrame:
    """Members' ranked lists (member, list, items of v1 ids): unknown works drop out, a work listed twice keeps its first place."""
    placed = tops.select("member", "list", F.posexplode("items").alias("at", "v1_id")).join(matched.where("id is not null"), "v1_id")
    return placed.groupBy("member", "list", F.col("id").alias("work")).agg((F.min("at") + 1).alias("rank"))


def import_discoveries(seen: DataFrame, matched: DataFrame) -> DataFrame:
    """First discovery of a work by a member wins: seen: member, v1_id, at."""
    rows = seen.join(matched.where("id is not null"), "v1_id").select("member", F.col("id").alias("work"), "at")
    return rows.groupBy("member", "work").agg(F.min("at").alias("at"))


def import_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews without markup, replies tied to the review they answer if it came along: v1_id, member, text, reply_to_v1."""
    told = first_per_key(reviews, ["v1_id"], [F.col("member").asc_nulls_last()]).select("v1_id", "member", plain_text("text").alias("text"), "reply_to_v1").where("text is not null")
    ids = told.select(F.col("v1_id").alias("reply_to"))
    return told.join(ids, F.col("reply_to_v1") == F.col("reply_to"), "left").select("v1_id", "member", "text", "reply_to")
