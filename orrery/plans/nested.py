"""Nested-record operators bound to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import records
from orrery.plans.base import Tables, query


@query("p19_credit_flattening", "SELECT work, person, credit FROM (SELECT l_partkey AS work, l_suppkey AS person, l_orderkey AS o, min(l_linenumber) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey) - 1 AS credit FROM lineitem GROUP BY 1, 2, 3) WHERE credit < 15 AND person % 7 <> 0")
def credit_flattening(t: Tables) -> DataFrame:
    """The first fifteen credited of a part (suppliers by order), those without an id left out."""
    rows = t.lineitem.groupBy("l_partkey", "l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("n"))
    member = F.struct("l_orderkey", "l_suppkey")
    listed = rows.groupBy(F.col("l_partkey").alias("work")).agg(F.array_sort(F.collect_list(member)).alias("m"))
    no_role = F.lit(None).cast("array<struct<character:string,episode_count:int>>")
    shaped = F.transform("m", lambda m: F.struct(
        F.when(m["l_suppkey"] % 7 != 0, m["l_suppkey"]).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("profile_path"), F.lit(None).cast("string").alias("character"),
        F.lit(None).cast("int").alias("order"), F.lit(None).cast("int").alias("total_episode_count"), no_role.alias("roles"),
    ))
    edges = records.credit_edges(listed.select("work", records.cast_of(shaped).alias("people")), "work", "people", "ACTED")
    return edges.select("work", "person", F.col("credit").cast("long").alias("credit"))


@query("d4_top_images", "SELECT user_id, string_agg(path, ',' ORDER BY place) AS paths FROM (SELECT user_id, '/' || event_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(value) AS INTEGER) DESC, '/' || event_id) AS place FROM events) WHERE place <= 6 GROUP BY 1")
def top_images(t: Tables) -> DataFrame:
    """Six paths by votes, ties by path."""
    images = t.events.select("user_id", F.concat(F.lit("/"), "event_id").alias("file_path"), F.floor("value").cast("int").alias("vote_count"))
    return records.top_images(images, ["user_id"]).select("user_id", F.array_join("paths", ",").alias("paths"))


@query("p18_offers", "SELECT nation, kind, string_agg(c_name, ',' ORDER BY priority, c_name) AS providers FROM (SELECT c_nationkey AS nation, CASE c_mktsegment WHEN 'BUILDING' THEN 'flatrate' WHEN 'MACHINERY' THEN 'rent' ELSE 'buy' END AS kind, c_name, CAST(c_custkey % 5 AS INTEGER) AS priority FROM customer) GROUP BY 1, 2")
def watch_offers(t: Tables) -> DataFrame:
    """Offers by country, kind and priority."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "flatrate").when(F.col("c_mktsegment") == "MACHINERY", "rent").otherwise("buy")
    per = t.customer.groupBy(F.col("c_nationkey").alias("nation"), kind.alias("kind")).agg(F.array_sort(F.collect_list(F.struct(F.col("c_name").alias("provider_name"), (F.col("c_custkey") % 5).cast("int").alias("display_priority")))).alias("p"))
    maps = per.groupBy("nation").agg(F.map_from_entries(F.collect_list(F.struct("kind", "p"))).alias("w"))
    return maps.select("nation", F.explode(records.offers(F.col("w"))).alias("o")).select("nation", "o.kind", F.array_join("o.providers", ",").alias("providers"))


@query("p20_book_records", "WITH w AS (SELECT source AS work, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents GROUP BY 1), a AS (SELECT source AS work, lang AS article_lang, row_number() OVER (PARTITION BY source ORDER BY coalesce(array_position(['fr', 'en'], lang), 9), length(text) DESC, lang) AS rn FROM documents) SELECT work, article_lang, languages FROM w JOIN a USING (work) WHERE rn = 1")
def book_records(t: Tables) -> DataFrame:
    """P20: one record a work from its sources; the article in the preferred language."""
    none = F.lit(None).cast("map<string,string>")
    sources = t.documents.select(F.col("source").alias("work"), F.lit("wikipedia").alias("source"), "lang", F.col("text").alias("content"), none.alias("facts"))
    works = t.documents.select(F.col("source").alias("work")).distinct().select("work", F.col("work").alias("title"), F.lit(None).cast("int").alias("year"))
    return records.assemble_books(works, sources, ["fr", "en"]).select("work", "article_lang", F.array_join(F.array_sort("languages"), ",").alias("languages"))


@query("p6_prefer_filled", "SELECT c_custkey, coalesce(f, o, 0) AS first_list FROM customer LEFT JOIN (SELECT o_custkey, nullif(count(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0) AS f, count(*) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def prefer_filled(t: Tables) -> DataFrame:
    """The finished orders unless there are none, else all."""
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("f"), F.collect_list("o_orderkey").alias("o"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.greatest(F.coalesce(F.size(records.prefer_filled(F.col("f"), F.col("o"))), F.lit(0)), F.lit(0)).cast("long").alias("first_list"))


@query("v12_ablation")
def ablation(t: Tables) -> DataFrame:
    """What half of the coordinates contribute."""
    half = F.transform("embedding", lambda x, i: F.when(i < 32, x.cast("double")).otherwise(0.0))
    rows = t.embeddings.where("label is not null").select(F.col("vec_id").alias("work"), F.lit("label").alias("axis"), (F.col("label") + 1.0).alias("value"), F.col("embedding").alias("with_section"), half.alias("without_section"))
    return records.ablation(rows)


@query("k19_import_positions", "WITH m AS (SELECT o_custkey AS member, l_partkey AS item, min(l_linenumber) AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT member, item AS work, place AS rank FROM m WHERE item % 3 <> 0")
def import_positions(t: Tables) -> DataFrame:
    """Lists of members; unknown works drop out, repeats keep the first place."""
    from orrery.sources.legacy_import import import_positions as phase

    rows = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    # a list holds at every place (line number) one part; several at a place make several lists
    lists = rows.groupBy(F.col("o_custkey").alias("member"), "l_partkey").agg(F.min("l_linenumber").alias("place"))
    lists = lists.select("member", F.lit(1).alias("list"), F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("place") - 1), F.array("l_partkey")).alias("items"))
    matched = t.part.select(F.col("p_partkey").alias("v1_id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("id"))
    return phase(lists, matched).select("member", "work", "rank")
