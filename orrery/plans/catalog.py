"""Rated, filtered and paged cards over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import scalars as S
from orrery.operators import paging
from orrery.plans.base import Tables, query

_CARDS = """cards AS (
  SELECT p.p_partkey, p.p_name, p.p_brand, p.p_type, p.p_size, l.votes, l.average,
         CASE WHEN coalesce(l.votes, 0) = 0 THEN NULL ELSE (l.average * l.votes + 325.0) / (l.votes + 50) END AS rating
  FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS votes, sum(l_quantity) / count(*) / 5 AS average FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_partkey = p_partkey)"""


def cards(t: Tables) -> DataFrame:
    """Parts with votes (returned lines), their average and weighted rating; parts without votes are unrated."""
    votes = t.lineitem.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("votes"), (F.sum("l_quantity") / F.count("*") / 5).alias("average"))
    joined = t.part.join(votes, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "votes", "average", S.weighted_rating("average", "votes").alias("rating"))


@query("o3_rated_page", f"WITH {_CARDS} SELECT p_partkey, p_name, votes, round(rating, 6) AS rating, row_number() OVER (ORDER BY round(rating, 9) DESC NULLS LAST, p_partkey DESC) AS position, (SELECT count(*) FROM cards) AS total FROM cards ORDER BY round(rating, 9) DESC NULLS LAST, p_partkey DESC LIMIT 24")
def rated_page(t: Tables) -> DataFrame:
    """The best rated page of 24 with the total."""
    found = cards(t).withColumn("rating", F.round("rating", 9))
    rows = paging.page(found, [("rating", True)], "p_partkey", 0, 24)
    return paging.with_total(rows.select("p_partkey", "p_name", "votes", F.round("rating", 6).alias("rating"), F.col("position").cast("long").alias("position")), t.part)


@query("x1_weighted_rating", f"WITH {_CARDS} SELECT p_partkey, votes, round(rating, 6) AS rating FROM cards")
def weighted_rating(t: Tables) -> DataFrame:
    return cards(t).select("p_partkey", "votes", F.round("rating", 6).alias("rating"))


@query("o1_nulls_last_two_criteria", f"WITH {_CARDS} SELECT p_partkey, row_number() OVER (ORDER BY votes ASC NULLS LAST, p_size DESC NULLS LAST, p_partkey) AS position FROM cards ORDER BY 2 LIMIT 200")
def two_criteria(t: Tables) -> DataFrame:
    """Votes ascending, then size descending; unrated parts last."""
    return paging.page(cards(t), [("votes", False), ("p_size", True)], "p_partkey", 0, 200).select("p_partkey", F.col("position").cast("long").alias("position"))


@query("o4_page_before_aggregate", "WITH page AS (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC LIMIT 50) SELECT c_custkey, c_acctbal, count(o_orderkey) AS orders, count(DISTINCT o_orderstatus) AS statuses FROM page LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def page_before_aggregate(t: Tables) -> DataFrame:
    """The page is cut first, so only its orders are aggregated (the page is at most 50 rows: broadcast)."""
    page = paging.page(t.customer.select("c_custkey", "c_acctbal"), [("c_acctbal", True)], "c_custkey", 0, 50).drop("position")
    orders = t.orders.join(F.broadcast(page.select(F.col("c_custkey").alias("o_custkey"))), "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_distinct("o_orderstatus").alias("statuses"))
    return page.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_acctbal", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("statuses", F.lit(0)).alias("statuses"))


@query("f_filters_combined", "SELECT p_partkey, p_name, p_size FROM part WHERE (p_name ILIKE '%gear%' OR p_partkey = 7) AND p_size BETWEEN 5 AND 40 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#11', 'Brand#12') AND NOT starts_with(p_type, 'ECONOMY')")
def filters_combined(t: Tables) -> DataFrame:
    """Only the criteria given become predicates."""
    wanted: dict = {"text": "gear", "size": (5, 40), "brands": ["Brand#1", "Brand#2", "Brand#3", "Brand#11", "Brand#12"], "not_type": "ECONOMY"}
    rows = t.part
    if text := wanted.get("text"):
        rows = rows.where(F.col("p_name").ilike(f"%{text}%") | (F.col("p_partkey") == 7))
    if size := wanted.get("size"):
        rows = rows.where(F.col("p_size").between(*size))
    if brands := wanted.get("brands"):
        rows = rows.where(F.col("p_brand").isin(brands))
    if prefix := wanted.get("not_type"):
        rows = rows.where(~F.col("p_type").startswith(prefix))
    return rows.select("p_partkey", "p_name", "p_size")


@query("f1_http_success", "SELECT event_id FROM events WHERE 100 + event_id * 7 % 400 BETWEEN 200 AND 299 AND CASE WHEN event_type <> 'error' THEN props END IS NOT NULL")
def http_success(t: Tables) -> DataFrame:
    """answered with success, and with something."""
    rows = t.events.select("event_id", (F.col("event_id") * 7 % 400 + 100).alias("status"), F.when(F.col("event_type") != "error", F.col("props")).alias("payload"))
    return rows.where(S.succeeded("status") & F.col("payload").isNotNull()).select("event_id")


@query("f4_any_of_arrays", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type, ' '), ['STEEL', 'BRASS', 'PROMO'])")
def any_of_arrays(t: Tables) -> DataFrame:
    """genres are OR."""
    return t.part.where(F.arrays_overlap(F.split("p_type", " "), F.array(*[F.lit(x) for x in ("STEEL", "BRASS", "PROMO")]))).select("p_partkey")


@query("f5_json_key_exists", "SELECT event_id FROM events WHERE json_exists(props, '$.k')")
def json_key_exists(t: Tables) -> DataFrame:
    """whether a JSON object has a key."""
    return t.events.where(F.array_contains(F.json_object_keys("props"), "k")).select("event_id")


@query("f6_null_safe", f"WITH {_CARDS} SELECT p_partkey, votes IS NOT DISTINCT FROM p_size AS same, (votes > 5) IS NOT FALSE AS not_false FROM cards")
def null_safe(t: Tables) -> DataFrame:
    return cards(t).select("p_partkey", F.col("votes").eqNullSafe(F.col("p_size")).alias("same"), F.coalesce(F.col("votes") > 5, F.lit(True)).alias("not_false"))


@query("f7_regex", "SELECT page_id, regexp_matches(url, '[?]') AS has_query, NOT regexp_matches(url, '^https') AS plain FROM pages")
def regex(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.col("url").rlike("[?]").alias("has_query"), (~F.col("url").rlike("^https")).alias("plain"))


@query("f9_present", "SELECT doc_id, nullif(trim(text), '') IS NOT NULL AS present FROM documents")
def present(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.present("text").alias("present"))


@query("f10_status_predicates", "SELECT c_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'absent' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'collected' ELSE 'error' END AS status FROM customer")
def status_predicates(t: Tables) -> DataFrame:
    """from one grouped scan instead of two existence checks a row."""
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("ok"))
    status = F.when(F.col("ok").isNull(), "absent").when(F.col("ok"), "collected").otherwise("error")
    return t.customer.select("c_custkey").join(seen, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("f11_visible", "SELECT d.doc_id, lang FROM documents d JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0) USING (doc_id)")
def visible(t: Tables) -> DataFrame:
    """valid and not hidden."""
    good = t.labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).where("q = 1 and x = 0").select("doc_id")
    return t.documents.join(good, "doc_id", "left_semi").select("doc_id", "lang")


@query("f12_eligible", "WITH s AS (SELECT o_custkey, max(o_orderdate) AS seen, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS ok FROM orders GROUP BY 1) SELECT c_custkey FROM customer LEFT JOIN s ON o_custkey = c_custkey WHERE ok IS NULL OR seen > ok OR ok < (SELECT max(o_orderdate) FROM orders) - INTERVAL 300 DAY")
def eligible(t: Tables) -> DataFrame:
    """never succeeded, changed since the last success, or older than 300 days."""
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("ok"))
    now = t.orders.agg(F.max("o_orderdate").alias("now"))
    joined = t.customer.select("c_custkey").join(seen, "c_custkey", "left").crossJoin(F.broadcast(now))
    return joined.where("ok is null or at > ok or ok < now - interval 300 days").select("c_custkey")


@query("a8_facets", "SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def facets(t: Tables) -> DataFrame:
    return paging.facets(t.part, "p_brand")


@query("a8_facets_array", "SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS value FROM part) GROUP BY 1")
def facets_array(t: Tables) -> DataFrame:
    """Facets of an array column."""
    return paging.facets(t.part.select(F.split("p_type", " ").alias("types")), "types", array=True)


@query("j13_hydrate", "SELECT p_partkey, p_name, position FROM part JOIN (SELECT unnest([9, 3, 141, 27, 500]) AS p_partkey, unnest([0, 1, 2, 3, 4]) AS position) USING (p_partkey)")
def hydrate(t: Tables) -> DataFrame:
    """Ranked ids, hydrated in their order."""
    return paging.hydrate(t.part, "p_partkey", [9, 3, 141, 27, 500]).select("p_partkey", "p_name", F.col("position").cast("int").alias("position"))


@query("p14_work_state", "SELECT c_custkey, CASE WHEN seen IS NULL THEN 'absent' WHEN ok_at IS NULL THEN 'error' WHEN expected = 0 THEN 'series_only' WHEN coalesce(done, 0) = 0 THEN 'lang_missing' WHEN done >= expected THEN 'complete' ELSE 'partial' END AS state, CASE WHEN expected > 0 THEN round(done / expected, 6) END AS ratio FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS seen, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END) AS ok_at, count(CASE WHEN o_orderpriority <> '5-LOW' THEN 1 END) AS expected, count(CASE WHEN o_orderpriority <> '5-LOW' AND o_orderstatus = 'F' THEN 1 END) AS done FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def work_state(t: Tables) -> DataFrame:
    """The six states and the coverage ratio."""
    wanted, done = F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") == "F"
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderdate").alias("at"), F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))).alias("ok_at"),
        F.count_if(wanted).alias("expected"), F.count_if(wanted & done).alias("done"),
    )
    joined = t.customer.select("c_custkey").join(seen, "c_custkey", "left")
    return joined.select("c_custkey", S.work_state(F.col("at"), F.col("ok_at"), F.col("expected"), F.col("done")).alias("state"), F.round(S.ratio(F.col("done"), F.col("expected")), 6).alias("ratio"))


@query("p3_field_unification", "SELECT 'c' || c_custkey AS id, c_name AS name, c_acctbal AS popularity, CAST(NULL AS DATE) AS first_date FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, s_acctbal, CAST(NULL AS DATE) FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name, NULL, make_date(1990 + p_size, 1, 1) FROM part")
def field_unification(t: Tables) -> DataFrame:
    """Three universes under one schema, missing columns as typed nulls."""
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("popularity"))
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("popularity"))
    p = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.make_date(F.col("p_size") + 1990, F.lit(1), F.lit(1)).alias("first_date"))
    return c.unionByName(s).unionByName(p, allowMissingColumns=True).select("id", "name", "popularity", "first_date")


@query("p1_json_fields", "SELECT event_id, TRY_CAST(nullif(json_extract_string(props, '$.k'), '') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_fields(t: Tables) -> DataFrame:
    """Paths into JSON, an empty text is null before the cast."""
    return t.events.select("event_id", S.safe_int(F.get_json_object("props", "$.k")).alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("p9_computed_columns", "SELECT page_id, length(html) AS content_chars, len(regexp_extract_all(html, '<img')) AS media_count, CASE WHEN url LIKE '%?%' THEN 2 ELSE 1 END AS priority FROM pages")
def computed_columns(t: Tables) -> DataFrame:
    """Generated columns."""
    return t.pages.select("page_id", F.char_length("html").cast("long").alias("content_chars"), F.regexp_count("html", F.lit("<img")).cast("long").alias("media_count"), F.when(F.col("url").contains("?"), 2).otherwise(1).alias("priority"))


@query("p10_excerpt", "SELECT doc_id, left(text, 1500) AS excerpt, length(text) > 1500 AS truncated FROM documents")
def excerpt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring("text", 1, 1500).alias("excerpt"), (F.char_length("text") > 1500).alias("truncated"))


@query("p13_split_key", "SELECT split_part(key, '/', 1) AS owner, split_part(key, '/', 2) AS part, count(*) AS n FROM (SELECT o_custkey || '/' || o_orderstatus AS key FROM orders) GROUP BY 1, 2")
def split_key(t: Tables) -> DataFrame:
    keyed = t.orders.select(F.concat_ws("/", "o_custkey", "o_orderstatus").alias("key"))
    return keyed.groupBy(S.split_key("key", 1).alias("owner"), S.split_key("key", 2).alias("part")).agg(F.count("*").alias("n"))


@query("p4_slice_and_filter", "SELECT c_custkey, array_to_string(list_sort(list(k))[1:5], ',') AS first_keys, count(CASE WHEN s = 'F' THEN 1 END) AS done FROM customer JOIN (SELECT o_custkey, o_orderkey AS k, o_orderstatus AS s FROM orders) ON o_custkey = c_custkey GROUP BY 1")
def slice_and_filter(t: Tables) -> DataFrame:
    """Ordered array of structs, cut and filtered inside the engine."""
    rows = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("orders"))
    rows = rows.join(t.customer.select("c_custkey"), "c_custkey", "left_semi")
    return rows.select("c_custkey", F.array_join(F.slice(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), 1, 5), ",").alias("first_keys"), F.size(F.filter("orders", lambda o: o["o_orderstatus"] == "F")).cast("long").alias("done"))


@query("p16_language_fallback", "SELECT source, coalesce(max(CASE WHEN lang = 'fr' THEN doc_id END), max(CASE WHEN lang = 'en' THEN doc_id END), max(CASE WHEN lang = 'es' THEN doc_id END)) AS picked, max(CASE WHEN lang = 'fr' THEN doc_id END) IS NOT NULL AS translated FROM documents GROUP BY 1")
def language_fallback(t: Tables) -> DataFrame:
    """The first language present in order of preference."""
    by = {x: F.max(F.when(F.col("lang") == x, F.col("doc_id"))) for x in ("fr", "en", "es")}
    return t.documents.groupBy("source").agg(F.coalesce(*by.values()).alias("picked"), by["fr"].isNotNull().alias("translated"))
