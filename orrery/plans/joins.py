"""Joins (J1-J17) and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import title_key
from orrery.plans.base import Tables, query


@query("j1_left_chain", "SELECT c_custkey, n_name, r_name, coalesce(orders, 0) AS orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_chain(t: Tables) -> DataFrame:
    """The fact side is aggregated before it joins."""
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    joined = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left").join(orders, "c_custkey", "left")
    return joined.select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("j2_inner", "SELECT p_brand, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def inner(t: Tables) -> DataFrame:
    by_part = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    return by_part.join(t.part.select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.sum("lines").alias("lines"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("j3_lateral_latest", "SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true")
def lateral_latest(t: Tables) -> DataFrame:
    """The latest row per key by aggregation, then a left join."""
    newest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return t.customer.select("c_custkey").join(newest, "c_custkey", "left").select("c_custkey", "o.o_orderkey", "o.o_totalprice")


@query("j4_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("j5_anti", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("j6_composite_keys", "SELECT event_id FROM events WHERE (user_id, event_type) IN (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) > 15)")
def composite_keys(t: Tables) -> DataFrame:
    """Pairs of keys."""
    pairs = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 15")
    return t.events.select("event_id", "user_id", "event_type").join(pairs, ["user_id", "event_type"], "left_semi").select("event_id")


@query("j7_guarded_outer", "SELECT l_orderkey, l_linenumber, coalesce(s.s_name, c.c_name) AS name, count(*) AS n FROM lineitem LEFT JOIN supplier s ON l_returnflag = 'R' AND s_suppkey = l_suppkey LEFT JOIN customer c ON l_returnflag <> 'R' AND c_custkey = l_suppkey GROUP BY 1, 2, 3")
def guarded_outer(t: Tables) -> DataFrame:
    """One key, two dimensions, chosen by a guard: a key that is null on the wrong side never matches."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("s_suppkey"), F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("c_custkey"))
    joined = rows.join(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", "left").join(t.customer.select("c_custkey", "c_name"), "c_custkey", "left")
    return joined.groupBy("l_orderkey", "l_linenumber", F.coalesce("s_name", "c_name").alias("name")).agg(F.count("*").alias("n"))


@query("j10_unique_candidate", "WITH w AS (SELECT c_custkey AS work, 1990 + c_nationkey AS y, lower(c_mktsegment) AS k FROM customer), c AS (SELECT s_suppkey AS cand, 1990 + s_nationkey AS y, (['automobile', 'building', 'furniture', 'household', 'machinery'])[1 + s_suppkey % 5] AS k FROM supplier) SELECT work, min(cand) AS cand FROM w JOIN c ON w.k = c.k AND c.y BETWEEN w.y - 1 AND w.y + 1 GROUP BY 1 HAVING count(DISTINCT cand) = 1")
def unique_candidate(t: Tables) -> DataFrame:
    """Same normalised title and a year within one, only if exactly one candidate fits.

    The range becomes an equi-join: each work asks for three years. Candidates are counted per title and year
    before, so a popular title meets a work as one row.
    """
    works = t.customer.select(F.col("c_custkey").alias("work"), F.explode(F.sequence(F.col("c_nationkey") + 1989, F.col("c_nationkey") + 1991)).alias("y"), title_key("c_mktsegment").alias("k"))
    names = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    candidates = t.supplier.select(F.col("s_suppkey").alias("cand"), (F.col("s_nationkey") + 1990).alias("y"), title_key(F.get(names, (F.col("s_suppkey") % 5).cast("int"))).alias("k"))
    candidates = candidates.groupBy("k", "y").agg(F.min("cand").alias("cand"), F.max("cand").alias("other"))
    met = works.join(candidates, ["k", "y"]).groupBy("work").agg(F.min("cand").alias("cand"), F.max("other").alias("other"))
    return met.where("cand = other").select("work", "cand")


@query("j11_reply_threads", "SELECT c.conv_id, c.turn, p.turn AS reply_to, p.role AS reply_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def reply_threads(t: Tables) -> DataFrame:
    """A self join."""
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("reply_to"), F.col("role").alias("reply_role"))
    return t.conversations.select("conv_id", "turn").join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "reply_to", "reply_role")


@query("j14_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def scalar_subquery(t: Tables) -> DataFrame:
    newest = t.orders.agg(F.max("o_orderdate").alias("newest"))
    return t.orders.select("o_orderkey", "o_orderdate").crossJoin(F.broadcast(newest)).where("o_orderdate = newest").select("o_orderkey")


@query("j16_update_from", "SELECT p_partkey, CASE WHEN m.top IS DISTINCT FROM p_size AND m.top IS NOT NULL THEN m.top ELSE p_size END AS p_size, m.top IS DISTINCT FROM p_size AND m.top IS NOT NULL AS changed FROM part LEFT JOIN (SELECT l_partkey, CAST(max(l_quantity) AS INTEGER) AS top FROM lineitem GROUP BY 1) m ON l_partkey = p_partkey")
def update_from(t: Tables) -> DataFrame:
    """A column set from another table where it differs."""
    top = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("int").alias("top"))
    differs = F.col("top").isNotNull() & (F.col("top") != F.col("p_size"))
    return t.part.select("p_partkey", "p_size").join(top, "p_partkey", "left").select("p_partkey", F.when(differs, F.col("top")).otherwise(F.col("p_size")).alias("p_size"), F.coalesce(differs, F.lit(False)).alias("changed"))


@query("u1_union_all", "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")))


@query("u4_union_distinct", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(t: Tables) -> DataFrame:
    """U3, U4."""
    return t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).unionByName(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))).distinct()


@query("u2_distinct_titles", "SELECT p_partkey, len(list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' '))) AS titles FROM part")
def distinct_titles(t: Tables) -> DataFrame:
    """Several sources of titles, each once."""
    parts = F.flatten(F.array(*[F.split(c, " ") for c in ("p_name", "p_type", "p_brand")]))
    return t.part.select("p_partkey", F.size(F.array_distinct(parts)).cast("long").alias("titles"))


@query("u5_set_difference", "WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT (SELECT count(*) FROM a WHERE l_partkey NOT IN (SELECT l_partkey FROM r)) AS only_a, (SELECT count(*) FROM r WHERE l_partkey NOT IN (SELECT l_partkey FROM a)) AS only_r, (SELECT count(*) FROM a WHERE l_partkey IN (SELECT l_partkey FROM r)) AS both")
def set_difference(t: Tables) -> DataFrame:
    """Difference, intersection and symmetric difference from one pass of flags."""
    has = lambda f: F.bool_or(F.col("l_returnflag") == f)
    flags = t.lineitem.groupBy("l_partkey").agg(has("A").alias("a"), has("R").alias("r"))
    return flags.agg(F.count_if(F.expr("a and not r")).alias("only_a"), F.count_if(F.expr("r and not a")).alias("only_r"), F.count_if(F.expr("a and r")).alias("both"))


@query("u6_configured_then_observed", "SELECT lang, min(rank) AS rank FROM (SELECT unnest(['fr', 'en', 'ar']) AS lang, unnest([1, 2, 3]) AS rank UNION ALL SELECT DISTINCT lang, 100 FROM documents) GROUP BY 1")
def configured_then_observed(t: Tables) -> DataFrame:
    """Configured languages in their order, then those observed."""
    wanted = t.spark.createDataFrame([("fr", 1), ("en", 2), ("ar", 3)], "lang string, rank int")
    seen = t.documents.select("lang").distinct().withColumn("rank", F.lit(100))
    return wanted.unionByName(seen).groupBy("lang").agg(F.min("rank").alias("rank"))
