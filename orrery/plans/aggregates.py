"""Aggregations (A1-A18), window-type operators (W4-W11) and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import paging, selection
from orrery.plans.base import Tables, query


@query("a1_filtered_counts", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def filtered_counts(t: Tables) -> DataFrame:
    """A1: distinct per (group, key) once, then plain counts: one shuffle on many keys instead of an expansion."""
    per = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("f"))
    return per.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.count("*").alias("customers"), F.count_if("f").alias("done"))


@query("a2_min_max", "SELECT event_type, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def min_max(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("a3_object_aggregation", "SELECT c_custkey, string_agg(s || '=' || n, ',' ORDER BY s) AS by_status FROM (SELECT o_custkey AS c_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def object_aggregation(t: Tables) -> DataFrame:
    """A3: a map per key, compared as ordered text."""
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").agg(F.count("*").alias("n"))
    maps = per.groupBy("c_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("c_custkey", F.array_join(entries, ",").alias("by_status"))


@query("a4_ordered_array", "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def ordered_array(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda r: r["role"]), ">").alias("roles"))


@query("a5_distinct_array", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY 1")
def distinct_array(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("a6_completeness", "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5")
def completeness(t: Tables) -> DataFrame:
    """Only groups that have every kind."""
    return t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).where("n = 5").select("user_id")


@query("a7_summary", "SELECT count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open, count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS large, max(o_orderdate) AS newest FROM orders")
def summary(t: Tables) -> DataFrame:
    """All counters in one pass."""
    return t.orders.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.max("o_orderdate").alias("newest"))


@query("a9_group_sizes", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def group_sizes(t: Tables) -> DataFrame:
    """A9, R2."""
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("a10_string_concat", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY 1")
def string_concat(t: Tables) -> DataFrame:
    """A10: distinct, in canonical order."""
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


@query("a11_top_per_key", "SELECT o_custkey, o_orderkey, nth FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth <= 4")
def top_per_key(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return paging.top_per_key(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey", F.col("nth").cast("long").alias("nth"))


@query("a12_canonical_rollup", "SELECT coalesce(n.n_regionkey, -1) AS canonical, count(*) AS citations FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey GROUP BY 1")
def canonical_rollup(t: Tables) -> DataFrame:
    """Counts under the canonical key."""
    per = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return per.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.coalesce("n_regionkey", F.lit(-1)).alias("canonical")).agg(F.sum("n").alias("citations"))


@query("a13_with_without_gap", "SELECT p_brand, round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS with_r, round(avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 4) AS without_r, round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) - avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 4) AS gap FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def with_without_gap(t: Tables) -> DataFrame:
    joined = t.lineitem.select("l_partkey", "l_returnflag", "l_quantity").join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    a, b = (F.avg(F.when(c, F.col("l_quantity"))) for c in (F.col("l_returnflag") == "R", F.col("l_returnflag") != "R"))
    return joined.groupBy("p_brand").agg(F.round(a, 4).alias("with_r"), F.round(b, 4).alias("without_r"), F.round(a - b, 4).alias("gap"))


@query("a14_quartiles_by_position", "WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, CASE WHEN n // 4 = 0 THEN 4 ELSE least(4, i // (n // 4) + 1) END AS quartile, count(*) AS works, min(n_chars) AS least, max(n_chars) AS most FROM r GROUP BY 1, 2")
def quartiles_by_position(t: Tables) -> DataFrame:
    rows = paging.buckets_by_position(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars"), F.col("doc_id")], 4, "quartile")
    return rows.groupBy("source", F.col("quartile").cast("long").alias("quartile")).agg(F.count("*").alias("works"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("a15_guarded_correlation", "SELECT l_returnflag, CASE WHEN stddev_pop(l_quantity) > 1e-9 AND stddev_pop(l_extendedprice) > 1e-9 THEN round(corr(l_quantity, l_extendedprice), 6) END AS r FROM lineitem GROUP BY 1")
def guarded_correlation(t: Tables) -> DataFrame:
    spread = (F.stddev_pop("l_quantity") > 1e-9) & (F.stddev_pop("l_extendedprice") > 1e-9)
    return t.lineitem.groupBy("l_returnflag").agg(F.when(spread, F.round(F.corr("l_quantity", "l_extendedprice"), 6)).alias("r"))


@query("a16_mean_absolute_error", "SELECT l_linestatus, round(avg(abs(l_quantity - 25)), 6) AS mae FROM lineitem GROUP BY 1")
def mean_absolute_error(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.avg(F.abs(F.col("l_quantity") - 25)), 6).alias("mae"))


@query("a17_coverage_profile", "SELECT lang, round(avg(n_chars), 4) AS mean, median(n_chars) AS median, round(avg(CASE WHEN n_chars >= 400 THEN 100.0 ELSE 0 END), 4) AS enough FROM documents GROUP BY 1")
def coverage_profile(t: Tables) -> DataFrame:
    """The median by selection, so that one language may hold all rows."""
    rows = t.documents.select("lang", "n_chars")
    means = rows.groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.avg(F.when(F.col("n_chars") >= 400, 100.0).otherwise(0.0)), 4).alias("enough"))
    middle = selection.median(rows, ["lang"], "n_chars").withColumnRenamed("lang", "_lang")
    return means.join(middle, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")


@query("a18_match_quality", "WITH c AS (SELECT l_partkey AS k, l_suppkey % 7 = l_partkey % 7 AS ok, l_quantity / 50 AS score, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS place FROM lineitem) SELECT count(DISTINCT k) AS cases, count(CASE WHEN place = 1 AND ok THEN 1 END) AS top_right, count(CASE WHEN place = 1 AND NOT ok AND score >= 0.9 THEN 1 END) AS confident_wrong, count(DISTINCT CASE WHEN place > 1 AND ok THEN k END) AS right_deeper FROM c")
def match_quality(t: Tables) -> DataFrame:
    """Of ranked candidates, how often the first is right, confidently wrong, or a later one right."""
    order = Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    rows = t.lineitem.select("l_partkey", (F.col("l_suppkey") % 7 == F.col("l_partkey") % 7).alias("ok"), "l_quantity", F.row_number().over(order).alias("place"))
    per = rows.groupBy("l_partkey").agg(F.bool_or(F.expr("place = 1 and ok")).alias("right"), F.bool_or(F.expr("place = 1 and not ok and l_quantity / 50 >= 0.9")).alias("wrong"), F.bool_or(F.expr("place > 1 and ok")).alias("deeper"))
    return per.agg(F.count("*").alias("cases"), F.count_if("right").alias("top_right"), F.count_if("wrong").alias("confident_wrong"), F.count_if("deeper").alias("right_deeper"))


@query("w4_deciles", "SELECT decile, min(c_acctbal) AS least, max(c_acctbal) AS most, count(*) AS n FROM (SELECT c_acctbal, ntile(10) OVER (ORDER BY c_acctbal DESC, c_custkey) AS decile FROM customer) GROUP BY 1")
def deciles(t: Tables) -> DataFrame:
    """Ntile from ranks that are counted by ranges first, so no task sorts all rows.

    The ranges are bounds of 100 quantiles, collected as numbers; ranks are exact whatever the bounds are.
    """
    rows = t.customer.select("c_custkey", "c_acctbal")
    bounds = sorted(set(rows.approxQuantile("c_acctbal", [i / 100 for i in range(1, 100)], 0.005)))
    cut = rows.withColumn("_cut", F.array_size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b >= F.col("c_acctbal"))))
    sizes = cut.groupBy("_cut").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_cut", F.coalesce(F.sum("_n").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    nth = F.row_number().over(Window.partitionBy("_cut").orderBy(F.desc("c_acctbal"), "c_custkey"))
    ranked = cut.join(F.broadcast(sizes), "_cut").withColumn("_i", F.col("_before") + nth - 1)  # 100 rows at most
    size, extra = F.floor(F.col("_all") / 10), F.col("_all") % 10
    decile = F.when(F.col("_i") < extra * (size + 1), F.floor(F.col("_i") / (size + 1))).otherwise(extra + F.floor((F.col("_i") - extra * (size + 1)) / size)) + 1
    return ranked.groupBy(decile.cast("long").alias("decile")).agg(F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"), F.count("*").alias("n"))


@query("w6_ordinality", "SELECT p_partkey, i AS place, string_split(p_type, ' ')[i] AS word FROM part, unnest(range(1, len(string_split(p_type, ' ')) + 1)) r(i)")
def ordinality(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("at", "word")).select("p_partkey", (F.col("at") + 1).cast("long").alias("place"), "word")


@query("w8_evenly_spaced", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR i IN (0, round_even((n - 1) / 3, 0), round_even(2 * (n - 1) / 3, 0), n - 1)")
def evenly_spaced(t: Tables) -> DataFrame:
    return paging.evenly_spaced(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 4)


@query("w9_stride_sample", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, doc_id FROM r WHERE i % greatest(n // 20, 1) = 0 AND i // greatest(n // 20, 1) < 20")
def stride_sample(t: Tables) -> DataFrame:
    """Twenty of each stratum: sampling is the feature."""
    return paging.stride_sample(t.documents.select("lang", "doc_id"), ["lang"], [F.col("doc_id")], 20)


@query("w11_first_in_list", "SELECT user_id, event_type, min(rn) AS place FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1, 2")
def first_in_list(t: Tables) -> DataFrame:
    """Repeats within a list keep the first place."""
    ranked = t.events.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rn"))
    return ranked.groupBy("user_id", "event_type").agg(F.min("rn").cast("long").alias("place"))


@query("o8_natural_sort", "SELECT key, row_number() OVER (ORDER BY split_part(key, '/s', 1), CAST(split_part(key, '/s', 2) AS INTEGER)) AS place FROM (SELECT DISTINCT l_returnflag || '/s' || l_linenumber AS key FROM lineitem)")
def natural_sort(t: Tables) -> DataFrame:
    """Suffixes as numbers; there are as many keys as (flag, line number) pairs."""
    keys = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.lit(1))
    order = Window.orderBy("l_returnflag", "l_linenumber")
    return keys.select(F.concat("l_returnflag", F.lit("/s"), "l_linenumber").alias("key"), F.row_number().over(order).cast("long").alias("place"))


@query("o9_longest_first", "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS place FROM documents) WHERE place <= 2")
def longest_first(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "doc_id", F.char_length("text").alias("n"))
    return paging.top_per_key(rows, ["source"], [F.desc("n"), F.col("doc_id")], 2, "place").select("source", "doc_id", F.col("place").cast("long").alias("place"))


@query("o12_ranked_by_cases", "SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, value DESC NULLS LAST, event_id) AS place FROM events) WHERE place <= 100")
def ranked_by_cases(t: Tables) -> DataFrame:
    """Rank by listed values, then value: a top-k, so a hundred rows reach the last task."""
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    order = [rank, F.desc_nulls_last("value"), F.col("event_id")]
    top = t.events.select("event_id", "event_type", "value").orderBy(*order).limit(100)
    return top.select("event_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("o14_top_in_stratum", "SELECT p_partkey, p_retailprice FROM part WHERE p_size < 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def top_in_stratum(t: Tables) -> DataFrame:
    return t.part.where("p_size < 10").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30)


@query("o7_random_order")
def random_order(t: Tables) -> DataFrame:
    """A seeded random sample of a hundred (a top-k of hashes, so reruns agree)."""
    return t.customer.select("c_custkey").orderBy(F.xxhash64("c_custkey", F.lit(11))).limit(100)
