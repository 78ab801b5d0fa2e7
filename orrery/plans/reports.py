"""Runbook reports (R1-R9) and quotes (V16 in part, V17-V18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.base import Tables, query
from orrery.sources.scratch import save


@query("r1_funnel", "SELECT (SELECT count(*) FROM customer) AS catalogue, (SELECT count(DISTINCT o_custkey) FROM orders) AS collected, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS looked_up, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS enriched")
def funnel(t: Tables) -> DataFrame:
    """Four counts from one scan of the orders."""
    per = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).alias("e"))
    counts = per.agg(F.count("*").alias("collected"), F.count_if("f").alias("looked_up"), F.count_if("e").alias("enriched"))
    return t.customer.agg(F.count("*").alias("catalogue")).crossJoin(F.broadcast(counts))


@query("r3_match_routes", "SELECT lang, source, count(*) AS n, row_number() OVER (ORDER BY lang, count(*) DESC, source) AS place FROM documents GROUP BY 1, 2")
def match_routes(t: Tables) -> DataFrame:
    """Two keys, mixed directions; the ranked rows are one per (language, source)."""
    per = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return per.withColumn("place", F.row_number().over(Window.orderBy("lang", F.desc("n"), "source")).cast("long"))


@query("r4_new_changed_gone", "WITH m AS (SELECT max(ts) AS t FROM events), u AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1) SELECT count(CASE WHEN a > t - INTERVAL 24 HOUR THEN 1 END) AS new, count(CASE WHEN b > t - INTERVAL 24 HOUR AND a <= t - INTERVAL 24 HOUR THEN 1 END) AS changed, count(CASE WHEN b <= t - INTERVAL 24 HOUR THEN 1 END) AS gone FROM u, m")
def new_changed_gone(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("t"))
    per = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).crossJoin(F.broadcast(newest)).withColumn("t", F.expr("t - interval 24 hours"))
    return per.agg(F.count_if(F.expr("a > t")).alias("new"), F.count_if(F.expr("b > t and a <= t")).alias("changed"), F.count_if(F.expr("b <= t")).alias("gone"))


_MAPS = "a AS (SELECT l_suppkey AS run, l_returnflag AS axis, avg(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), b AS (SELECT l_suppkey AS run, l_returnflag AS axis, avg(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)"


def _gaps(t: Tables) -> DataFrame:
    """Per run two maps axis -> score, joined on their keys."""
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("axis")).agg(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("f"), F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("o"))
    entry = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("axis", c))))
    maps = per.groupBy("run").agg(entry("f").alias("f"), entry("o").alias("o"))
    gaps = F.map_filter(F.map_zip_with("f", "o", lambda k, x, y: F.abs(x - y)), lambda k, v: v.isNotNull())
    return maps.select("run", F.explode(gaps).alias("axis", "gap"))


@query("r5_mean_gap_of_maps", f"WITH {_MAPS} SELECT a.run, round(avg(abs(a.v - b.v)), 6) AS gap FROM a JOIN b ON a.run = b.run AND a.axis = b.axis GROUP BY 1")
def mean_gap_of_maps(t: Tables) -> DataFrame:
    return _gaps(t).groupBy("run").agg(F.round(F.avg("gap"), 6).alias("gap"))


@query("r6_most_divergent_axis", f"WITH {_MAPS} SELECT a.axis, round(avg(abs(a.v - b.v)), 6) AS gap, count(*) AS runs FROM a JOIN b ON a.run = b.run AND a.axis = b.axis GROUP BY 1")
def most_divergent_axis(t: Tables) -> DataFrame:
    return _gaps(t).groupBy("axis").agg(F.round(F.avg("gap"), 6).alias("gap"), F.count("*").alias("runs"))


@query("r7_sources_of_scored", "SELECT source, count(DISTINCT d.doc_id) AS works FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def sources_of_scored(t: Tables) -> DataFrame:
    return t.documents.select("source", "doc_id").join(t.labels.select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count_distinct("doc_id").alias("works"))


@query("r8_share_non_empty", "SELECT round(100.0 * count(CASE WHEN len(regexp_extract_all(html, '<a ')) > 0 THEN 1 END) / count(*), 4) AS share FROM pages")
def share_non_empty(t: Tables) -> DataFrame:
    return t.pages.agg(F.round(F.count_if(F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))) > 0) * 100.0 / F.count("*"), 4).alias("share"))


@query("r9_translation_lookup", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def translation_lookup(t: Tables) -> DataFrame:
    """One kind of entry out of an array of structs."""
    nested = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("e"))
    return nested.select("conv_id", F.explode(F.filter("e", lambda e: e["role"] == "user")).alias("e")).select("conv_id", "e.turn", "e.text")


@query("v18_tiered_quote", "WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i FROM documents), t AS (SELECT unnest([1000, 5000, 20000, 50000, 100000, 1000000000]) AS tier) SELECT tier, count(*) AS works, count(CASE WHEN n_chars >= 400 THEN 1 END) AS enough, round(sum(n_chars) / 4 * 2.5 / 1e6, 8) AS cost FROM t JOIN r ON i <= tier GROUP BY 1")
def tiered_quote(t: Tables) -> DataFrame:
    """Cost of the first 1000 to 100,000, and of all: each tier is a top-k of the one above, so ranks of all rows aren't needed."""
    rows, tiers = t.documents.select("doc_id", "n_chars"), []
    first = save(rows.orderBy(F.desc("n_chars"), "doc_id").limit(100_000))
    tiers = [(n, first.orderBy(F.desc("n_chars"), "doc_id").limit(n)) for n in (1_000, 5_000, 20_000, 50_000, 100_000)] + [(1_000_000_000, rows)]
    out = None
    for n, part in tiers:
        one = part.agg(F.lit(n).alias("tier"), F.count("*").alias("works"), F.count_if(F.col("n_chars") >= 400).alias("enough"), F.round(F.sum("n_chars") / 4 * 2.5 / 1e6, 8).alias("cost"))
        out = one if out is None else out.unionByName(one)
    return out


@query("v17_validity_gaps", "SELECT d.source, round(avg(CASE WHEN l.toxic = 1 THEN n_chars END) - avg(CASE WHEN l.toxic = 0 THEN n_chars END), 4) AS gap, count(*) AS works FROM documents d JOIN labels l USING (doc_id) GROUP BY 1 HAVING count(*) >= 8")
def validity_gaps(t: Tables) -> DataFrame:
    """The gap between two classes, for groups of enough works."""
    joined = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", "toxic"), "doc_id")
    mean = lambda x: F.avg(F.when(F.col("toxic") == x, F.col("n_chars")))
    return joined.groupBy("source").agg(F.round(mean(1) - mean(0), 4).alias("gap"), F.count("*").alias("works")).where("works >= 8")


@query("v16_matter_diagnostic", "WITH r AS (SELECT d.doc_id, n_chars, quality, row_number() OVER (ORDER BY n_chars, d.doc_id) - 1 AS i, count(*) OVER () AS n FROM documents d JOIN labels l USING (doc_id)) SELECT least(4, i // (n // 4) + 1) AS quartile, count(*) AS works, round(avg(quality), 6) AS quality, round(100.0 * avg(CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END), 4) AS truncated FROM r GROUP BY 1")
def matter_diagnostic(t: Tables) -> DataFrame:
    """Quality and truncation by quartile of length; ranks are counted by length first, then within a length."""
    rows = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    sizes = rows.groupBy("n_chars").agg(F.count("*").alias("_n")).withColumn("_cut", F.floor(F.col("n_chars") / 256))
    cuts = sizes.groupBy("_cut").agg(F.sum("_n").alias("_m"))
    cuts = cuts.select("_cut", F.coalesce(F.sum("_m").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_cut").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_b", before).join(cuts, "_cut").select("n_chars", (F.col("_b") + F.col("_c")).alias("_before"))
    total = rows.agg(F.count("*").alias("n"))
    ranked = rows.join(sizes, "n_chars").withColumn("i", F.col("_before") + F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id")) - 1).crossJoin(F.broadcast(total))
    quartile = F.least(F.lit(4).cast("long"), F.expr("i div (n div 4) + 1"))
    return ranked.groupBy(quartile.alias("quartile")).agg(F.count("*").alias("works"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg(F.when(F.col("n_chars") > 1500, 1).otherwise(0)) * 100.0, 4).alias("truncated"))
