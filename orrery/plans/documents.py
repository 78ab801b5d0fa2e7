"""Dossiers, translations, feeds and readers on the text tables (D1-D8, S-readers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import dossier, latest
from orrery.plans.base import Tables, query
from orrery.sources.scratch import new_folder, save


@query("d1_english_translation", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE lang = 'en') WHERE rn = 1")
def english_translation(t: Tables) -> DataFrame:
    """Among translations the English one of US origin (none here), else the first."""
    entries = t.documents.select("source", "doc_id", "lang", F.lit("GB").alias("country"), F.col("doc_id").cast("string").alias("overview"))
    return dossier.english_rows(entries, ["source"], "doc_id", "doc_id")


@query("d2_latest_in_language", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents WHERE lang = 'fr') WHERE rn = 1")
def latest_in_language(t: Tables) -> DataFrame:
    return latest.latest_per_key(t.documents.where("lang = 'fr'").select("source", "doc_id"), ["source"], ["doc_id"])


@query("d3_dossier", "SELECT c_custkey, sha256(d) AS sha, length(d) AS chars, length(d) >= 400 AS enough FROM (SELECT c_custkey, concat_ws(chr(10) || chr(10), 'NAME: ' || c_name, 'SEGMENT: ' || nullif(trim(c_mktsegment), ''), 'COUNTRY: ' || n_name, 'ORDERS: ' || o, 'MATERIAL: ' || concat_ws(', ', 'NAME', 'SEGMENT', 'COUNTRY', CASE WHEN o IS NOT NULL THEN 'ORDERS' END)) AS d FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey || ' ' || o_orderpriority, '; ' ORDER BY o_orderkey) AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey)")
def dossiers(t: Tables) -> DataFrame:
    """D3: labelled sections, the missing ones left out; a digest, a length, and whether it is enough."""
    done = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("o"))
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(done, "c_custkey", "left")
    orders = F.array_join(F.transform("o", lambda o: F.concat_ws(" ", o["o_orderkey"], o["o_orderpriority"])), "; ")
    made = dossier.assemble(rows, "c_custkey", [("NAME", F.col("c_name")), ("SEGMENT", F.col("c_mktsegment")), ("COUNTRY", F.col("n_name")), ("ORDERS", orders)])
    return made.select("c_custkey", "sha", F.col("chars").cast("long").alias("chars"), "enough")


@query("d7_newest_events", "SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_events(t: Tables) -> DataFrame:
    """A news feed of fifty."""
    return t.events.select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("d8_enrichment_by_source", "SELECT source, count(*) AS works, sum(length(text))::BIGINT AS chars, count(DISTINCT lang) AS langs, max(doc_id) AS newest FROM documents GROUP BY 1")
def enrichment_by_source(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("works"), F.sum(F.char_length("text")).alias("chars"), F.count_distinct("lang").alias("langs"), F.max("doc_id").alias("newest"))


@query("s9_fan_out", "SELECT c_custkey, season, lang FROM (SELECT c_custkey, unnest(range(1, 1 + 1 + c_nationkey % 3)) AS season FROM customer), (SELECT unnest(['fr', 'en']) AS lang)")
def fan_out(t: Tables) -> DataFrame:
    """A row per season and language still to read."""
    from orrery.sources.readers import fan_out as spread

    rows = t.customer.select("c_custkey", F.sequence(F.lit(1).cast("long"), (F.col("c_nationkey") % 3 + 1).cast("long")).alias("seasons"))
    return spread(rows, "seasons", ["fr", "en"]).select("c_custkey", "season", "lang")


@query("s8_changed_ids", "SELECT DISTINCT user_id AS id, (SELECT max(event_id) FROM events) // 500 >= 12 AS truncated FROM events WHERE event_id // 500 < 12")
def changed_ids(t: Tables) -> DataFrame:
    """A paged feed that stops at its first bad page (page 12 here)."""
    from orrery.sources.readers import changed_ids as read

    pages = t.events.groupBy(F.expr("event_id div 500").alias("page")).agg(F.collect_set("user_id").alias("ids")).withColumn("ok", F.col("page") != 12)
    return read(pages)


@query("s19_editions_by_language", "SELECT source AS work, coalesce(lang, '') AS lang, count(*) AS editions, arg_min(doc_id::VARCHAR, doc_id) AS isbn, min(1900 + n_chars % 100)::INTEGER AS first_year FROM documents GROUP BY 1, 2")
def editions(t: Tables) -> DataFrame:
    from orrery.sources.readers import editions_by_language

    rows = t.documents.select(F.col("source").alias("work"), F.col("doc_id").alias("position"), "lang", F.col("doc_id").cast("string").alias("isbn_13"), F.lit(None).cast("string").alias("isbn_10"), F.concat(F.lit("printed in "), (F.col("n_chars") % 100 + 1900).cast("string")).alias("published"))
    return editions_by_language(rows)


@query("s10_sparql_rows", "SELECT p_partkey, nullif(trim(p_name), '') AS label, array_to_string(list_sort(list_distinct(list_filter(string_split(replace(p_type, ' ', '|'), '|'), lambda x: x <> ''))), ',') AS genres FROM part")
def sparql_rows(t: Tables) -> DataFrame:
    """Bindings to flat rows, concatenated lists in canonical order."""
    from orrery.sources.readers import sparql_rows as flatten

    value = lambda c: F.struct(c.alias("value"))
    rows = t.part.select("p_partkey", F.create_map(F.lit("label"), value(F.col("p_name")), F.lit("genres"), value(F.replace("p_type", F.lit(" "), F.lit("|")))).alias("bindings"))
    return flatten(rows, single=("label",), lists=("genres",)).select("p_partkey", "label", F.array_join("genres", ",").alias("genres"))


@query("s15_site_links", "SELECT n_nationkey, array_to_string(list_sort(['en=' || n_name, 'fr=' || n_name]), ',') AS links FROM nation")
def site_links(t: Tables) -> DataFrame:
    from orrery.sources.readers import site_links as read

    links = F.create_map(F.lit("enwiki"), "n_name", F.lit("frwiki"), "n_name", F.lit("commonswiki"), "n_name", F.lit("enwikiquote"), "n_name")
    entries = F.array_sort(F.map_entries(read(links)))
    return t.nation.select("n_nationkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("links"))


@query("s16_first_article", "SELECT source, arg_min(text, doc_id) AS extract FROM documents WHERE lang <> 'en' AND trim(text) <> '' GROUP BY 1")
def first_article(t: Tables) -> DataFrame:
    """The first article that isn't missing (English ones are, here) and says something."""
    from orrery.sources.readers import first_articles

    return first_articles(t.documents.select("source", "doc_id", (F.col("lang") == "en").alias("missing"), F.col("text").alias("extract")), ["source"], "doc_id")


@query("s23_distinct_values", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def distinct_values(t: Tables) -> DataFrame:
    from orrery.sources.readers import distinct_values as read

    return read(t.documents, "lang")


@query("s4_restricted_scan", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def restricted_scan(t: Tables) -> DataFrame:
    """A scan restricted to ids."""
    return t.orders.select("o_orderkey", "o_custkey").join(t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


_EVENT_DIFF = "WITH v AS (SELECT user_id, event_id, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, CAST(ts AS DATE) AS day FROM events) SELECT event_id, CASE WHEN status = 'error' THEN 'diffusion_terminee' ELSE 'annulation' END AS type, day FROM v WHERE was IS NOT NULL AND was <> status AND status IN ('error', 'click')"


@query("d5_event_diff", _EVENT_DIFF)
def event_diff(t: Tables) -> DataFrame:
    """A user's event types as a record's status: its changes become events."""
    from orrery.operators.changes import derive

    return derive(_versions(t)).select(F.col("id").alias("event_id"), "type", "day")


def _versions(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "Ended").when(F.col("event_type") == "click", "Canceled").otherwise(F.col("event_type"))
    return t.events.select(F.col("event_id").alias("id"), F.lit("tv").alias("kind"), F.col("user_id").alias("source_id"), F.lit("").alias("lang"), F.col("ts").cast("timestamp").alias("fetched_at"), F.to_json(F.struct(status.alias("status"))).alias("payload"))


@query("d6_event_stream", _EVENT_DIFF)
def event_stream(t: Tables) -> DataFrame:
    """The same events from a stream of four batches, each row compared with its key's last version only."""
    from orrery.streaming.stateful import append_batches, derive_stream

    root, rows = new_folder(t.spark, "versions"), _versions(t)
    ranged = save(rows.repartitionByRange(4, "fetched_at", "id").withColumn("part", F.spark_partition_id()))
    for k in range(4):  # one after the other, as versions are collected: a stream takes the oldest files first
        ranged.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    append_batches(derive_stream(stream), f"{root}/events", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/events").select(F.col("id").alias("event_id"), "type", "day")
