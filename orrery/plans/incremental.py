"""Incremental operators in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.base import Tables, query
from orrery.sources.scratch import new_folder
from orrery.streaming import incremental as I


@query("i1_above_mark", "SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE ts < TIMESTAMP '2024-01-20')")
def above_mark(t: Tables) -> DataFrame:
    """Everything above a stored mark."""
    mark = t.events.where("ts < timestamp '2024-01-20'").agg(F.max("event_id").alias("mark"))
    return t.events.select("event_id").crossJoin(F.broadcast(mark)).where("event_id > mark").select("event_id")


@query("i3_changed_keys", "SELECT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-25' UNION SELECT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-25'")
def changed_keys(t: Tables) -> DataFrame:
    """Keys that either source changed since the mark."""
    mark = F.lit("2024-01-25").cast("timestamp")
    return I.changed_since([t.events.where("event_type = 'purchase'"), t.events.where("event_type = 'error'")], "user_id", "ts", mark)


@query("i7_digest_dedup", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def digest_dedup(t: Tables) -> DataFrame:
    """Each content once, by its digest."""
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("i8_staleness", "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS projectable, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS stale")
def staleness(t: Tables) -> DataFrame:
    return I.staleness(t.documents, t.labels, "doc_id")


@query("i9_recheck_queue", "SELECT c_custkey AS id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS checked_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal >= 0 ORDER BY checked_at NULLS FIRST, c_custkey LIMIT 60")
def recheck_queue(t: Tables) -> DataFrame:
    checked = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("checked_at"))
    rows = t.customer.join(checked, "c_custkey", "left").select(F.col("c_custkey").alias("id"), "checked_at", (F.col("c_acctbal") >= 0).alias("alive"))
    return I.recheck_queue(rows, 60).select("id")


@query("i11_rate_last_hour", "SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1")
def rate_last_hour(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("newest"))
    return t.events.crossJoin(F.broadcast(newest)).where("ts > newest - interval 1 hour").groupBy("event_type").agg(F.count("*").alias("n"))


@query("i11_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(t: Tables) -> DataFrame:
    """I11 as a stream would count it."""
    return I.windowed_counts(t.events, "ts", ["event_type"])


@query("i_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Events as a stream, appended once by key; equals its batch form (tested)."""
    root = new_folder(t.spark, "stream")
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir).select("user_id", "event_type", "event_id")
    I.append_new(stream, f"{root}/table", ["user_id", "event_type"], f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/table").select("user_id", "event_type")
