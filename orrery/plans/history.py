"""Versioned records: events keyed by (user_id, event_type), versions in order of (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import latest
from orrery.plans.base import Tables, query
from orrery.sources.keyed_table import KeyedTable
from orrery.sources.scratch import new_folder

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


@query("w1_latest_per_key", f"SELECT user_id, event_type, event_id, ts, value FROM ({_LATEST})")
def latest_per_key(t: Tables) -> DataFrame:
    """As one aggregation."""
    return latest.latest_per_key(t.events.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("s6_latest_payload", "SELECT user_id, arg_max(props, (ts, event_id)) AS payload FROM events WHERE event_type = 'purchase' GROUP BY 1")
def latest_payload(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("payload"))


@query("w2_priority_pick", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def priority_pick(t: Tables) -> DataFrame:
    """Priority first, then the newest: a minimum of structs (times negated)."""
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    best = t.events.groupBy("user_id").agg(F.min_by(F.struct("event_type", "event_id"), F.struct(rank, -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id"))).alias("b"))
    return best.select("user_id", "b.event_type", "b.event_id")


@query("w3_preferred_language", "SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(array_position(['fr', 'es'], lang), 99), n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def preferred_language(t: Tables) -> DataFrame:
    """An absent language comes after all listed ones."""
    rows = t.documents.select("source", "doc_id", "lang", "n_chars")
    order = [latest.language_rank("lang", ["fr", "es"]), F.desc("n_chars"), F.col("doc_id")]
    return latest.first_per_key(rows, ["source"], order).drop("n_chars")


@query("w12_first_wins", "SELECT user_id, min(ts) AS discovered, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1")
def first_wins(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("discovered"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("j9_previous_version", "SELECT event_id, lag(event_id) OVER w AS prev_event_id, lag(value) OVER w AS prev_value FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def previous_version(t: Tables) -> DataFrame:
    """An as-of join to the version before, as one window."""
    rows = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    return latest.previous_version(rows, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]).select("event_id", "prev_event_id", "prev_value")


@query("k1_insert_new", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-10') n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-10' AND o.user_id = n.user_id AND o.event_type = n.event_type)")
def insert_new(t: Tables) -> DataFrame:
    """Keys first seen on or after a day."""
    cut = F.lit("2024-01-10").cast("timestamp")
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    new = rows.where(F.col("ts") >= cut).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return latest.insert_new(rows.where(F.col("ts") < cut), new, ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


_DAYS = "old AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS popularity FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS popularity FROM customer WHERE c_custkey % 5 <> 0)"


def _days(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("popularity"))
    new = c.select("id", F.upper("name").alias("name"), F.when(F.col("popularity") > 0, F.col("popularity")).alias("popularity"))
    return c.where("id % 3 <> 0"), new.where("id % 5 <> 0")


def _stored(t: Tables, rows: DataFrame) -> KeyedTable:
    table = KeyedTable(t.spark, new_folder(t.spark, "keyed"))
    table.create(rows, ["id"], buckets=16)
    return table


@query("k3_bulk_upsert", f"WITH {_DAYS} SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.popularity ELSE o.popularity END AS popularity, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM old o FULL JOIN new n ON o.id = n.id")
def bulk_upsert(t: Tables) -> DataFrame:
    """K3: two exports of a catalogue through a stored table; rows absent from the second are kept, repeated ids count once, rows without an id don't."""
    old, new = _days(t)
    copies = F.array(F.struct("id", "name", F.lit(1).alias("seq")), F.when(F.col("id") % 7 == 0, F.struct("id", F.lit("stale").alias("name"), F.lit(0).alias("seq"))), F.when(F.col("id") % 11 == 0, F.struct(F.lit(None).cast("long").alias("id"), "name", F.lit(1).alias("seq"))))
    new = new.select("popularity", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c")).select("c.id", "c.name", "popularity", "c.seq")
    table = _stored(t, old)
    table.upsert(new, order=["seq"])
    return table.changes(since=1)


@query("k5_fill_only", f"WITH {_DAYS} SELECT coalesce(o.id, n.id) AS id, coalesce(o.name, n.name) AS name, coalesce(o.popularity, n.popularity) AS popularity FROM old o FULL JOIN new n ON o.id = n.id")
def fill_only(t: Tables) -> DataFrame:
    """K5: nulls are filled, nothing is overwritten."""
    return latest.upsert(*_days(t), ["id"], fill_only=("name", "popularity")).drop("change")


@query("k7_mixed_policies", f"WITH {_DAYS} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.popularity ELSE o.popularity END AS popularity FROM old o FULL JOIN new n ON o.id = n.id")
def mixed_policies(t: Tables) -> DataFrame:
    """K7: one column as first seen, one as last seen, in a stored table."""
    old, new = _days(t)
    table = _stored(t, old)
    table.upsert(new, keep_first=("name",))
    return table.read()


@query("k6_keyed_replace", f"WITH {_DAYS} SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def keyed_replace(t: Tables) -> DataFrame:
    """The rows of some keys give way in a stored table."""
    old, new = _days(t)
    table = _stored(t, old)
    table.replace(new)
    return table.read()


@query("k4_ensure_pivot", f"WITH {_DAYS} SELECT n AS works, n AS keys, n AS greatest FROM (SELECT count(*) AS n FROM (SELECT id FROM old UNION SELECT id FROM new))")
def ensure_pivot(t: Tables) -> DataFrame:
    """K4: every known key keeps its number, new ones continue: as many numbers as keys, without a gap."""
    from orrery.operators.regression import row_index

    old, new = _days(t)
    known = row_index(old.select("id").withColumn("_all", F.lit(1)), ["_all"], "id").select("id", (F.col("i") + 1).alias("pivot"))
    made = latest.assign_keys(known, new, "id", "pivot")
    return made.agg(F.count_distinct("id").alias("works"), F.count_distinct("pivot").alias("keys"), F.max("pivot").alias("greatest"))


@query("k18_purge", "SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'de'")
def purge(t: Tables) -> DataFrame:
    from orrery.sources.sinks import purge as drop

    return drop(t.documents.select("doc_id", "lang"), "lang", "de")


@query("k20_remap_keys", "SELECT o_orderkey, coalesce(1000000 + c_custkey, o_custkey) AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) ON c_custkey = o_custkey")
def remap_keys(t: Tables) -> DataFrame:
    from orrery.sources.sinks import remap_keys as remap

    mapping = t.customer.where("c_nationkey < 5").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return remap(t.orders.select("o_orderkey", "o_custkey"), mapping, "o_custkey")


@query("k15_prune_orphans", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-03-01')")
def prune_orphans(t: Tables) -> DataFrame:
    from orrery.operators.graph import orphans

    edges = t.lineitem.where("l_returnflag = 'R' and l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1995-03-01'").select(F.col("l_partkey").alias("p_partkey"))
    return orphans(t.part.select("p_partkey"), edges, "p_partkey")
