"""Graph queries (G1-G10; G11 is in diagnostics): customers cite parts, the line number is the rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import graph
from orrery.plans.base import Tables, query
from orrery.sources.scratch import save

_EDGES = "edges AS (SELECT o_custkey AS member, l_partkey AS work, min(l_linenumber) AS rank FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"
_MEMBERS = "c_custkey % 50 = 0"
_NEAR = f"""{_EDGES}, near AS (SELECT * FROM (SELECT m.member, e.member AS neighbour, count(DISTINCT m.work) AS common, row_number() OVER (PARTITION BY m.member ORDER BY count(DISTINCT m.work) DESC, e.member) AS place
  FROM edges m JOIN edges e ON e.work = m.work AND e.member <> m.member WHERE m.member % 50 = 0 GROUP BY 1, 2) WHERE place <= 10)"""
_SHOWN = "shown AS (SELECT member, work FROM (SELECT member, work, row_number() OVER (PARTITION BY member ORDER BY rank, p_name, work) AS place FROM edges JOIN part ON p_partkey = work WHERE member % 50 = 0) WHERE place <= 12)"


def edges(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"))
    return graph.citations(rows, "o_custkey", "l_partkey", "l_linenumber")


def members(t: Tables) -> DataFrame:
    """The members whose pages are drawn: the stated query set."""
    return t.customer.where(_MEMBERS).select(F.col("c_custkey").alias("member"))


@query("g3_citation_edges", f"WITH {_EDGES} SELECT * FROM edges")
def citation_edges(t: Tables) -> DataFrame:
    return edges(t)


@query("g4_member_works", f"WITH {_EDGES} SELECT member, work, place FROM (SELECT member, work, row_number() OVER (PARTITION BY member ORDER BY rank, p_name, work) AS place FROM edges JOIN part ON p_partkey = work) WHERE place <= 12")
def member_works(t: Tables) -> DataFrame:
    titles = t.part.select(F.col("p_partkey").alias("work"), F.col("p_name").alias("title"))
    return graph.member_works(edges(t), titles).select("member", "work", F.col("place").cast("long").alias("place"))


@query("g5_people_of_works", "SELECT work, person, role, place FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY credit, person, role) AS place FROM (SELECT l_partkey AS work, l_suppkey AS person, l_returnflag AS role, min(l_linenumber) AS credit FROM lineitem GROUP BY 1, 2, 3)) WHERE place <= 4")
def people_of_works(t: Tables) -> DataFrame:
    """Suppliers as people, return flags as roles."""
    return graph.people_of_works(_credits(t)).select("work", "person", "role", F.col("place").cast("long").alias("place"))


def _credits(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("work"), F.col("l_suppkey").alias("person"), F.col("l_returnflag").alias("role")).agg(F.min("l_linenumber").alias("credit"))


@query("g2_person_roles", "SELECT l_suppkey AS person, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS roles, count(DISTINCT l_partkey) AS works FROM lineitem GROUP BY 1")
def person_roles(t: Tables) -> DataFrame:
    return graph.roles(_credits(t))


@query("g6_neighbours", f"WITH {_NEAR} SELECT member, neighbour, common, place FROM near")
def neighbours(t: Tables) -> DataFrame:
    """Two hops, for the members drawn; the edges are built once."""
    return graph.neighbours(edges(t), members(t)).select("member", "neighbour", "common", F.col("place").cast("long").alias("place"))


@query("g7_suggestions", f"WITH {_NEAR}, {_SHOWN}, s AS (SELECT n.member, e.work, count(DISTINCT n.neighbour) AS neighbours, avg(6 - coalesce(e.rank, 5)) AS strength FROM near n JOIN edges e ON e.member = n.neighbour WHERE NOT EXISTS (SELECT 1 FROM shown x WHERE x.member = n.member AND x.work = e.work) GROUP BY 1, 2) SELECT member, work, neighbours, round(strength, 6) AS strength, place FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY neighbours DESC, strength DESC, work) AS place FROM s) WHERE place <= 12")
def suggestions(t: Tables) -> DataFrame:
    """What neighbours cite and the member isn't shown."""
    e, m = save(edges(t)), members(t)
    shown = graph.member_works(e.join(m, "member", "left_semi"), t.part.select(F.col("p_partkey").alias("work"), F.col("p_name").alias("title"))).select("member", "work")
    found = graph.suggestions(e, m, shown)
    return found.select("member", "work", "neighbours", F.round("strength", 6).alias("strength"), F.col("place").cast("long").alias("place"))


@query("g8_graph_state", f"WITH {_EDGES} SELECT 'members' AS what, count(DISTINCT member) AS n FROM edges UNION ALL SELECT 'works', count(DISTINCT work) FROM edges UNION ALL SELECT 'citations', count(*) FROM edges UNION ALL SELECT 'rank ' || rank, count(*) FROM edges GROUP BY rank")
def graph_state(t: Tables) -> DataFrame:
    """Nodes and relations counted from one edge table."""
    e = save(edges(t))
    parts = [e.select("member").distinct().agg(F.lit("members").alias("what"), F.count("*").alias("n")), e.select("work").distinct().agg(F.lit("works").alias("what"), F.count("*").alias("n")), e.agg(F.lit("citations").alias("what"), F.count("*").alias("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(e.groupBy("rank").agg(F.count("*").alias("n")).select(F.concat(F.lit("rank "), "rank").alias("what"), "n"))


@query("g9_unique_nodes", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_nodes(t: Tables) -> DataFrame:
    """Violations of a key."""
    return graph.duplicate_keys(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("g10_subgraph", f"WITH {_EDGES}, e AS (SELECT * FROM edges WHERE member % 50 = 0) SELECT 'member:' || member AS node, 'work:' || work AS target, 'CITES' AS kind FROM e UNION SELECT 'work:' || p_partkey, 'brand:' || p_brand, 'IS' FROM part WHERE p_partkey IN (SELECT work FROM e)")
def subgraph(t: Tables) -> DataFrame:
    """Typed edges of the members drawn and of their works."""
    e = edges(t).join(members(t), "member", "left_semi")
    cites = e.select(F.concat(F.lit("member:"), "member").alias("node"), F.concat(F.lit("work:"), "work").alias("target"), F.lit("CITES").alias("kind"))
    works = t.part.select(F.col("p_partkey").alias("work"), "p_brand").join(e.select("work").distinct(), "work", "left_semi")
    return cites.unionByName(works.select(F.concat(F.lit("work:"), "work").alias("node"), F.concat(F.lit("brand:"), "p_brand").alias("target"), F.lit("IS").alias("kind"))).distinct()
