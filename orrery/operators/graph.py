"""Citation graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalars import norm
from orrery.operators import similarity
from orrery.sources.scratch import save

MOST_WORKS, MOST_PEOPLE, MOST_NEIGHBOURS, MOST_SUGGESTIONS = 12, 4, 10, 12
#: Rows of a work on a side of a join, beyond which it is cut into tiles.
HEAVY = 2000
#: Rank of a citation without one, the value of the first place, and of an uncredited person.
DEFAULT_RANK, TOP_VALUE, DEFAULT_CREDIT = 5, 6, 99


def citations(rows: DataFrame, member: str, work: str, rank: str) -> DataFrame:
    """One edge a pair, with its best rank."""
    return rows.groupBy(F.col(member).alias("member"), F.col(work).alias("work")).agg(F.min(rank).alias("rank"))


def member_works(edges: DataFrame, titles: DataFrame, most: int = MOST_WORKS) -> DataFrame:
    """Each member's works by rank, title and id; titles: work, title."""
    order = Window.partitionBy("member").orderBy(F.col("rank").asc_nulls_last(), "title", "work")
    return edges.join(titles, "work").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def meetings(mine: DataFrame, edges: DataFrame, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """mine (me, work) and edges (other, work) with the tile (work, a, b) in which a pair of rows that share a work meets exactly once.

    A work with more than `heavy` rows on either side is cut into tiles of some `heavy` rows a side, by hashes of the members;
    each row goes to the tiles of its row or column. Few works are heavy, all others are one tile.
    """
    sizes = edges.groupBy("work").agg(F.count("*").alias("_n")).where(F.col("_n") > heavy)
    asked = mine.groupBy("work").agg(F.count("*").alias("_m")).where(F.col("_m") > heavy)
    large = save(sizes.join(asked, "work", "full_outer").select("work", F.ceil(F.coalesce("_m", F.lit(1)) / F.lit(heavy)).alias("_rows"), F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(heavy)).alias("_columns")))
    one = F.lit(1).cast("long")

    def dealt(rows: DataFrame, member: str, own: str, others: str, own_name: str, other_name: str) -> DataFrame:
        cut = rows.join(large, "work", "left").withColumn(own_name, F.pmod(F.xxhash64(member), F.coalesce(own, one)))
        return cut.withColumn(other_name, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(others, one) - 1))).select(member, "work", "a", "b")

    return dealt(mine, "me", "_rows", "_columns", "a", "b"), dealt(edges, "other", "_columns", "_rows", "b", "a")


def neighbours(edges: DataFrame, members: DataFrame, most: int = MOST_NEIGHBOURS, heavy: int = HEAVY) -> DataFrame:
    """For each of `members`, who shares most works with them (ties: smaller id).

    The chosen members' works meet all edges in tiles, so that a work which everybody cites is many small joins; what two members
    share is added up before it is shuffled.
    """
    edges = edges.select("member", "work").distinct()
    mine = edges.join(members.select("member"), "member", "left_semi").select(F.col("member").alias("me"), "work")
    left, right = meetings(save(mine), save(edges.select(F.col("member").alias("other"), "work")), heavy)
    met = left.join(right, ["work", "a", "b"]).where("me <> other")
    common = met.groupBy("me", "other").agg(F.count("*").alias("common"))
    order = Window.partitionBy("me").orderBy(F.desc("common"), "other")
    return common.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).withColumnsRenamed({"me": "member", "other": "neighbour"})


def suggestions(edges: DataFrame, members: DataFrame, shown: DataFrame, most: int = MOST_SUGGESTIONS) -> DataFrame:
    """Works that neighbours cite and the member isn't shown, by neighbours, mean strength and id; shown: member, work."""
    near = neighbours(edges, members).select("member", "neighbour")
    theirs = near.join(edges.select(F.col("member").alias("neighbour"), "work", "rank"), "neighbour")
    new = theirs.join(shown.select("member", "work"), ["member", "work"], "left_anti")
    strength = F.avg(F.lit(TOP_VALUE) - F.coalesce("rank", F.lit(DEFAULT_RANK)))
    ranked = new.groupBy("member", "work").agg(F.count_distinct("neighbour").alias("neighbours"), strength.alias("strength"))
    order = Window.partitionBy("member").orderBy(F.desc("neighbours"), F.desc("strength"), "work")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def people_of_works(credits: DataFrame, most: int = MOST_PEOPLE) -> DataFrame:
    """The first people of each work by credit order; credits: work, person, role, credit."""
    order = Window.partitionBy("work").orderBy(F.coalesce("credit", F.lit(DEFAULT_CREDIT)), "person", "role")
    return credits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def roles(credits: DataFrame) -> DataFrame:
    """Each person's set of roles, sorted."""
    return credits.groupBy("person").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_distinct("work").alias("works"))


def orphans(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(edges.select(key).distinct(), key, "left_anti")


def duplicate_keys(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one node has; empty when the constraint holds."""
    return nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def nearest_works(works: DataFrame, is_query: Column, most: int = 5) -> DataFrame:
    """query_id, id, distance, place: the works nearest in the scale of the scores; works: vec_id, embedding."""
    found = similarity.nearest(works, is_query, most, "euclid")
    return found.select("query_id", "id", F.sqrt(1 / F.col("score") - 1).alias("distance"), "place")


def same_colour(works: DataFrame, is_query: Column, pool: int = 50, most: int = 5) -> DataFrame:
    """Of the `pool` works of most similar direction, the first that are stronger than the query."""
    found = similarity.nearest(works, is_query, pool, "cosine").drop("place")
    size = works.select(F.col("vec_id").alias("id"), norm("embedding").alias("size"))
    both = found.join(size, "id").join(size.withColumnsRenamed({"id": "query_id", "size": "own"}), "query_id").where("size > own")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "id", "score", "size", "place")


def same_colour_and_links(works: DataFrame, is_query: Column, genres: DataFrame, people: DataFrame, pool: int = 200, most: int = 10) -> DataFrame:
    """Of the `pool` works of most similar direction those that share a genre, by likeness, then by people shared.

    genres: work, genre; people: work, person. Shared edges are counted for the pools' pairs only.
    """
    found = save(similarity.nearest(works, is_query, pool, "cosine").drop("place"))

    def shared(edges: DataFrame, of: str) -> DataFrame:
        one = edges.select("work", of).distinct()
        mine = found.select("query_id", "id").join(one.withColumnRenamed("work", "query_id"), "query_id")
        return mine.join(one.withColumnRenamed("work", "id"), ["id", of])

    kin = found.join(shared(genres, "genre").select("query_id", "id").distinct(), ["query_id", "id"])
    links = shared(people, "person").groupBy("query_id", "id").agg(F.count("*").alias("links"))
    told = kin.join(links, ["query_id", "id"], "left").withColumn("links", F.coalesce("links", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("links"), "id")
    return told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "id", "score", "links", "place")
