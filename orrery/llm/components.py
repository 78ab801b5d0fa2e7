"""Connected components of an edge table, by hooking and pointer jumping over DataFrames.

Edges, labels and parents stay distributed tables in the shared scratch folder; the
driver only learns whether a round changed anything. Minima are combined before each
shuffle, so a node with very many edges costs no more than its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import remove, save


def clashes(rows: DataFrame, number: str, check: str) -> DataFrame | None:
    """(number, check, other) for everything whose 64-bit number another thing has, too; `other` is a number of its own. None if all numbers differ.

    `check` is a second 64-bit hash, independent of the first: both together tell things apart.
    """
    known = rows.where(F.col(number).isNotNull()).groupBy(number).agg(F.min(check).alias("_a"), F.max(check).alias("_b"))
    shared = save(known.where("_a <> _b").select(number))
    if shared.isEmpty():
        return None
    apart = save(rows.join(shared, number, "left_semi").select(number, check).distinct())
    attempt = 0
    while True:
        made = save(apart.withColumn("other", F.xxhash64(number, check, F.lit(attempt))))
        taken = rows.select(F.col(number).alias("other")).join(made, "other", "left_semi")
        if made.groupBy("other").count().where("count > 1").isEmpty() and taken.isEmpty():
            return made
        attempt += 1


def renumbered(frame: DataFrame, clashing: DataFrame | None, number: str, check: str) -> DataFrame:
    """frame with numbers that tell everything apart, as found by `clashes`."""
    if clashing is None:
        return frame
    return frame.join(clashing, [number, check], "left").withColumn(number, F.coalesce("other", number)).select(*frame.columns)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges with a null end are ignored, loops only make their node known. No edges: an empty table.
    """
    lo, hi = F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b")
    rest = save(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(lo, hi).distinct())
    labels = None
    while True:
        both = rest.select("a", F.col("a").alias("p")).union(rest.select(F.col("b").alias("a"), F.col("a").alias("p")))
        parent = save(both.groupBy("a").agg(F.min("p").alias("p")))
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = save(parent.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            remove(parent)
            parent = jumped.select("a", "p")
            if not moved:
                break
        if labels is None:
            labels, done = parent.select(F.col("a").alias("node"), F.col("p").alias("component")), None
        else:
            done = labels
            labels = save(labels.join(parent.select(F.col("a").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        to = parent.select(F.col("a").alias("x"), F.col("p").alias("y"))
        mapped = (
            rest.join(to.withColumnsRenamed({"x": "a", "y": "pa"}), "a").join(to.withColumnsRenamed({"x": "b", "y": "pb"}), "b")
            .where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        shrunk = save(mapped)
        remove(rest, *([done] if done is not None else []))
        if done is not None:
            remove(parent)
        rest = shrunk
        if rest.isEmpty():
            remove(rest)
            return labels
