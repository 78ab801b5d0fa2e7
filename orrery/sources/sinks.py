"""Writers: versioned tables with a pointer, keyed upserts of stored tables, id lists, corpora."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orrery.sources.pointer import Pointer


class VersionedTable:
    """Every write makes a new version folder; a pointer file names the ones that readers see.

    Folders have names of their own, so a write that fails leaves one that nothing points to, and none is ever written twice.
    When the version is whole, the pointer is replaced in one step. Versions older than the last `keep` go, and with sweep()
    those that nothing points to. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep, self.pointer = spark, folder.rstrip("/"), keep, Pointer(spark, folder)

    def versions(self) -> list[str]:
        """The versions that can be read, oldest first."""
        return (self.pointer.read() or {"versions": []})["versions"]

    def write(self, frame: DataFrame, partition_by: list[str] | None = None) -> int:
        """Write a version, point to it, and return how many rows it has."""
        before, name, seen = self.versions(), f"v-{uuid.uuid4().hex}", Observation()
        writer = frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.folder}/{name}")
        kept = [*before, name][-self.keep :]
        self.pointer.replace({"versions": kept})
        self.pointer.delete(*(old for old in before if old not in kept))
        return seen.get["rows"]

    def read(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no version in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{versions[-1]}")

    def sweep(self) -> list[str]:
        """Delete and name the folders of writes that failed."""
        known = self.versions()
        gone = [n for n in self.pointer.names() if n.startswith(("v-", "CURRENT.")) and n not in known]
        self.pointer.delete(*gone)
        return gone


def export_corpus(entries: DataFrame, current: DataFrame, path: str) -> dict[str, int]:
    """Write as JSON lines the entries (work, sha, ...) whose digest is still the current one; counts written and stale."""
    fresh = entries.join(current.select("work", F.col("sha").alias("now")), "work", "left")
    kept = fresh.where("sha <=> now").drop("now")
    kept.write.mode("overwrite").json(path)
    counts = fresh.agg(F.count_if(F.expr("sha <=> now")).alias("written"), F.count_if(F.expr("not (sha <=> now)")).alias("stale")).first()
    return counts.asDict()


def export_ids(frame: DataFrame, column: str, path: str) -> None:
    """One id a line."""
    frame.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def purge(frame: DataFrame, column: str, value: str) -> DataFrame:
    """All rows but those of one universe; rows without one stay."""
    return frame.where(~F.col(column).eqNullSafe(F.lit(value)))


def remap_keys(rows: DataFrame, mapping: DataFrame, key: str, chained: bool = False) -> DataFrame:
    """Keys rewritten by a correspondence (old, new); others stay. Chained: what a key became may have become another since."""
    if chained:
        from orrery.sources.readers import redirect_ends

        mapping = redirect_ends(mapping.select(F.col("old").alias("_from"), F.col("new").alias("_to"))).where("not looped").select(F.col("_from").alias("old"), F.col("end").alias("new"))
    return rows.join(mapping.select(F.col("old").alias(key), F.col("new").alias("_new")), key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")
