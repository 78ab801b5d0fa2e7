"""A stored table with keys, of which a write rewrites only the buckets that it changes.

Rows lie in buckets by the hash of their keys. A manifest names each bucket's files; a write reads the buckets
of the keys it brings, writes these anew, and replaces the manifest in one step. All other files stay as they
are, byte for byte. Readers see all of a write or nothing, and readers of the state before it may finish: its
files go with the write after. Each row carries the write that last changed it and the one that first brought its key,
so what changed since a write is found in the files written since.

Writing the same rows again leaves the same table. One writer at a time. A bucket with more rows than a task should
write becomes several files (adaptive execution splits it).

Nulls and edges: rows without a key are left out; of rows that repeat a key in an upsert the one of the greatest
`order` counts (else one, always the same), in a replacement all do; a write of no rows changes nothing; an
empty table has no files; columns named like the marks (_first, _last) are refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orrery.operators import latest
from orrery.sources.pointer import Pointer

BUCKETS = 64
FIRST, LAST = "_first", "_last"


class KeyedTable:
    """A table in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.pointer = spark, folder.rstrip("/"), Pointer(spark, folder)

    def manifest(self) -> dict:
        found = self.pointer.read()
        if found is None:
            raise LookupError(f"no table in {self.folder}: create one")
        return found

    # ------------------------------------------------------------ reading
    def _rows(self, manifest: dict, buckets: list[int] | None = None, since: int = 0) -> DataFrame:
        """Rows with marks, of some buckets or all, in files written after `since`."""
        schema = StructType.fromJson(manifest["schema"])
        files = [f for b, held in manifest["files"].items() if buckets is None or int(b) in buckets for f, at in held if at > since]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{f}" for f in files))

    def read(self) -> DataFrame:
        return self._rows(self.manifest()).drop(FIRST, LAST)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys: only their buckets are read."""
        manifest = self.manifest()
        return self._rows(manifest, self._touched(keys, manifest)).drop(FIRST, LAST).join(keys.select(*manifest["keys"]).distinct(), manifest["keys"], "left_semi")

    def changes(self, since: int) -> DataFrame:
        """Rows with `change` (inserted, updated, kept) compared with the state after write `since`; files older than that hold kept rows only."""
        change = F.when(F.col(FIRST) > since, "inserted").when(F.col(LAST) > since, "updated").otherwise("kept")
        return self._rows(self.manifest()).withColumn("change", change).drop(FIRST, LAST)

    def changed(self, since: int) -> DataFrame:
        """Rows that writes after `since` brought, from the files written since: what an index or a projection has to catch up with."""
        return self._rows(self.manifest(), since=since).where(F.col(LAST) > since).drop(FIRST, LAST)

    # ------------------------------------------------------------ writing
    @staticmethod
    def _bucket(keys: list[str], buckets: int):
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _touched(self, rows: DataFrame, manifest: dict) -> list[int]:
        """The buckets of some rows' keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.dropna(subset=manifest["keys"]).select(self._bucket(manifest["keys"], manifest["buckets"])).distinct().collect())

    def _write(self, rows: DataFrame, manifest: dict, touched: list[int], seen: Observation | None = None) -> dict:
        """Write rows, which are all of the touched buckets, and point to them."""
        keys, number, name = manifest["keys"], manifest["write"] + 1, f"w-{uuid.uuid4().hex}"
        place = rows.withColumn("_bucket", self._bucket(keys, manifest["buckets"])).hint("rebalance", "_bucket")
        place.write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        made = {b: [] for b in map(str, touched)}
        for folder in self.pointer.names_in(name):
            if folder.startswith("_bucket="):
                made[folder.split("=")[1]] = [[f"{name}/{folder}/{file}", number] for file in self.pointer.names_in(f"{name}/{folder}")]
        files = {b: held for b, held in (manifest["files"] | made).items() if held}
        after = manifest | {"write": number, "files": files, "before": sorted(self._folders(manifest["files"]))}
        self.pointer.replace(after)
        self.pointer.delete(*(set(manifest["before"]) - set(after["before"]) - self._folders(files)))
        return after

    @staticmethod
    def _folders(files: dict) -> set[str]:
        return {f.split("/")[0] for held in files.values() for f, _ in held}

    def create(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> dict:
        """A table of rows; replaces one that is there."""
        if {FIRST, LAST, "_bucket"} & {c.lower() for c in rows.columns}:
            raise ValueError(f"columns may not be called {FIRST}, {LAST} or _bucket")
        old = self.pointer.read()
        schema = StructType([*rows.schema.fields, StructField(FIRST, LongType()), StructField(LAST, LongType())])
        manifest = {"keys": keys, "buckets": buckets, "schema": schema.jsonValue(), "write": old["write"] if old else 0, "files": {}, "before": sorted(self._folders(old["files"])) if old else []}
        number = manifest["write"] + 1
        return self._write(rows.dropna(subset=keys).withColumns({FIRST: F.lit(number), LAST: F.lit(number)}), manifest, [])

    def _marked(self, rows: DataFrame, manifest: dict) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        if sorted(rows.columns) != sorted(c for c in schema.names if c not in (FIRST, LAST)):
            raise ValueError("rows have the columns of the table")
        number = F.lit(manifest["write"] + 1).cast("long")
        rows = rows.dropna(subset=manifest["keys"]).withColumns({FIRST: number, LAST: number})
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    def upsert(self, rows: DataFrame, keep_first: tuple[str, ...] = (), fill_only: tuple[str, ...] = (), order: list[str] | None = None) -> dict[str, int]:
        """K3, K5, K7: rows replace those of their keys, column by column as `latest.upsert` does; counts read, inserted and updated.

        `order` may name columns that the table doesn't keep.
        """
        manifest = self.manifest()
        keys, number = manifest["keys"], manifest["write"] + 1
        names = [c for c in StructType.fromJson(manifest["schema"]).names if c not in (FIRST, LAST)]
        if set(names) - set(rows.columns):
            raise ValueError("rows have the columns of the table")
        one = rows.dropna(subset=keys)
        if order:
            one = latest.latest_per_key(one, keys, order, [c for c in rows.columns if c not in keys])
        touched = self._touched(one, manifest)
        if not touched:
            return {"read": 0, "inserted": 0, "updated": 0}
        old = self._rows(manifest, touched)
        both = latest.upsert(old, self._marked(one.select(*names), manifest), keys, keep_first=(*keep_first, FIRST), fill_only=fill_only)
        seen = Observation()
        told = F.col(LAST) == number
        both = both.drop("change").observe(seen, F.count_if(told).alias("read"), F.count_if(told & (F.col(FIRST) == number)).alias("inserted"))
        self._write(both.select(*StructType.fromJson(manifest["schema"]).names), manifest, touched)
        return seen.get | {"updated": seen.get["read"] - seen.get["inserted"]}

    def replace(self, rows: DataFrame) -> None:
        """All rows of the keys in `rows` give way to these."""
        manifest = self.manifest()
        if touched := self._touched(rows, manifest):
            self._write(latest.replace_keys(self._rows(manifest, touched), self._marked(rows, manifest), manifest["keys"]), manifest, touched)

    def insert_new(self, rows: DataFrame) -> None:
        """Rows whose key the table lacks, one a key; buckets without a new key are not written."""
        manifest = self.manifest()
        if touched := self._touched(rows, manifest):
            made = latest.insert_new(self._rows(manifest, touched), self._marked(rows, manifest), manifest["keys"])
            if touched := self._touched(made, manifest):
                self._write(self._rows(manifest, touched).unionByName(made), manifest, touched)

    def delete(self, keys: DataFrame) -> None:
        """All rows of some keys go."""
        manifest = self.manifest()
        if touched := self._touched(keys, manifest):
            self._write(self._rows(manifest, touched).join(keys.select(*manifest["keys"]).distinct(), manifest["keys"], "left_anti"), manifest, touched)

    def sweep(self) -> list[str]:
        """Delete and name what writes that failed, and the state before the last write, have left."""
        known = self._folders(self.manifest()["files"])
        gone = [n for n in self.pointer.names() if n.startswith(("w-", "CURRENT.")) and n not in known]
        self.pointer.delete(*gone)
        return gone
