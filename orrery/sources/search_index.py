"""A stored inverted index: segments of postings that searches probe, kept up to date without a rebuild.

A segment is written once and never changed:

- `postings`: a row for each word of a document with its places, in folders by the hash of the word's first
  letters, sorted by word. A word, or all words with a prefix, is one folder and a range of it, so a
  search reads the row groups of its words and no text;
- `documents`: keys and stored columns (a rating, say).

A change writes one more segment and, for documents that older segments hold, marks (segment, key): what is
marked is dead. The pointer names segments and marks, and is replaced last, so readers see all of a change
or nothing. Small segments are merged, without looking at a text again, when there are more than SEGMENTS of them
or when the dead outweigh a share of the living.

The bucket of a frequent word is spread over tasks and files (adaptive execution splits it).

Nulls and edges: a document without text has no postings, but counts; rows without key are left out; of rows
that repeat a key within a change one counts, always the same; an empty table is an index that finds nothing.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from orrery.functions.unicode import fold_text
from orrery.sources.pointer import Pointer

BUCKETS, LEAD = 64, 2
ROW_GROUP = 4 << 20
SEGMENTS, DEAD = 8, 0.3
#: Bytes of texts that are cut into words at once, and postings of a batch.
CHUNK, POSTINGS = 1 << 20, 1 << 16
_WORD, _BEYOND = re.compile("[a-z0-9]+"), re.compile(r"[^\x00-\x7f]+")
_INSIDE = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def words(text: str) -> list[str]:
    """Folded words of letters and digits, as `fulltext.tokens` finds them."""
    return _WORD.findall(text.lower() if text.isascii() else fold_text(text))


@lru_cache(1 << 16)
def _folded_run(run: str) -> str:
    return fold_text(run)


def _folded_bytes(text: str) -> bytes:
    """The folded text's bytes. Folding looks at one character at a time, so runs beyond ASCII are folded alone, equal ones once."""
    return (text if text.isascii() else _BEYOND.sub(lambda m: _folded_run(m[0]), text)).encode().lower()


def word_places(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(text's number, word, places) of every different word of every folded text, all texts at once."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    inside = _INSIDE[data]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    counts = np.bincount(row, minlength=len(texts))
    place = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    cuts = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(cuts), pa.py_buffer(data[inside])).dictionary_encode()
    at = row * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    some = order[first]
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    return row[some], coded.dictionary.take(coded.indices.take(pa.array(some))).cast(pa.string()), lists


def postings_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, places) of every different word of every document; a document's words meet in its own task."""
    kind = docs.schema[key].dataType
    schema = StructType([StructField("token", StringType()), StructField(key, kind), StructField("places", ArrayType(IntegerType()))])

    def run(batches):
        for batch in batches:
            texts, begin, size = [], 0, 0
            for row, value in enumerate(batch.column(1)):
                texts.append(_folded_bytes(value.as_py() or ""))
                size += len(texts[-1])
                if size > CHUNK or row + 1 == batch.num_rows:
                    rows, tokens, places = word_places(texts)
                    for at in range(0, len(rows), POSTINGS):
                        own = slice(at, at + POSTINGS)
                        yield pa.RecordBatch.from_arrays([tokens[own], batch.column(0).take(pa.array(rows[own] + begin)), places[own]], names=schema.names)
                    texts, begin, size = [], row + 1, 0

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def bucket_of(token: Column) -> Column:
    return F.pmod(F.crc32(F.substring(token, 1, LEAD)), F.lit(BUCKETS)).cast("int")


def _bucket(token: str) -> int:
    return zlib.crc32(token[:LEAD].encode()) % BUCKETS


def _together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class SearchIndex:
    """An index in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.pointer = spark, folder.rstrip("/"), Pointer(spark, folder)

    # ------------------------------------------------------------ what readers see
    def manifest(self) -> dict:
        found = self.pointer.read()
        if found is None:
            raise LookupError(f"no index in {self.folder}: build one")
        return found

    @property
    def key(self) -> str:
        return self.manifest()["key"]

    def __len__(self) -> int:
        return sum(s["documents"] - s["dead"] for s in self.manifest()["segments"])

    def _living(self, segment: dict, part: str, key: str, schema: dict) -> DataFrame:
        rows = self.spark.read.schema(StructType.fromJson(schema)).parquet(f"{self.folder}/{segment['name']}/{part}")
        if not segment["dead"]:
            return rows
        marks = self.spark.read.parquet(*(f"{self.folder}/{m}" for m in segment["marks"])).where(F.col("segment") == segment["name"])
        return rows.join(marks.select(key), key, "left_anti")

    def _each(self, part: str, manifest: dict | None = None) -> Iterator[DataFrame]:
        manifest = manifest or self.manifest()
        yield from (self._living(s, part, manifest["key"], manifest[part]) for s in manifest["segments"])

    def documents(self) -> DataFrame:
        """Key and stored columns of all documents."""
        return _together(list(self._each("documents")))

    def postings(self) -> DataFrame:
        """(token, key, places) of all documents."""
        return _together([p.drop("bucket") for p in self._each("postings")])

    def total(self) -> DataFrame:
        return self.spark.createDataFrame([(len(self),)], "docs long")

    def _found(self, at: Column) -> DataFrame:
        manifest = self.manifest()
        return _together([p.where(at).select(manifest["key"], "places") for p in self._each("postings", manifest)])

    def exact(self, token: str) -> DataFrame:
        """(key, places) of a word."""
        at = (F.col("bucket") == _bucket(token)) & (F.col("token") == token)
        return self._found(at)

    def prefix(self, prefix: str) -> DataFrame:
        """(key, places) of all words that start so; of LEAD letters at least."""
        if len(prefix) < LEAD:
            raise ValueError(f"prefixes have {LEAD} letters at least")
        beyond = prefix[:-1] + chr(ord(prefix[-1]) + 1)
        at = (F.col("bucket") == _bucket(prefix)) & (F.col("token") >= prefix) & (F.col("token") < beyond)
        return self._found(at)

    # ------------------------------------------------------------ writing
    def _write_postings(self, frame: DataFrame, name: str, key: str) -> None:
        # a bucket that is large, as that of a frequent word is, becomes several tasks and files
        place = frame.withColumn("bucket", bucket_of(F.col("token"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", key)
        place.write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{self.folder}/{name}/postings")

    def _segment(self, docs: DataFrame, key: str, text: str, stored: list[str]) -> dict:
        """Write a segment of docs; nothing points to it yet."""
        name = f"s-{uuid.uuid4().hex}"
        rest = [c for c in (text, *stored) if c != key]
        one = docs.where(F.col(key).isNotNull()).select(key, *rest)
        one = one.groupBy(key).agg(F.max_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row")).select(key, "_row.*") if not self._unique(one, key) else one
        self._write_postings(postings_of(one, key, text), name, key)
        seen = Observation()
        one.select(key, *stored).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.folder}/{name}/documents")
        return {"name": name, "documents": seen.get["rows"], "dead": 0, "marks": []}

    @staticmethod
    def _unique(docs: DataFrame, key: str) -> bool:
        """Whether no key repeats, found on the keys alone, so that texts move only if one does."""
        return docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def build(self, docs: DataFrame, key: str, text: str, stored: list[str] | None = None, mark: str | None = None) -> dict:
        """Index all of docs anew; readers see the old index until the new one is whole."""
        stored = stored or []
        old = self.pointer.read()
        places = StructType([StructField("token", StringType()), docs.schema[key], StructField("places", ArrayType(IntegerType())), StructField("bucket", IntegerType())])
        schemas = {"postings": places.jsonValue(), "documents": docs.select(key, *stored).schema.jsonValue()}
        manifest = schemas | {"key": key, "text": text, "stored": stored, "mark": mark, "segments": [self._segment(docs, key, text, stored)]}
        self.pointer.replace(manifest)
        if old:
            self.pointer.delete(*self._folders(old))
        return manifest

    def upsert(self, docs: DataFrame, removed: DataFrame | None = None, mark: str | None = None) -> dict:
        """Docs replace the documents of their keys or are added; those of `removed` (key) go. Costs what changes."""
        manifest = self.manifest()
        key, before = manifest["key"], manifest["segments"]
        made = self._segment(docs, key, manifest["text"], manifest["stored"])
        gone = self.spark.read.schema(StructType.fromJson(manifest["documents"])).parquet(f"{self.folder}/{made['name']}/documents").select(key)
        gone = gone.unionByName(removed.select(key)).distinct() if removed is not None else gone
        name = f"m-{uuid.uuid4().hex}"
        dead = _together([d.select(F.lit(s["name"]).alias("segment"), key) for s, d in zip(before, self._each("documents", manifest), strict=True)])
        dead.join(gone, key, "left_semi").write.parquet(f"{self.folder}/{name}")
        marks = self.spark.read.schema(StructType([StructField("segment", StringType()), StructType.fromJson(manifest["documents"])[key]])).parquet(f"{self.folder}/{name}")
        counts = {r["segment"]: r["n"] for r in marks.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row a segment
        after = [s | {"dead": s["dead"] + counts[s["name"]], "marks": [*s["marks"], name]} if s["name"] in counts else s for s in before]
        self.pointer.replace(manifest | {"segments": [*after, made], "mark": mark or manifest["mark"]})
        if not counts:
            self.pointer.delete(name)
        return self.merge()

    def synchronise(self, docs: DataFrame, changed: str, now: str, removed: DataFrame | None = None) -> dict:
        """Upsert the rows whose `changed` is later than the mark, then set the mark to `now`, the time before reading: what moves meanwhile is seen twice, never missed."""
        mark = self.manifest()["mark"]
        if mark is None:
            raise LookupError("an index without a mark doesn't know what it lacks: build it anew")
        return self.upsert(docs.where(F.col(changed) > F.lit(mark).cast("timestamp")), removed, now)

    def merge(self, all_: bool = False) -> dict:
        """Rewrite the living postings of small segments, or of those with many dead, as one segment; results don't change."""
        manifest = self.manifest()
        segments = manifest["segments"]
        largest = max(s["documents"] for s in segments)
        worn = [s for s in segments if s["dead"] > DEAD * s["documents"]]
        small = [s for s in segments if s["documents"] < largest] if len(segments) > SEGMENTS else []
        names = {s["name"] for s in (segments if all_ else [*worn, *small])}
        some = [s for s in segments if s["name"] in names]
        if not some or (all_ and len(some) == 1 and not some[0]["dead"]):
            return manifest
        name, chosen = f"s-{uuid.uuid4().hex}", manifest | {"segments": some}
        self._write_postings(_together([p.drop("bucket") for p in self._each("postings", chosen)]), name, manifest["key"])
        _together([*self._each("documents", chosen)]).write.parquet(f"{self.folder}/{name}/documents")
        merged = {"name": name, "documents": sum(s["documents"] - s["dead"] for s in some), "dead": 0, "marks": []}
        after = manifest | {"segments": [*(s for s in segments if s["name"] not in names), merged]}
        self.pointer.replace(after)
        self.pointer.delete(*(self._folders(manifest) - self._folders(after)))
        return after

    @staticmethod
    def _folders(manifest: dict) -> set[str]:
        return {s["name"] for s in manifest["segments"]} | {m for s in manifest["segments"] for m in s["marks"]}

    def sweep(self) -> list[str]:
        """Delete and name the folders that writes which failed have left."""
        known = self._folders(self.manifest())
        gone = [n for n in self.pointer.names() if n.startswith(("s-", "m-", "CURRENT.")) and n not in known]
        self.pointer.delete(*gone)
        return gone


class ScannedTexts:
    """The same questions answered by reading all texts, for a table that has no index."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.docs, self.key = docs, key
        self._postings = postings_of(docs, key, text)

    def total(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("docs"))

    def documents(self) -> DataFrame:
        return self.docs

    def postings(self) -> DataFrame:
        return self._postings

    def exact(self, token: str) -> DataFrame:
        return self._postings.where(F.col("token") == token).select(self.key, "places")

    def prefix(self, prefix: str) -> DataFrame:
        return self._postings.where(F.startswith("token", F.lit(prefix))).select(self.key, "places")
