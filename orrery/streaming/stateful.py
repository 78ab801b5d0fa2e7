"""Streams that remember something of every key: what was seen, and each record's last version.

State lives in Spark's RocksDB store: a batch costs what it brings, however many keys came before, since the
store asks its own Bloom filters before it reads; changes go to the checkpoint, from which a lost executor's part is
restored. `remembering` sets that store for a session.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, DateType, LongType, StringType, StructField, StructType

from orrery.operators.changes import RECORD, diff_events

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["kind", "source_id", "lang"]


def remembering(spark: SparkSession) -> None:
    """Stateful streams of this session keep their state in RocksDB and write changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _OnceAKey(StatefulProcessor):
    """The first row of every key that neither a former batch nor the initial state has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("seen", BooleanType())]))

    def handleInitialState(self, key, state, timers) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        first = next(rows, None)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_of_each(stream: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """Rows of a stream whose key was never seen, without an end to the memory; known: keys seen before its start. Rows with a null in their key are left out."""
    remembering(stream.sparkSession)
    rows = stream.dropna(subset=keys)
    before = known.select(*keys).dropna().distinct().groupBy(*keys) if known is not None else None
    return rows.groupBy(*keys).transformWithState(_OnceAKey(), rows.schema, "Append", "None", before)


class _Pairs(StatefulProcessor):
    """Every version of a record with the one before it, which is all that is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("at", LongType()), StructField("id", LongType()), StructField("record", StringType())]))

    def handleInitialState(self, key, state: Row, timers) -> None:
        self.last.update((state["at"], state["id"], state["record"]))

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            if last is not None and (r["at"], r["id"]) <= (last[0], last[1]):
                continue
            if last is not None:
                yield Row(id=r["id"], **{k: r[k] for k in KEYS}, day=r["day"], before=last[2], record=r["record"])
            last = (r["at"], r["id"], r["record"])
        if last is not None:
            self.last.update(last)

    def close(self) -> None:
        pass


def version_rows(raw: DataFrame) -> DataFrame:
    """id, kind, source_id, lang, at (microseconds), day and record (of the payload, what events come from) of versions."""
    record = F.to_json(F.from_json("payload", RECORD))
    return raw.select("id", *KEYS, F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("at"), F.to_date("fetched_at").alias("day"), record.alias("record"))


def derive_stream(raw: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The events of a stream of versions, each against its key's last version.

    raw: id, kind, source_id, lang, fetched_at, payload (JSON); known: the last versions before the stream's start, in the same
    columns. A key's rows of a batch are put in order of (fetched_at, id); a version older than one that went before is
    passed over, since what it changed was told against a newer one. A first version, or one after a version without
    a payload, tells nothing. Nulls in a key make a key.
    """
    remembering(raw.sparkSession)
    rows = version_rows(raw).where("id is not null and at is not null")
    before = version_rows(known).groupBy(*KEYS).agg(F.max_by(F.struct("at", "id", "record"), F.struct("at", "id")).alias("_r")).select(*KEYS, "_r.*").groupBy(*KEYS) if known is not None else None
    schema = StructType([StructField("id", LongType()), *[rows.schema[k] for k in KEYS], StructField("day", DateType()), StructField("before", StringType()), StructField("record", StringType())])
    paired = rows.groupBy(*KEYS).transformWithState(_Pairs(), schema, "Append", "None", before)
    parsed = paired.where("before is not null").withColumn("before", F.from_json("before", RECORD)).withColumn("after", F.from_json("record", RECORD))
    return diff_events(parsed.drop("record"))


def run_name(checkpoint: str) -> str:
    """A name for what one checkpoint writes; not a number, whatever the digest."""
    return "r" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def append_batches(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """A stream appended to a table of a partition (run, batch) a batch; a batch that is replayed writes over its own. Ends when all input is read."""
    run = run_name(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/run={run}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
