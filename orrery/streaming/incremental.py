"""Incremental operators (I1-I11): digest dedup, change events and rates as streams, and batch marks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.latest import replace_keys
from orrery.streaming.stateful import append_batches, first_of_each, run_name


def new_items(items: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Items not seen before by key; with a time column, state is dropped after `delay`."""
    if items.isStreaming and time:
        return items.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return items.dropDuplicates(keys)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events per key and window; late rows up to `delay` still count."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def append_new(stream: DataFrame, table: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append what a table lacks, batch by batch. The checkpoint is the mark.

    Keys that were seen are state (see `stateful`), so a batch reads none of the table; what other checkpoints put into the table
    is read once, when this one begins. A batch is a partition of the table, named after checkpoint and number and written over
    when it is replayed.
    """
    spark, known, run = stream.sparkSession, None, run_name(checkpoint)
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        known = spark.read.schema(stream.schema.add("run", "string")).parquet(table).where(F.col("run") != run)
    return append_batches(first_of_each(stream, keys, known), table, checkpoint)


def changed_since(sources: list[DataFrame], key: str, time: str, mark) -> DataFrame:
    """Distinct keys that any source changed at or after the mark.

    I2: take the next mark before reading, so that an overlap, never a gap, lies between two runs.
    """
    if mark is None:
        raise ValueError("no mark: project everything first")  # I4
    out = None
    for s in sources:
        part = s.where(F.col(time) >= F.lit(mark)).select(key)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def staleness(projectable: DataFrame, projected: DataFrame, key: str) -> DataFrame:
    """I8: how many keys could be projected, are, and aren't yet."""
    a, b = projectable.select(key).distinct(), projected.select(key).distinct()
    missing = a.join(b, key, "left_anti")
    return a.agg(F.count("*").alias("projectable")).crossJoin(missing.agg(F.count("*").alias("stale")))


def recheck_queue(videos: DataFrame, most: int) -> DataFrame:
    """What to check next: never checked first, then the longest ago; only the definitely dead are left out."""
    return videos.where("alive is not false").orderBy(F.col("checked_at").asc_nulls_first(), "id").limit(most)


def advance_mark(marks: DataFrame, universe: str, started, complete: bool) -> DataFrame:
    """Marks (universe, mark) after a projection that began at `started`.

    Only one of everything moves the mark: after a part, it would say that works never listed are up to date.
    """
    if not complete:
        return marks
    row = marks.sparkSession.range(1).select(F.lit(universe).alias("universe"), F.lit(started).cast("timestamp").alias("mark"))
    return replace_keys(marks, row, ["universe"])


class SummaryCache:
    """The rows of small summaries, kept on the driver for some seconds; `most` bounds a summary's rows."""

    def __init__(self, seconds: float, most: int = 1000, clock=time.monotonic):
        self.seconds, self.most, self.clock, self.held = seconds, most, clock, {}

    def get(self, key: str, make) -> list:
        """The rows of make(), a DataFrame, computed anew when they are older than `seconds`."""
        at, rows = self.held.get(key, (None, None))
        if at is None or self.clock() - at > self.seconds:
            rows = make().limit(self.most + 1).collect()
            if len(rows) > self.most:
                raise ValueError(f"a summary has at most {self.most} rows")
            self.held[key] = (self.clock(), rows)
        return rows

    def clear(self) -> None:
        self.held.clear()
