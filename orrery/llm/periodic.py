"""Periodic runs of words, found by probing harmonic grids.

A run is a stretch of consecutive words in which words `period` apart are equal, at least `times` periods
(and `shortest` words) long, that no neighbouring word extends; the period is its smallest. A run of period
p that is 4 p long holds three neighbours among the multiples of p whose words equal the next multiple's.
So for every p only the words at jp and (j+1)p are compared, n/p of them, n ln n in all; where three hold in a
row, the stretch is extended both ways by comparing chunks of doubling size, and the grid points inside
what is found are skipped, as are those inside a run whose period divides p (there p isn't the smallest).
The texts of some megabytes are probed together, one p after the other, so short texts cost no loop of
their own.

Words are numbered exactly (by a dictionary of the texts at hand), never by a hash.

Collapsing drops the words that a run holds after its first period.

Nulls and edges: a null or empty text has no words, no runs and an empty collapsed text; texts of any
length are processed whole, in memory that grows with the longest; overlapping runs are each returned;
rows that repeat give equal results; an empty table returns no rows; other columns pass through, but one
called like a result (runs, collapsed, n_words) gives way to it.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

TIMES, SHORTEST = 4, 6
BYTES = 1 << 22
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts, one after another, and where each text's begin (and the last one's end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty piece
    return flat.filter(pa.array(filled)), np.concatenate(([0], np.cumsum(filled)))[offsets]


def _upwards(words: np.ndarray, at: int, period: int, end: int) -> int:
    """The first i >= at, below end, whose word differs from that at i + period; end if none does."""
    size = 32
    while at < end:
        stop = min(end, at + size)
        same = words[at:stop] == words[at + period : stop + period]
        if not same.all():
            return at + int(np.argmin(same))
        at, size = stop, 2 * size
    return end


def _downwards(words: np.ndarray, at: int, period: int) -> int:
    """The first i <= at from which on all words up to at equal those `period` later, given that at does."""
    size = 32
    while at > 0:
        stop = max(0, at - size)
        same = words[stop:at] == words[stop + period : at + period]
        if not same.all():
            return at - int(np.argmin(same[::-1]))
        at, size = stop, 2 * size
    return 0


class _Found:
    """The runs of one text, by period and start."""

    def __init__(self, words: np.ndarray, times: int, shortest: int):
        self.words, self.times, self.shortest = words, times, shortest
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}

    def past(self, at: int, period: int) -> int:
        """The first place from which a known run, whose period divides this one, no longer holds both grid points of `at`."""
        for q, starts in self.starts.items():
            if period % q == 0 and (k := bisect_right(starts, at)) and at + period < (end := self.ends[q][k - 1]):
                return end - period
        return at

    def probe(self, first: int, last: int, period: int) -> None:
        """Grid points first, first + period, ..., last all equal their next one: find the runs among them."""
        at, words = first, self.words
        while at <= last:
            if (beyond := self.past(at, period)) == at:
                begin, end = _downwards(words, at, period), _upwards(words, at, period, len(words) - period) + period
                if end - begin >= max(self.shortest, self.times * period):
                    self.starts.setdefault(period, []).append(begin)
                    self.ends.setdefault(period, []).append(end)
                beyond = end - period
            at += max(period, -(-(beyond - at) // period) * period)

    def rows(self) -> list[tuple[int, int, int]]:
        return sorted((s, e - s, q) for q in self.starts for s, e in zip(self.starts[q], self.ends[q], strict=True))


def runs_of(words: np.ndarray, offsets: np.ndarray, times: int = TIMES, shortest: int = SHORTEST) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text that has any, by start, then period. words: numbers; offsets: where texts begin."""
    if times < 4:
        raise ValueError("three grid points in a row need four periods")
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], offsets[:-1][order]
    found: dict[int, _Found] = {}
    for period in range(1, (int(size[0]) if len(size) else 0) // times + 1):
        n = int(np.searchsorted(-size, -max(shortest, times * period), side="right"))  # texts long enough
        if not n:
            break
        points = (size[:n] - 1) // period
        upto = np.cumsum(points)
        grid = np.arange(upto[-1]) * period + np.repeat(begin[:n] - (upto - points) * period, points)
        hit = words[grid] == words[grid + period]
        three = np.flatnonzero(hit[:-2] & hit[1:-1] & hit[2:])
        three = three[grid[three + 2] - grid[three] == 2 * period]  # within one text
        if not len(three):
            continue
        text = np.searchsorted(upto, three, side="right")
        cuts = np.flatnonzero((np.diff(three) != 1) | (np.diff(text) != 0)) + 1
        for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(three)])).tolist(), strict=True):
            k = int(text[a])
            own = found.get(k) or found.setdefault(k, _Found(words[begin[k] : begin[k] + size[k]], times, shortest))
            own.probe(int(grid[three[a]] - begin[k]), int(grid[three[b - 1]] - begin[k]), period)
    return {int(order[k]): rows for k, f in found.items() if (rows := f.rows())}


def _slices(batch: pa.RecordBatch, column: pa.Array):
    """Runs of rows of about BYTES."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def find_runs(docs: DataFrame, text: str = "text", times: int = TIMES, shortest: int = SHORTEST, keep_text: bool = True) -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed, the words that stay joined by a space."""
    made = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("n_words", "runs", "collapsed") and (keep_text or f.name != text)]
    schema = StructType([*kept, *made])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for whole in batches:
            for batch in _slices(whole, whole.column(whole.schema.get_field_index(text))):
                words, offsets = split_words(batch.column(batch.schema.get_field_index(text)))
                found = runs_of(words.dictionary_encode().indices.to_numpy(), offsets, times, shortest)
                stay = np.ones(len(words), dtype=bool)
                for k, rows in found.items():
                    for start, length, period in rows:
                        stay[offsets[k] + start + period : offsets[k] + start + length] = False
                left = np.concatenate(([0], np.cumsum(stay)))[offsets]
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(stay))), pa.scalar(" ", pa.large_string()))
                lists = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(k, ())] for k in range(batch.num_rows)], kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(np.diff(offsets)), lists, texts.cast(pa.string())], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def plant_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs in which, by crc32 of doc_id, every tenth text ends in a repetition of some of its own words (for measuring)."""

    def run(batches):
        import zlib

        for whole in batches:
            place = whole.schema.get_field_index(text)
            for batch in _slices(whole, whole.column(place)):
                column, made = batch.column(place), []
                for k, i in enumerate(batch.column(batch.schema.get_field_index("doc_id")).to_pylist()):
                    h = zlib.crc32(str(i).encode()) if i is not None else 1
                    value = column[k].as_py()
                    if h % 10 == 0 and value:
                        words = split_words(pa.array([value]))[0].to_pylist()
                        if n := len(words):
                            g = h // 10
                            a = g % n
                            p = 1 + (n - a) // (3 + g % 8)
                            value = " ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])
                    made.append(value)
                arrays = [pa.array(made, pa.string()) if c == place else batch.column(c) for c in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    nothing = F.lit(None).cast(RUN)
    best = F.aggregate("runs", nothing, lambda a, b: F.when(a.isNull() | better(b, a), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
