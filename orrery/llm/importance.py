"""Importance resampling towards a target distribution, by hashed n-gram features.

Features of a text are its runs of 1 to `width` consecutive words (A-Z lower-cased), joined by a space,
repeats counted; a feature's bucket is the unsigned crc32 of its bytes modulo `buckets`. One pass counts
the buckets of all documents and of all target texts; gains, one whole number a bucket, are an array.
A second pass scores every document by the floored mean of the gains at its features' buckets, and a
keyed Gumbel number makes the draw random but repeatable.

Scores are whole numbers in a range that does not depend on the number of documents, so their histogram
is exact and small: added up from its upper end it tells how many documents precede each score, and so
the score at which the draw ends. Only documents at or above it are ranked, by doc_id within a score.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII. The crc32 of all
words of a megabyte advances a byte at a time for all of them together; an n-gram goes on from the state
of its first words.

Nulls and edges: a null or empty text has no features and weight 0; documents of fewer than `least` words
are weighed but never drawn, nor are rows without doc_id, whose score is null; ties go to the smaller
doc_id, and equal rows are interchangeable; rows that repeat an id are documents of their own; very long
texts are whole (memory grows with the longest); an empty table, or an empty target, draws by the same
rule; other columns are ignored by `importance_ranks` and pass through `resample`, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.shared import byte_class, fresh, save, text_chunks, word_spans

WIDTH, BUCKETS, SHARE, LEAST, SEED = 2, 10_000, 25, 20, 7
#: Words longer than this advance one by one.
LONG = 48
RUN = 1 << 16


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, np.uint32(0xEDB88320) ^ (row >> np.uint32(1)), row >> np.uint32(1))
    return row


CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """States of crc32 after these byte ranges."""
    out = state.copy()
    for k in np.flatnonzero(sizes > LONG):
        out[k] = ~np.uint32(zlib.crc32(data[starts[k] : starts[k] + sizes[k]].tobytes(), int(~state[k])))
    short = np.flatnonzero(sizes <= LONG)
    short = short[np.argsort(-sizes[short], kind="stable")]
    at, left, now = starts[short], sizes[short], state[short]
    live = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")  # how many are longer than 0, 1, ...
    for j, n in enumerate(live.tolist()):
        part = now[:n]
        now[:n] = CRC[(part ^ data[at[:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[short] = now
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each length of n-gram the buckets of all and how many each text has."""
    data = _LOWER[data]
    starts, ends, words = word_spans(data, offsets, byte_class("alnum"))
    sizes, state, out, have = ends - starts, np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), [], words
    first = np.repeat(np.cumsum(words) - words, words)  # of each word's text
    last = first + np.repeat(words, words)
    lead = np.arange(len(starts))
    for k in range(width):
        if k:
            inside = lead + k < last[lead]
            lead, state = lead[inside], state[inside]
            state = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            have = np.maximum(words - k, 0)
        state = _advance(state, data, starts[lead + k], sizes[lead + k])
        out.append(((~state % np.uint32(buckets)).astype(np.int64), have))
    return words, out


def bucket_counts(texts: DataFrame, text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks add theirs up first."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                for at, _ in feature_buckets(data, offsets, width, buckets)[1]:
                    total += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of add-one smoothed shares) of every bucket."""
    n = len(source)
    whole, wanted = int(source.sum()), int(target.sum())
    ratio = [((t + 1) * (whole + n)) / ((s + 1) * (wanted + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, width: int = WIDTH, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, n_words, n_features, weight of docs (keys, text)."""
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            rows = []
            for _, _, data, offsets in text_chunks(batch.column(len(keys))):
                words, found = feature_buckets(data, offsets, width, len(gain))
                total, n = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
                for at, have in found:
                    sums = np.concatenate(([0], np.cumsum(gain[at])))
                    upto = np.cumsum(have)
                    total += sums[upto] - sums[upto - have]
                    n += have
                rows.append((words, n, total // np.maximum(n, 1)))
            if rows:
                words, n, weight = (np.concatenate(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)], names=[*keys, "n_words", "n_features", "weight"])

    return docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{schema}, n_words long, n_features long, weight long")


def importance_ranks(docs: DataFrame, target: DataFrame, share: int = SHARE, width: int = WIDTH, buckets: int = BUCKETS, least: int = LEAST, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id (and row), n_features, weight, score, rank of docs (doc_id, text) drawn towards target (text); rank is null where undrawn."""
    keys = ["doc_id", *([row] if row else [])]
    gain = gains(bucket_counts(docs, "text", width, buckets), bucket_counts(target, "text", width, buckets))
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((number + 0.5) / 4294967296.0)))
    scored = save(weigh(docs, gain, width, tuple(keys)).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("able", (F.col("n_words") >= least) & F.col("score").isNotNull()))

    # at most a row for each whole number between the least and greatest gain plus noise: some 100 000, however many documents there are
    seen = scored.where("able").groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    scores, counts = seen.column(0).to_numpy(), seen.column(1).to_numpy()
    draw = int(counts.sum()) * share // 100
    before = np.cumsum(counts) - counts  # documents of greater scores
    kept = int(np.searchsorted(before, draw, side="left"))  # scores of which at least one document is drawn
    spark = docs.sparkSession
    if not kept:
        return scored.select(*keys, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    starts = spark.createDataFrame(pa.table({"score": scores[:kept], "_before": before[:kept]}))
    cut = int(scores[kept - 1])

    out = [*keys, "n_features", "weight", "score"]
    alive = F.col("able") & (F.col("score") >= cut)
    # equal rows count as one until they are ranked, so an id that repeats without end is one row a task
    grouped = scored.where(alive).groupBy(*out).agg(F.count("*").alias("_copies")).join(F.broadcast(starts), "score")
    ahead = Window.partitionBy("score").orderBy(*keys, "n_features", "weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = grouped.withColumn("_first", F.col("_before") + F.sum("_copies").over(ahead) - F.col("_copies"))
    runs = ranked.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {RUN}"))))
    each = runs.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN), F.col("_copies") - F.col("_run") * RUN).cast("long"))))
    rank = F.col("_first") + F.col("_run") * RUN + F.col("_k")
    drawn = each.select(*out, F.when(rank <= draw, rank).alias("rank"))
    rest = scored.where(~F.coalesce(alive, F.lit(False))).select(*out, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; docs is written once with a number for each row."""
    row = fresh("_row", docs.columns)
    kept = save(docs.withColumn(row, F.monotonically_increasing_id()))
    ranks = importance_ranks(kept.select("doc_id", "text", F.col(row).alias("_row")), target, row="_row", **options)
    return kept.join(ranks.where("rank is not null").select(F.col("_row").alias(row)), row, "left_semi").select(*docs.columns)
