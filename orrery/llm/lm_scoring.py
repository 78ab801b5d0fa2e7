"""Language-model scoring with stupid backoff, as joins of hash-partitioned n-gram tables.

Counts of all n-grams up to `order` come from all documents. Each word is scored by
leaving itself out: S = (c(context, w) - 1) / (c(context) - 1) if that n-gram occurs
elsewhere, else ALPHA times the shorter context's S, down to max(c(w) - 1, 1/2) / N. A
document's score is the sum of log S over its words.

1. Documents are read once into a table of blocks of about `block_words` words each: a block's
   vocabulary of word hashes and every word as a number in it. A longer document is cut into
   pieces of several blocks; a piece repeats the words that its first contexts need. The table
   is bucketed by block, so the join below doesn't shuffle it.
2. A block's distinct n-grams and their counts are exploded into cells by n-gram hash: rows
   (cell, block, packed sorted hashes, counts), so a frequent n-gram is one entry per block
   and copies of a document are dealt like any other; nothing is a hot key.
3. Cells are grouped: counts are summed over blocks, and each block gets back, in the order
   in which it sent its n-grams, how often they occur in all.
4. Blocks are joined with these totals, logarithms are summed per piece, and pieces per document.

Rows hold packed arrays instead of one n-gram each: the same join, with some thousand times
fewer rows to shuffle. Cells and the shuffles' partitions grow with the words, so what a task
holds doesn't.

Words are runs of letters, digits and non-ASCII characters, in ASCII lower case; n-grams are
compared by 64-bit hashes. Nulls and edges: a null or empty text has no words and score 0
(mean null); repeated rows count and are scored as often as they occur; ties can't arise, as every
row gets its own score; long texts are whole; an empty table returns no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import byte_class, mix, new_folder, span_hashes, text_chunks, word_spans

ALNUM = byte_class("alnum")
ALPHA = 0.4
SLICE = 1 << 22  # bytes of a text that are hashed at once
MOST_ROWS = 1 << 16  # documents of a block, however short
_K = np.array([0x9AE16A3B2F90404F, 0xC949C7DEFE7A4D8B, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: the high bytes are mostly zero and compress in the shuffle."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def pack(ascending: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(from_planes(packed), dtype=np.uint64)


def bucketed(frame: DataFrame, parts: int, key: str) -> DataFrame:
    """frame, written to the scratch folder as a table of `parts` buckets; its name leaves the catalogue at once, the relation stays."""
    spark, name = frame.sparkSession, f"orrery_{uuid.uuid4().hex}"
    frame.write.bucketBy(parts, key).option("path", new_folder(spark, "blocks")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def squeeze(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def expand(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def ngram_hashes(words: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Per length 1..order the hash of the n-gram ending at each word; 0 where the piece has none. first: each word's place in its piece."""
    out = [mix(words + _K[0])]
    for n in range(2, order + 1):
        longer = np.zeros_like(words)
        longer[1:] = mix(out[-1][:-1] * _K[1] + words[1:] + np.uint64(n))
        out.append(np.where(first >= n - 1, longer, np.uint64(0)))
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and words per row. A long text is hashed in slices that end where a word does."""
    if len(offsets) > 2 or len(data) <= SLICE:
        starts, ends, counts = word_spans(data, offsets, ALNUM)
        return (span_hashes(data)(starts, ends) if len(data) else np.zeros(0, np.uint64)), counts
    out, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and ALNUM[data[end - 1]] and ALNUM[data[end]]:
            end += 1
        part = data[at:end]
        starts, ends, _ = word_spans(part, np.array([0, len(part)]), ALNUM)
        out.append(span_hashes(part)(starts, ends))
        at = end
    words = np.concatenate(out)
    return words, np.array([len(words)])


BLOCKS = "block long, rows array<long>, doc_ids array<long>, words array<long>, lead array<int>, n_words long, vocabulary binary, ids binary, n_ids long, n_known long"


def block_table(docs: DataFrame, order: int, block_words: int) -> tuple[DataFrame, int]:
    """The table of blocks and its number of buckets: pieces of documents (row number, doc_id, words, and words before them that are context only), their words as numbers in the block's vocabulary."""

    def run(batches):
        task, made, row = TaskContext.get().partitionId(), 0, 0
        pieces: list[tuple] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal made, pieces, held, size
            vocabulary, ids, times = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
            often = np.argsort(-times, kind="stable")  # frequent words have small numbers, which compress
            number = np.empty(len(often), np.uint32)
            number[often] = np.arange(len(often))
            vocabulary, ids = vocabulary[often], number[ids]
            rows, doc_ids, words, lead = zip(*pieces, strict=True)
            cells = {"block": (task << 32) + made, "rows": rows, "doc_ids": doc_ids, "words": words, "lead": lead, "n_words": sum(words)}
            cells |= {"vocabulary": squeeze(vocabulary.tobytes()), "ids": squeeze(ids.view(np.uint8).reshape(-1, 4).T.tobytes()), "n_ids": len(ids), "n_known": len(vocabulary)}
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            made, pieces, held, size = made + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(cells.values(), kinds, strict=True)], names=list(cells))

        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(0)):
                words, counts = hashed_words(data, offsets)
                at = np.concatenate(([0], np.cumsum(counts)))
                for doc_id, a, b in zip(batch.column(1).slice(i, j - i).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    begin = a
                    while True:
                        end = min(b, begin + block_words - size)
                        lead = min(order - 1, begin - a)
                        pieces.append(((task << 32) + row, doc_id, end - begin, lead))
                        held.append(words[begin - lead : end])
                        size += end - begin
                        begin = end
                        if size >= block_words or len(pieces) >= MOST_ROWS:
                            yield flush()
                        if begin >= b:
                            break
                    row += 1
        if pieces:
            yield flush()

    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(8, size // (24 * block_words) + 1)  # some four blocks each
    return bucketed(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, BLOCKS), parts, "block"), parts


def block_grams(row: dict, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a block: its pieces' word counts with lead, which words are scored, n-gram hashes per length, each word's place in its piece."""
    vocabulary = np.frombuffer(expand(row["vocabulary"], 8 * row["n_known"]), np.uint64)
    words = vocabulary[np.frombuffer(expand(row["ids"], 4 * row["n_ids"]), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()]
    lead = np.array(row["lead"], dtype=np.int64)
    counts = np.array(row["words"], dtype=np.int64) + lead
    first = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    return counts, first >= np.repeat(lead, counts), ngram_hashes(words, first, order), first


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = ALPHA, cells: int = 32, block_words: int = 1 << 20, cell_grams: int = 1 << 21) -> DataFrame:
    """doc_id, n_words, n_backoff (words whose longest context did not help), logprob and mean_logprob of every row of docs (doc_id, text)."""
    if cells & (cells - 1):
        raise ValueError("cells must be a power of two")
    blocks, parts = block_table(docs, order, block_words)
    n_words = max(blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0], 1)
    while cells * cell_grams < order * n_words:
        cells *= 2
    shift = np.uint64(64 - (cells.bit_length() - 1))

    def count(batches):
        for batch in batches:
            for row in (batch.slice(r, 1).to_pylist()[0] for r in range(batch.num_rows)):
                _, scored, grams, _ = block_grams(row, order)
                keys = np.concatenate(grams)
                own = np.tile(scored, order)[keys != 0]
                keys, back = np.unique(keys[keys != 0], return_inverse=True)
                counts = np.bincount(back[own], minlength=len(keys)).astype(np.uint64)
                at = np.searchsorted((keys >> shift).astype(np.int64), np.arange(cells + 1))
                for c in np.flatnonzero(at[1:] > at[:-1]).tolist():
                    cut = slice(at[c], at[c + 1])
                    packed = [pa.array([squeeze(pack(keys[cut]))], pa.binary()), pa.array([squeeze(planes(counts[cut]))], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([row["block"]]), *packed, pa.array([int(at[c + 1] - at[c])])], names=["cell", "block", "grams", "counts", "n"])

    packed_words = blocks.select("block", "words", "lead", "vocabulary", "ids", "n_ids", "n_known")
    exploded = packed_words.mapInArrow(count, "cell int, block long, grams binary, counts binary, n long").repartition(max(8, cells // 4), "cell")

    def total(table: pa.Table) -> pa.Table:
        grams = [unpack(expand(g.as_py(), 8 * n)) for g, n in zip(table.column("grams"), table.column("n").to_pylist(), strict=True)]
        counts = np.concatenate([from_planes(expand(c.as_py(), 8 * len(g))) for c, g in zip(table.column("counts"), grams, strict=True)])
        keys = np.concatenate(grams)
        order_ = np.argsort(keys, kind="stable")
        keys = keys[order_]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        sums = np.empty(len(keys), np.uint64)
        sums[order_] = np.add.reduceat(counts[order_], np.flatnonzero(new))[np.cumsum(new) - 1]
        ends = np.cumsum([len(g) for g in grams])
        packed = [squeeze(planes(sums[e - len(g) : e].copy())) for g, e in zip(grams, ends, strict=True)]
        return pa.table({"block": table.column("block"), "cell": table.column("cell"), "sums": pa.array(packed, pa.binary()), "n": pa.array([len(g) for g in grams], pa.int64())})

    totals = exploded.groupBy("cell").applyInArrow(total, "block long, cell int, sums binary, n long")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        counts, scored, grams, first = block_grams(row, order)
        keys = np.concatenate(grams)
        some = keys != 0
        _, back = np.unique(keys[some], return_inverse=True)
        by_cell = sorted(zip(right.column("cell").to_pylist(), right.column("sums").to_pylist(), right.column("n").to_pylist(), strict=True))
        sums = np.concatenate([np.zeros(0, np.uint64), *(from_planes(expand(s, 8 * n)) for _, s, n in by_cell)]).astype(np.int64)
        here = np.zeros(len(keys), np.int64)
        here[some] = sums[back] - 1  # how often an n-gram occurs besides here
        here = here.reshape(order, -1)
        value = np.log(np.maximum(here[0], 0.5) / n_words)
        hit = np.ones(len(value), dtype=bool)
        for n in range(1, order):
            before = np.zeros_like(here[n])
            before[1:] = here[n - 1][:-1]
            inside = first >= n
            found = inside & (here[n] > 0)
            value = np.where(found, np.log(np.maximum(here[n], 1) / np.maximum(before, 1)), value + np.where(inside, np.log(alpha), 0.0))
            hit = np.where(inside, found, hit)
        at = np.concatenate(([0], np.cumsum(counts)))
        sums_of = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
        return pa.table({
            "row": pa.array(row["rows"], pa.int64()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(row["words"], pa.int64()),
            "n_backoff": pa.array(sums_of(~hit & scored).astype(np.int64)), "logprob": pa.array(sums_of(np.where(scored, value, 0.0)).astype(np.float64)),
        })

    both = blocks.groupBy("block").cogroup(totals.repartition(parts, "block").groupBy("block"))
    pieces = both.applyInArrow(score, "row long, doc_id long, n_words long, n_backoff long, logprob double")
    whole = pieces.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_backoff", "logprob")]).drop("row")
    return whole.withColumn("mean_logprob", F.when(F.col("n_words") > 0, F.col("logprob") / F.col("n_words")))
