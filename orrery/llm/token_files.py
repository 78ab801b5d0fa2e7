"""Token ids as flat binary files: written in order of doc_id, read by memory mapping.

A dataset is a folder:

- `<name>.bin`: the ids of a file's documents one after another, little-endian unsigned integers of 16 bits
  if the vocabulary fits, else 32;
- `<name>.idx`: the magic, version, bytes of an id and number of documents n (four 64-bit integers), then
  n + 1 64-bit offsets, counted in ids from the file's start, n doc_ids and n flags (1: there is a doc_id);
- `manifest.json`: the files in order with their documents, ids and bases. A file's base, the number of ids
  before it, is the prefix sum of its predecessors' counts. It is written last: without it there is no
  dataset, and files that a lost or repeated task has left are not in it.

Writing: rows are dealt into ranges of doc_id, sorted within, and each task encodes its texts and streams
their ids into one file. Only texts move, once. Several ranges hold one doc_id if it repeats without end.

Encoding: a text is cut where no token of a byte-level BPE with the usual pattern crosses: before white space that
follows other characters, and between letters, digits and signs. Equal pieces are found by Arrow's dictionaries (exactly, not by a hash), and only
pieces that a task has not seen lately go to the tokenizers library; ids of all others are gathered.
Ids equal those of the library on the whole text.

Reading: a file's index tells where each document's ids are; ids are mapped, not loaded, wherever the
store has local paths, and otherwise read in parts. `Dataset` serves single documents and windows of ids.

Nulls and edges: a null or empty text has no ids but the end id; rows without doc_id come first; rows
that repeat a doc_id follow each other in order of their texts; very long texts are whole (a piece without
any white space goes to the library at once); an empty table is a dataset without files; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import new_folder, save, text_chunks

MAGIC, VERSION = 0x4F52544F4B454E53, 1
END = 2
FILE_BYTES = 256 << 20
KNOWN_PIECES, MOST_IDS = 800_000, 1 << 23
CALL, CHUNK = 20_000, 1 << 22
PART = 1 << 20
MANIFEST = "file string, documents long, ids long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- encoding
LETTER, DIGIT, SIGN, QUOTE, SPACE = 1, 2, 3, 4, 5


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each ASCII character (0: another), and between which classes the usual pattern always ends a token."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[0x21:0x7F] = SIGN
    kind[ord("'")] = QUOTE
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[ord("A") : ord("Z") + 1] = kind[ord("a") : ord("z") + 1] = LETTER
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    ends = np.zeros((6, 6), dtype=bool)
    ends[[LETTER, DIGIT, SIGN, QUOTE], SPACE] = True
    ends[[LETTER, DIGIT], SIGN] = ends[[LETTER, DIGIT], QUOTE] = True
    ends[LETTER, DIGIT] = ends[DIGIT, LETTER] = True
    ends[SIGN, LETTER] = ends[SIGN, DIGIT] = True  # but not behind a quote, which may begin a short form ('s)
    return kind, ends.ravel()


KINDS, ENDS = _classes()


def cuts(data: np.ndarray, words_only: bool = False) -> np.ndarray:
    """Places in UTF-8 bytes where a token surely ends: before white space that follows none and, unless words_only, between letters, digits and signs.

    U+00C0 to U+00FF but two are letters. Of other characters beyond ASCII only those are known that aren't white space:
    U+0080 to U+00BF and U+1000 to U+3FFF may be.
    """
    if len(data) < 2:
        return np.zeros(0, dtype=np.int64)
    kind = KINDS[data]
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[:-1][latin], kind[1:][latin] = LETTER, LETTER
    ends = (kind[1:] == SPACE) & (kind[:-1] != SPACE) & (kind[:-1] != 0) if words_only else ENDS[6 * kind[:-1] + kind[1:]]
    known = data >= 0x80
    known[1:] &= (data[:-1] != 0xC2) | (data[1:] < 0x80)
    known[2:] &= ~((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & (data[1:-1] >= 0x80) & (data[2:] >= 0x80))
    return np.flatnonzero(ends | (known[:-1] & (kind[1:] == SPACE))) + 1


class Encoder:
    """Ids of texts by a tokenizers file's content; keeps those of the pieces seen lately."""

    def __init__(self, content: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        shape = json.loads(content)
        before = shape.get("pre_tokenizer") or {}
        self.cuttable = shape.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in shape.get("added_tokens", ()))
        self.special = [t["content"].encode() for t in shape.get("added_tokens", ())]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.upto = np.zeros(1 << 12, dtype=np.int64)  # where the ids of each piece end
        self.seen = np.zeros(1 << 12, dtype=np.int64)  # in how many chunks each piece was, of late

    def _make_room(self) -> None:
        """Keep the pieces that were in several chunks, as far as they leave half of the room."""
        names, seen = list(self.number), self.seen[: len(self.number)]
        stay = np.flatnonzero(seen > 1)
        stay = np.sort(stay[np.argsort(-seen[stay], kind="stable")][: KNOWN_PIECES // 2])
        sizes = self.upto[stay + 1] - self.upto[stay]
        at = np.repeat(self.upto[stay] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        flat, seen = self.flat[at], seen[stay]
        self.forget()
        if len(flat) > MOST_IDS // 2:
            return
        self.flat, self.used = np.concatenate((flat, self.flat)), len(flat)
        self.upto = np.concatenate(([0], np.cumsum(sizes), self.upto))
        self.seen = np.concatenate((seen // 2, np.zeros(len(self.upto), dtype=np.int64)))
        self.number = {names[k]: n for n, k in enumerate(stay.tolist())}

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces and number them; each goes through the library as a text of its own, some thousand in a call."""
        for first in range(0, len(pieces), CALL):
            some = pieces[first : first + CALL]
            got = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, of = np.array(got.ids, dtype=np.uint32), np.array(got.word_ids, dtype=np.int64)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.used : self.used + len(ids)] = ids
            n = len(self.number)
            while n + len(some) >= len(self.upto):
                self.upto, self.seen = (np.concatenate((a, np.zeros_like(self.upto))) for a in (self.upto, self.seen))
            self.upto[n + 1 : n + 1 + len(some)] = self.used + np.cumsum(np.bincount(of, minlength=len(some)))
            self.used += len(ids)
            self.number.update(zip(some, range(n, n + len(some))))

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of texts, all their ids, ids of each text) for runs of texts of some megabytes, in order."""
        for _, _, data, offsets in text_chunks(column, CHUNK):
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[offsets] = True
            if self.cuttable:
                raw = data.tobytes()
                edge[cuts(data, any(t in raw for t in self.special))] = True
            edges = np.flatnonzero(edge)
            starts = edges[:-1]
            pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
            names = pieces.dictionary.to_pylist()
            if len(self.number) + len(names) > KNOWN_PIECES or self.used > MOST_IDS:
                self._make_room()
            known = self.number
            if new := [n for n in names if n not in known]:
                self._learn(new)
            numbers = np.fromiter(map(known.__getitem__, names), dtype=np.int64, count=len(names))
            self.seen[numbers] += 1
            numbers = numbers[pieces.indices.to_numpy()]
            at, sizes = self.upto[numbers], self.upto[numbers + 1] - self.upto[numbers]
            upto = np.concatenate(([0], np.cumsum(sizes)))
            ids = self.flat[np.arange(upto[-1]) + np.repeat(at - upto[:-1], sizes)]
            yield len(offsets) - 1, ids, np.diff(upto[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=1)
def encoder_of(content: str) -> Encoder:
    """One for all tasks of a worker: what one has seen the next needn't learn."""
    return Encoder(content)


def _vocabulary_bytes(content: str) -> int:
    shape = json.loads(content)
    most = max([*shape["model"]["vocab"].values(), *(t["id"] for t in shape.get("added_tokens", ())), END])
    return 2 if most < 1 << 16 else 4


# ---------------------------------------------------------------- writing
def _head(width: int, offsets: np.ndarray, ids: list[int | None]) -> bytes:
    have = np.array([i is not None for i in ids], dtype=np.uint8)
    return np.array([MAGIC, VERSION, width, len(ids)], dtype="<i8").tobytes() + offsets.astype("<i8").tobytes() + np.array([i or 0 for i in ids], dtype="<i8").tobytes() + have.tobytes()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, file_bytes: int = FILE_BYTES) -> dict:
    """Write docs (doc_id, text) as a dataset in `folder`, which every executor can open; returns its manifest."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        content = f.read()
    spark = docs.sparkSession
    width = _vocabulary_bytes(content)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    files: list[dict] = []
    if total is not None:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / file_bytes))
        order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("text")]
        ranged = rows.withColumn("digest", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
        ranged = ranged.repartitionByRange(n, order[0], "digest", "row").sortWithinPartitions(*order)
        written = save(ranged.select("doc_id", "text").mapInArrow(_writer(folder, spark.sparkContext.broadcast(content), width, end), f"{MANIFEST}, place int"))
        base = 0
        for file in written.orderBy("place").collect():  # one row a file
            files.append({"file": file["file"], "documents": file["documents"], "ids": file["ids"], "base": base})
            base += file["ids"]
    manifest = {"version": VERSION, "bytes": width, "end": end, "documents": sum(f["documents"] for f in files), "ids": sum(f["ids"] for f in files), "files": files}
    with store.open_output_stream(f"{root}/manifest.json.part", compression=None) as out:
        out.write(json.dumps(manifest).encode())
    store.move(f"{root}/manifest.json.part", f"{root}/manifest.json")
    return manifest


def _writer(folder: str, content, width: int, end: int):
    kind = np.dtype(f"<u{width}")

    def run(batches):
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(folder)
        name, sink, encoder = uuid.uuid4().hex, None, None
        doc_ids: list = []
        sizes = [np.zeros(1, dtype=np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or encoder_of(content.value)
            sink = sink or store.open_output_stream(f"{root}/{name}.bin", compression=None)
            doc_ids += batch.column(0).to_pylist()
            for n, ids, counts in encoder.encode(batch.column(1)):
                upto = np.cumsum(counts)
                closed = np.empty(len(ids) + n, dtype=kind)
                ends = upto + np.arange(n)
                inside = np.ones(len(closed), dtype=bool)
                inside[ends] = False
                closed[inside], closed[ends] = ids, end
                sink.write(closed.tobytes())
                sizes.append(counts + 1)
        if sink:
            sink.close()
            offsets = np.cumsum(np.concatenate(sizes))
            with store.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                index.write(_head(width, offsets, doc_ids))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(doc_ids)]), pa.array([int(offsets[-1])]), pa.array([TaskContext.get().partitionId()], pa.int32())], names=["file", "documents", "ids", "place"])

    return run


# ---------------------------------------------------------------- reading
class _File:
    """One file of a dataset: offsets, doc_ids and ids, mapped into memory where the store has local paths."""

    def __init__(self, folder: str, name: str):
        store, root = pafs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{root}/{name}.idx") as f:
            head = np.frombuffer(f.read(32), dtype="<i8")
            if len(head) < 4 or head[0] != MAGIC or head[1] != VERSION:
                raise ValueError(f"{name}.idx isn't an index of token files")
            n = int(head[3])
            body = f.read()
        if len(body) != 8 * (2 * n + 1) + n:
            raise ValueError(f"{name}.idx isn't whole")
        self.kind = np.dtype(f"<u{int(head[2])}")
        self.offsets = np.frombuffer(body, dtype="<i8", count=n + 1)
        self.doc_ids = np.frombuffer(body, dtype="<i8", count=n, offset=8 * (n + 1))
        self.have = np.frombuffer(body, dtype=np.uint8, count=n, offset=8 * (2 * n + 1)).astype(bool)
        self.local = isinstance(store, pafs.LocalFileSystem)
        self.ids = np.memmap(f"{root}/{name}.bin", dtype=self.kind, mode="r") if self.local and self.offsets[-1] else None
        self.store, self.path = store, f"{root}/{name}.bin"
        if store.get_file_info(self.path).size != self.kind.itemsize * int(self.offsets[-1]):
            raise ValueError(f"{name}.bin isn't as long as its index states")

    def read(self, start: int, stop: int) -> np.ndarray:
        if self.ids is not None:
            return self.ids[start:stop]
        with self.store.open_input_file(self.path) as f:
            return np.frombuffer(f.read_at((stop - start) * self.kind.itemsize, start * self.kind.itemsize), dtype=self.kind)


class Dataset:
    """Random access to a dataset for a training loader: documents by place, windows of ids across documents and files."""

    def __init__(self, folder: str):
        self.folder, self.manifest = folder, read_manifest(folder)
        files = self.manifest["files"]
        self.bases = np.array([f["base"] for f in files] + [self.manifest["ids"]], dtype=np.int64)
        self.first = np.cumsum([0] + [f["documents"] for f in files])
        self.open: dict[int, _File] = {}

    def __len__(self) -> int:
        return self.manifest["documents"]

    def _file(self, k: int) -> _File:
        if k not in self.open:
            self.open[k] = _File(self.folder, self.manifest["files"][k]["file"])
        return self.open[k]

    def __getitem__(self, place: int) -> np.ndarray:
        """The ids of the place-th document in order of doc_id."""
        if not 0 <= place < len(self):
            raise IndexError(place)
        k = int(np.searchsorted(self.first, place, side="right")) - 1
        file, at = self._file(k), place - int(self.first[k])
        return file.read(int(file.offsets[at]), int(file.offsets[at + 1]))

    def window(self, start: int, size: int) -> np.ndarray:
        """`size` ids from the start-th on (fewer at the end)."""
        parts, stop = [], min(start + size, int(self.bases[-1]))
        k = int(np.searchsorted(self.bases, start, side="right")) - 1
        while start < stop:
            upto = min(stop, int(self.bases[k + 1]))
            parts.append(self._file(k).read(start - int(self.bases[k]), upto - int(self.bases[k])))
            start, k = upto, k + 1
        return np.concatenate(parts) if parts else np.zeros(0, dtype=f"<u{self.manifest['bytes']}")


def read_manifest(folder: str) -> dict:
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _per_document(spark: SparkSession, folder: str, schema: str, made) -> DataFrame:
    """Rows that `made` gives for each slice (file, base, first, last) of some PART ids of each file."""
    files = read_manifest(folder)["files"]
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f["file"], f["base"]) for f in files], "file string, base long").repartition(len(files), "file")

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, n, first = _File(folder, name), 0, 0
                n = len(file.doc_ids)
                while first < n:
                    last = max(first + 1, int(np.searchsorted(file.offsets, file.offsets[first] + PART, side="right")) - 1)
                    yield made(file, base, first, min(last, n))
                    first = min(last, n)

    return listed.mapInArrow(run, schema)


def _named(file: _File, first: int, last: int) -> pa.Array:
    return pa.array(file.doc_ids[first:last], mask=~file.have[first:last])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids of every document."""

    def made(file, base, first, last):
        at = file.offsets[first : last + 1]
        ids = pa.array(np.asarray(file.read(int(at[0]), int(at[-1]))).astype(np.int32))
        lists = pa.LargeListArray.from_arrays(pa.array(at - at[0]), ids).cast(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([_named(file, first, last), pa.array(at[:-1] + base), lists], names=["doc_id", "start", "ids"])

    return _per_document(spark, folder, "doc_id long, start long, ids array<int>", made)


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of every document, a part of a long one at a time."""

    def crc(file, start, stop):
        out = 0
        for at in range(start, stop, PART):
            out = zlib.crc32(np.asarray(file.read(at, min(stop, at + PART))).astype("<u4").tobytes(), out)
        return out

    def made(file, base, first, last):
        at = file.offsets[first : last + 1]
        whole = np.asarray(file.read(int(at[0]), int(at[-1]))).astype("<u4").tobytes() if last - first > 1 else b""
        cut = (4 * (at - at[0])).tolist()
        view = memoryview(whole)
        crcs = [zlib.crc32(view[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)] if whole else [crc(file, int(at[0]), int(at[-1]))]
        return pa.RecordBatch.from_arrays([_named(file, first, last), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _per_document(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", made)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs (doc_id, text) as a dataset of the scratch folder, and read its digests back."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer)
    return token_digests(docs.sparkSession, folder)
