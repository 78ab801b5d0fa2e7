"""WARC writing and reading with a chunked record table.

Writing: payloads become chunk rows of at most CHUNK bytes, which carry their record's identifier and
number and follow each other in a task, and each task streams its chunks into one archive of the shared
folder, a gzip member per record, so no writer holds a record. The archive is renamed when it is whole;
a retried task writes another file, and only the files that the job reports are read. Payloads of
MIN_REVISIT bytes and more that are equal are stored once: the smallest id is the response, others are
revisit records that refer to it. That is decided on identifiers and digests alone; payloads move at
most once, to meet that decision by page and digest, and stay where they are if it is small.

Reading: archives are streamed member by member. A record's payload is never held whole: it
comes as rows (record, chunk number, bytes, running SHA-256 of the payload so far), at most
CHUNK bytes each, so a record may be larger than a task's memory. The last chunk's digest is
that of the payload; it must equal the one the record states, or reading fails. An archive that
ends within a record fails, too.

Digests are SHA-256 in lower-case hexadecimal. Nulls and edges: a null payload is empty; a
null url is written as an empty target; rows of the same id and payload are each written, and
only rows with an id greater than the smallest refer to it (a tie: the same id is response in each);
rows without id are responses. An empty table writes no archives and reads as an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import new_folder, save

CHUNK = 1 << 20
MIN_REVISIT = 100
CRLF = b"\r\n"
CHUNKS = "page_id long, record_type string, refers_to long, chunk_no long, chunk_bytes long, payload_bytes long, full_bytes long, digest string, stated string, last boolean, url string, data binary"


def _payload(pages: DataFrame, payload: str, *more) -> DataFrame:
    data = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), *more, data)
    return rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))


def revisits(pages: DataFrame, payload: str = "html") -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload another page holds as its response, decided over all rows."""
    rows = _payload(pages, payload).where((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    # written, so that the join reads two plain tables and splits a digest that many pages share
    first = save(rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select("digest", "refers_to"))
    return save(rows.join(first, "digest").where("page_id > refers_to").distinct())


def chunk_rows(pages: DataFrame, payload: str = "html") -> DataFrame:
    """The records to write, in chunks: page_id, row, chunk_no, and with the first chunk url, size, digest, refers_to; data is null in revisits."""
    rows = _payload(pages, payload, F.col("url").cast("string").alias("url")).withColumn("row", F.monotonically_increasing_id())
    again = revisits(pages, payload)
    told = rows.join(again, ["page_id", "digest"], "left")
    pieces = F.greatest(F.lit(1), F.when(F.col("refers_to").isNull(), F.expr(f"(size + {CHUNK - 1}) div {CHUNK}")).otherwise(1))
    cut = F.transform(F.sequence(F.lit(1).cast("long"), pieces.cast("long")), lambda k: F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), ((k - 1) * CHUNK + 1).cast("int"), F.lit(CHUNK))))
    opening = lambda c: F.when(F.col("chunk_no") == 0, F.col(c)).alias(c)
    return told.select("page_id", "row", "url", "size", "digest", "refers_to", F.posexplode(cut).alias("chunk_no", "data")).select("page_id", "row", "chunk_no", *map(opening, ("url", "size", "digest", "refers_to")), "data")


def _head(page_id: int | None, url: str, refers_to: int | None, digest: str, size: int) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode()]
    lines += [b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A"), f"WARC-Payload-Digest: sha256:{digest}".encode()]
    if refers_to is not None:  # a field of our own tells a revisit's full length
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {size}".encode()]
    lines += [b"Content-Type: text/html", f"Content-Length: {size if refers_to is None else 0}".encode(), b"", b""]
    return CRLF.join(lines)


def write_archives(chunks: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """(path, records, bytes) of the archives of chunk_rows, in `folder`, a location pyarrow can open from every executor.

    A record's chunks must follow each other, as chunk_rows makes them; a table that was dealt anew is refused.
    """

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        sink = press = None
        records = size = 0
        current, expected = None, 0

        def put(part: bytes) -> None:
            nonlocal size
            sink.write(part)
            size += len(part)

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, row, number, url, length, digest, refers_to, data = (batch.column(c)[k] for c in range(8))
                if number.as_py() and (number.as_py() != expected or row.as_py() != current):
                    raise ValueError("the chunks of a record don't follow each other")
                current, expected = row.as_py(), number.as_py() + 1
                if number.as_py() == 0:
                    if press:
                        put(press.compress(CRLF + CRLF) + press.flush())
                    sink = sink or store.open_output_stream(f"{root}/.{name}.part", compression=None)
                    press = zlib.compressobj(level, zlib.DEFLATED, 31)
                    put(press.compress(_head(page_id.as_py(), url.as_py() or "", refers_to.as_py(), digest.as_py(), length.as_py())))
                    records += 1
                if data.is_valid:
                    put(press.compress(memoryview(data.as_buffer())))
        if sink:
            put(press.compress(CRLF + CRLF) + press.flush())
            sink.close()
            store.move(f"{root}/.{name}.part", f"{root}/{name}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}.warc.gz"]), pa.array([records]), pa.array([size])], names=["path", "records", "bytes"])

    return chunks.select("page_id", "row", "chunk_no", "url", "size", "digest", "refers_to", "data").mapInArrow(run, "path string, records long, bytes long")


class _Members:
    """The bytes of a gzip file as one stream that is filled as it is read."""

    def __init__(self, source):
        self.source, self.raw, self.held, self.press = source, b"", bytearray(), None

    def fill(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                if self.press:
                    raise ValueError("an archive ends within a record")
                return False
        self.press = self.press or zlib.decompressobj(31)
        self.held += self.press.decompress(self.raw, CHUNK)
        self.raw = self.press.unconsumed_tail
        if self.press.eof:
            self.raw, self.press = self.press.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if not self.fill():
                if self.held.strip():
                    raise ValueError("an archive ends within a record's head")
                return b""
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        while not self.held:
            if not self.fill():
                raise ValueError("an archive ends within a record")
        out = bytes(self.held[:most])
        del self.held[:most]
        return out


def _id(text: str) -> int | None:
    digits = text.rpartition(":")[2].rstrip(">")
    return int(digits) if digits else None


def records(source) -> Iterator[tuple]:
    """Rows of CHUNKS from an open archive."""
    stream = _Members(source)
    while head := stream.until(CRLF + CRLF):
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.lstrip().decode().split("\r\n")[1:])
        size = left = int(fields["Content-Length"])
        chunk, seen, sha = 0, 0, hashlib.sha256()
        stated = fields["WARC-Payload-Digest"].partition(":")[2]
        kind, to = fields["WARC-Type"], fields.get("WARC-Refers-To")
        while True:
            data = bytearray()
            while left and len(data) < CHUNK:
                data += stream.take(min(left, CHUNK - len(data)))
                left = size - seen - len(data)
            sha.update(data)
            seen += len(data)
            if not left and kind == "response" and sha.hexdigest() != stated:
                raise ValueError(f"record {fields['WARC-Record-ID']}: its payload doesn't have the digest it states")
            yield _id(fields["WARC-Record-ID"]), kind, _id(to) if to else None, chunk, len(data), seen, int(fields.get("X-Payload-Length", size)), sha.hexdigest(), stated, not left, fields["WARC-Target-URI"], bytes(data)
            chunk += 1
            if not left:
                break
        if stream.until(CRLF + CRLF):
            raise ValueError("a record is longer than it states")


def read_archives(archives: DataFrame) -> DataFrame:
    """The chunk table of archives (path). Each archive is streamed by one task, a few chunks at a time."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(inner, compression=None) as source:
                    for row in records(source):
                        rows.append(row)
                        size += row[4] + 200
                        if size > 4 * CHUNK:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    return archives.select("path").mapInArrow(run, CHUNKS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html), read the chunk table back: page_id, payload_bytes, payload_digest, record_type, refers_to, chunks.

    A record's rows follow each other, and its last one tells its length, digest and number of chunks, so no rows meet.
    """
    folder = new_folder(spark, "warc")
    archives = save(write_archives(chunk_rows(pages), folder))
    found = read_archives(archives.repartition(max(1, archives.count())))
    whole = F.when(F.octet_length("data") == F.col("chunk_bytes"), F.col("full_bytes")).otherwise(F.raise_error(F.lit("a chunk's bytes are not all there")).cast("long"))
    return found.where("last").select("page_id", whole.alias("payload_bytes"), F.col("stated").alias("payload_digest"), "record_type", "refers_to", (F.col("chunk_no") + 1).alias("chunks"))
