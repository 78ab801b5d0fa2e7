"""What the operators of this package share: scratch tables and whole-chunk word hashing.

Words are hashed with numpy over the raw UTF-8 buffer of an Arrow column, a few
megabytes at a time, so memory does not depend on the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.sources.scratch import delete, new_folder, save, scratch_dir

__all__ = ["delete", "new_folder", "save", "scratch_dir"]

CHUNK = 1 << 20
ONE = np.uint64(1)


# ---------------------------------------------------------------- scratch tables
def remove(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for frame in frames:
        root = scratch_dir(frame.sparkSession)
        inside = {f.rsplit("/", 1)[0] for f in frame.inputFiles()}
        delete(frame.sparkSession, *(f for f in inside if f.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/"))))


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with underscores before it until no column is called so (in any case)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


# ---------------------------------------------------------------- bounded membership filters
def id_bits(frame: DataFrame, hashed, n: int, most: int = 28) -> np.ndarray:
    """A Bloom bitmap of a column of 64-bit hashes, at least 16 bits a row up to 2**most bits (32 MB).

    Bits are combined before and in a shuffle; the driver gets the bitmap, whose size is bounded.
    """
    power = min(most, max(16, (16 * max(n, 1) - 1).bit_length()))
    at = F.explode(F.array(*(F.shiftrightunsigned(hashed, s).bitwiseAND((1 << power) - 1) for s in (0, 30))))
    words = frame.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_bits"))
    got = words.toArrow()
    bits = np.zeros(1 << (power - 6), dtype=np.int64)
    bits[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return bits.view(np.uint64)


def maybe_in(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether hashes may be among those of `id_bits`; never False for one that is."""
    out = np.ones(len(hashed), dtype=bool)
    h = hashed.view(np.uint64)
    for s in (0, 30):
        at = (h >> np.uint64(s)) & np.uint64(64 * len(bits) - 1)
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & ONE == ONE
    return out


# ---------------------------------------------------------------- word hashing
def _odd_inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


_P = 0x9E3779B97F4A7C15
_SEED = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | ONE
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("p", _P), ("i", _odd_inverse(_P))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(word: str) -> np.ndarray:
    """256 flags: which bytes belong to words. 'space': all but 0x20 and 0x09-0x0D; 'alnum': digits,
    ASCII letters and every byte of a non-ASCII character; 'alpha': the same without digits."""
    out = np.ones(256, dtype=bool)
    if word == "space":
        out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
        return out
    out[:128] = False
    out[ord("a") : ord("z") + 1] = out[ord("A") : ord("Z") + 1] = True
    if word == "alnum":
        out[ord("0") : ord("9") + 1] = True
    return out


def _lowered() -> np.ndarray:
    out = BYTE_VALUES.copy()
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    return out


LOWER_VALUES = _lowered()


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them) for runs of rows of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each row."""
    inside = is_word[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, values: np.ndarray = LOWER_VALUES):
    """A function from (starts, ends) to 64-bit hashes of these byte ranges."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:-1], out=total[1:])

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    return hashes


def hash_word(word: str | bytes, values: np.ndarray = LOWER_VALUES) -> int:
    """The hash that `span_hashes` gives one word."""
    data = np.frombuffer(word.encode() if isinstance(word, str) else word, dtype=np.uint8)
    return int(span_hashes(data, values)(np.array([0]), np.array([len(data)]))[0])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
