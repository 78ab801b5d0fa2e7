"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

A document's set holds its distinct word shingles (ASCII lower case; a text of fewer
words is one shingle; no words: the empty set, linked with nothing). Two documents link
when |A & B| / |A | B| >= percent / 100. The result is exact.

1. Part keys (candidates, none lost). Linked sets differ in at most D elements, D bounded
   by their sizes. Shingles of many documents, known from a table of hashed counts over all
   documents, are set aside. What is left of a set is cut by hash range into D + 1 + slack
   parts, a number fixed per size band, so linked sets agree on more parts than the slack.
   Each non-empty part becomes one key. A set with more empty parts than the slack also gives
   the keys of its whole self: if two linked sets agree on empty parts only, both do. A set
   whose partner may lie in the next band gives that band's keys, too. So common passages
   make no keys of their own, and candidates follow real copies and grow with the input.
2. Families: every key's sets are joined to the key's smallest set (the join splits when
   skewed); connected components of these pairs are families. Most keys are of one set only; which
   aren't is found first, on four bytes of each key, packed into rows by hash range, so no row or hash
   table entry of the JVM stands for one key and few bytes of one are shuffled. Only one document of equal sets is asked.
3. Tiles: a large family falls into the groups of its keys, each key's sets under its smallest set, which hold all its
   candidates; so pairs that share no key aren't met, however many sets a family chains together.
   A family or group of more than a block is cut into size bands and blocks; a tile holds two blocks whose sizes
   can reach the threshold, about BLOCK sets each. In a tile, bit counts of hashed bitmaps
   bound each overlap from above, the survivors are intersected as sorted arrays, and pairs
   already connected are skipped. A tile returns spanning links only, never all pairs. In
   a family of many tiles, every set is first compared with one other; groups of a block
   and more that this connects are then compared with the rest of the family only, so a
   large group of near copies costs in proportion to its size.
4. Components of the links; a component is named after its smallest doc_id.

Equal sets are one node (the 64-bit sum of mixed shingle hashes), so exact copies are never
paired. A second such sum goes with it: sets that share the first only are found once over all
documents and get numbers of their own, so 128 bits tell sets apart. What the table of hashed counts sets aside, the size of
families that are compared with one set first (CROWD) and the bitmaps' fixed size only save work.

Nulls and edges: a null text counts as empty; a null doc_id is never a component's name
(all null: null); repeated rows each return a row; ties at the threshold link; very long texts are
whole; an empty table returns no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.components import clashes, connected_components, renumbered
from orrery.llm.shared import as_long, byte_class, id_bits, maybe_in, mix, remove, save, span_hashes, text_chunks, word_spans

BLOCK, CROWD = 256, 4
BITS = 1024
SLACK, SLACK_SHARE = 2, 0.15
COUNTS, SLOTS = 1 << 20, 256  # hashed counts of shingles, and pieces that their table is added up in
PACK, CELL = 1 << 18, 1 << 20  # part keys that are packed at once, and shingles of all documents for each range of keys
SPACE = byte_class("space")
_K = np.array([0x9AE16A3B2F90404F, 0xC949C7DEFE7A4D8B, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, and how many each row has."""
    starts, ends, counts = word_spans(data, offsets, SPACE)
    words = span_hashes(data)(starts, ends)
    n = len(words)
    out = np.full(n, n, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    first = np.cumsum(counts) - counts
    last = np.repeat(first + counts, counts)
    at = np.arange(n)
    for k in range(width):
        here = np.minimum(at + k, n - 1)
        inside = at + k < last
        total += np.where(inside, (words[here] + np.uint64(k + 1)) * (_K[k % 5] + np.uint64(2 * (k // 5))), np.uint64(0))
    out = mix(total)
    whole = at + width <= last
    short = (counts > 0) & (counts < width)
    whole[first[short]] = True
    return out[whole], np.where(short, 1, np.maximum(counts - width + 1, 0))


def band_of(n: int, percent: int) -> int:
    """Size bands are one threshold ratio wide."""
    return int(math.floor(math.log(n) / math.log(100 / percent) + 1e-9))


def band_top(band: int, percent: int) -> int:
    return int(math.ceil((100 / percent) ** (band + 1) + 1e-6))


def _parts(found: np.ndarray, parts: int, tag: int) -> np.ndarray:
    """Keys of the non-empty parts of a sorted set."""
    if not len(found):
        return found
    at = ((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return mix(np.add.reduceat(mix(found + np.array([tag], np.uint64)), cut) + at[cut] * _K[0] + np.array([tag], np.uint64) * _K[1])


def part_keys(found: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The keys of a sorted distinct shingle set; sets that link share at least one key or are equal.

    common: flags of count table cells whose shingles are set aside.
    """
    n = len(found)
    rare = found[~common[(found >> np.uint64(44)).astype(np.int64)]]
    keys = [np.zeros(0, np.uint64)]
    for band in range(band_of(n, percent), band_of(max(n, n * 100 // percent), percent) + 1):
        # |A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|), both at most the band's top
        differ = (100 - percent) * 2 * band_top(band, percent) // (100 + percent)
        if differ == 0:
            continue
        slack = max(SLACK, math.ceil(SLACK_SHARE * (differ + 1)))
        keys.append(_parts(rare, differ + 1 + slack, 2 * band + 2))
        if differ + 1 + slack - len(keys[-1]) > slack:  # agreed parts may all be empty: the whole set must speak
            whole = _parts(found, differ + 1 + slack, 2 * band + 3)
            if differ + 1 + slack - len(whole) > slack:  # the same again: one key for all such sets of a band
                whole = np.append(whole, mix(np.array([2 * band + 3], np.uint64) * _K[2]))
            keys.append(whole)
    return np.concatenate(keys)


def _sets_of(batch: pa.RecordBatch, width: int):
    """(row, sorted distinct shingle hashes) of every row of a batch whose first column is the text."""
    for i, j, data, offsets in text_chunks(batch.column(0)):
        if not len(data):
            yield from ((r, np.zeros(0, np.uint64)) for r in range(i, j))
            continue
        found, counts = shingles(data, offsets, width)
        at = np.concatenate(([0], np.cumsum(counts)))
        for r in range(j - i):
            yield i + r, np.unique(found[at[r] : at[r + 1]])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(values)))


def _slices(batches, rows: int = 256):
    """Runs of rows, as few as leave a worker's memory small beside the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def _node(shingled: np.ndarray) -> np.uint64:
    return np.sum(mix(shingled + _K[4])) + np.uint64(len(shingled))


def _check(shingled: np.ndarray) -> np.uint64:
    """Another number of a set, independent of its node."""
    return np.sum(mix(shingled ^ _K[2]))


def _identities(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Node and check of sets; fewer than 64 bits make nodes clash, for tests."""
    node = mix(np.array([_node(s) if len(s) else 0 for s in sets], dtype=np.uint64)) & np.uint64((1 << bits) - 1)
    return as_long(node), as_long(np.array([_check(s) for s in sets], dtype=np.uint64))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"))


#: A number of a row of `_input`. The least of a set's rows tells which one speaks for it.
TELLER = "digest ^ coalesce(doc_id, -1L)"


def _telling(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch of `_input` whose TELLER may be in a bitmap."""
    number = batch.column(2).to_numpy() ^ pc.fill_null(batch.column(1), -1).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(maybe_in(bits, number)))


def shingle_sets(docs: DataFrame, width: int, bits: int = 64) -> tuple[DataFrame, np.ndarray, DataFrame | None]:
    """(doc_id, digest, n, node, check) of every row: the text's hash, set size and the set's identity (node null when empty); flags of common shingles; clashing nodes.

    The count table has a fixed size; tasks add up their own, then pieces of it are added up in a shuffle.
    """

    names = ["doc_id", "digest", "n", "node", "check", "slot", "counts"]

    def run(batches):
        counts = np.zeros(COUNTS, dtype=np.int64)
        for batch in _slices(batches):
            sets = [s for _, s in _sets_of(batch, width)]
            if sets:
                np.add.at(counts, (np.concatenate(sets) >> np.uint64(44)).astype(np.int64), 1)
            node, check = _identities(sets, bits)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(n), pa.array(node, mask=n == 0), pa.array(check), *none], names=names)
        if counts.any():
            pieces = [p.astype(np.uint32).tobytes() for p in counts.reshape(SLOTS, -1)]
            none = [pa.nulls(SLOTS, pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(SLOTS, dtype=np.int32)), pa.array(pieces, pa.binary())], names=names)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[slot] = sums.get(slot, 0) + np.frombuffer(piece.as_buffer(), np.uint32).astype(np.int64)
        for slot, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "counts"])

    made = save(_input(docs).mapInArrow(run, "doc_id long, digest long, n long, node long, check long, slot int, counts binary"))
    pieces = made.where("slot is not null").select("slot", "counts").repartition("slot").mapInArrow(add, "slot int, counts binary")
    counts = np.zeros((SLOTS, COUNTS // SLOTS), dtype=np.int64)
    for r in pieces.toLocalIterator():  # the table: 8 MB
        counts[r["slot"]] = np.frombuffer(r["counts"], np.int64)
    usual = float(counts.mean())
    rows = made.where("slot is null").select("doc_id", "digest", "n", "node", "check")
    clashing = clashes(rows, "node", "check")
    return renumbered(rows, clashing, "node", "check"), (counts > usual + 6 * math.sqrt(usual) + 8).ravel(), clashing


def _bitmaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One-bit-per-shingle bitmaps, and how many shingles each lost to shared bits."""
    bits = np.zeros((len(sets), BITS), dtype=np.uint8)
    for r, s in enumerate(sets):
        bits[r, (s % np.uint64(BITS)).astype(np.int64)] = 1
    lost = np.array([len(s) for s in sets]) - bits.sum(1)
    return np.packbits(bits, axis=1).view(np.uint64), lost


def linked_in_tile(node: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links among the pairs (left x right) of a tile."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    maps, lost = _bitmaps(sets)
    root = np.arange(len(sets))
    links = []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(left):
        other = np.flatnonzero(right & (size * 100 >= size[i] * percent) & (size[i] * 100 >= size * percent))
        other = other[other != i]
        if not len(other):
            continue
        # an overlap is at most the common bits and the shingles that share a bit in the smaller of the losses
        bound = np.bitwise_count(maps[other] & maps[i]).sum(1).astype(np.int64) + np.minimum(lost[other], lost[i])
        for j in other[bound * (100 + percent) >= percent * (size[other] + size[i])]:
            a, b = top(i), top(j)
            if a != b and similar(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                links.append((int(node[i]), int(node[j])))
    return links


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text); percent from 1 to 100, where 100 links equal sets only."""
    return _named(_grouped(docs, width, percent, bits))


def _grouped(docs: DataFrame, width: int, percent: int, bits: int = 64) -> DataFrame:
    """(doc_id, digest, n, group) of every row of docs; linked rows share a group, rows without words have none."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    rows, common, clashing = shingle_sets(docs, width, bits)
    if percent == 100:
        return rows.select("doc_id", "digest", "n", F.col("node").alias("group"))
    found = save(rows.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min(F.expr(TELLER)).alias("teller")))
    context = rows.sparkSession.sparkContext
    flags = context.broadcast(common)
    # one document of each set is enough
    tellers = context.broadcast(id_bits(found, F.col("teller"), found.count()))

    clash = clashing is not None
    cells = math.ceil((found.agg(F.sum("n")).first()[0] or 1) / CELL)

    def keys_of(batch):
        sets = [s for _, s in _sets_of(batch, width) if len(s)]
        keys = [part_keys(s, percent, flags.value) for s in sets]
        node, check = (np.repeat(x, [len(k) for k in keys]) for x in _identities(sets, bits))
        return node, check, np.concatenate([*keys, np.zeros(0, np.uint64)])

    def keyed(wanted):
        """(node, key) of all sets, or of those keys only whose tokens may be in a bitmap."""

        def run(batches):
            for batch in _slices(batches):
                node, check, key = keys_of(_telling(batch, tellers.value))
                if wanted is not None:
                    some = maybe_in(wanted.value, _tokens(_cells(key, cells), key))
                    node, check, key = node[some], check[some], key[some]
                yield pa.RecordBatch.from_arrays([pa.array(node), *([pa.array(check)] if clash else []), pa.array(as_long(key))], names=names)

        names = ["node", "check", "key"] if clash else ["node", "key"]
        found = _input(docs).mapInArrow(run, ", ".join(f"{c} long" for c in names))
        return renumbered(found, clashing, "node", "check").select("node", "key")

    if clash:  # sets are renumbered by a join, a row a key
        pairs = save(keyed(None))
    else:
        shared = save(_shared_tokens(_input(docs), lambda batch: keys_of(_telling(batch, tellers.value)), cells))
        wanted = context.broadcast(id_bits(shared, F.col("token"), shared.count()))
        pairs = save(keyed(wanted))
        remove(shared)
    first = save(_shared_keys(pairs, math.ceil(max(pairs.count(), 1) / CELL)))
    star = save(pairs.join(first, "key").where("node <> first").select("node", "first").distinct())
    remove(pairs, first)
    family = connected_components(star, "node", "first").withColumnsRenamed({"component": "family"})

    sizes = family.join(found, "node")
    edge = math.log(100 / percent)
    members = save(sizes.withColumn("band", F.floor(F.log("n") / F.lit(edge) + F.lit(1e-9))))
    links = save(_verify(lambda of: _member_sets(docs, of, width, bits, clashing), members, star, percent))
    group = connected_components(links).withColumnsRenamed({"component": "group"})
    return save(rows.join(group, "node", "left").select("doc_id", "digest", "n", F.coalesce("group", "node").alias("group")))


def _ends(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, with the smallest and the largest node of each."""
    order = np.argsort(key)
    key, node = key[order], node[order]
    cut = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    if not len(cut):
        return key, node, node
    return key[cut], np.minimum.reduceat(node, cut), np.maximum.reduceat(node, cut)


def _cells(key: np.ndarray, cells: int) -> np.ndarray:
    """The ranges that keys lie in."""
    return ((key >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)


def _tokens(cell: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number of a key's range and its last four bytes; few keys share one by chance, which costs work only."""
    return as_long(mix((cell.astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))))


def _packed(key: np.ndarray, node: np.ndarray, cells: int):
    """Batches (cell, keys, nodes) of keys with their smallest and largest node; a row holds those of one range of keys."""
    key, low, high = _ends(key, node)
    more = np.flatnonzero(low != high)
    key, node = np.insert(key, more, key[more]), np.insert(low, more, high[more])
    cell = _cells(key, cells)
    for at in range(0, len(key), PACK):
        here = cell[at : at + PACK].astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
        ends = pa.py_buffer((np.append(cut, len(here)) * 8).astype(np.int32))
        both = [pa.Array.from_buffers(pa.binary(), len(cut), [None, ends, pa.py_buffer(np.ascontiguousarray(x[at : at + PACK]))]) for x in (as_long(key), node)]
        yield pa.RecordBatch.from_arrays([pa.array(here[cut]), *both], names=["cell", "keys", "nodes"])


def _packs(keys: Iterator[tuple[np.ndarray, np.ndarray]], cells: int):
    """`_packed` batches of (key, node) arrays, some PACK keys at a time."""
    held, n = [], 0
    for key, node in keys:
        held.append((key, node))
        n += len(key)
        if n >= PACK:
            yield from _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), cells)
            held, n = [], 0
    if n:
        yield from _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), cells)


def _shared_tokens(texts: DataFrame, keys_of: Callable, cells: int) -> DataFrame:
    """token of the keys that more than one row of texts has; keys_of gives (node, check, key) of a batch of them.

    A row holds the last four bytes of the keys of one range. What other keys share a token with is met as well.
    """

    def pack(batches):
        for packed in _packs(((key, node) for node, _, key in map(keys_of, _slices(batches))), cells):
            ends, data = packed.column(1).buffers()[1:]
            ends, data = np.frombuffer(ends, np.int32) // 2, np.frombuffer(data, np.uint64).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([packed.column(0), pa.Array.from_buffers(pa.binary(), packed.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])], names=["cell", "keys"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        some = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")])).astype(np.uint64)
        again = np.unique(some[1:][some[1:] == some[:-1]])
        return pa.table({"token": pa.array(_tokens(np.full(len(again), key[0].as_py()), again))})

    return texts.mapInArrow(pack, "cell long, keys binary").groupBy("cell").applyInArrow(meet, "token long")


def _shared_keys(pairs: DataFrame, cells: int) -> DataFrame:
    """(key, first) of the keys that more than one node has; pairs: (node, key)."""

    def pack(batches):
        yield from _packs(((b.column(1).to_numpy().view(np.uint64), b.column(0).to_numpy()) for b in batches), cells)

    def meet(table: pa.Table) -> pa.Table:
        key, node = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(c)]) for c in ("keys", "nodes"))
        key, low, high = _ends(key, node)
        return pa.table({"key": pa.array(key[low != high]), "first": pa.array(low[low != high])})

    packed = pairs.select("node", "key").mapInArrow(pack, "cell long, keys binary, nodes binary")
    return packed.groupBy("cell").applyInArrow(meet, "key long, first long")


def _member_sets(docs: DataFrame, members: DataFrame, width: int, bits: int, clashing: DataFrame | None) -> DataFrame:
    """(node, shingles) of members (teller), and of few others.

    One document of each set is enough: a bitmap of them spares a shuffle of all texts.
    """
    wanted = members.sparkSession.sparkContext.broadcast(id_bits(members, F.col("teller"), members.count()))

    def sets_again(batches):
        told: set[tuple[int, int]] = set()  # rows that repeat are told once a task
        for batch in _slices(batches):
            sets = [s for _, s in _sets_of(_telling(batch, wanted.value), width)]
            node, check = _identities(sets, bits)
            keep = []
            for k, both in enumerate(zip(node.tolist(), check.tolist(), strict=True)):
                if both not in told and len(sets[k]):
                    told.add(both)
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(check[keep]), _lists([sets[k] for k in keep])], names=["node", "check", "shingles"])

    found = _input(docs).mapInArrow(sets_again, "node long, check long, shingles array<long>")
    return renumbered(found, clashing, "node", "check").select("node", "shingles")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays link, by exact intersection."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _star_links(sets: DataFrame, members: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of members to the smallest set they share a key with: one comparison a member."""
    pairs = star.join(members.select("node"), "node", "left_semi").groupBy("node").agg(F.min("first").alias("first"))
    mine = pairs.join(sets, "node").withColumnsRenamed({"shingles": "x"})
    both = mine.join(sets.select(F.col("node").alias("first"), F.col("shingles").alias("y")), "first").select("node", "first", "x", "y")

    def check(batches):
        for batch in _slices(batches, 256):
            pairs = zip(_views(batch.column(2)), _views(batch.column(3)), strict=True)
            ok = np.array([similar(x.view(np.uint64), y.view(np.uint64), percent) for x, y in pairs], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long").distinct()


def _settled(placed: DataFrame) -> DataFrame:
    """placed (node, family, band, crowd), in one band where a family has a block at most."""
    placed = save(placed)
    large = save(placed.groupBy("family").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).select("family"))
    return save(placed.join(large, "family", "left_semi").unionByName(placed.join(large, "family", "left_anti").withColumn("band", F.lit(0).cast("long"))))


def _near(members: DataFrame):
    """Rows and blocks of every family, band and crowd; per family and band the blocks that it touches; those of them that a crowd meets."""
    blocks = members.groupBy("family", "band", "crowd").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    entry = F.struct(F.col("band").alias("of"), "crowd", "blocks").alias("near")
    near = blocks.select("family", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), entry)
    near = near.groupBy("family", "band").agg(F.collect_list("near").alias("near"))  # an entry per crowd and touching band
    return blocks, near, F.filter("near", lambda z: (z["crowd"] == 0) | (z["crowd"] != F.col("crowd")))


def _cost(members: DataFrame) -> DataFrame:
    """(family, cost): how many rows its tiles have."""
    blocks, near, met = _near(members)
    each = F.aggregate(met, F.lit(0).cast("long"), lambda n, z: n + z["blocks"])
    return blocks.join(near, ["family", "band"]).groupBy("family").agg(F.sum(F.col("n") * each).alias("cost"))


def _verify(sets_of: Callable[[DataFrame], DataFrame], members: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span the groups of every family; sets_of gives the sets of some members.

    Members of families of more than CROWD tiles' size are first compared with one set each. What is connected then in
    groups of a block and more isn't compared within itself again, only with the rest of its family. Such a family
    then falls into groups, a star's centre and its leaves, where that makes fewer rows: sets that link share a key, so
    they are in the group of that key's smallest set. All else is compared in tiles: a family or group of a block is one, a larger one is cut
    into two blocks a tile whose size bands touch.
    """
    crowded = members.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > CROWD * BLOCK).select("family")
    crowd = save(members.join(crowded, "family", "left_semi"))
    early = None
    all_members = members
    members = members.withColumn("crowd", F.lit(0).cast("long"))
    if not crowd.isEmpty():
        early = save(_star_links(sets_of(crowd), crowd, star, percent))
        groups = connected_components(early)
        large = groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK).select("component")
        of = groups.join(large, "component", "left_semi")
        crowd = save(crowd.join(of, "node", "left").withColumn("crowd", F.coalesce("component", F.lit(0))).drop("component"))
        whole = _settled(crowd.select("node", "family", "band", "crowd"))
        centres = star.select("node", "first").union(star.select(F.col("first").alias("node"), "first").distinct())
        centres = centres.groupBy("node").agg(F.collect_set("first").alias("firsts"))  # some of the node's keys have each
        apart = crowd.withColumnRenamed("family", "home").join(centres, "node")
        apart = _settled(apart.select("node", F.explode("firsts").alias("family"), "band", "crowd", "home"))
        homes = apart.select("family", "home").distinct()
        cheaper = _cost(apart).join(homes, "family").groupBy("home").agg(F.sum("cost").alias("cost")).join(_cost(whole).select(F.col("family").alias("home"), F.col("cost").alias("most")), "home", "right")
        cheaper = save(cheaper.where("coalesce(cost, 0) < most").select("home"))
        apart = apart.join(cheaper, "home", "left_semi").drop("home")
        whole = whole.join(cheaper.withColumnRenamed("home", "family"), "family", "left_anti")
        members = members.join(crowded, "family", "left_anti")
        members = _settled(members.select("node", "family", "band", "crowd")).unionByName(whole).unionByName(apart)
    else:
        members = _settled(members.select("node", "family", "band", "crowd"))

    blocks, near, met = _near(members)
    own = F.concat_ws(":", "band", "crowd", "block")
    them = F.concat_ws(":", "x.of", "x.crowd", "x.i")
    spread = F.flatten(F.transform(met, lambda z: F.transform(F.sequence(F.lit(0).cast("long"), z["blocks"] - 1), lambda i: F.struct(z["of"].alias("of"), z["crowd"].alias("crowd"), i.alias("i")))))
    count = F.element_at(F.filter("near", lambda z: (z["of"] == F.col("band")) & (z["crowd"] == F.col("crowd"))), 1)["blocks"]
    tiled = (
        members.join(near, ["family", "band"])
        .withColumn("block", F.pmod(F.xxhash64("node"), count))
        .withColumn("x", F.explode(spread))
        .select("node", "family", own.alias("own"), F.least(own, them).alias("lo"), F.greatest(own, them).alias("hi"))
    )
    tiles = tiled.select("node", F.xxhash64("family", "lo", "hi").alias("tile"), (F.col("own") == F.col("lo")).alias("is_lo"), (F.col("own") == F.col("hi")).alias("is_hi"))

    def link(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        _, once = np.unique(node, return_index=True)
        table = table.take(pa.array(once))
        shingled = [x.view(np.uint64) for chunk in table.column("shingles").chunks for x in _views(chunk)]
        got = linked_in_tile(node[once], shingled, table.column("is_lo").to_numpy(), table.column("is_hi").to_numpy(), percent)
        return pa.table({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64())})

    links = sets_of(all_members).join(tiles, "node").groupBy("tile").applyInArrow(link, "a long, b long")
    return links if early is None else links.unionByName(early)


def _views(column: pa.ListArray):
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    yield from (values[offsets[r] : offsets[r + 1]] for r in range(len(column)))


def _named(grouped: DataFrame) -> DataFrame:
    """Every row with the smallest doc_id of its group.

    Only groups of several rows need one from elsewhere; the names are written, so that the join reads two plain tables
    and splits a large group.
    """
    names = save(grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("name"), F.count("*").alias("rows")).where("rows > 1").select("group", "name"))
    return grouped.join(names, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each group: that of the smallest doc_id (null last), then of the smallest hash of the text.

    Rows are told apart by doc_id and text, so different texts of one doc_id, or of none, are judged each by its own group.
    Rows without words stay, repeated or not. Only rows that repeat, and few others, are shuffled, repeats combined before: two
    bitmaps tell most rows that go from those that stay where they are read.
    """
    rows = _grouped(docs, width, percent).where("group is not null")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = save(rows.groupBy("group").agg(F.min(place).alias("best"), F.count("*").alias("rows")).where("rows > 1").select("group", "best"))
    texts = rows.groupBy("group", "doc_id", "digest").agg(F.count("*").alias("times"))
    marked = texts.join(best, "group").withColumn("_stays", place == F.col("best"))
    goes, again = (save(marked.where(w).select(F.col("doc_id").alias("_of"), F.col("digest").alias("_text"))) for w in ("not _stays", "_stays and times > 1"))
    context, hashed = docs.sparkSession.sparkContext, F.xxhash64("_of", "_text")
    gone = context.broadcast(id_bits(goes, hashed, goes.count()))
    number, digest = F.col("doc_id").cast("long"), F.xxhash64("text")
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_digest") == F.col("_text"))

    @F.pandas_udf("boolean")
    def maybe_gone(hashed: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(gone.value, hashed.to_numpy()))

    # rows that stay though the first bitmap may hold them, and those that repeat, are in a second one
    told = rows.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).where(maybe_gone(F.xxhash64("_id", "_digest")))
    spared = save(told.join(goes, same, "left_anti").select(F.col("_id").alias("_of"), F.col("_digest").alias("_text")).union(again))
    left = context.broadcast(id_bits(spared, hashed, spared.count()))

    @F.pandas_udf("int")
    def fate(hashed: pd.Series) -> pd.Series:
        """0: stays, the only one of its doc_id and text; 1: goes; 2: to be looked at."""
        return pd.Series(np.where(maybe_in(left.value, hashed.to_numpy()), 2, maybe_in(gone.value, hashed.to_numpy()))).astype("int32")

    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    flagged = docs.withColumn("_fate", F.when(worded, fate(F.xxhash64(number, digest))).otherwise(0))
    content = F.xxhash64(*[f.name for f in docs.schema if "map<" not in f.dataType.simpleString()])
    once = flagged.where("_fate = 2").groupBy(number.alias("_id"), digest.alias("_digest")).agg(F.min_by(F.struct(*docs.columns), content).alias("_row"))
    once = once.join(goes, same, "left_anti").select("_row.*")
    return flagged.where("_fate = 0").drop("_fate").unionByName(once)
