"""Embedding near-duplicates by lattice hashing with E8, verified by cosine.

Equal vectors of a label are one node with a count; a second 64-bit hash finds vectors, and labels, that
share the first only, which get numbers of their own. Every node's unit vector is projected at
random onto BLOCKS x 8 dimensions, in TABLES tables; each 8-dimensional part is decoded to its
nearest E8 lattice point and to the next one, and the PROBES combinations nearest to the
projection become keys. Nodes that share a key meet in a tile, where cosines are computed in
double precision; so no reported link is below the threshold.

A key with more than BLOCK nodes is a crowd. Its nodes are first compared with one other node each;
what these links connect in groups of a block and more is compared within itself once, in tiles of
two blocks, and not again under any key. So a large group of near copies costs one pass over its
pairs, however many keys it shares. All else that meets under keys is counted under the smallest key
that a pair shares, hence once; a key with many nodes becomes several tiles of two blocks each, so no
task holds an unbounded group. A tile returns per node how many vectors it links to, and links that
span its connected nodes, never all pairs.

Nulls and edges: vectors that are null, zero or hold null or non-finite components, and rows
without a label, link with nothing; vectors of different length never link; repeated rows are
linked copies; ties at the threshold link; a null vec_id is never a component's name; an empty table
returns no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.components import clashes, connected_components, renumbered
from orrery.llm.shared import as_long, mix, save
from orrery.llm.vectors import matrix, usable

TABLES, BLOCKS, PROBES = 12, 2, 4
SCALE = 1.25  # of the lattice, in distances of two vectors at the threshold as projected
BLOCK = 512


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest E8 points (doubled, so whole numbers) of rows of 8, and the next nearest of the other coset."""
    found = []
    for shift in (0.0, 0.5):
        y = x - shift
        near = np.rint(y)
        odd = near.sum(1) % 2 != 0
        off = y - near
        worst = np.argmax(np.abs(off), axis=1)
        rows = np.flatnonzero(odd)
        near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1, -1)
        found.append(near + shift)
    far = [((x - p) ** 2).sum(1) for p in found]
    first = (far[0] <= far[1])[:, None]
    return 2 * np.where(first, found[0], found[1]), 2 * np.where(first, found[1], found[0])


def lattice_keys(unit: np.ndarray, label_hash: np.ndarray, cosine: float, tables: int = TABLES, seed: int = 8) -> np.ndarray:
    """(rows x tables * PROBES) 64-bit keys, sorted in each row, 0 repeated where probes coincide."""
    n, dim = unit.shape
    rng = np.random.default_rng(seed)
    wide = 8 * BLOCKS
    distance = np.sqrt(2 * (1 - cosine)) * np.sqrt(8 / max(dim, 8))
    weights = rng.integers(1, 1 << 63, (tables, BLOCKS, 8), dtype=np.uint64)
    keys = np.empty((n, tables * PROBES), dtype=np.uint64)
    for t in range(tables):
        # rows of a random rotation, or of several where the vectors are shorter than the projection
        turn = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-wide // dim))], axis=1)[:, :wide]
        x = unit @ turn / (SCALE * 2 * distance) + rng.random(wide)
        hashes, costs = [], []
        for b in range(BLOCKS):
            part = x[:, 8 * b : 8 * b + 8]
            points = nearest_e8(part)
            hashes.append([(p.astype(np.int64).view(np.uint64) * weights[t, b]).sum(1) for p in points])
            costs.append([((part - p / 2) ** 2).sum(1) for p in points])
        combos = [(i, j) for i in (0, 1) for j in (0, 1)]
        for k, (i, j) in enumerate(combos):
            keys[:, t * PROBES + k] = mix(mix(hashes[0][i] + label_hash) + hashes[1][j] + np.uint64(t + 1))
    return np.sort(keys, axis=1)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows over pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = np.minimum(low, low[low])
        if np.array_equal(low, root):
            return root
        root = low


def tile_links(vectors: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float, keys: np.ndarray | None = None, key: int = 0, crowd: np.ndarray | None = None):
    """(links per row, parent per row or -1) among the pairs left x right.

    With keys, only pairs whose smallest shared key is `key` and that aren't of one crowd (not 0).
    """
    n = len(vectors)
    counts, parent = np.zeros(n, dtype=np.int64), np.full(n, -1)
    unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    close = (unit @ unit.T >= cosine - 1e-9) & ((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]))
    if crowd is not None:
        close &= (crowd[:, None] != crowd[None, :]) | (crowd == 0)[:, None]
    a, b = np.nonzero(np.triu(close, 1))
    linked = []
    for at in range(0, len(a), 20_000):
        i, j = a[at : at + 20_000], b[at : at + 20_000]
        exact = (vectors[i] * vectors[j]).sum(1) / np.sqrt((vectors[i] ** 2).sum(1) * (vectors[j] ** 2).sum(1))
        i, j = i[exact >= cosine], j[exact >= cosine]
        if keys is not None:
            low = np.full(len(i), np.iinfo(np.uint64).max, dtype=np.uint64)
            for k in range(keys.shape[1]):
                mine = keys[i, k]
                low = np.where((keys[j] == mine[:, None]).any(1), np.minimum(low, mine), low)
            i, j = i[low == np.uint64(key)], j[low == np.uint64(key)]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        linked.append((i, j))
    if linked:
        root = connected(n, *(np.concatenate(c) for c in zip(*linked, strict=True)))
        parent = np.where(root < np.arange(n), root, -1)
    return counts, parent


def _found(table: pa.Table, counts: np.ndarray, parent: np.ndarray) -> pa.Table:
    node = table.column("node").to_numpy()
    use = np.flatnonzero((counts > 0) | (parent >= 0))
    return pa.table({"node": node[use], "links": counts[use], "parent": np.where(parent[use] >= 0, node[np.maximum(parent[use], 0)], node[use])})


FOUND = "node long, links long, parent long"


def _crowds(nodes: DataFrame, entries: DataFrame, crowded: DataFrame, cosine: float) -> DataFrame:
    """(node, crowd) of nodes under crowded keys that one link each connects in groups of a block and more."""
    # written, so that the joins below read plain tables and split a large crowd
    first = save(entries.join(crowded.select("key"), "key", "left_semi").groupBy("key").agg(F.min("node").alias("first")))
    pairs = entries.join(first, "key").where("node <> first").groupBy("node").agg(F.min("first").alias("first"))
    mine = pairs.join(nodes.select("node", F.col("embedding").alias("x")), "node")
    both = mine.join(nodes.select(F.col("node").alias("first"), F.col("embedding").alias("y")), "first").select("node", "first", "x", "y")

    def check(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            same = np.asarray(x.value_lengths()) == np.asarray(y.value_lengths())
            batch = batch.filter(pa.array(same))
            x, y = matrix(batch.column(2)), matrix(batch.column(3))
            ok = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= cosine if len(x) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in (0, 1)], names=["a", "b"])

    groups = connected_components(both.mapInArrow(check, "a long, b long"))
    large = groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK)
    return save(groups.join(large, "component").select("node", F.col("component").alias("crowd"), F.ceil(F.col("n") / F.lit(BLOCK)).alias("blocks")))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, bits: int = 64) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept. Fewer than 64 bits make numbers clash, for tests."""
    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    able = usable() & F.col("label").isNotNull()
    number = lambda *of: F.xxhash64(*of) if bits == 64 else F.xxhash64(*of).bitwiseAND((1 << bits) - 1)
    rows = picked.withColumns({"node": F.when(able, number("label", "embedding")), "check": F.when(able, F.xxhash64(F.lit(1), "label", "embedding"))})
    rows = save(rows.withColumns({"check_label": F.xxhash64(F.lit(1), "label"), "label": number("label")}))
    for name, check in (("node", "check"), ("label", "check_label")):
        rows = renumbered(rows, clashes(rows, name, check), name, check)
    nodes = rows.where("node is not null").groupBy("node", "label", "embedding").agg(F.count("*").alias("copies"))

    def hashed(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths())
            for dim in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == dim))
                x = matrix(own.column(2))
                unit = x / np.sqrt((x * x).sum(1))[:, None]
                label = mix(own.column(1).to_numpy().view(np.uint64) + np.uint64(dim))
                for at in range(0, len(x), 4096):
                    keys = lattice_keys(unit[at : at + 4096], label[at : at + 4096], cosine)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(as_long(keys.ravel())))
                    part = own.slice(at, 4096)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), lists], names=["node", "embedding", "copies", "keys"])

    nodes = nodes.select("node", "label", "embedding", "copies")
    nodes = save(nodes.mapInArrow(hashed, "node long, embedding array<double>, copies long, keys array<long>"))
    entries = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = save(shared)
    entries = save(entries.join(shared.select("key"), "key"))
    crowded = shared.where(F.col("n") > BLOCK)
    found = []
    placed = entries.withColumn("crowd", F.lit(0).cast("long"))
    if not crowded.isEmpty():
        crowds = _crowds(nodes, entries, crowded, cosine)
        placed = entries.join(crowds.select("node", "crowd"), "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0)))
        tiled = _tiles(crowds.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("others", F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

        def within(table: pa.Table) -> pa.Table:
            own = table.column("own").to_numpy()
            sides = (own == table.column(c)[0].as_py() for c in ("lo", "hi"))
            return _found(table, *tile_links(matrix(table.column("embedding")), table.column("copies").to_numpy(), *sides, cosine))

        tiles = tiled.select("node", "crowd", "own", "lo", "hi").join(nodes.select("node", "embedding", "copies"), "node")
        found.append(tiles.groupBy("crowd", "lo", "hi").applyInArrow(within, FOUND))

    # under a key: blocks of each crowd and of all other nodes; a crowd's blocks don't meet each other
    placed = save(placed)
    sizes = placed.groupBy("key", "crowd").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    met = sizes.groupBy("key").agg(F.collect_list(F.struct("crowd", "blocks")).alias("crowds")).where("size(crowds) > 1 or crowds[0].crowd = 0")
    met = save(met)
    spread = lambda z: F.transform(F.sequence(F.lit(0).cast("long"), z["blocks"] - 1), lambda i: F.concat_ws(":", z["crowd"], i))
    others = F.flatten(F.transform(F.filter("crowds", lambda z: (z["crowd"] == 0) | (z["crowd"] != F.col("crowd"))), spread))
    count = F.element_at(F.filter("crowds", lambda z: z["crowd"] == F.col("crowd")), 1)["blocks"]
    own = F.concat_ws(":", "crowd", F.pmod(F.xxhash64("node", "key"), count))
    tiles = _tiles(placed.join(met, "key").withColumn("own", own).withColumn("others", others)).select("node", "key", "crowd", "own", "lo", "hi").join(nodes, "node")

    def link(table: pa.Table) -> pa.Table:
        own = np.array(table.column("own").to_pylist(), dtype=object)
        left, right = (own == table.column(c)[0].as_py() for c in ("lo", "hi"))
        keys, key = matrix(table.column("keys"), np.int64).view(np.uint64), int(table.column("key")[0].as_py()) & 0xFFFFFFFFFFFFFFFF
        return _found(table, *tile_links(matrix(table.column("embedding")), table.column("copies").to_numpy(), left, right, cosine, keys, key, table.column("crowd").to_numpy()))

    found.append(tiles.groupBy("key", "lo", "hi").applyInArrow(link, FOUND))
    found = save(found[0] if len(found) == 1 else found[0].unionByName(found[1]))
    group = connected_components(found.where("node <> parent"), "node", "parent").withColumnsRenamed({"component": "group"})
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies").join(links, "node", "left").join(group, "node", "left")
    known = save(known.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("group", "node").alias("group")))
    grouped = save(rows.select("vec_id", "node").join(known, "node", "left"))
    # only groups of several rows need a name from elsewhere; written, so that the join splits a large group
    names = save(grouped.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("name"), F.count("*").alias("n")).where("n > 1").select("group", "name"))
    out = grouped.join(names, "group", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("name", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _tiles(placed: DataFrame) -> DataFrame:
    """A row for each tile of a node's block `own` and one of `others`, as lo and hi."""
    met = placed.withColumn("other", F.explode("others")).drop("others")
    return met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")
