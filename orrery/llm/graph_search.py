"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Rows are dealt into shards of about SHARD rows (fewer, if NUMBERS numbers are fewer rows) by a hash. In a shard, equal vectors are one
node. A graph is built from random edges in two passes: for batches of nodes a greedy search
proposes neighbours, relaxed distance pruning (drop what is nearer, times alpha, to a neighbour
already chosen than to the node) keeps diverse edges, and reverse edges are added and pruned.
For inner products a component is appended that gives all vectors of the shard equal norms.
Each shard's graph is one row of the index table; all rows of the input are in it.

Queries go in blocks to every shard of their dimension: one group of a task is one shard and one
block. Beam search advances a block's queries together; what it meets is scored in double precision
on the original vectors, and the best of all shards are merged. A shard of fewer nodes than a few
beams (4 * BEAM) is scanned, which gives the same answer exactly. Every query visits every shard, so
the work is in proportion to queries times rows / SHARD; vectors without clusters leave nothing to
route queries by.

Nulls and edges: vectors that are null, zero or hold null or non-finite components, and rows
without an id, take no part; ties go to the smaller id; equal vectors of different ids each count as
candidates, repeated rows once; an id with several vectors is a candidate with each, and queries with
the least of them (as arrays compare); only vectors of a query's length are candidates; an empty
table returns no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.shared import save
from orrery.llm.vectors import matrix, usable

SHARD, DEGREE, BEAM, ALPHA, WIDTH = 16384, 32, 96, 1.2, 4
NUMBERS = 1 << 22  # of a shard's vectors, or a block of queries', on average: wide vectors make smaller ones
QUERY_BLOCK, AT_ONCE = 16384, 1024


def _distances(x: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances from to[b] to x[ids[b, c]]."""
    d = x[ids] - to[:, None, :]
    return np.einsum("bcd,bcd->bc", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of each query's beam, nearest first; -1 where it isn't full. All queries advance together.

    Queries whose beam is done leave; a node met twice in one step counts where it was written last.
    """
    q, n = len(queries), len(x)
    out_ids, out_far = np.full((q, beam), -1), np.full((q, beam), np.inf, dtype=x.dtype)
    ids = np.full((q, beam), -1)
    far = np.full((q, beam), np.inf, dtype=x.dtype)
    done = np.ones((q, beam), dtype=bool)
    ids[:, 0], done[:, 0] = start, False
    far[:, 0] = ((x[start] - queries) ** 2).sum(1)
    seen = np.zeros((q, n), dtype=np.uint16)  # the place in its step at which a node was met, from 1
    seen[:, start] = 1
    who = np.arange(q)
    while len(who):
        waiting = np.where(done, np.inf, far)
        pick = np.argpartition(waiting, WIDTH - 1, axis=1)[:, :WIDTH]
        open_ = ~np.take_along_axis(done, pick, 1)
        np.put_along_axis(done, pick, True, 1)
        next_ = graph[np.where(open_, np.take_along_axis(ids, pick, 1), start)].reshape(len(who), -1)
        row, col = np.nonzero(np.repeat(open_, graph.shape[1], axis=1) & (next_ >= 0))
        node = next_[row, col]
        fresh = seen[who[row], node] == 0
        row, node = row[fresh], node[fresh]
        place = (np.arange(len(row)) % 65535 + 1).astype(np.uint16)
        seen[who[row], node] = place
        once = seen[who[row], node] == place
        row, node = row[once], node[once]
        if len(row):
            d = x[node] - queries[who[row]]
            d = np.einsum("cd,cd->c", d, d)
            many = np.bincount(row, minlength=len(who))
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            wide = int(many.max())
            new_far = np.full((len(who), wide), np.inf, dtype=x.dtype)
            new_ids = np.full((len(who), wide), -1)
            new_far[row, at], new_ids[row, at] = d, node
            all_far = np.concatenate((far, new_far), 1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far = np.take_along_axis(all_far, best, 1)
            ids = np.take_along_axis(np.concatenate((ids, new_ids), 1), best, 1)
            done = np.take_along_axis(np.concatenate((done, new_ids < 0), 1), best, 1)
        over = done.all(1)
        if over.any():
            out_ids[who[over]], out_far[who[over]] = ids[over], far[over]
            who, ids, far, done = who[~over], ids[~over], far[~over], done[~over]
    order = np.argsort(out_far, axis=1, kind="stable")
    return np.take_along_axis(out_ids, order, 1), np.take_along_axis(out_far, order, 1)


def robust_prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges (-1: none) of nodes `of` from candidate ids (-1: none)."""
    if len(of) > 512:
        return np.concatenate([robust_prune(x, of[at : at + 512], candidates[at : at + 512], degree, alpha) for at in range(0, len(of), 512)])
    ok = (candidates >= 0) & (candidates != of[:, None])
    safe = np.where(ok, candidates, 0)
    near = np.where(ok, _distances(x, safe, x[of]), np.inf)
    order = np.argsort(near, axis=1, kind="stable")
    safe, near = np.take_along_axis(safe, order, 1), np.take_along_axis(near, order, 1)
    near[:, 1:][safe[:, 1:] == safe[:, :-1]] = np.inf
    held = x[safe]
    size = np.einsum("bcd,bcd->bc", held, held)
    between = size[:, :, None] + size[:, None, :] - 2 * (held @ held.transpose(0, 2, 1))  # squared distances of the candidates
    out = np.full((len(of), degree), -1)
    live = np.isfinite(near)
    rows = np.arange(len(of))
    for k in range(degree):
        have = live.any(1)
        if not have.any():
            break
        at = np.argmax(live, axis=1)
        out[have, k] = safe[rows, at][have]
        live &= ~((alpha * alpha) * between[rows, at] <= near)
        live[rows, at] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = 64, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """(out-edges, start node) over the rows of x."""
    n = len(x)
    rng = np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, min(degree, 16)))
    graph = np.concatenate((graph, np.full((n, degree - graph.shape[1]), -1)), 1)
    start = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    for slack in (1.0, alpha):
        order = rng.permutation(n)
        for batch in np.array_split(order, max(1, n // 512)):
            found, _ = beam_search(x, graph, start, x[batch], beam)
            graph[batch] = robust_prune(x, batch, np.concatenate((found, graph[batch]), 1), degree, slack)
            source, target = np.repeat(batch, degree), graph[batch].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            touched, first, many = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, many)
            incoming = np.full((len(touched), min(int(many.max()), 2 * degree)), -1)
            use = place < incoming.shape[1]
            incoming[np.repeat(np.arange(len(touched)), many)[use], place[use]] = source[use]
            both = np.concatenate((graph[touched], incoming), 1)
            crowded = (both >= 0).sum(1) > degree
            loose = np.flatnonzero(~crowded)
            packed = np.take_along_axis(both[loose], np.argsort(both[loose] < 0, axis=1, kind="stable"), 1)[:, :degree]
            graph[touched[loose]] = packed
            graph[touched[crowded]] = robust_prune(x, touched[crowded], both[crowded], degree, slack)
    return graph.astype(np.int32), start


def _lifted(x: np.ndarray) -> np.ndarray:
    """Vectors of norm one whose nearest neighbours have the largest inner products; scaled first, so that no square overflows."""
    x = x / np.abs(x).max()
    x = x / np.sqrt((x * x).sum(1).max())
    rest = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
    return np.concatenate((x, rest[:, None]), 1).astype(np.float32)


def build_index(vectors: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The index table, a row for each shard, and the number of shards."""
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # a repeated row would take several of a query's places; repeats are combined before the shuffle
    rows = save(rows.distinct()).withColumn("embedding", F.col("embedding").cast("array<double>"))
    n, numbers = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()
    shards = max(1, math.ceil(n / shard), math.ceil(numbers / NUMBERS))
    rows = rows.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids, x = table.column("vec_id").to_numpy(), matrix(table.column("embedding"))
        distinct, back = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, back.ravel()))
        graph, start = build_graph(_lifted(distinct)) if len(distinct) > 4 * BEAM else (np.zeros((0, DEGREE), np.int32), 0)
        cells = {"dim": table.column("dim")[0].as_py(), "shard": table.column("shard")[0].as_py(), "start": start}
        packed = {"ids": ids[order], "copies": np.bincount(back.ravel()).astype(np.int64), "vectors": distinct, "graph": graph}
        return pa.table({k: pa.array([v], pa.int64() if k == "start" else pa.int32()) for k, v in cells.items()} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()})

    return save(rows.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, start long, ids binary, copies binary, vectors binary, graph binary")), shards


def search_shard(row: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vector ids, scores): the k best of one shard for each query, itself left out."""
    dim = row["dim"]
    x = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
    ids, copies = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64)
    graph = np.frombuffer(row["graph"], np.int32).reshape(-1, DEGREE)
    first = np.cumsum(copies) - copies
    out = []
    found = None
    if len(graph):
        lifted = _lifted(x)
        aim = queries / np.abs(queries).max(1, keepdims=True)  # a query's length doesn't change its order of inner products
        aim = np.concatenate((aim / np.sqrt((aim * aim).sum(1, keepdims=True)), np.zeros((len(aim), 1))), 1).astype(np.float32)
        found = np.concatenate([beam_search(lifted, graph, row["start"], aim[part : part + AT_ONCE], max(beam, k + 1))[0] for part in range(0, len(aim), AT_ONCE)])
    for at, q in enumerate(queries):
        nodes = found[at][found[at] >= 0] if found is not None else np.arange(len(x))
        scores = (x[nodes] * q).sum(1)
        best = np.argsort(-scores, kind="stable")
        best = best[scores[best] >= scores[best[min(k, len(best) - 1)]]]  # whoever ties with the last stays
        many = np.minimum(copies[nodes[best]], k + 1)
        vec = ids[np.arange(many.sum()) + np.repeat(first[nodes[best]] - (np.cumsum(many) - many), many)]
        score = np.repeat(scores[best], many)
        other = vec != query_ids[at]
        vec, score = vec[other], score[other]
        top = np.lexsort((vec, -score))[:k]
        out.append((np.full(len(top), query_ids[at]), vec[top], score[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product among all other rows of vectors (vec_id, embedding)."""
    index, shards = build_index(vectors, shard)
    queries = vectors.where(usable() & F.col("vec_id").isNotNull() & is_query).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = save(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    n, numbers = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / QUERY_BLOCK), math.ceil(numbers / NUMBERS))
    queries = queries.withColumn("dim", F.size("embedding")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        cells = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("dim", "block")}
        packed = {"query_ids": table.column("vec_id").to_numpy().tobytes(), "queries": matrix(table.column("embedding")).tobytes()}
        return pa.table(cells | {c: pa.array([v], pa.binary()) for c, v in packed.items()})

    packed = queries.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, query_ids binary, queries binary")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = ("dim", "shard", "block")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ("query_id", "vec_id", "score"), (pa.int64(), pa.int64(), pa.float64())
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        sent = right.to_pylist()[0]
        ids = np.frombuffer(sent["query_ids"], np.int64)
        got = search_shard(left.to_pylist()[0], ids, np.frombuffer(sent["queries"], np.float64).reshape(len(ids), -1), k, beam)
        return pa.table({n: pa.array(g, t) for n, g, t in zip(names, got, kinds, strict=True)})

    shards_of = index.withColumn("block", every(blocks)).groupBy(*met)
    found = shards_of.cogroup(packed.withColumn("shard", every(shards)).groupBy(*met)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
