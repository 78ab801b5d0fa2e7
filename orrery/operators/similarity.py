"""Exact vector search and fingerprints (V1-V3, V7)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalars import clamp_score, dot, norm
from orrery.sources.scratch import save

#: What rounding may add to a distance of matrix products, in lengths of the vectors, and to a score: bounds are wider by both.
SLACK, ALIKE = 1e-6, 2e-9


ROWS_OF_BLOCK = 20_000


def blocked_pairs(queries: DataFrame, rows: DataFrame, blocks: int | None = None) -> DataFrame:
    """A stated set of queries against all rows: rows are dealt into blocks, each query goes to every block once.

    An equi-join on the block, so work is spread by blocks and nothing is broadcast. There are as many blocks as keep
    one at ROWS_OF_BLOCK rows, 32 at least.
    """
    blocks = blocks or max(32, -(-rows.count() // ROWS_OF_BLOCK))
    sent = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return sent.join(rows.withColumn("_block", F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(blocks)).cast("int")), "_block").drop("_block")


#: Rows of a cell's block, cells' centres at most, and queries that meet a block at once.
CELL_ROWS, CENTRES, QUERY_ROWS = 4096, 512, 1024


def _packed(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, ids and vectors of blocks of some `size` rows: numbers of a row's key are dealt into blocks by hash."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(size)).alias("_blocks"))
    dealt = rows.join(counts, keys).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"]).astype(float)
        return pd.DataFrame({k: [v] for k, v in zip(keys, key, strict=False)} | {"ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "radius": [float(pdf["far"].max())]})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.groupBy(*keys, "_block").applyInPandas(pack, f"{kinds}, ids binary, vectors binary, radius double").withColumn("block", F.monotonically_increasing_id())


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _wider(far: np.ndarray, measure: str) -> np.ndarray:
    """The distance of a score that rounding can't tell from that of `far`."""
    if measure == "cosine":
        return np.sqrt(far * far + 2 * ALIKE)
    score = 1 / (1 + far * far) - ALIKE
    return np.where(score > 0, np.sqrt(np.maximum(1 / np.where(score > 0, score, 1) - 1, 0)), np.inf)


def _longest(*sets: np.ndarray) -> float:
    return sum(float(np.sqrt((x * x).sum(1).max())) for x in sets if len(x))


def nearest(vectors: DataFrame, is_query: Column, k: int, measure: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """V1, V2: exact k nearest of each query, itself left out; ties (to 9 digits) go to the smaller id.

    euclid: score 1 / (1 + d^2); cosine: dot product of unit vectors, zero vectors left out.

    Rows lie in cells around sampled centres, packed as matrices. Queries first meet their own cell; the k-th distance found there
    bounds what else can count, and by the triangle inequality a cell that lies further away, centre less radius, isn't looked at.
    Vectors that are null or hold a null or non-finite number take no part; a width of its own is a space of its own.
    """
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    base = base.where(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    if measure == "cosine":
        base = base.withColumn("_n", norm("v")).where("_n > 0").withColumn("v", F.transform("v", lambda x: x / F.col("_n"))).drop("_n")
    base = save(base.withColumn("width", F.size("v")))
    context, found = base.sparkSession.sparkContext, []
    for row in base.groupBy("width").agg(F.count("*").alias("n")).toLocalIterator():  # few widths; usually one
        found.append(_nearest_of_width(base.where(F.col("width") == row["width"]), row["n"], k, measure, context))
    if not found:
        return base.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("place")).limit(0)
    scored = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "id", "score", "place")


def _nearest_of_width(base: DataFrame, n: int, k: int, measure: str, context) -> DataFrame:
    """(query_id, id, far, score) of at least the k nearest of each query, as pairs of packed blocks that the triangle inequality leaves."""
    wanted = max(1, min(CENTRES, int(np.sqrt(n) / 2)))
    centres = np.array([r["v"] for r in base.orderBy(F.xxhash64("id")).limit(wanted).collect()])  # CENTRES vectors at most
    held = context.broadcast(centres)

    def place(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            far = _far(x, held.value) if len(x) else np.zeros((0, 1))
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(cell.astype(np.int64)), pa.array(np.take_along_axis(far, cell[:, None], 1)[:, 0])], names=["id", "v", "asks", "cell", "far"])

    placed = save(base.select("id", "v", "asks").mapInArrow(place, "id long, v array<double>, asks boolean, cell long, far double"))
    blocks = save(_packed(placed, ["cell"], CELL_ROWS))
    queries = save(_packed(placed.where("asks"), ["cell"], QUERY_ROWS).select("cell", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")))

    def score(batches):
        """The k nearest of every query in a block, and those as near as the k-th to rounding; only within each query's bound."""
        for batch in batches:
            for row in (batch.slice(r, 1).to_pylist()[0] for r in range(batch.num_rows)):
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                x, q = np.frombuffer(row["vectors"]).reshape(len(ids), -1), np.frombuffer(row["queries"]).reshape(len(query_ids), -1)
                far = _far(q, x)
                far[query_ids[:, None] == ids[None, :]] = np.inf
                slack = SLACK * _longest(q, x)
                if row.get("bounds") is not None:
                    far[far > np.frombuffer(row["bounds"])[:, None] + slack] = np.inf
                kth = np.partition(far, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                a, b = np.nonzero((far <= _wider(kth + slack, measure)[:, None] + slack) & np.isfinite(far))
                exact = np.sqrt(((q[a] - x[b]) ** 2).sum(1))
                like = (q[a] * x[b]).sum(1) if measure == "cosine" else 1 / (1 + exact * exact)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[a]), pa.array(ids[b]), pa.array(exact), pa.array(like)], names=["query_id", "id", "far", "score"])

    kind = "query_id long, id long, far double, score double"
    own = save(queries.join(blocks.hint("merge"), "cell").mapInArrow(score, kind))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "id"))
    bound = own.withColumn("nth", nth).where(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("far").alias("bound"))
    cells = blocks.groupBy("cell").agg(F.max("radius").alias("radius")).toPandas()  # a row a centre
    reach = context.broadcast((cells["cell"].to_numpy(), cells["radius"].to_numpy(), centres))
    asked = placed.where("asks").join(bound, "id", "left").select("id", "v", F.col("cell").alias("own"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def send(batches):
        """Each query to the cells other than its own that may hold something nearer than its bound."""
        for batch in batches:
            cells, radius, centres = reach.value
            q = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            own, bound = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            if len(q):
                bound, slack = _wider(bound, measure), SLACK * (_longest(q, centres) + float(radius.max()))
                a, b = np.nonzero((_far(q, centres[cells]) - radius[None, :] <= bound[:, None] + slack) & (cells[None, :] != own[:, None]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a)), batch.column(1).take(pa.array(a)), pa.array(cells[b]), pa.array(bound[a])], names=["id", "v", "cell", "far"])

    sent = save(asked.mapInArrow(send, "id long, v array<double>, cell long, far double"))

    def bounded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [key[0]], "query_ids": [pdf["id"].to_numpy(np.int64).tobytes()], "queries": [np.stack(pdf["v"]).astype(float).tobytes()], "bounds": [pdf["far"].to_numpy(float).tobytes()]})

    counts = sent.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).alias("_blocks"))
    packs = sent.join(counts, "cell").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks"))).groupBy("cell", "_block").applyInPandas(bounded, "cell long, query_ids binary, queries binary, bounds binary")
    others = packs.join(blocks.hint("merge"), "cell").mapInArrow(score, kind)  # packs look small to the planner, which would broadcast all queries
    return own.unionByName(others)


def fingerprints(scores: DataFrame, axes: list[str]) -> DataFrame:
    """Each work's vector in the order of the axes: complete ones only, judged before predicted.

    scores: work, axis, value, judged, version. The latest score per (work, axis, judged) counts.
    """
    latest = scores.groupBy("work", "judged", "axis").agg(F.max_by("value", "version").alias("value"))
    latest = latest.where(F.col("axis").isin(axes) & F.col("value").isNotNull())
    place = F.array_position(F.array(*[F.lit(a) for a in axes]), F.col("axis"))
    whole = latest.groupBy("work", "judged").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "value"))).alias("parts")).where(F.size("parts") == len(axes))
    picked = whole.groupBy("work").agg(F.max_by(F.struct("judged", "parts"), "judged").alias("best"))
    return picked.select("work", F.col("best.judged").alias("judged"), F.transform("best.parts", lambda p: p["value"]).alias("fingerprint"))


def predict(vectors: DataFrame, weights: DataFrame, vector: str = "embedding", max_axes: int = 1000) -> DataFrame:
    """V7: vectors (any columns) x weights (axis, intercept, coef), clamped to the scale.

    Weights are a row per axis, few by nature: up to max_axes of them are broadcast, more meet the vectors in blocks.
    """
    if weights.limit(max_axes + 1).count() <= max_axes:
        met = vectors.crossJoin(F.broadcast(weights))
    else:
        met = blocked_pairs(vectors, weights)
    return met.withColumn("prediction", clamp_score(F.col("intercept") + dot(vector, "coef"))).drop("intercept", "coef")
