"""Sorting, pages, facets and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.scratch import save

#: Windows past this are refused, as are longer lists of ids.
DEEPEST, MOST_IDS = 10_000, 2_000


def nulls_last(criteria: list[tuple[str, bool]], tiebreak: str) -> list[Column]:
    """O1, O2: (column, descending) criteria with nulls last either way, then the tiebreak."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in criteria]
    last = criteria[0][1] if criteria else False
    return [*order, F.col(tiebreak).desc() if last else F.col(tiebreak).asc()]


def page(frame: DataFrame, criteria: list[tuple[str, bool]], tiebreak: str, offset: int, size: int) -> DataFrame:
    """One page in a total order (a distributed top-k), with the rank of each row."""
    if offset + size > DEEPEST:
        raise ValueError(f"pages end at {DEEPEST} rows")
    top = frame.orderBy(*nulls_last(criteria, tiebreak)).limit(offset + size)
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(*nulls_last(criteria, tiebreak))))
    return ranked.where(F.col("position") > offset)


def with_total(rows: DataFrame, frame: DataFrame, name: str = "total") -> DataFrame:
    """Rows with the number of all rows of `frame`, counted once."""
    return rows.crossJoin(F.broadcast(frame.agg(F.count("*").alias(name))))


def hydrate(frame: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """The rows of these ids in the order of the list."""
    if len(ids) > MOST_IDS:
        raise ValueError(f"at most {MOST_IDS} ids")
    wanted = frame.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], f"position int, {key} long")
    return frame.join(F.broadcast(wanted), key)


def facets(frame: DataFrame, column: str, array: bool = False) -> DataFrame:
    """Values with their number of rows, most frequent first, then by name."""
    value = F.explode(column).alias("value") if array else F.col(column).alias("value")
    return frame.select(value).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def keyed_rank(frame: DataFrame, keys: list[str], order: list[Column], name: str = "_i", count: str = "_n") -> DataFrame:
    """frame with each row's place (from 0) in its key's order, and the key's number of rows.

    Rows are sorted into ranges by key and order; a key's rows of the ranges before are added up, so a key with a third of all
    rows is spread over ranges instead of one window.
    """
    ranged = save(frame.orderBy(*keys, *order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    own = Window.partitionBy(*keys)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_m"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_m").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), "_first", before.alias("_before"), F.sum("_m").over(own).alias(count))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return ranged.join(known, same).select(*frame.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name), count)


def buckets_by_position(frame: DataFrame, keys: list[str], order: list[Column], count: int, name: str = "bucket") -> DataFrame:
    """Equal slices by position, the last takes the remainder (not ntile's rule)."""
    size = F.expr(f"cast(floor(_n / {count}) as int)")
    slice_ = F.when(size == 0, F.lit(count)).otherwise(F.least(F.lit(count), F.floor(F.col("_i") / size) + 1))
    return keyed_rank(frame, keys, order).withColumn(name, slice_.cast("int")).drop("_n", "_i")


def evenly_spaced(frame: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """K rows of each key spread over its order, first and last kept; halves round to even."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(k - 1), 0).cast("long"))
    return keyed_rank(frame, keys, order).where((F.col("_n") <= k) | F.array_contains(picked, F.col("_i"))).drop("_n", "_i")


def stride_sample(frame: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Every (n div k)-th row of each key's order, k at most."""
    step = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    return keyed_rank(frame, keys, order).where((F.col("_i") % step == 0) & (F.col("_i") / step < k)).drop("_n", "_i")


def global_rank(frame: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """frame with each row's place (from 0) in a total order: rows of the ranges before its own, then the place within."""
    ranged = save(frame.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def decile_sample(frame: DataFrame, order: list[Column], k: int) -> DataFrame:
    """K rows of each tenth of an order, an even stride apart; tenths are equal, what is left over is dropped."""
    ranked = global_rank(frame, order, "_i")
    size = ranked.count() // 10
    step = max(1, size // k)
    at = F.col("_i") % F.lit(max(size, 1))
    picked = ranked.where((F.col("_i") < 10 * size) & (at % step == 0) & (at / step < k))
    return picked.withColumn("decile", (F.expr(f"_i div {max(size, 1)}") + 1).cast("int")).drop("_i")


def top_per_key(frame: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "nth") -> DataFrame:
    """Each key's first k rows."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
