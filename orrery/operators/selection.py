"""Exact medians and quantiles of groups of any size, without sorting them.

A group's values are counted in BINS bins between its least and its greatest, the bin that holds the wanted
place is kept, and cut into BINS bins again: each pass is one aggregation, combined before the shuffle, of at most BINS
rows a key and place. After PASSES passes the bin's different values are few; they are counted, and the one at the place is
taken. Bins are even on a scale that grows with the logarithm, so values of any magnitude are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.scratch import save

BINS, PASSES = 4096, 3


def _scale(value: Column) -> Column:
    """A finite number that grows with the value; only infinite values share one with others, at the ends."""
    return F.signum(value) * F.least(F.log1p(F.abs(value)), F.lit(1000.0))


def at_places(frame: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """keys, n and for each name the value at that place (from 0) of the key's values in order; places are columns of n, the key's rows with a value.

    Null and NaN values don't count; a place outside gives null; infinite values are kept in their order.
    """
    kept = frame.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).alias("_v"), _scale(F.col(value).cast("double")).alias("_g"))
    groups = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_g").alias("_lo"), F.max("_g").alias("_hi"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), at.cast("long").alias("_at")) for name, at in places.items()])).alias("_p")
    # a row a key and place: the interval that holds it, and how many values lie before the interval
    wanted = save(groups.select(*keys, "n", asked, F.col("_lo"), F.col("_hi"), F.lit(0).cast("long").alias("_before")).select(*keys, "n", "_p.*", "_lo", "_hi", "_before"))
    for _ in range(PASSES):
        wanted = save(_narrowed(kept, wanted, keys))
    same = _same(keys)
    inside = kept.join(_named(wanted, keys), same & (F.col("_g") >= F.col("_lo")) & (F.col("_g") <= F.col("_hi")))
    counted = inside.groupBy(*keys, "_name", "_at", "_before", "_v").agg(F.count("*").alias("_m"))
    upto = F.col("_before") + F.sum("_m").over(Window.partitionBy(*keys, "_name").orderBy("_v"))
    found = counted.withColumn("_upto", upto).where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_m") <= F.col("_at"))).select(*keys, "_name", "_v")
    told = found.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])
    return groups.select(*keys, "n").join(told, same, "left").select(*keys, "n", *places)


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out


def _named(wanted: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_name", "_at", "_lo", "_hi", "_before")


def _narrowed(kept: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals cut to the bin that holds their place; one of a single point stays."""
    span = F.col("_hi") - F.col("_lo")
    bin_ = F.when(span > 0, F.least(F.floor((F.col("_g") - F.col("_lo")) / span * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
    inside = kept.join(_named(wanted, keys), _same(keys) & (F.col("_g") >= F.col("_lo")) & (F.col("_g") <= F.col("_hi")))
    binned = inside.groupBy(*keys, "_name", "_at", "_before", bin_.alias("_bin")).agg(F.count("*").alias("_m"), F.min("_g").alias("_least"), F.max("_g").alias("_most"))
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_name").orderBy("_bin"))
    placed = binned.withColumn("_upto", F.col("_before") + upto)
    hit = placed.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_m") <= F.col("_at")))
    return hit.select(*keys, F.lit(None).cast("long").alias("n"), "_name", "_at", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_upto") - F.col("_m")).alias("_before"))


def median(frame: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Keys and the median of each: the middle value, or the mean of the two middle ones."""
    found = at_places(frame, keys, value, {"_low": F.expr("(n - 1) div 2"), "_high": F.expr("n div 2")})
    return found.select(*keys, ((F.col("_low").cast("double") + F.col("_high").cast("double")) / 2).alias(name))
