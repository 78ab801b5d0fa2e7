"""Mixing sources to target weights by a low-discrepancy source schedule.

Every source's documents, in a keyed shuffled order, form one endless stream of words (after the
last document the first follows again), cut into blocks of `block` words. Slot i of the mix draws a
low-discrepancy point (golden ratio, or van der Corput), which falls into the source whose share of
the cumulative weights holds it; the slot's rank among its source's slots is the block it takes. So
the points alone decide how many blocks a source gives and where in the mix each lies: every stretch
of the mix has nearly the target shares, and a source's words are off its target by a few blocks.

Targets: `share` times all words, split by weight; no source is taken more than `cap` times, its
excess is shared again by weight among the others. Slots past `cap` times a source's words are
trimmed, so no document is taken more often.

Up to FEW sources get their targets on the driver; more are a table like any other, ranked and given targets by
sums. Either way they are looked up by joins. Running sums and ranks are two-level (sums of hash buckets, slot chunks or ranges, then within
them), so a source with a third of all rows is spread like any other.

Nulls and edges: a null source is a source, after all others; a null or empty text has no words and
is never taken; a very long text spans many blocks; rows that repeat are separate documents, and ties
(equal doc_id and size) are interchangeable; an empty table mixes to an empty table; other columns
pass through whatever their names. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.shared import fresh, save

POINTS = 32  # bits of a point
GOLDEN = 2654435769  # 2^32 / phi, odd: i * GOLDEN mod 2^32 visits every point once
SLOTS = 2**20  # blocks are as large as give about so many slots, MOST_BLOCK words at most
MOST_BLOCK = 65536
UNITS = 1024  # shares are added up in whole parts of a word, so that intervals meet exactly
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
FEW = 10_000  # sources that the driver gives their targets; more are a table throughout


def _running(frame: DataFrame, keys: list[str], chunk: str, order: list, value, name: str) -> DataFrame:
    """The sum of `value` over the rows before each row of its keys, in order of (chunk, order)."""
    whole = frame.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return frame.join(whole, [*keys, chunk]).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """src, source, source_size, target, low, high of every source of sized (source, size).

    src ranks sources by code point, null last; they take the weights in turn. low and high bound the source's
    points. The level at which words are given out per weight rises until no further source reaches its cap.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    few = per.limit(FEW + 1).collect()
    if len(few) <= FEW:
        made = _few_targets([(r["source"], r["source_size"]) for r in few], weights, share, cap)
        return sized.sparkSession.createDataFrame(made, "src long, source string, source_size long, target double, low long, high long")
    per = per.orderBy(F.col("source").asc_nulls_last())
    # a sorted table is numbered by its ranges: rows of the ranges before, then the place within
    per = save(per.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    src = _running(per.withColumn("all", F.lit(0)), ["all"], "range", [F.col("at")], F.lit(1), "src").drop("all", "at")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    ranked = save(src.withColumn("weight", weight))

    words, total_weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, closed = share * words / max(total_weight, 1e-300), -1
    while True:
        full = F.lit(cap) * F.col("source_size") < F.lit(level) * F.col("weight")
        n, given, rest = ranked.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.lit(cap) * F.col("source_size"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == closed or not rest:
            break
        closed, level = n, (share * words - given) / rest
    target = F.least(F.lit(cap) * F.col("source_size"), F.lit(level) * F.col("weight"))

    units = ranked.withColumn("target", target).withColumn("units", F.floor(F.col("target") * UNITS)).withColumn("all", F.lit(0))
    placed = _running(units, ["all"], "range", [F.col("src")], F.col("units"), "begin")
    whole = max(units.agg(F.sum("units")).first()[0] or 0, 1)
    point = lambda x: F.floor(x / F.lit(whole) * F.lit(2.0**POINTS)).cast("long")
    return save(placed.select("src", "source", "source_size", "target", point(F.col("begin")).alias("low"), point(F.col("begin") + F.col("units")).alias("high")))


def _few_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, cap: float) -> list[tuple]:
    """The rows of `source_targets` for at most FEW sources: the same sums in one place."""
    ranked = [(k, s, n, weights[k % len(weights)]) for k, (s, n) in enumerate(sorted(sizes, key=lambda x: (x[0] is None, x[0] or "")))]
    words, open_ = sum(n for _, _, n, _ in ranked), ranked
    level, closed = share * words / max(sum(w for *_, w in ranked), 1e-300), -1
    while True:
        open_ = [r for r in ranked if not cap * r[2] < level * r[3]]
        given, rest = sum(cap * r[2] for r in ranked if cap * r[2] < level * r[3]), sum(r[3] for r in open_)
        if len(ranked) - len(open_) == closed or not rest:
            break
        closed, level = len(ranked) - len(open_), (share * words - given) / rest
    targets = [min(cap * n, level * w) for _, _, n, w in ranked]
    units = [math.floor(t * UNITS) for t in targets]
    whole, begin, out = max(sum(units), 1), 0, []
    point = lambda x: math.floor(float(x) / float(whole) * 2.0**POINTS)
    for (k, s, n, _), target, unit in zip(ranked, targets, units, strict=True):
        out.append((k, s, n, float(target), point(begin), point(begin + unit)))
        begin += unit
    return out


def point_of(slot: Column, points: str) -> Column:
    """The slot's point, a whole number below 2**POINTS."""
    if points == "golden":
        return slot.bitwiseAND(0x7FFFFFFF).cast("long") * F.lit(GOLDEN) % F.lit(2**POINTS)
    if points == "corput":  # the slot's bits in reverse order
        return F.conv(F.reverse(F.lpad(F.bin(slot.bitwiseAND(2**POINTS - 1)), POINTS, F.lit("0"))), 2, 10).cast("long")
    raise ValueError("points are golden or corput")


def draw(sources: DataFrame, n_slots: int, n_sources: int, points: str = "golden") -> DataFrame:
    """slot, src, rank of all slots: whose points they draw, and how many slots their source has before.

    Points find their interval by an equi-join on cells, some four for each source.
    """
    bits = min(30, max(4, (4 * n_sources).bit_length()))
    shift = POINTS - bits
    cell = F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))
    cells = sources.where("high > low").select("src", "low", "high", F.explode(cell).alias("cell"))
    chunk = max(256, math.isqrt(n_slots))
    drawn = sources.sparkSession.range(n_slots).select(F.col("id").alias("slot"), point_of(F.col("id"), points).alias("point"), F.floor(F.col("id") / F.lit(chunk)).alias("chunk"))
    drawn = drawn.withColumn("cell", F.shiftright("point", shift)).join(cells, "cell").where("point >= low and point < high").select("slot", "src", "chunk")
    return _running(save(drawn), ["src"], "chunk", [F.col("slot")], F.lit(1), "rank").select("slot", "src", "rank")


def schedule(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17, block: int | None = None, points: str = "golden", row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, segments) of the mix of docs (doc_id, source, text and, where rows must be told apart, row).

    documents: doc_id (and row), size, src, source_size, target, and begin, the place in its source's stream.
    slots: slot, src, rank, until: the slot takes the words of its block before `until`.
    segments: src, rank, begin, size, epoch, from, to: the part of a document that lies in a block, at its source's epoch-th pass.
    """
    keys = ["doc_id", *([row] if row else [])]
    # sizes are written once: each of the joins below would count all texts' words again
    sized = save(docs.select(*keys, F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")))
    sources = source_targets(sized, weights, share, cap)
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    block = block or min(max(math.ceil(total / SLOTS), 1), MOST_BLOCK)

    buckets = max(1, 2 * math.isqrt(sized.count()))
    keyed = sized.join(sources.drop("low", "high"), sized["source"].eqNullSafe(sources["source"])).select(*keys, "size", "src", "source_size", "target", F.xxhash64(F.lit(seed), "doc_id", "size").alias("_h"))
    keyed = keyed.withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    documents = save(_running(keyed, ["src"], "_bucket", [F.col("_h"), *[F.col(k) for k in keys], F.col("size")], F.col("size"), "begin").drop("_bucket", "_h"))

    limit = F.floor(F.lit(cap) * F.col("source_size")).cast("long")
    slots = draw(sources, round(total / block), n_sources, points).join(sources.select("src", limit.alias("_most")), "src")
    slots = slots.where(F.col("rank") * block < F.col("_most")).select("slot", "src", "rank", F.least((F.col("rank") + 1) * block, "_most").alias("until"))

    passes = documents.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(cap) - 1).cast("long"))))
    start = F.col("epoch") * F.col("source_size") + F.col("begin")
    passes = passes.select("src", "begin", "size", "epoch", start.alias("start"))
    segments = passes.withColumn("rank", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    segments = segments.withColumn("from", F.greatest("start", F.col("rank") * block)).withColumn("to", F.least(F.expr("start + size"), (F.col("rank") + 1) * block)).drop("start")
    return documents, slots, segments


def mixture(docs: DataFrame, row: str | None = None, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (words, repeats counted), copies (passes that take at least half of it) and slots, where in the mix these begin."""
    documents, slots, segments = schedule(docs, row=row, **options)
    words = F.greatest(F.lit(0), F.least("to", "until") - F.col("from"))
    taken = segments.join(slots, ["src", "rank"]).groupBy("src", "begin", "epoch").agg(F.sum(words).alias("words"), F.max("size").alias("size"), F.min("slot").alias("slot"))
    whole = F.when(F.col("words") * 2 >= F.col("size"), F.col("slot"))
    taken = taken.groupBy("src", "begin").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(whole)).alias("slots"))
    some = documents.where("size > 0").join(taken, ["src", "begin"], "left")
    out = some.unionByName(documents.where("size = 0"), allowMissingColumns=True).withColumn("slots", F.coalesce("slots", F.array().cast("array<long>")))
    return out.select("doc_id", *([row] if row else []), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.size("slots").cast("long").alias("copies"), "slots")


def mix(docs: DataFrame, slot: str | None = None, **options) -> DataFrame:
    """docs with every document repeated as often as the schedule takes (at least half of) it; `slot` names a column of where in the mix.

    docs is written once with a number for each row, so that rows are told apart whatever they hold.
    """
    row, at = fresh("_row", docs.columns), fresh("_slots", docs.columns)
    kept = save(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mixture(kept.select("doc_id", "source", "text", F.col(row).alias("_row")), row="_row", **options).where("copies > 0")
    taken = taken.select(F.col("_row").alias(row), F.col("slots").alias(at))
    joined = kept.join(taken, row).withColumn(at, F.explode(at))
    return joined.select(*docs.columns, *([F.col(at).alias(slot)] if slot else []))
