"""Keyed history: latest versions, previous versions, upserts, preferred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.scratch import save


def latest_per_key(frame: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """Each key's row with the greatest `order`, as one aggregation (combined before the shuffle).

    A maximum of structs needs no sort and no window, and a frequent key is one row per task.
    """
    rest = columns or [c for c in frame.columns if c not in keys]
    picked = frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_per_key(frame: DataFrame, keys: list[str], order: list[Column], name: str = "_nth") -> DataFrame:
    """Each key's first row in an order that needs nulls placed or directions mixed."""
    ranked = frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) == 1).drop(name)


def language_rank(lang: str, preferred: list[str]) -> Column:
    """Place in the list of preference; after all others when absent."""
    place = F.array_position(F.array(*[F.lit(x) for x in preferred]), F.col(lang))
    return F.when(place > 0, place).otherwise(F.lit(len(preferred) + 1))


#: Rows of one key that a task may order by itself.
MOST_OF_A_KEY = 1_000_000


def previous_version(frame: DataFrame, keys: list[str], order: list[str], columns: list[str], most: int = MOST_OF_A_KEY) -> DataFrame:
    """Every row with its key's row before it, as columns prev_<name>.

    One window, as long as no key has more than `most` rows (which is counted first). Else rows are sorted into ranges by key and order, and each looks back within its range; a range's first row gets the last one of the
    range before, if it is of its key. So a key with a third of all rows is spread over ranges like any others.
    """
    if frame.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).isEmpty():
        window = Window.partitionBy(*keys).orderBy(*order)
        return frame.select("*", *[F.lag(c).over(window).alias(f"prev_{c}") for c in columns])
    ranged = save(frame.orderBy(*keys, *order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    told = F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], *[F.col(c).alias(f"c{n}") for n, c in enumerate(columns)])
    last = ranged.groupBy("_range").agg(F.max_by(told, "_at").alias("_last"))  # a row a range
    before = last.select(F.col("_range").alias("_r"), F.lag("_last").over(Window.orderBy("_range")).alias("_edge"))
    back = F.coalesce(F.lag(told).over(Window.partitionBy("_range").orderBy("_at")), F.col("_edge"))
    rows = ranged.join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn("_back", back)
    same = F.lit(True)
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_back.k{n}"))
    same &= F.col("_back").isNotNull()
    return rows.select(*frame.columns, *[F.when(same, F.col(f"_back.c{n}")).alias(f"prev_{c}") for n, c in enumerate(columns)])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new` whose key `old` lacks, one a key."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_first: tuple[str, ...] = (), fill_only: tuple[str, ...] = (), order: list[str] | None = None) -> DataFrame:
    """K3, K5, K7, K9: new values replace old ones by key; rows of `new` without a key are left out.

    Of several new rows of a key the one with the greatest `order` counts (without an order, one of them, always the same).
    keep_first columns stay as first seen; fill_only ones change only where they were null.
    """
    rest = [c for c in new.columns if c not in keys]
    place = F.struct(*order) if order else F.xxhash64(F.to_json(F.struct(*rest)))
    new = new.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in keys], F.lit(True).alias("_old"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest], F.lit(True).alias("_new"))
    both = o.join(n, keys, "full_outer")
    out = []
    for c in rest:
        was, now = F.col(f"_o_{c}") if c in old.columns else F.lit(None), F.col(f"_n_{c}")
        value = F.when(F.col("_old"), was).otherwise(now) if c in keep_first else F.coalesce(was, now) if c in fill_only else F.when(F.col("_new"), now).otherwise(was)
        out.append(value.alias(c))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return both.select(*keys, *out, change.alias("change"))


def assign_keys(known: DataFrame, wanted: DataFrame, natural: str, surrogate: str) -> DataFrame:
    """K4: surrogate numbers of all wanted natural keys; new ones continue after the greatest.

    New keys are numbered in natural order: sums of hash-range partitions first, so no single task numbers all.
    """
    base = known.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("_base"))
    new = wanted.select(natural).where(F.col(natural).isNotNull()).distinct().join(known.select(natural), natural, "left_anti")
    bucketed = new.withColumn("_bucket", F.pmod(F.xxhash64(natural), F.lit(1024)))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(natural))
    made = bucketed.withColumn("_nth", nth).join(F.broadcast(before.select("_bucket", "_before")), "_bucket").crossJoin(F.broadcast(base))
    return known.select(natural, surrogate).unionByName(made.select(natural, (F.col("_base") + F.col("_before") + F.col("_nth")).alias(surrogate)))


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in `new` are replaced by it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_counts(change: DataFrame) -> DataFrame:
    """K3: read, inserted and updated of an upsert's result."""
    told = F.col("change")
    return change.agg(F.count_if(told != "kept").alias("read"), F.count_if(told == "inserted").alias("inserted"), F.count_if(told == "updated").alias("updated"))


def mark_fetch(state: DataFrame, visits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """K2: the state of every key after visits (keys, at, status, changed, error and the columns of `order`).

    The time of the last success moves only with a 2xx status, that of the last change only with a change; attempts add up.
    """
    when = lambda cond: F.max(F.when(cond, F.col("at")))
    last = lambda c: F.max_by(c, F.struct(*order))
    seen = visits.groupBy(*keys).agg(
        F.max("at").alias("n_fetched"), when(F.col("status").between(200, 299)).alias("n_success"), when(F.col("changed")).alias("n_changed"), F.count("*").alias("n_attempts"),
        last("status").alias("n_status"), last("error").alias("n_error"), F.lit(True).alias("n_seen"),
    )
    both = state.join(seen, keys, "full_outer")
    new = F.col("n_seen").isNotNull()
    return both.select(
        *keys, F.coalesce("n_fetched", "last_fetched_at").alias("last_fetched_at"), F.coalesce("n_success", "last_success_at").alias("last_success_at"), F.coalesce("n_changed", "last_changed_at").alias("last_changed_at"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("n_attempts", F.lit(0))).alias("attempts"), F.when(new, F.col("n_status")).otherwise(F.col("last_status")).alias("last_status"), F.when(new, F.col("n_error")).otherwise(F.col("last_error")).alias("last_error"),
    )


def append_scores(scores: DataFrame, judged: DataFrame) -> DataFrame:
    """K8: one more row for each axis that was judged; no row is ever changed. judged: scores (map of axis to struct of score and confidence) and all other columns."""
    rest = [c for c in scores.columns if c not in ("axis", "value", "confidence")]
    new = judged.select(*rest, F.explode("scores").alias("axis", "_s"))
    return scores.unionByName(new.select(*rest, "axis", F.col("_s.score").alias("value"), F.col("_s.confidence").alias("confidence")))


def journal_weights(journal: DataFrame, trained: DataFrame, prompt: str, at) -> DataFrame:
    """K9: the dated journal of weights, one row a prompt (by its digest): training the same prompt again replaces and dates its row.

    journal: prompt_sha256, prompt, rubric, weights (axis to struct), trained_at; trained: rubric, axis, intercept, coef, trained_on.
    """
    one = trained.groupBy("rubric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", F.struct("intercept", "coef", "trained_on").alias("of"))))).alias("weights"))
    row = one.select(F.sha2(F.lit(prompt), 256).alias("prompt_sha256"), F.lit(prompt).alias("prompt"), "rubric", "weights", F.lit(at).cast("timestamp").alias("trained_at"))
    return replace_keys(journal, row, ["prompt_sha256"])
