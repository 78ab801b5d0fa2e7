"""What an encoder doesn't read, and whether scores measure what they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import fold
from orrery.operators import similarity
from orrery.operators.paging import global_rank

#: Characters that an encoder reads, the bounds of the length classes, and works from which quartiles are told: fixed values.
READ, LENGTHS, FEWEST = 12_000, (6_000, 12_000, 20_000), 8


def matter_summary(works: DataFrame) -> DataFrame:
    """One row about works (chars, article_chars, article_start, error): how many are cut, the share of all characters lost, how
    their articles survive the cut, works by length class, and how the error goes with the length.

    article_start: where the article's text begins, null without one; error: null where nothing was judged.
    """
    lost = F.greatest(F.lit(0), F.col("chars") - READ)
    has = F.col("article_chars") > 0
    seen = F.when(~has | F.col("article_start").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(READ) - F.col("article_start"), F.col("article_chars"))))
    judged = F.col("error").isNotNull()
    spread = lambda c: F.stddev_pop(F.when(judged, F.col(c))) * F.sqrt(F.count_if(judged))
    low, high = (0, *LENGTHS), (*LENGTHS, None)
    classes = [F.count_if((F.col("chars") >= a) & (F.lit(True) if b is None else F.col("chars") < b)).alias(f"from_{a}") for a, b in zip(low, high, strict=True)]
    return works.agg(
        F.count("*").alias("works"), F.count_if(lost > 0).alias("cut"), F.round(F.coalesce(F.sum(lost) / F.nullif(F.sum("chars"), F.lit(0)), F.lit(0.0)), 3).alias("share_lost"),
        F.count_if(has).alias("articles"), F.count_if(has & (seen >= F.col("article_chars"))).alias("whole"), F.count_if(has & (seen > 0) & (seen < F.col("article_chars"))).alias("partly"), F.count_if(has & (seen == 0)).alias("unseen"),
        *classes, F.when((F.count_if(judged) >= 3) & (spread("chars") > 1e-9) & (spread("error") > 1e-9), F.round(F.corr(F.when(judged, F.col("chars")), "error"), 2)).alias("correlation"),
    )


def error_by_quartile(works: DataFrame) -> DataFrame:
    """Quartile, works, chars_min, chars_max and mae of judged works by length, the last quartile with what is left over; nothing for fewer than FEWEST."""
    ranked = global_rank(works.where("error is not null").select("work", "chars", "error"), [F.col("chars"), F.col("work")], "i")
    n = ranked.agg(F.count("*").alias("n"))
    quartile = F.least(F.lit(4).cast("long"), F.expr("i div (n div 4) + 1")).alias("quartile")
    told = ranked.crossJoin(F.broadcast(n)).where(F.col("n") >= FEWEST).groupBy(quartile)
    return told.agg(F.count("*").alias("works"), F.min("chars").alias("chars_min"), F.max("chars").alias("chars_max"), F.round(F.avg("error"), 3).alias("mae"))


def neighbourhood(vectors: DataFrame, judged: DataFrame, focus: int, most: int = 10) -> DataFrame:
    """The works nearest to one, and what they got on the axis where its score and its prediction differ most.

    vectors: vec_id, embedding; judged: work, axis, value, predicted (null: not predicted).
    """
    gap = F.abs(F.col("value") - F.col("predicted"))
    worst = judged.where((F.col("work") == focus) & gap.isNotNull()).agg(F.max_by("axis", F.struct(gap, F.col("axis"))).alias("axis"))
    near = similarity.nearest(vectors, F.col("vec_id") == focus, most, "cosine").select(F.col("id").alias("work"), F.round("score", 3).alias("cosine"), "place")
    scores = judged.join(F.broadcast(worst), "axis").select("work", "value")
    return near.crossJoin(F.broadcast(worst)).join(scores, "work", "left").select("work", "cosine", "place", "axis", "value")


def anchor_summary(anchors: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per axis how many anchors a rubric declares, how many were found, and their mean and worst gap; gaps as of records.anchor_gaps."""
    declared = anchors.groupBy("axis").agg(F.count("*").alias("declared"))
    found = gaps.groupBy("axis").agg(F.count("*").alias("found"), F.round(F.avg(F.abs("gap")), 2).alias("mean_gap"), F.max_by("work", F.struct(F.abs("gap"), -F.col("work"))).alias("worst"))
    return declared.join(found, "axis", "left").select("axis", "declared", F.coalesce("found", F.lit(0)).alias("found"), "mean_gap", "worst")


def _plain(genres: DataFrame) -> DataFrame:
    """Works and folded genres, each once; a spelling is folded once, however many works have it."""
    spelt = genres.where("genre is not null").select("work", "genre")
    names = spelt.select("genre").distinct().select("genre", fold("genre").alias("_plain"))
    return spelt.join(names, "genre").select("work", F.col("_plain").alias("genre")).distinct()


def genre_gap(scores: DataFrame, genres: DataFrame, expected: DataFrame) -> DataFrame:
    """Per axis the mean score with and without a genre that should raise it; works without any genre stay out.

    scores: work, axis, value; genres: work, genre; expected: axis, genre (few).
    """
    plain = _plain(genres)
    claims = F.broadcast(expected.coalesce(1).select("axis", fold("genre").alias("genre")).distinct())
    raised = plain.join(claims, "genre").select("work", "axis").distinct().withColumn("has", F.lit(True))
    told = scores.where("value is not null").join(plain.select("work").distinct(), "work", "left_semi").join(raised, ["work", "axis"], "left")
    mean = lambda cond: F.avg(F.when(cond, F.col("value")))
    with_, without = mean(F.col("has")), mean(F.col("has").isNull())
    return told.groupBy("axis").agg(F.count_if("has").alias("with_genre"), F.round(with_, 2).alias("mean_with"), F.round(without, 2).alias("mean_without"), F.round(with_ - without, 2).alias("gap"))


def counter_judge(scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per axis the works that another judge scored, too, and the mean distance; verdicts: work, at, axis, value, the newest of a work and axis counts."""
    newest = verdicts.groupBy("work", "axis").agg(F.max_by("value", "at").alias("other"))
    both = scores.join(newest, ["work", "axis"]).where("value is not null and other is not null")
    return both.groupBy("axis").agg(F.count("*").alias("works"), F.round(F.avg(F.abs(F.col("value") - F.col("other"))), 2).alias("mean_gap"))


def orphan_genres(genres: DataFrame, expected: DataFrame, most: int = 8) -> DataFrame:
    """The genres of most works that no axis claims."""
    free = _plain(genres).join(F.broadcast(expected.coalesce(1).select(fold("genre").alias("genre")).distinct()), "genre", "left_anti")
    return free.groupBy("genre").agg(F.count("*").alias("works")).orderBy(F.desc("works"), F.desc("genre")).limit(most)

