"""Events from consecutive versions of a record (D5) and their incremental derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import safe_date
from orrery.operators.latest import previous_version

#: Event types and titles: fixed values.
SEASON, AIRING, ENDED, CANCELLED, RELEASE = "saison_annoncee", "date_diffusion", "diffusion_terminee", "annulation", "sortie"
RECORD = "seasons array<struct<season_number:int,air_date:string>>, next_episode_to_air struct<air_date:string>, status string, last_air_date string, release_date string"


def _seasons(record: str) -> Column:
    found = F.filter(F.coalesce(F.col(f"{record}.seasons"), F.array().cast("array<struct<season_number:int,air_date:string>>")), lambda s: s["season_number"] > 0)
    return found


def _event(when: Column, kind: str, day: Column, title: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("type"), day.alias("day"), title.alias("title")))


def diff_events(versions: DataFrame) -> DataFrame:
    """Events between a version and the one before it; versions: id, kind, day, before, after (records of RECORD), any other columns.

    A kind of event occurs once a version: several new seasons are one announcement.
    """
    had = F.transform(_seasons("before"), lambda s: s["season_number"])
    new = F.filter(_seasons("after"), lambda s: ~F.array_contains(had, s["season_number"]))
    numbers = F.array_sort(F.array_distinct(F.transform(new, lambda s: s["season_number"])))
    first_air = F.array_min(F.transform(new, lambda s: safe_date(s["air_date"])))
    names = F.when(F.size(numbers) == 1, F.concat(F.lit("Saison "), numbers[0], F.lit(" annoncée"))).otherwise(F.concat(F.lit("Saisons "), F.array_join(numbers.cast("array<string>"), " et "), F.lit(" annoncées")))
    air, aired = F.col("after.next_episode_to_air.air_date"), F.col("before.next_episode_to_air.air_date")
    status, was = F.col("after.status"), F.col("before.status")
    ends = F.coalesce(safe_date("after.last_air_date"), F.col("day"))
    out, out_before = safe_date("after.release_date"), safe_date("before.release_date")
    show = lambda d: F.date_format(d, "dd/MM/yyyy")
    tv, movie, changed = F.col("kind") == "tv", F.col("kind") == "movie", ~status.eqNullSafe(was)
    moved = out.isNotNull() & ~out.eqNullSafe(out_before)
    events = F.array(
        _event(tv & (F.size(numbers) > 0), SEASON, F.coalesce(first_air, F.col("day")), names),
        _event(tv & safe_date(air).isNotNull() & ~air.eqNullSafe(aired), AIRING, safe_date(air), F.concat(F.lit("Prochain épisode le "), show(safe_date(air)))),
        _event(tv & changed & (status == "Ended"), ENDED, ends, F.lit("Diffusion terminée")),
        _event(tv & changed & (status == "Canceled"), CANCELLED, ends, F.lit("Série annulée")),
        _event(movie & moved, RELEASE, out, F.concat(F.when(out >= F.col("day"), "Sortie le ").otherwise("Sorti le "), show(out))),
        _event(movie & ~F.coalesce(moved, F.lit(False)) & (status == "Released") & ~was.eqNullSafe(F.lit("Released")), RELEASE, F.coalesce(out, F.col("day")), F.lit("Film sorti")),
    )
    kept = F.filter(events, lambda e: e.isNotNull())
    rest = [c for c in versions.columns if c not in ("before", "after", "day")]
    return versions.select(*rest, F.explode(kept).alias("_e")).select(*rest, "_e.*")


def derive(raw: DataFrame, above: int | None = None) -> DataFrame:
    """Events of all versions with an id above the mark, each against its predecessor (of any id).

    raw: id, kind, source_id, lang, fetched_at, payload (JSON). The new mark is the greatest id read.
    """
    parsed = raw.withColumn("after", F.from_json("payload", RECORD)).withColumn("day", F.to_date("fetched_at"))
    paired = previous_version(parsed, ["kind", "source_id", "lang"], ["fetched_at", "id"], ["after"]).withColumnRenamed("prev_after", "before")
    fresh = paired.where("before is not null" if above is None else f"before is not null and id > {int(above)}")
    return diff_events(fresh.select("id", "kind", "source_id", "lang", "day", "before", "after"))
