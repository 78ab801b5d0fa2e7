"""Dossiers: labelled sections joined into one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENOUGH = 400


def section(label: str, body: Column) -> Column:
    """A labelled section, null when its body is blank (so it leaves no gap)."""
    return F.when(F.nullif(F.trim(body), F.lit("")).isNotNull(), F.concat(F.lit(f"{label}: "), F.trim(body)))


def assemble(rows: DataFrame, key: str, sections: list[tuple[str, Column]]) -> DataFrame:
    """D3: key, dossier, sha, chars and whether it is enough; sections in the given order."""
    made = [section(label, body) for label, body in sections]
    names = F.concat_ws(", ", *[F.when(m.isNotNull(), F.lit(label)) for (label, _), m in zip(sections, made, strict=True)])
    text = F.concat_ws("\n\n", *made, F.concat(F.lit("MATERIAL: "), names))
    out = rows.select(key, text.alias("dossier"))
    return out.select(key, "dossier", F.sha2("dossier", 256).alias("sha"), F.char_length("dossier").alias("chars"), (F.char_length("dossier") >= ENOUGH).alias("enough"))


def english_translation(entries: Column) -> Column:
    """Of translation structs (lang, country, overview) the English one: US first, the first with an overview, else the first."""
    english = F.filter(entries, lambda e: e["lang"] == "en")
    ordered = F.concat(F.filter(english, lambda e: e["country"] == "US"), F.filter(english, lambda e: ~e["country"].eqNullSafe(F.lit("US"))))
    told = F.filter(ordered, lambda e: F.nullif(F.trim(e["overview"]), F.lit("")).isNotNull())
    return F.coalesce(F.try_element_at(told, F.lit(1)), F.try_element_at(ordered, F.lit(1)))


def english_rows(entries: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """D1 over rows (keys, order, lang, country, overview, value): keys and `value` of the English entry that `english_translation` would pick, without gathering a key's entries."""
    blank = F.trim(F.coalesce("overview", F.lit(""))) == ""
    rank = F.struct(blank, ~F.col("country").eqNullSafe(F.lit("US")), F.col(order))
    return entries.where("lang = 'en'").groupBy(*keys).agg(F.min_by(value, rank).alias(value))
