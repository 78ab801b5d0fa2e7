"""Nested records as columns: credits, offers, images, canonical facts, books."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import anchor_key, safe_int
from orrery.operators import regression
from orrery.operators.paging import top_per_key
from orrery.operators.latest import first_per_key, language_rank

#: Kinds of offers in order of display, and how many people and images a work keeps: fixed values.
OFFER_KINDS = ("flatrate", "free", "ads", "rent", "buy")
MOST_CAST, MOST_DIRECTORS, MOST_BACKDROPS, MOST_STILLS = 15, 10, 6, 6

#: What the functions below read of a record.
MEMBER = "struct<id:long,name:string,profile_path:string,character:string,order:int,total_episode_count:int,roles:array<struct<character:string,episode_count:int>>>"
CREW = "struct<id:long,name:string,department:string,job:string,total_episode_count:int,jobs:array<struct<job:string,episode_count:int>>>"


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def prefer_filled(first: Column, second: Column) -> Column:
    """The first array unless it is empty or null."""
    return F.when(F.coalesce(F.size(first), F.lit(0)) > 0, first).otherwise(second)


def cast_of(members: Column, most: int = MOST_CAST) -> Column:
    """Credited actors: flat and nested roles read alike, without an id left out; the order defaults to the place."""

    def one(m: Column, at: Column) -> Column:
        role = _first(F.coalesce(m["roles"], F.array().cast("array<struct<character:string,episode_count:int>>")))
        return F.struct(
            m["id"].alias("id"), m["name"].alias("name"), F.coalesce(_blank_to_null(m["character"]), _blank_to_null(role["character"])).alias("character"),
            F.coalesce(m["order"], at).alias("credit"), F.coalesce(F.nullif(m["total_episode_count"], F.lit(0)), role["episode_count"]).alias("episodes"),
        )

    return F.filter(F.transform(F.slice(F.coalesce(members, F.array().cast(f"array<{MEMBER}>")), 1, most), one), lambda m: m["id"].isNotNull())


def directors_of(crew: Column, most: int | None = MOST_DIRECTORS) -> Column:
    """Directors only, by episodes (stable), the first `most` (None: all): a job list counts if it names one, else the single job must be it."""
    jobs = lambda m: F.coalesce(m["jobs"], F.array().cast("array<struct<job:string,episode_count:int>>"))
    mine = lambda m: F.filter(jobs(m), lambda j: j["job"] == "Director")
    kept = F.filter(crew, lambda m: m["id"].isNotNull() & F.when(F.size(jobs(m)) > 0, F.size(mine(m)) > 0).otherwise(F.coalesce(m["job"] == "Director", F.lit(False))))
    episodes = lambda m: F.when(F.size(jobs(m)) > 0, F.coalesce(F.nullif(m["total_episode_count"], F.lit(0)), _first(mine(m))["episode_count"]))
    ranked = F.array_sort(F.transform(kept, lambda m, i: F.struct((-F.coalesce(episodes(m), F.lit(0))).alias("less"), i.alias("at"), m["id"].alias("id"), m["name"].alias("name"), episodes(m).alias("episodes"))))
    kept = ranked if most is None else F.slice(ranked, 1, most)
    return F.transform(kept, lambda m: F.struct(m["id"].alias("id"), m["name"].alias("name"), m["episodes"].alias("episodes")))


def credit_edges(works: DataFrame, work: str, people: str, role: str) -> DataFrame:
    """G1: edges (person, work, role, credit) of an array of people; a work's place is the default credit."""
    rows = works.select(F.col(work).alias("work"), F.posexplode(people).alias("at", "p"))
    credit = F.col("p.credit") if "credit" in rows.schema["p"].dataType.names else F.col("at")
    return rows.select(F.col("p.id").alias("person"), "work", F.lit(role).alias("role"), credit.alias("credit"))


def offers(providers: Column) -> Column:
    """A country's offers (kind -> providers) in the fixed order of kinds, providers by priority (missing: first)."""
    of = lambda k: F.try_element_at(providers, k)
    by_priority = lambda ps: F.transform(F.array_sort(F.transform(ps, lambda p, i: F.struct(F.coalesce(p["display_priority"], F.lit(0)).alias("priority"), i.alias("at"), p["provider_name"].alias("name")))), lambda p: p["name"])
    made = F.transform(F.array(*[F.lit(k) for k in OFFER_KINDS]), lambda k: F.struct(k.alias("kind"), by_priority(of(k)).alias("providers")))
    return F.filter(made, lambda o: F.coalesce(F.size(o["providers"]), F.lit(0)) > 0)


def top_images(images: DataFrame, keys: list[str], most: int = MOST_BACKDROPS) -> DataFrame:
    """D4, O10 over rows (keys, file_path, vote_count): keys and `paths` as `backdrops` orders them; each task sends a key's `most` best at most."""
    told = images.where(_blank_to_null(F.col("file_path")).isNotNull()).withColumn("vote_count", F.coalesce("vote_count", F.lit(0)))
    best = top_per_key(told, keys, [F.desc("vote_count"), F.col("file_path")], most)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "file_path"))), lambda b: b["file_path"]).alias("paths"))


def backdrops(images: Column, most: int = MOST_BACKDROPS) -> Column:
    """Paths of the images with most votes, ties by path; without a path left out."""
    told = F.filter(images, lambda b: _blank_to_null(b["file_path"]).isNotNull())
    ranked = F.array_sort(F.transform(told, lambda b: F.struct((-F.coalesce(b["vote_count"], F.lit(0))).alias("less"), b["file_path"].alias("path"))))
    return F.transform(F.slice(ranked, 1, most), lambda b: b["path"])


def evenly(items: Column, count: int) -> Column:
    """W8 on an array: `count` elements spread over it, first and last kept; halves round to even."""
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (F.size(items) - 1) / F.lit(count - 1)).cast("int")))
    return F.when(F.size(items) <= count, items).otherwise(F.transform(at, lambda i: F.get(items, i)))


def facts(pairs: dict[str, Column]) -> Column:
    """A map of JSON values that holds only what says something: a missing value is a missing key, zero stays."""
    entries = [F.struct(F.lit(k).alias("key"), F.nullif(F.nullif(F.nullif(v.cast("string") if not isinstance(v, str) else F.col(v), F.lit("")), F.lit("[]")), F.lit("{}")).alias("value")) for k, v in sorted(pairs.items())]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def series_facts(row: str = "facts") -> Column:
    """A series' facts (countries, languages, filmed, set, qid, imdb, tvmaze) in the closed schema."""
    c = lambda n: F.col(f"{row}.{n}")
    place = lambda kind: lambda x: F.struct(F.lit(kind).alias("type"), x.alias("nom"))
    places = F.concat(*[F.transform(F.coalesce(c(n), F.array().cast("array<string>")), place(kind)) for n, kind in (("filmed", "tournage"), ("set_in", "action"))])
    ids = facts({"wikidata": c("qid"), "imdb": c("imdb"), "tvmaze": safe_int(c("tvmaze"))})
    listed = lambda x: F.when(F.size(x) > 0, F.to_json(x))
    return facts({"pays": listed(c("countries")), "langues": listed(c("languages")), "lieux": listed(places), "ids": F.when(F.size(ids) > 0, F.to_json(ids))})


#: A show's states as they are told in the closed schema; others say nothing sure. Fixed values.
SHOW_STATES = {"Running": "en_cours", "Ended": "terminee", "Canceled": "annulee", "Cancelled": "annulee"}


def _listed(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.to_json(items))


def _said(text: Column) -> Column:
    """Null for an empty text, so that a struct's JSON leaves it out."""
    return F.nullif(text, F.lit(""))


def book_facts(row: str = "facts") -> Column:
    """A book's facts of the knowledge base (year, countries, languages, site_links, authors of qid and name, qid, olid) in the closed schema."""
    c = lambda n: F.col(f"{row}.{n}")
    authors = F.filter(F.transform(c("authors"), lambda a: F.struct(_said(a["qid"]).alias("qid"), _said(a["name"]).alias("nom"))), lambda a: a["qid"].isNotNull() | a["nom"].isNotNull())
    ids = F.to_json(F.struct(_said(c("qid")).alias("wikidata"), _said(c("olid")).alias("openlibrary")))
    return facts({"annee": c("year"), "pays": _listed(c("countries")), "langues": _listed(c("languages")), "sitelinks": c("site_links"), "auteurs": _listed(authors), "ids": ids})


def library_facts(row: str = "facts") -> Column:
    """A library work's facts (title, olid, and of its editions by_language, total, without_language, truncated) in the closed schema; no editions, no key."""
    c = lambda n: F.col(f"{row}.{n}")
    none = F.array().cast("array<struct<langue:string,nombre:long,isbn:string,annee:int>>")
    editions = F.struct(F.coalesce(c("by_language"), none).alias("par_langue"), c("total").alias("total"), F.coalesce(c("without_language"), F.lit(0)).alias("sans_langue"), F.coalesce(c("truncated"), F.lit(False)).alias("tronque"))
    return facts({"titre": c("title"), "editions": F.when(c("total") > 0, F.to_json(editions)), "ids": F.to_json(F.struct(_said(c("olid")).alias("openlibrary")))})


def show_facts(row: str = "facts") -> Column:
    """A show's facts (id, name, premiered, status, country, network, days, time, episodes, dated, told, imdb) in the closed schema."""
    c = lambda n: F.col(f"{row}.{n}")
    state = F.try_element_at(F.create_map(*[F.lit(x) for p in SHOW_STATES.items() for x in p]), F.coalesce(c("status"), F.lit("")))
    year = F.when(c("premiered").rlike("^[0-9]{4}"), F.substring(c("premiered"), 1, 4).cast("int"))
    hours = F.to_json(F.struct(F.when(F.size(c("days")) > 0, c("days")).alias("jours"), _said(c("time")).alias("heure")))
    episodes = F.when(c("episodes") > 0, F.to_json(F.struct(c("episodes").alias("total"), c("dated").alias("dates"), c("told").alias("resumes"))))
    ids = F.to_json(F.struct(safe_int(c("id")).alias("tvmaze"), _said(c("imdb")).alias("imdb")))
    country = F.when(c("country") != "", F.to_json(F.array(c("country"))))
    return facts({"titre": c("name"), "annee": year, "statut": state, "pays": country, "diffuseur": c("network"), "calendrier": hours, "episodes": episodes, "ids": ids})


def assemble_books(works: DataFrame, sources: DataFrame, preferred: list[str]) -> DataFrame:
    """P20: one record a book from its source rows: facts of the knowledge base, description of the catalogue, the article in the preferred language.

    works: work, title, year; sources: work, source, lang, content, facts (map).
    """
    by = lambda name: sources.where(F.col("source") == name)
    known = by("wikidata").groupBy("work").agg(F.max_by("facts", "lang").alias("facts"))
    library = by("openlibrary").groupBy("work").agg(F.max_by("content", F.length("content")).alias("description"), F.array_sort(F.collect_set("lang")).alias("editions"))
    article = first_per_key(by("wikipedia").select("work", "lang", "content"), ["work"], [language_rank("lang", preferred), F.desc(F.length("content")), F.col("lang")])
    read = by("wikipedia").groupBy("work").agg(F.array_sort(F.collect_set("lang")).alias("articles"))
    out = works.join(known, "work", "left").join(library, "work", "left").join(article.select("work", F.col("content").alias("article"), F.col("lang").alias("article_lang")), "work", "left").join(read, "work", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "work", F.coalesce(_blank_to_null(F.col("title")), F.try_element_at("facts", F.lit("titre"))).alias("title"), F.coalesce("year", safe_int(F.try_element_at("facts", F.lit("annee")))).alias("year"),
        F.coalesce("description", "article").alias("overview"), "article_lang", F.array_union(F.coalesce("editions", none), F.coalesce("articles", none)).alias("languages"),
    )


#: A rubric's lines: a numbered axis, and the line that names works of known score for it. Fixed values.
AXIS_LINE, ANCHOR_LINE = r"[^\S\n]*\d+\.[^\S\n]+(\w+)[^\S\n]+—", r"[^\S\n]*Anchors:[^\S\n]*"


def anchors_of(prompt: Column | str) -> Column:
    """(axis, title, wanted) of a rubric's text: an axis line, and the first 'Anchors:' line before the next one; titles as keys.

    Of an axis or a title that is named again the last counts; pieces without a number are passed over.
    """
    prompt = F.concat(F.lit("\n"), F.col(prompt) if isinstance(prompt, str) else prompt)
    pattern = rf"(?U)\n{AXIS_LINE}[^\n]*+(?:\n(?!{AXIS_LINE}|{ANCHOR_LINE})[^\n]*+)*+\n{ANCHOR_LINE}([^\n]+)"
    said = F.arrays_zip(F.regexp_extract_all(prompt, F.lit(pattern), F.lit(1)).alias("axis"), F.regexp_extract_all(prompt, F.lit(pattern), F.lit(3)).alias("told"))

    def pairs(s: Column) -> Column:
        pieces = F.split(F.regexp_replace(s["told"], r"\.+$", ""), ",")
        scored = F.filter(pieces, lambda p: F.substring_index(p, "=", -1).rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$") & p.contains("="))
        made = F.transform(scored, lambda p: F.struct(s["axis"].alias("axis"), anchor_key(F.regexp_replace(p, "=[^=]*$", "")).alias("title"), F.trim(F.substring_index(p, "=", -1)).cast("double").alias("wanted")))
        return _last_of_each(made, "title")

    return F.flatten(F.transform(_last_of_each(said, "axis"), pairs))


def _last_of_each(rows: Column, key: str) -> Column:
    """The last struct of each key, in order. Rows are made once: what lambdas name outside of them, they make again for every element."""
    placed = F.transform(rows, lambda r, i: F.struct(r[key].alias("k"), i.alias("i"), r.alias("r")))
    by_key = F.transform(F.array(F.array_sort(placed)), lambda x: F.filter(x, lambda r, i: ~F.get(x, i + 1)["k"].eqNullSafe(r["k"])))[0]
    return F.transform(F.array_sort(F.transform(by_key, lambda r: F.struct(r["i"].alias("i"), r["r"].alias("r")))), lambda r: r["r"])


def anchor_gaps(scores: DataFrame, titles: DataFrame, anchors: DataFrame) -> DataFrame:
    """How far scores (work, axis, value) are from a rubric's anchors (axis, title, wanted); titles: work, title."""
    wanted = anchors.select("axis", anchor_key("title").alias("_k"), "wanted")
    named = titles.select("work", anchor_key("title").alias("_k"))
    return wanted.join(named, "_k").join(scores, ["work", "axis"]).select("axis", "work", "wanted", "value", (F.col("value") - F.col("wanted")).alias("gap"))


#: The encoder that runs without an address, and the label of its vectors: fixed values.
OWN_ENCODER, OWN_LABEL = "jinaai/jina-embeddings-v2-small-en", "jina-v2-small-en@512"


def encoder_label(spec: Column | str) -> Column:
    """What tells one encoder's vectors from another's: a served model's name, a local model's folder (wherever it lies), else the name itself."""
    spec = F.col(spec) if isinstance(spec, str) else spec
    folder = F.substring_index(F.regexp_replace(F.regexp_replace(spec, "^local:", ""), "/+$", ""), "/", -1)
    return F.when(spec.startswith("openai/"), F.regexp_replace(spec, "^openai/", "")).when(spec.startswith("local:"), folder).when(spec == OWN_ENCODER, F.lit(OWN_LABEL)).otherwise(spec)



def ablation(scored: DataFrame) -> DataFrame:
    """Per axis the held-out error with a section, without it, and of weights learnt with it on texts without it.

    scored: work, axis, value, with_section, without_section (vectors). All works count, from both vectors' moments.
    """
    rows = regression.folded(scored, "with_section", "without_section")
    models = [regression.fold_models(rows.select("axis", "fold", "value", F.col(c).alias("embedding"))) for c in ("with_section", "without_section")]
    known = rows.sparkSession.sparkContext.broadcast(models)

    def guess(axis: str, part: pd.DataFrame) -> dict[str, np.ndarray]:
        fold, a, b, out = int(part["fold"].iloc[0]), np.stack(part["with_section"]), np.stack(part["without_section"]), {}
        for p, (intercept, coef) in known.value[0][axis].get(fold, {}).items():
            out[f"with {p}"], out[f"shifted {p}"] = a @ coef + intercept, b @ coef + intercept
        return out | {f"without {p}": b @ coef + intercept for p, (intercept, coef) in known.value[1][axis].get(fold, {}).items()}

    made = []
    for axis, sums in sorted(regression.held_out_sums(rows, guess, ["with_section", "without_section"]).items()):
        best = regression.least_error(sums, [f"with {p}" for p in regression.PENALTIES])
        other = regression.least_error(sums, [f"without {p}" for p in regression.PENALTIES])
        made.append((axis, int(sums[best][0]), *(float(sums[m][1] / sums[m][0]) for m in (best, other, best.replace("with", "shifted")))))
    return rows.sparkSession.createDataFrame(made, "axis string, works long, with_it double, without_it double, shifted double")
