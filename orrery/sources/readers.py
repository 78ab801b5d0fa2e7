"""Readers (S1-S24) and response flatteners; all parse inside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.functions.scalars import cut_at_sentence, plain_text, publication_year, safe_int, stripped
from orrery.functions.unicode import unescaped
from orrery.sources.scratch import save


def json_lines(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """JSON lines, gzip or not; blank and malformed lines are skipped, not fatal."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text with a header, gzip or not."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="")


def newest_file(spark: SparkSession, folder: str, names: list[str], strict: bool = False) -> str | None:
    """The first of the names (newest first) that is there; strict: only the first counts."""
    for name in names[:1] if strict else names:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return f"{folder.rstrip('/')}/{name}"
    return None


def latest_payload(raw: DataFrame, source: str, kind: str, source_id: Column | str, lang: str | None = None) -> DataFrame:
    """The newest payload of one record; lang None: of any language."""
    rows = raw.where((F.col("source") == source) & (F.col("kind") == kind) & (F.col("source_id") == source_id))
    rows = rows if lang is None else rows.where(F.col("lang") == lang)
    return rows.groupBy("source_id").agg(F.max_by("payload", F.struct("fetched_at", "id")).alias("payload"), F.max(F.struct("fetched_at", "id")).getField("id").alias("id"))


def changed_ids(pages: DataFrame, most_pages: int = 500) -> DataFrame:
    """Distinct ids of a paged change feed (page, ok, ids) up to its first bad page, and whether it was cut."""
    bad = F.coalesce(F.min(F.when(~F.col("ok"), F.col("page"))), F.lit(most_pages + 1))
    limit = pages.agg(F.least(bad, F.lit(most_pages + 1)).alias("_end"), F.max("page").alias("_last"))
    kept = pages.crossJoin(F.broadcast(limit)).where(F.col("page") < F.col("_end"))
    return kept.select(F.explode("ids").alias("id"), (F.col("_end") <= F.col("_last")).alias("truncated")).distinct()


def fan_out(records: DataFrame, seasons: str, langs: list[str]) -> DataFrame:
    """A row per season and language still to be read."""
    return records.withColumn("season", F.explode(seasons)).withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs])))


def sparql_rows(bindings: DataFrame, column: str = "bindings", single: tuple[str, ...] = (), lists: tuple[str, ...] = (), separator: str = "|") -> DataFrame:
    """Result bindings (name -> struct of value) as flat rows; concatenated lists in canonical order."""
    value = lambda name: F.nullif(F.trim(F.try_element_at(F.col(column), F.lit(name))["value"]), F.lit(""))
    split = lambda v: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(v, f"[{separator}]"), lambda x: F.trim(x)), lambda x: x != "")))
    return bindings.select(*[c for c in bindings.columns if c != column], *[value(n).alias(n) for n in single], *[F.coalesce(split(value(n)), F.array().cast("array<string>")).alias(n) for n in lists])


def sparql_pairs(value: Column | str, separator: str = "|", between: str = "~") -> Column:
    """A concatenated list of id and label pairs as structs, each once, by id; a pair without an id is left out."""
    value = F.col(value) if isinstance(value, str) else value
    pairs = F.transform(F.split(value, f"[{separator}]"), lambda p: F.struct(F.nullif(F.trim(F.split_part(p, F.lit(between), F.lit(1))), F.lit("")).alias("qid"), F.nullif(F.trim(F.split_part(p, F.lit(between), F.lit(2))), F.lit("")).alias("label")))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(pairs, lambda p: p["qid"].isNotNull()))), F.array().cast("array<struct<qid:string,label:string>>"))


def first_years(rows: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """The earliest year of each key's dates."""
    return rows.groupBy(*keys).agg(F.min(publication_year(F.col(date).cast("string"))).alias("year"))


def sweep_page(items: DataFrame, known: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` items that aren't known yet, in order of their key: a page begins after the last key of the one before."""
    rest = items if after is None else items.where(F.col(key) > F.lit(after))
    return rest.join(known.select(key).distinct(), key, "left_anti").orderBy(key).limit(size)


def most_linked(items: DataFrame, links: str, key: str, most: int) -> DataFrame:
    """The `most` items with most links, ties by key."""
    return items.orderBy(F.col(links).desc_nulls_last(), key).limit(most)


def site_links(links: Column | str) -> Column:
    """Wiki language -> title; other projects and commons left out."""
    links = F.col(links) if isinstance(links, str) else links
    kept = F.map_filter(links, lambda k, v: k.endswith("wiki") & ~k.startswith("commons"))
    return F.transform_keys(kept, lambda k, v: F.regexp_replace(k, "wiki$", ""))


def first_article(pages: Column | str) -> Column:
    """Of page structs (missing, title, extract) the first that has an extract."""
    pages = F.col(pages) if isinstance(pages, str) else pages
    return F.try_element_at(F.filter(pages, lambda p: ~F.coalesce(p["missing"], F.lit(False)) & (F.trim(F.coalesce(p["extract"], F.lit(""))) != "")), F.lit(1))


def first_articles(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys, extract of each key's first page by `order` that isn't missing and has an extract; pages: keys, order, missing, extract.

    The first is found on `order` alone, so texts are neither sorted nor gathered; only those of first pages move.
    """
    told = pages.where(~F.coalesce("missing", F.lit(False)) & (F.trim(F.coalesce("extract", F.lit(""))) != ""))
    first = told.groupBy(*keys).agg(F.min(order).alias("_first")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first")
    same = F.col(order) == F.col("_first")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return told.join(first, same).groupBy(*keys).agg(F.min("extract").alias("extract"))


def show_summary(episodes: Column | str) -> Column:
    """(episodes, seasons, summary): counts and the told episodes' text in order."""
    episodes = F.col(episodes) if isinstance(episodes, str) else episodes
    # entities of all summaries are resolved at once, each summary is then stripped by itself
    texts = F.split(unescaped(F.array_join(F.transform(episodes, lambda e: F.coalesce(e["summary"], F.lit(""))), "\x01")), "\x01")
    told = F.filter(F.transform(texts, stripped), lambda s: s.isNotNull())
    return F.struct(F.size(episodes).alias("episodes"), F.size(F.array_distinct(F.transform(episodes, lambda e: e["season"]))).alias("seasons"), F.array_join(told, " ").alias("summary"))


def accepted_show(candidates: Column | str, imdb: Column | str) -> Column:
    """The first candidate (struct with imdb) of exactly this external id; a title alone is no proof."""
    candidates, imdb = (F.col(c) if isinstance(c, str) else c for c in (candidates, imdb))
    return F.try_element_at(F.filter(candidates, lambda c: c["imdb"] == imdb), F.lit(1))


SHOW_IMAGE = "struct<image:struct<original:string,medium:string>>"
SHOW_CANDIDATES = "array<struct<show:struct<id:string,externals:struct<imdb:string>>>>"


def show_images(payload: Column | str) -> Column:
    """A show's poster (type, url) in its best size, as a list of one or none."""
    image = F.from_json(F.col(payload) if isinstance(payload, str) else payload, SHOW_IMAGE)["image"]
    url = F.coalesce(F.nullif(image["original"], F.lit("")), F.nullif(image["medium"], F.lit("")))
    return F.filter(F.array(F.struct(F.lit("poster").alias("type"), url.alias("url"))), lambda i: i["url"].isNotNull())


def chosen_show(payload: Column | str, imdb: Column | str) -> Column:
    """The id of the first search result that carries this external id, wherever it stands; a title alone chooses none."""
    found = F.from_json(F.col(payload) if isinstance(payload, str) else payload, SHOW_CANDIDATES)
    imdb = F.nullif(F.col(imdb) if isinstance(imdb, str) else imdb, F.lit(""))
    same = F.filter(found, lambda c: c["show"]["externals"]["imdb"] == imdb)
    return safe_int(F.try_element_at(same, F.lit(1))["show"]["id"])


def last_part(key: Column) -> Column:
    return F.nullif(F.substring_index(key, "/", -1), F.lit(""))


#: Covers kept of a work, and library language codes as they are written elsewhere: fixed values.
MOST_COVERS = 4
MARC_TO_ISO = {"fre": "fr", "eng": "en", "spa": "es", "ara": "ar", "tur": "tr", "ger": "de", "ita": "it", "por": "pt", "rus": "ru", "jpn": "ja", "chi": "zh", "kor": "ko"}
LIBRARY_WORK = "struct<key:string,title:string,description:string,covers:array<int>,location:string,type:struct<key:string>>"


def library_work(payload: Column | str) -> Column:
    """(olid, title, description, covers, redirect) of a work's JSON; null if it has no key.

    A description is a text or an object with a value; covers that were taken back (not above 0) are left out; redirect is
    the work that a merged one points to.
    """
    w = F.from_json(F.col(payload) if isinstance(payload, str) else payload, LIBRARY_WORK)
    told = F.when(w["description"].startswith("{"), F.get_json_object(w["description"], "$.value")).otherwise(w["description"])
    covers = F.slice(F.filter(F.coalesce(w["covers"], F.array().cast("array<int>")), lambda c: c > 0), 1, MOST_COVERS)
    merged = F.when(w["type"]["key"] == "/type/redirect", last_part(w["location"]))
    out = F.struct(last_part(w["key"]).alias("olid"), w["title"].alias("title"), F.nullif(F.trim(told), F.lit("")).alias("description"), covers.alias("covers"), merged.alias("redirect"))
    return F.when(w["key"].isNotNull(), out)


def edition_work(payload: Column | str) -> Column:
    """The work of an edition's JSON; null for an edition without one."""
    e = F.from_json(F.col(payload) if isinstance(payload, str) else payload, "struct<works:array<struct<key:string>>>")
    return last_part(F.try_element_at(e["works"], F.lit(1))["key"])


def redirect_ends(links: DataFrame) -> DataFrame:
    """(_from, end, looped) of links (_from, _to), one a place: where a chain of any length ends. Null where it runs into a circle (looped).

    Every round doubles how far each link reaches, so a chain of n links takes log2(n) rounds. What has no end after as many
    rounds as all links together could need, goes round.
    """
    one = save(links.where("_from is not null and _to is not null and _from <> _to").groupBy("_from").agg(F.min("_to").alias("_to")))
    most, reach, rounds = max(one.count(), 1), one, 0
    while True:
        further = reach.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        joined = save(reach.join(further, "_to", "left").select("_from", F.coalesce("_next", "_to").alias("_to"), F.col("_next").isNotNull().alias("_on")))
        moving = not joined.where("_on").isEmpty()
        reach, rounds = joined.select("_from", "_to"), rounds + 1
        if not moving or 2**rounds > 2 * most:
            break
    starts = one.select(F.col("_from").alias("_to"), F.lit(True).alias("looped"))
    told = reach.join(starts, "_to", "left").withColumn("looped", F.coalesce("looped", F.lit(False)))
    return told.select("_from", F.when(~F.col("looped"), F.col("_to")).alias("end"), "looped")


def resolved(works: DataFrame, key: str, to: str) -> DataFrame:
    """Works with `canonical`, the end of their redirects (null or 0: none), however many; a work whose redirects go round stays itself and is `looped`."""
    links = works.where(F.col(to).isNotNull() & (F.col(to).cast("string") != "0")).select(F.col(key).alias("_from"), F.col(to).alias("_to"))
    out = works.join(redirect_ends(links), F.col(key) == F.col("_from"), "left")
    return out.withColumn("canonical", F.coalesce("end", key)).withColumn("looped", F.coalesce("looped", F.lit(False))).drop("_from", "end")


def iso_language(code: Column | str) -> Column:
    """A library's language code as a two-letter one where there is one."""
    code = F.col(code) if isinstance(code, str) else code
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in MARC_TO_ISO.items() for x in p]), code), code)


def editions_inventory(editions: DataFrame, sizes: DataFrame, work: str = "work") -> DataFrame:
    """Per work how many editions were read, how many name no language, and whether the list was cut; sizes: work, size (as the source states it)."""
    read = editions.groupBy(work).agg(F.count("*").alias("total"), F.count_if(F.coalesce("lang", F.lit("")) == "").alias("without_language"))
    return read.join(sizes, work, "left").select(work, "total", "without_language", (F.coalesce("size", "total") > F.col("total")).alias("truncated"))


def work_key(candidates: Column | str) -> Column:
    """The first candidate key that names a work (it ends with W)."""
    candidates = F.col(candidates) if isinstance(candidates, str) else candidates
    return F.try_element_at(F.filter(candidates, lambda k: k.endswith("W")), F.lit(1))


def editions_by_language(editions: DataFrame, work: str = "work") -> DataFrame:
    """Per work and language (two letters where known): editions, first ISBN (13 digits before 10) and earliest year; no language: ''.

    editions: work, position, lang, isbn_13, isbn_10, published.
    """
    year = publication_year("published")
    isbn = F.coalesce(F.min_by("isbn_13", F.when(F.col("isbn_13").isNotNull(), F.col("position"))), F.min_by("isbn_10", F.when(F.col("isbn_10").isNotNull(), F.col("position"))))
    return editions.groupBy(work, iso_language(F.coalesce("lang", F.lit(""))).alias("lang")).agg(F.count("*").alias("editions"), isbn.alias("isbn"), F.min(year).alias("first_year"))


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Feed entries from XML files: title, link, guid, published, sorted tags, summary without markup, cut at a sentence."""
    schema = "title string, link string, guid string, pubDate string, category array<string>, description string"
    rows = spark.read.schema(schema).option("rowTag", row_tag).xml(path)
    tags = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("category", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")))
    return rows.select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.coalesce("guid", "link").alias("guid"), "pubDate", tags.alias("tags"), cut_at_sentence(plain_text("description"), 500).alias("summary"))


def ranked_lists(lists: DataFrame, items: str = "items") -> DataFrame:
    """List elements with their place from 1; repeats within a list keep the first place."""
    placed = lists.select(*[c for c in lists.columns if c != items], F.posexplode(items).alias("_at", "item"))
    keys = [c for c in lists.columns if c != items]
    return placed.groupBy(*keys, "item").agg((F.min("_at") + 1).alias("place"))


def citation_counts(lists: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """How often each item of valid lists is cited, and 0 for items that are mentioned only; lists: keys, valid; mentions: keys."""
    cited = lists.where("valid").groupBy(*keys).agg(F.count("*").alias("n"))
    return cited.unionByName(mentions.select(*keys).distinct().withColumn("n", F.lit(0).cast("long"))).groupBy(*keys).agg(F.sum("n").alias("n"))


def distinct_values(frame: DataFrame, column: str) -> DataFrame:
    """The values present, in order."""
    return frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(column)
