"""Full-text search (T1-T9) over documents and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import fulltext
from orrery.plans.base import Tables, query
from orrery.plans.catalog import _CARDS
from orrery.sources.scratch import new_folder
from orrery.sources.search_index import SearchIndex

_BUILT: dict[tuple, str] = {}


def _state(frame: DataFrame) -> str:
    """The files of a table with their lengths and times: an index of another state isn't used."""
    jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsc.hadoopConfiguration()
    stats = [(p, p.getFileSystem(conf).getFileStatus(p)) for p in map(jvm.org.apache.hadoop.fs.Path, sorted(frame.inputFiles()))]
    return ",".join(f"{p.toString()}:{s.getLen()}:{s.getModificationTime()}" for p, s in stats)


def stored_index(t: Tables, name: str, docs: DataFrame, key: str, stored: list[str] | None = None) -> SearchIndex:
    """The index of docs (key, text, stored), built once for a session and a state of the tables."""
    at = (t.spark.sparkContext.applicationId, t.sf_dir, name, _state(docs))
    folder = _BUILT.get(at)
    if folder is None or SearchIndex(t.spark, folder).pointer.read() is None:
        folder = _BUILT[at] = new_folder(t.spark, f"index-{name}")
        SearchIndex(t.spark, folder).build(docs, key, "text", stored)
    return SearchIndex(t.spark, folder)


def documents_index(t: Tables) -> SearchIndex:
    return stored_index(t, "documents", t.documents.select("doc_id", "text"), "doc_id")

_WORDS = "w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(strip_accents(replace(replace(replace(lower(text), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g')), ' ')) AS token FROM documents)"


@query("t1_prefix_index", "WITH w AS (SELECT p_partkey, unnest(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS token FROM part), t AS (SELECT p_partkey, token, count(*) AS tf FROM w WHERE token <> '' GROUP BY 1, 2) SELECT prefix, p_partkey, sum(tf)::BIGINT AS tf FROM (SELECT p_partkey, tf, unnest(list_distinct(list_append(list_transform(range(2, least(20, length(token)) + 1), lambda n: left(token, n::INT)), token))) AS prefix FROM t) GROUP BY 1, 2")
def prefix_index(t: Tables) -> DataFrame:
    """The forms under which the stored index finds a part."""
    return fulltext.prefix_forms(stored_index(t, "parts", t.part.select("p_partkey", F.col("p_name").alias("text")), "p_partkey"))


@query("t3_match_all_prefixes", f"WITH {_WORDS} SELECT doc_id FROM w GROUP BY 1 HAVING count(CASE WHEN starts_with(token, 'licen') THEN 1 END) > 0 AND count(CASE WHEN starts_with(token, 'th') THEN 1 END) > 0")
def match_all_prefixes(t: Tables) -> DataFrame:
    """Every query word starts some word."""
    return fulltext.match_all(documents_index(t), ["licen", "th"]).select("doc_id")


@query("t7_bm25_no_norms", f"WITH {_WORDS}, tf AS (SELECT 'licen' AS term, doc_id, count(*) AS tf FROM w WHERE starts_with(token, 'licen') GROUP BY 2 UNION ALL SELECT 'th', doc_id, count(*) FROM w WHERE starts_with(token, 'th') GROUP BY 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2)), 6) AS score FROM tf JOIN df USING (term), n GROUP BY 1 HAVING count(*) = 2")
def bm25(t: Tables) -> DataFrame:
    """BM25 without length normalisation."""
    return fulltext.match_all(documents_index(t), ["licen", "th"]).select("doc_id", F.round("score", 6).alias("score"))


@query("t4_phrase", "SELECT doc_id, len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' apache license (?=version )| apache license version ')) AS times FROM documents WHERE regexp_matches(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' apache license version ')".replace("(?=version )| apache license version ", "version "))
def phrase(t: Tables) -> DataFrame:
    """T4: consecutive whole words."""
    return fulltext.match_phrase(documents_index(t), ["apache", "license", "version"])


_PART_WORDS = f"""{_CARDS}, l AS (SELECT p_partkey, string_split(trim(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')), ' ') AS l FROM part),
  w AS (SELECT p_partkey, unnest(l) AS token, unnest(range(len(l))) AS place FROM l), n AS (SELECT count(*) AS n FROM part)"""
_IDF = "idf AS (SELECT *, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT *, count(*) OVER (PARTITION BY kind, term) AS df FROM tf), n)"
_RATED = "SELECT p_partkey, round(score * coalesce(rating, 5.0), 6) AS score FROM (SELECT p_partkey, sum(score) AS score FROM s GROUP BY 1) JOIN cards USING (p_partkey)"


def _searched(t: Tables, words: str) -> DataFrame:
    from orrery.plans.catalog import cards

    rows = cards(t).withColumn("text", F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    found = fulltext.search(stored_index(t, "cards", rows.select("p_partkey", "text", "rating"), "p_partkey", ["rating"]), words, "rating")
    return found.select("p_partkey", F.round("score", 6).alias("score"))


def _terms(kind: str, term: str, match: str) -> str:
    return f"SELECT '{kind}' AS kind, '{term}' AS term, p_partkey, count(*) AS tf FROM w WHERE {match} GROUP BY 3"


def _searched_sql(tf: list[str], clauses: list[str]) -> str:
    return f"WITH {_PART_WORDS}, tf AS ({' UNION ALL '.join(tf)}), {_IDF}, s AS ({' UNION ALL '.join(clauses)}) {_RATED}"


@query(
    "t6_rated_search",
    _searched_sql(
        [_terms("p", "small", "starts_with(token, 'small')"), _terms("p", "ring", "starts_with(token, 'ring')"), _terms("w", "small", "token = 'small'"), _terms("w", "ring", "token = 'ring'")],
        [
            "SELECT p_partkey, sum(idf * tf / (tf + 1.2)) AS score FROM idf WHERE kind = 'p' GROUP BY 1 HAVING count(*) = 2",
            "SELECT a.p_partkey, 3 * (SELECT sum(DISTINCT idf) FROM idf WHERE kind = 'w') * count(*) / (count(*) + 1.2) FROM w a JOIN w b ON b.p_partkey = a.p_partkey AND b.place = a.place + 1 WHERE a.token = 'small' AND b.token = 'ring' GROUP BY 1",
        ],
    ),
)
def rated_search(t: Tables) -> DataFrame:
    """Prefixes and the phrase of an accented query, times the rating."""
    return _searched(t, "Smáll RÎNG")


@query(
    "t5_id_clause",
    _searched_sql(
        [_terms("p", "7", "token = '7'"), _terms("w", "7", "token = '7'")],
        ["SELECT p_partkey, idf * tf / (tf + 1.2) AS score FROM idf WHERE kind = 'p'", "SELECT p_partkey, 3 * idf * tf / (tf + 1.2) FROM idf WHERE kind = 'w'", "SELECT p_partkey, 10.0 FROM part WHERE p_partkey = 7"],
    ),
)
def id_clause(t: Tables) -> DataFrame:
    """T5: a numeric query also names an id; of one letter, it must be a whole word."""
    return _searched(t, "7")


@query("t9_facet_terms", "SELECT p_brand AS value, count(*) AS n FROM part WHERE p_name LIKE '%ring%' GROUP BY 1")
def facet_terms(t: Tables) -> DataFrame:
    """Values of the rows found."""
    from orrery.operators.paging import facets

    return facets(t.part.where("p_name like '%ring%'"), "p_brand")


@query("t8_document_builder", "SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS titles FROM (SELECT p_partkey, list_filter([p_name, CASE WHEN p_brand <> p_name THEN p_brand END, CASE WHEN p_type <> p_name AND p_type <> p_brand THEN p_type END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM part)")
def document_builder(t: Tables) -> DataFrame:
    """Titles without nulls, each once, in order."""
    titles = F.array_distinct(F.filter(F.array("p_name", "p_brand", "p_type"), lambda x: x.isNotNull()))
    return t.part.select("p_partkey", F.array_join(titles, "|").alias("titles"))


@query("k12_index_refresh", f"WITH {_WORDS} SELECT doc_id FROM w WHERE doc_id % 10 <> 1 GROUP BY 1 HAVING count(CASE WHEN starts_with(token, 'licen') THEN 1 END) > 0 AND count(CASE WHEN starts_with(token, 'th') THEN 1 END) > 0")
def index_refresh(t: Tables) -> DataFrame:
    """An index of older texts after two changes, a removal and a merge finds what one of the present texts would."""
    index, docs = SearchIndex(t.spark, new_folder(t.spark, "index")), t.documents.select("doc_id", "text")
    index.build(docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit("a licence that was there before")).otherwise(F.col("text"))), "doc_id", "text")
    index.upsert(docs.where("doc_id % 20 = 0"))
    index.upsert(docs.where("doc_id % 20 = 10"), removed=docs.where("doc_id % 10 = 1"))
    index.merge(all_=True)
    return fulltext.match_all(index, ["licen", "th"]).select("doc_id")
