"""The opN_ queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    """The secret of spark.orrery.pii.key; where it is unset, one that is drawn for this session, which nobody can undo or link to other sessions."""
    key = spark.conf.get("spark.orrery.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("spark.orrery.pii.key", key)
    return key


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, how many values were replaced, and their kinds."""
    from orrery.llm.pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, and the verdict at the language's threshold."""
    from orrery.llm import toxicity

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs.select("doc_id", "lang", "text"), model)
    cut = toxicity.threshold_column(model)
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), (F.col("toxicity") >= cut).cast("int").alias("predicted_by_lang")
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id at three words and 90 percent."""
    from orrery.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, first_slot: the mix of all documents."""
    from orrery.llm.mixing import mixture

    mixed = mixture(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.withColumn("first_slot", F.try_element_at("slots", F.lit(1))).drop("slots")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_hash, n_bytes, round_trip of every whole text."""
    from orrery.llm.sentencepieces import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the spans as text."""
    from orrery.llm.licenses import scan_licenses

    found = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"], s["last"], s["label"])), " "))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_backoff, logprob, mean_logprob under counts of all documents."""
    from orrery.llm.lm_scoring import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, chunks, as read back from the archives."""
    from orrery.llm.warc import round_trip

    return round_trip(spark, _table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest of every vec_id divisible by 20, among all rows."""
    from orrery.llm.graph_search import nearest

    return nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept at cosine 0.98 within a label."""
    from orrery.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), cosine=0.98)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a quarter of the documents of 20 words and more, drawn towards `benchmark`."""
    from orrery.llm.importance import importance_ranks

    return importance_ranks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every whole text, as read back from the token files."""
    from orrery.llm.token_files import round_trip

    return round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256; every tenth document gets a planted repetition."""
    from orrery.llm.periodic import find_runs, plant_repeats, run_digests

    return run_digests(find_runs(plant_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")), keep_text=False))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_toxicity, op3_graph_search, op4_mixing, op5_ngram_jaccard_join, op6_license_scan, op7_lm_scoring, op8_warc, op9_sentencepiece,
        op10_embedding_near_dedup, op11_importance_resampling, op12_token_files, op13_periodic_runs,
    )
}
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op5_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{_AZ}', '{_AZ.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.c AS component_id
FROM documents d JOIN (SELECT d, min(c) AS c FROM r GROUP BY 1) g ON g.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY 1)
SELECT page_id, size::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, CASE WHEN first < page_id THEN 1 ELSE greatest(1, (size + 1048575) // 1048576) END::BIGINT AS chunks
FROM p LEFT JOIN f ON f.html = p.html""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, a.e) > 0 AND list_dot_product(b.e, b.e) > 0 AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
n AS (SELECT a, count(*) AS n FROM p GROUP BY 1),
r(d, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.d, p.b FROM r JOIN p ON p.a = r.c)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, g.c AS component_id, e.vec_id = g.c AS kept
FROM embeddings e JOIN (SELECT d, min(c) AS c FROM r GROUP BY 1) g ON g.d = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    # the crc32 of every different feature, a byte at a time, by the table k
    "op11_importance_resampling": rf"""
WITH k AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS k FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '{_WORDS}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '{_WORDS}') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
g AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
y AS (SELECT f, list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)) AS y FROM x),
h AS (SELECT f, xor(list_reduce(y, lambda c, v: xor(c >> 8, k.k[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, k),
s AS (SELECT bucket, count(*) AS n FROM f JOIN h USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM g JOIN h USING (f) GROUP BY 1),
n AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (n.s + 10000) / ((s.n + 1) * (n.t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN h USING (f) JOIN gain USING (bucket) GROUP BY 1),
r AS (SELECT d.doc_id, len(d.w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || left(sha256('7:' || d.doc_id), 8))::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
q AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM r),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM q WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM q LEFT JOIN o USING (doc_id)""",
}
