"""The registered queries with their production parameters, on the smallest tables."""

import re
import sys
import zlib

import duckdb
import numpy as np
import pytest

from orrery.llm import queries, sentencepieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    place = sorted(got.columns)
    plain = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert plain(got.select(*place).collect()) == plain(duck.sql(f"SELECT {', '.join(place)} FROM ({queries.ORACLES[name]})").fetchall())


def test_toxicity_query(spark, duck):
    rows = {r.doc_id: r for r in queries.op2_toxicity(spark, SF).collect()}
    assert len(rows) == duck.sql("select count(*) from documents").fetchall()[0][0]
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    truth = duck.sql("select l.doc_id, toxic from labels l join documents using (doc_id) where toxic is not null").fetchall()
    assert np.mean([rows[i].predicted == t for i, t in truth if rows[i].held_out]) >= 0.9


def test_graph_query_finds_the_nearest(spark, duck):
    vectors = duck.sql("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, x = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors], dtype=float)
    got = queries.op3_graph_search(spark, SF).toPandas()
    assert sorted(got.query_id.unique()) == [i for i in ids if i % 20 == 0]
    hits = 0
    for q, part in got.groupby("query_id"):
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))][: min(20, len(ids) - 1)]
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, len(best) + 1)) and part.score.is_monotonic_decreasing
        hits += len(set(best) & set(part.vec_id)) / len(best)
    assert hits >= 0.9 * got.query_id.nunique()


def test_mixing_query(spark, duck):
    rows = queries.op4_mixing(spark, SF).collect()
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    assert len(rows) == len(texts)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r["size"] and (r.first_slot is None) == (r.copies == 0) for r in rows)


def test_pseudonym_query(spark, duck):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    rows = queries.op1_pii(spark, SF).collect()
    assert len(rows) == len(texts) and all((r.text != texts[r.doc_id]) == (r.n_private > 0) == bool(r.private_kinds) for r in rows)
    assert any(r.n_private for r in rows) and all(len(r.text) == len(texts[r.doc_id]) for r in rows if texts[r.doc_id] is not None and "date" not in r.private_kinds and "ip" not in r.private_kinds)


def test_scan_scores_and_pieces_queries(spark, duck):
    n = duck.sql("select count(*) from documents").fetchall()[0][0]
    scan, scores, pieces = (queries.QUERIES[q](spark, SF).collect() for q in ("op6_license_scan", "op7_lm_scoring", "op9_sentencepiece"))
    assert len(scan) == len(scores) == len(pieces) == n
    words = dict(duck.sql(r"select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) from documents").fetchall())
    assert all(r.n_words == words[r.doc_id] for r in scan) and all(r.n_words == words[r.doc_id] and (r.logprob < 0) == (r.n_words > 0) for r in scores)
    assert any(r.base_labels for r in scan) and all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in scan)
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    assert all(r.round_trip == ("▁" not in (texts[r.doc_id] or "")) for r in pieces) and sentencepieces.Vocabulary.load().spaces_last


def test_entry_lists_all():
    sys.path.insert(0, ".")
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) < names and "pipeline" in names and len(queries.QUERIES) == 13
