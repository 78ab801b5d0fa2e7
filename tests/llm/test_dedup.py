"""Jaccard join, components, E8 dedup and graph search against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import embedding_dedup, graph_search, jaccard_join, shared
from orrery.llm.components import clashes, connected_components, renumbered

SF = "/root/testdata/sf0.001"


def components_of(edges, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_of(edges, {x for e in edges for x in e})


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_jaccard(rows, width, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components_of(edges, sets).items()}


@pytest.mark.parametrize("width, percent, block", [(3, 90, 256), (5, 80, 256), (5, 80, 4), (2, 100, 256)])
def test_jaccard_join_is_exact(spark, width, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # small blocks: several tiles a family, and crowds
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(words) for _ in range(rng.randrange(1, 200))] for _ in range(25)]
    passage = [rng.choice(words) for _ in range(60)]
    for i in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, len(text) // 20])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text[len(text) // 2 : len(text) // 2] = passage
        rows.append((i, " ".join(text).upper() if rng.random() < 0.2 else " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    assert got == brute_jaccard(rows, width, percent)


def test_jaccard_join_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 3, 90).collect()}
    assert got == brute_jaccard([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 3, 90)


def test_jaccard_join_edge_cases(spark):
    same = "a b c d e f g"
    docs = spark.createDataFrame([(1, same, 0), (1, same, 1), (None, None, 2), (2, "", 3), (2, "", 4), (3, None, 5), (4, same.upper(), 6), (5, "x", 7)], "doc_id long, text string, node long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 0, None), (2, 0, 2), (2, 0, 2), (3, 0, 3), (4, 3, 1), (5, 1, 5)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_first(docs).collect()), key=str)
    assert kept == sorted([(1, same), (2, ""), (2, ""), (3, None), (None, None), (5, "x")], key=str)
    assert jaccard_join.jaccard_components(docs.limit(0)).collect() == []


def test_keep_first_judges_each_text_of_a_doc_id(spark):
    copied, unique, other, lone = ("a b c d e f g", "h i j k l m n o", "p q r s t u v", "w x y z 1 2 3")
    rows = [
        (3, copied), (7, copied.upper()), (7, unique), (7, unique), (8, None), (8, ""), (8, other),
        (None, copied), (None, lone), (None, lone), (None, lone.upper()), (None, None), (None, " "), (9, lone + " 4"),
    ]
    docs = spark.createDataFrame([(*r, {"at": i}) for i, r in enumerate(rows)], "doc_id long, text string, extra map<string,int>")
    kept = jaccard_join.keep_first(docs, percent=70)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, copied), (7, unique), (8, None), (8, ""), (8, other), (None, None), (None, " "), (9, lone + " 4")], key=str)
    nameless = sorted(r.text for r in jaccard_join.keep_first(docs.where("doc_id is null and text is not null")).collect())
    assert len(nameless) == 3 and {t.lower() for t in nameless} == {copied, lone, " "}


def test_jaccard_join_of_many_repeated_rows(spark):
    """Repeated rows, also without doc_id, are one set of a tile; as one more near copy."""
    text = "a b c d e f g h i j k l m n o p q r s t"
    docs = spark.range(300).select(F.when(F.col("id") < 150, F.lit(5)).alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(9, text + " u")], "doc_id long, text string"))
    rows = jaccard_join.jaccard_components(docs, 3, 90).collect()
    assert len(rows) == 301 and {r.component_id for r in rows} == {5}


@pytest.mark.parametrize("width, percent", [(3, 60), (2, 100)])
def test_jaccard_join_of_clashing_sets(spark, width, percent, monkeypatch):
    """Sets that share their first number (three bits here) are told apart by the second one, everywhere."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "CROWD", 1)
    rng = random.Random(8)
    base = [[f"w{rng.randrange(90)}" for _ in range(30)] for _ in range(9)]
    rows = []
    for i in range(70):
        text = list(rng.choice(base))
        text[rng.randrange(30)] = f"w{rng.randrange(90)}"
        rows.append((i, " ".join(text)))
    rows += [(100, rows[0][1]), (101, "short"), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, width, percent, bits=3).collect()}
    assert got == brute_jaccard(rows, width, percent) and len({c for _, c in got.values()}) > 5


def test_jaccard_join_refuses_percentages(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    for percent in (0, 101):
        with pytest.raises(ValueError):
            jaccard_join.jaccard_components(docs, 3, percent)


def test_numbers_that_clash(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5), (None, 1)], "number long, check long")
    found = clashes(rows, "number", "check")
    assert {(r.number, r["check"]) for r in found.collect()} == {(1, 5), (1, 6)}
    new = renumbered(rows, found, "number", "check")
    assert new.where("number is not null").select("number").distinct().count() == 3 and new.count() == 5 and new.where("number is null").count() == 1
    assert clashes(rows.where("check = 5"), "number", "check") is None


def test_part_keys_lose_no_link():
    rng = np.random.default_rng(5)
    none = np.zeros(jaccard_join.COUNTS, bool)
    for trial in range(300):
        n = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, n // 9)))
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, max(0, n // 9 - drop), dtype=np.uint64))))
        common = none if trial % 2 else rng.random(jaccard_join.COUNTS) < rng.random()
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 80 * (len(a) + len(b) - inter) and not np.array_equal(a, b):
            assert len(np.intersect1d(jaccard_join.part_keys(a, 80, common), jaccard_join.part_keys(b, 80, common)))


def test_bitmap_never_denies(spark):
    ids = spark.range(500).select(F.xxhash64("id").alias("h"))
    bits = shared.id_bits(ids, F.col("h"), 500)
    assert shared.maybe_in(bits, ids.toPandas()["h"].to_numpy()).all()
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    assert shared.maybe_in(bits, others).mean() < 0.1


def test_e8_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)) * 2
    near, other = embedding_dedup.nearest_e8(x)
    far = ((x - near / 2) ** 2).sum(1)
    assert (far <= 1 + 1e-9).all() and (far <= ((x - other / 2) ** 2).sum(1) + 1e-12).all()
    assert ((near.sum(1) / 2) % 2 == 0).all() and ((near % 2 == near[:, :1] % 2).all())


@pytest.mark.parametrize("block, bits", [(512, 64), (8, 64), (8, 3)])
def test_embedding_near_dedup(spark, block, bits, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)  # small blocks: crowds, and several tiles of a key
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64))
    rows = []
    for i in range(300):
        v = base[rng.integers(40)] + rng.normal(size=64) * rng.choice([0, 0.02, 0.1, 0.15, 1])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if i % 17 else None))
    rows += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [1.0, None], 1), (1004, [1.0, 0.0], 1), (1005, [2.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("node", "keys", "crowd", "n_links")})
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, bits=bits).collect()}
    ids = [r[0] for r in rows[:300]]
    x = np.array([r[1] for r in rows[:300]])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    pairs = [(i, j) for i in ids for j in ids if i < j and rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
    group = components_of(pairs, ids)
    found = sum(got[i].n_links for i in ids) / 2
    assert found >= 0.9 * len(pairs) and found <= len(pairs)
    if found == len(pairs):
        assert all(got[i].component_id == group[i] and got[i].kept == (group[i] == i) for i in ids)
    assert [got[i].n_links for i in (1000, 1001, 1002, 1003)] == [0] * 4 and got[1000].kept
    assert (got[1004].n_links, got[1005].n_links, got[1005].component_id) == (2, 2, 1004)


def test_embedding_crowd_is_counted_once(spark, monkeypatch):
    """One large group of near copies and one of exact ones, among others that share their keys: each link counts once."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = rng.normal(size=32)
    near = base + rng.normal(size=(90, 32)) * 0.03
    far = base + rng.normal(size=(40, 32)) * 0.16
    x = np.float32(np.concatenate((near, far, np.repeat(near[:1], 25, axis=0)))).astype(float)
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    exact = [i for i in range(90)] + list(range(130, 155))
    assert all(got[i].n_links <= want[i] for i in got) and sum(got[i].n_links for i in exact) >= 0.98 * sum(want[i] for i in exact)
    assert len({got[i].component_id for i in exact}) == 1 and got[0].kept


def test_connected():
    rng = random.Random(3)
    pairs = [(rng.randrange(50), rng.randrange(50)) for _ in range(35)] + [(60 + i, 61 + i) for i in range(30)]
    got = embedding_dedup.connected(100, *np.array(pairs).T)
    want = components_of(pairs, range(100))
    assert got.tolist() == [want[i] for i in range(100)]


def test_graph_search_recall(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(size=(1500, 24)), np.tile(rng.normal(size=(1, 24)), (60, 1))))
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [1.0, float("inf")])]
    got = graph_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=20, shard=800).toPandas()
    x = np.float32(x).astype(float)
    hits = total = 0
    for q, part in got.groupby("query_id"):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -scores))[:20]
        assert list(part.sort_values("rank")["rank"]) == list(range(1, 21)) and q not in set(part.vec_id)
        assert np.allclose(part.sort_values("rank")["score"], (x[part.sort_values("rank")["vec_id"]] * x[q]).sum(1), atol=1e-12)
        hits, total = hits + len(set(best) & set(part.vec_id)), total + 20
    assert got.query_id.nunique() == 78 and hits >= 0.9 * total


def test_graph_search_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-8, 9, (60, 6)).astype(float) + 0.5
    x[50:] = x[0] * 2  # ten ids of one vector
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    many = spark.createDataFrame(rows * 2 + rows[50:51] * 30, "vec_id long, embedding array<float>")
    index, shards = graph_search.build_index(many)
    assert shards == 1 and len(np.frombuffer(index.first()["ids"], np.int64)) == 60
    got = [(r.query_id, r["rank"], r.vec_id) for r in graph_search.nearest(many, F.col("vec_id") % 20 == 0, k=20).collect()]
    want = []
    for q in (0, 20, 40):
        best = [int(i) for i in np.lexsort((np.arange(60), -(x @ x[q]))) if i != q][:20]
        want += [(q, n + 1, i) for n, i in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_graph_search_large_components(spark):
    """Squares that overflow single precision don't break the order; several vectors of one id each count, its query is the least."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(900, 12)) * 1e25
    rows = [(i, [float(np.float32(a)) for a in v], "clash") for i, v in enumerate(x)]
    table = spark.createDataFrame(rows + [(0, [-1e25] * 12, "again"), (0, [-1e25] * 12, "again")], "vec_id long, embedding array<float>, query_id string").withColumns({c: F.lit(3) for c in ("shard", "dim", "rank")})
    got = graph_search.nearest(table, F.col("vec_id") % 100 == 0, k=20).toPandas()
    x = np.float32(x).astype(float)
    x0 = min(x[0].tolist(), np.float32([-1e25] * 12).astype(float).tolist())
    hits = 0
    for q, part in got.groupby("query_id"):
        scores = x @ (np.array(x0) if q == 0 else x[q])
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & set(part.vec_id))
        assert len(part) == 20 and list(part["rank"].sort_values()) == list(range(1, 21))
    assert got.query_id.nunique() == 9 and hits >= 0.9 * 180


def test_graph_search_small_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in graph_search.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert graph_search.nearest(few.limit(0), F.lit(True)).collect() == []
    assert embedding_dedup.near_duplicates(few.withColumn("label", F.lit(1)).limit(0)).collect() == []
