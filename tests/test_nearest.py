"""Exact neighbours by pruned blocks, and two hops over works that everybody cites."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import graph, similarity


def brute(x, queries, k, measure):
    out = {}
    usable = [i for i, v in x.items() if v is not None and all(a is not None and np.isfinite(a) for a in v) and (measure == "euclid" or any(v))]
    for q in queries:
        if q in usable:
            score = {}
            for i in usable:
                if i != q and len(x[i]) == len(x[q]):
                    a, b = np.array(x[q]), np.array(x[i])
                    score[i] = a @ b / np.sqrt((a @ a) * (b @ b)) if measure == "cosine" else 1 / (1 + ((a - b) ** 2).sum())
            best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]
            out[q] = [(i, round(score[i], 8)) for i in best]
    return out


@pytest.mark.parametrize("measure", ["euclid", "cosine"])
def test_nearest_is_exact(spark, measure, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_ROWS", 40)
    monkeypatch.setattr(similarity, "QUERY_ROWS", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 8
    x = {i: list(map(float, centres[i % 12] * (1 if i % 3 else 2) + rng.normal(size=6) * rng.choice([0.1, 2]))) for i in range(600)}
    x |= {600 + i: x[i] for i in range(15)}  # ties
    x |= {700: None, 701: [0.0] * 6, 702: [1.0, None, 0, 0, 0, 0], 703: [float("nan")] * 6, 704: [1.0, 2.0], 705: [2.0, 1.0], 706: [1e6] * 6, 707: [1e6 + 1] * 6}
    frame = spark.createDataFrame([(i, [None if a is None else float(a) for a in v] if v is not None else None) for i, v in x.items()], "vec_id long, embedding array<double>")
    for k in (1, 5, 30):
        got = {}
        for r in similarity.nearest(frame, F.col("vec_id") % 20 <= 7, k, measure).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append((r.id, round(r.score, 8)))
        want = brute(x, [i for i in x if i % 20 <= 7], k, measure)
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
        assert all(abs(a - b) < 1e-7 for q in got for (_, a), (_, b) in zip(got[q], want[q], strict=True))
    assert similarity.nearest(frame.limit(0), F.lit(True), 3, measure).collect() == []


def test_far_cells_are_not_looked_at(spark, monkeypatch):
    """Clusters far apart: almost all pairs of blocks are left out, which the rows that are sent show."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 4)) * 1000
    frame = spark.createDataFrame([(i, list(map(float, centres[i % 30] + rng.normal(size=4)))) for i in range(3000)], "vec_id long, embedding array<double>")
    sent, save = [], similarity.save
    monkeypatch.setattr(similarity, "save", lambda f: (sent.append(out), out)[1] if (out := save(f)) is not None else None)
    got = similarity.nearest(frame, F.col("vec_id") % 10 == 0, 5, "euclid")
    assert got.count() == 1500 and all(r.id % 30 == r.query_id % 30 for r in got.collect())
    asked = next(f for f in sent if f.columns == ["id", "v", "cell", "far"])
    assert asked.count() <= 0.15 * 300 * 27


def edges_of(rng, members, works, loved=()):
    out = {(m, w) for m in range(members) for w in rng.sample(range(works), rng.randrange(1, 6))} | {(m, w) for m in range(members) for w in loved}
    return sorted(out)


def test_neighbours_with_works_that_everybody_cites(spark):
    rng = random.Random(9)
    pairs = edges_of(rng, 300, 60, loved=(1000, 1001))
    edges = spark.createDataFrame([(m, w, 1) for m, w in pairs] + [(0, 1000, 1)], "member long, work long, rank int")  # one pair twice
    cites = {m: {w for n, w in pairs if n == m} for m in range(300)}
    for chosen, heavy in ((range(300), 20), (range(0, 300, 50), 20), (range(0, 300, 50), 2000)):
        me = spark.createDataFrame([(m,) for m in chosen], "member long")
        got = {}
        for r in graph.neighbours(edges, me, heavy=heavy).orderBy("member", "place").collect():
            got.setdefault(r.member, []).append((r.neighbour, r.common))
        for m in chosen:
            common = {n: len(cites[m] & cites[n]) for n in cites if n != m}
            assert got[m] == sorted(((n, c) for n, c in common.items() if c), key=lambda x: (-x[1], x[0]))[:10]


def test_tiles_of_a_heavy_work_are_even(spark):
    edges = spark.createDataFrame([(m, 1) for m in range(4000)] + [(m, 2 + m % 900) for m in range(4000)], "other long, work long")
    mine = edges.withColumnRenamed("other", "me")
    left, right = graph.meetings(mine, edges, heavy=100)
    for side, n in ((left, "me"), (right, "other")):
        tiles = [r["count"] for r in side.where("work = 1").groupBy("a", "b").count().collect()]
        assert len(tiles) == 1600 and max(tiles) <= 2 * sorted(tiles)[800] and side.where("work <> 1").count() == 4000 and n in side.columns
    met = Counter((r.work) for r in left.where("me < 40").join(right, ["work", "a", "b"]).collect())
    assert met[1] == 40 * 4000  # each pair once
