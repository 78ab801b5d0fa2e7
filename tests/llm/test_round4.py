"""What the review of round 4 found in the training-data operators: each would have failed before."""

import numpy as np

from orrery.llm import jaccard_join
from orrery.llm.shared import mix


def test_unlike_sets_of_common_shingles_share_no_key():
    rng = np.random.default_rng(5)
    common = np.ones(jaccard_join.COUNTS, bool)
    for n in (150, 400, 1000, 5000):
        a, b = (jaccard_join.part_keys(np.unique(mix(rng.integers(0, 1 << 63, n).astype(np.uint64))), 80, common) for _ in range(2))
        assert len(a) > n // 5 and not len(np.intersect1d(a, b))


def test_sets_that_share_no_key_are_not_met(spark, monkeypatch):
    """A large family of small groups costs what its groups cost, not the square of its members."""
    monkeypatch.setattr(jaccard_join, "CROWD", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    words = [list(range(1000 * (i % 20), 1000 * (i % 20) + 10)) for i in range(40)]  # i and i + 20 are alike, yet have no key in common
    words[1] = words[0]
    sets = spark.createDataFrame(list(enumerate(words)), "node long, shingles array<long>")
    members = spark.createDataFrame([(i, 0, 10, i, 10) for i in range(40)], "node long, family long, n long, teller long, band long")
    star = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "node long, first long")
    got = {tuple(sorted(r)) for r in jaccard_join._verify(lambda of: sets.join(of.select("node").distinct(), "node"), members, star, 80).collect()}
    assert got == {(0, 1)}


def test_tokens_of_shared_keys(spark, monkeypatch):
    """Four bytes a key are shuffled; no key that several rows have is missed, few others are met."""
    monkeypatch.setattr(jaccard_join, "PACK", 100)
    keys = mix(np.arange(3000, dtype=np.uint64))

    def keys_of(batch):
        i = np.array([int(t) for t in batch.column(0).to_pylist()])
        own = np.concatenate([keys[50 * i + k] for k in range(60)]) if len(i) else keys[:0]  # ten of a row's keys are the next one's
        return np.tile(i, 60)[: len(own)], None, own

    texts = spark.createDataFrame([(str(i), i, i) for i in range(59)], "text string, doc_id long, digest long").repartition(3)
    got = {r.token for r in jaccard_join._shared_tokens(texts, keys_of, 7).collect()}
    shared = keys[[50 * i + k for i in range(1, 59) for k in range(10)]]
    assert got == set(jaccard_join._tokens(jaccard_join._cells(shared, 7), shared).tolist())


def test_texts_that_go_are_not_shuffled(spark, monkeypatch):
    kept, save = [], jaccard_join.save

    def seen(frame):
        kept.append(save(frame))
        return kept[-1]

    monkeypatch.setattr(jaccard_join, "save", seen)
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{words} x{i % 7}") for i in range(60)] + [(90, "alone among them"), (90, "alone among them"), (91, None)], "doc_id long, text string")
    got = sorted((r.doc_id for r in jaccard_join.keep_first(docs, 5, 80).collect()))
    assert got == [0, 90, 91]
    assert kept[-1].count() == 1  # what is looked at again: the row that repeats
