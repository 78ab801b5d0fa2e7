"""The corpus pipeline on hand-made documents: every stage against a plain version of what it decides."""

import collections
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm.queries import pii_key
from orrery.llm import mixing, pii, sentencepieces, toxicity

sys.path.insert(0, ".")
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, _found int, ids string, _row int"


def documents(rng):
    words = ["".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(260):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randrange(3, 6) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["zounds", "blackguard", "vermin", "scoundrel"])
        rows.append([i, " ".join(text), rng.choice(["en", "fr"]), rng.choice(["a", "a", "b", None])])
        labels.append((i, int(toxic)))
    clean = [r for r, (_, y) in zip(rows, labels, strict=True) if not y]
    copies = [[1000 + k, clean[k % 5][1], "en", "a"] for k in range(20)] + [[1100 + k, clean[6][1] + f" end{k}", None, "b"] for k in range(4)]
    odd = [[2000, None, None, None], [2001, "", "en", "a"], [2002, " \n", "en", "a"], [None, clean[7][1], "en", "a"], [None, "only here " + " ".join(words[:9]), "en", "a"], [2003, "mail me@mail.example.com or 203.0.113.9 today " + " ".join(words[20:40]), "en", "b"], clean[8], clean[8]]
    rows += copies + odd
    return [(*r, len(r[1]) if r[1] is not None else None, "clash", 1, "clash", 2) for r in rows], labels


def shingled(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = documents(random.Random(21))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, made[-1], folder).write.parquet(f"{folder}/{number}")
        made.append(spark.read.parquet(f"{folder}/{number}"))
    return folder, made


def bag(frame):
    return collections.Counter((r.doc_id, r.text) for r in frame.collect())


def test_stages_keep_the_columns(stages):
    _, made = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "sentencepiece"]
    assert all(m.columns == made[0].columns for m in made[:-1])


def test_toxic_documents_go(spark, stages):
    folder, made = stages
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = bag(made[1])
    assert not kept - bag(made[0])
    verdicts = [(labels[i] == 0) == ((i, t) in kept) for i, t in bag(made[0]) if i in labels]
    assert np.mean(verdicts) >= 0.95 and {(2000, None), (2001, "")} <= set(kept)
    model = toxicity.fit(made[0], spark.read.parquet(f"{folder}/labels.parquet"))
    want = toxicity.score(made[0], model, "s").where(F.col("s") < toxicity.threshold_column(model)).drop("s")
    assert bag(want) == kept


def test_one_document_of_each_group_stays(stages):
    _, made = stages
    before, after = bag(made[1]), bag(made[2])
    assert not after - before
    sets = {k: shingled(k[1]) for k in before}
    kept = [k for k in sets if k in after and sets[k]]
    assert not any(linked(sets[a], sets[b]) for n, a in enumerate(kept) for b in kept[n + 1 :])
    assert all(after[k] == 1 for k in kept) and all(after[k] == before[k] for k in sets if not sets[k])
    group = {k: k for k in sets}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in sets:
        for b in sets:
            if linked(sets[a], sets[b]):
                group[top(a)] = top(b)
    of_kept = [top(k) for k in kept]
    assert len(set(of_kept)) == len(of_kept) and set(of_kept) == {top(k) for k in sets if sets[k]}
    for k in kept:
        named = [m[0] for m in sets if top(m) == top(k) and m[0] is not None]
        assert k[0] == min(named, default=None)


def test_private_values_are_replaced(spark, stages):
    _, made = stages
    before, after = ({r.doc_id: r for r in made[n].where("doc_id is not null").collect()} for n in (2, 3))
    assert before.keys() == after.keys() and sum(before[i].text != after[i].text for i in before) == 1
    text = after[2003].text
    assert "me@mail" not in text and "203.0.113.9" not in text and "@mail.example.com" in text and after[2003].n_chars == len(text)
    assert bag(pii.pseudonymise(made[2], pii_key(spark), count=None, kinds=None)) == bag(made[3])


def test_mix_repeats_documents(stages):
    _, made = stages
    before, after = bag(made[3]), bag(made[4])
    assert set(after) <= set(before) and all(n <= 2 * before[k] for k, n in after.items()) and not any(not (k[1] or "").split() for k in after)
    want = collections.Counter()
    for r in mixing.mixture(made[3]).collect():
        want[r.doc_id] += r.copies
    got = collections.Counter()
    for (i, _), n in after.items():
        got[i] += n
    assert got == +want and sum(after.values()) > 1.1 * sum(bool((t or "").split()) for _, t in before.elements())


def test_pieces_spell_the_texts(spark, stages):
    folder, made = stages
    coded = sentencepieces.decode(made[5]).collect()
    assert collections.Counter((r.doc_id, r.decoded) for r in coded) == bag(made[4]) and all(r.n_pieces == len(r.ids) for r in coded)
    whole = corpus_pipeline.run(spark, folder)
    plain = lambda f: collections.Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in f.collect())
    assert plain(whole) == plain(made[5])


def test_empty_tables(spark, stages, tmp_path):
    folder, _ = stages
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
