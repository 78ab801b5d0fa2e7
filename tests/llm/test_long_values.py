"""Values as long as whole documents, in every pattern and place that could take them."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import licenses, sentencepieces
from orrery.llm.pii import pseudonymise


@pytest.mark.parametrize(
    "name, text",
    [
        ("labels", "mail x@a" + ".b" * 100_000 + " end"),
        ("name", "y" * 300_000 + "@site.org"),
        ("dotted name", "a." * 150_000 + "b@site.org"),
        ("secret", "password = " + "Ab1_" * 100_000),
        ("digits", "4 " * 200_000),
        ("dates", "2020-01-02/" * 50_000),
        ("dots", "1." * 200_000),
        ("phone", "+49 " * 100_000),
        ("iban", "DE12 " * 100_000),
        ("assignment", "token" + " " * 300_000 + "= x"),
        ("names", "token" * 100_000),
        ("keys", "AKIA" * 100_000),
        ("letters", "q" * 3_000_000),
        ("ats", "@" * 1_000_000),
    ],
)
def test_pseudonyms_of_long_values(spark, name, text):
    docs = spark.createDataFrame([(1, text), (2, "write to ann@site.org")], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in pseudonymise(docs, "k").collect()}
    assert time.time() - began < 60 and rows[2].n_private == 1
    assert rows[1].n_private == (name in ("labels", "name", "dotted name", "secret")) and len(rows[1].text) == len(text)
    if name == "labels":
        assert rows[1].text.endswith("@a" + ".b" * 100_000 + " end") and rows[1].private_kinds == "email"


def test_pieces_of_long_words():
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.default_model())
    rng = random.Random(2)
    texts = ["".join(rng.choices(a, k=n)) for a, n in (("abcdefghijklmnopqrstuvwxyz", 60_000), ("0123456789abcdef", 300_000), ("abé漢ᚠ", 30_000), ("a", 300_001), ("ab ", 50_000))]
    texts += ["x " + texts[0][:4097] + " y", "ab" * 30_000, "   " + texts[1][:9000]]
    ids, counts = sentencepieces.Encoder(sentencepieces.Vocabulary.load()).encode(texts)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == lib.encode([t], num_threads=1)[0]
        at += n


def test_parts_that_share_no_piece(monkeypatch):
    """Overlaps too short to hold a common piece: the unit is merged whole."""
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.default_model())
    for name, value in (("LONG", 8), ("STEP", 3), ("LAP", 1)):
        monkeypatch.setattr(sentencepieces, name, value)
    texts = ["internationalisation" * 3, "aaaaaaaaaaaaaaaaaaaaaaa", "ᚠbᚠéinternational"]
    ids, _ = sentencepieces.Encoder(sentencepieces.Vocabulary.load()).encode(texts)
    assert ids.tolist() == [i for t in texts for i in lib.encode([t], num_threads=1)[0]]


def test_three_megabytes_without_a_space_in_the_pipeline(spark):
    rng = random.Random(4)
    word = "".join(rng.choices("0123456789abcdefABCDEF+/", k=3_000_000))
    docs = spark.createDataFrame([(1, "en", "s", word, 3_000_000), (2, "en", "s", "mail x@a" + ".b" * 50_000, 100_008), (3, "en", "s", "some other words", 16)], "doc_id long, lang string, source string, text string, n_chars long")
    spark.conf.set("spark.orrery.pii.key", "of the tests")
    changed = corpus_pipeline.pseudonymise(spark, docs, "")
    rows = {r.doc_id: r for r in corpus_pipeline.encode(spark, changed, "").collect()}
    assert rows[1].n_pieces > 1_000_000 and rows[2].n_pieces > 50_000 and rows[3].n_pieces == 3


def test_ten_megabytes_of_notices():
    notice = "this is free software under the mit license permission is hereby granted free of charge to any person obtaining a copy of this software "
    scanner = licenses.LicenseScanner(None, None)
    chains = {(k * 30 + a, k * 30 + b, label, n) for k in range(100_000) for a, b, label, n in ((0, 20, "mit", 18), (2, 9, "mit", 7), (0, 20, "bsd", 18), (3, 20, "bsd", 17))}
    began = time.time()
    kept = licenses.outermost(chains)
    assert time.time() - began < 10 and len(kept) == 200_000
    import numpy as np

    data = np.frombuffer((notice * 70_000).encode(), np.uint8)
    began = time.time()
    words, base, spans = scanner.scan(data, np.array([0, len(data)]))
    assert time.time() - began < 30 and len(base[0]) == 70_000 and words[0] == 70_000 * len(notice.split()) and spans[0]


def test_outermost_chains_by_definition():
    rng = random.Random(6)

    def inside(c, d):
        return d[0] <= c[0] and c[1] <= d[1] and (c[3] < d[3] or (c[3] == d[3] and c[2] == d[2] and c[:2] != d[:2]))

    for _ in range(300):
        chains = set()
        for _ in range(rng.randrange(12)):
            a = rng.randrange(10)
            chains.add((a, a + rng.randrange(1, 8), rng.choice("xy"), rng.randrange(1, 4)))
        assert sorted(licenses.outermost(chains)) == sorted(c for c in chains if not any(inside(c, d) for d in chains))
