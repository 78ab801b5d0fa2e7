"""Importance resampling, token files and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import importance, jaccard_join, periodic, queries, token_files
from orrery.llm.shared import mix, new_folder, text_chunks

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", " ", "a", "A b", "é É ñandú", "x" * 5000, "one two three four " * 60, "日本 語 テキスト", "tab\tnew\nline", "1 22 333 1 22 333", "a\x00b c\x7fd", "don't STOP's  <|endoftext|> end  ", "  lead", "trail  \n \n", "a  b　 c", "   x"]


# ---------------------------------------------------------------- importance resampling
def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    return words, words + [a + " " + b for a, b in zip(words, words[1:])]


def ranked(docs, target):
    """The contract, a document at a time."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own, wanted = [0] * 10000, [0] * 10000
    for _, text in docs:
        for f in features(text)[1]:
            own[bucket(f)] += 1
    for text in target:
        for f in features(text)[1]:
            wanted[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(own) + 10000) / ((s + 1) * (sum(wanted) + 10000)))) for s, t in zip(own, wanted)]
    out, able = [], []
    for n, (i, text) in enumerate(docs):
        words, all_ = features(text)
        weight = sum(gain[bucket(f)] for f in all_) // len(all_) if all_ else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= 20:
                able.append((-score, i, len(all_), weight, n))
        out.append([i, len(all_), weight, score, None])
    for rank, row in enumerate(sorted(able)[: 25 * len(able) // 100], 1):
        out[row[-1]][4] = rank
    return out


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_importance_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op11_importance_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = ranked(docs, target)
    assert plain(got.collect()) == plain(want) and sum(r[4] is not None for r in want) > 10


def test_importance_edges(spark):
    long = " ".join(f"w{k % 37}" for k in range(50_000))
    docs = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (None, "no id " * 30), (101, long), (5, "again " * 25), (5, "again " * 25), (5, "other words " * 25), (102, "word " * 19), (103, "word " * 20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([("w1 w2 w3 again",), (None,)], "text string")
    want = ranked(docs, ["w1 w2 w3 again", None])
    assert plain(importance.importance_ranks(frame, target).collect()) == plain(want)
    assert plain(importance.importance_ranks(frame, target.limit(0)).collect()) == plain(ranked(docs, []))
    assert importance.importance_ranks(frame.limit(0), target).collect() == []
    everything = importance.importance_ranks(frame, target, share=100, least=0).where("rank is not null").collect()
    assert sorted(r["rank"] for r in everything) == list(range(1, len(docs)))  # all but the one without id
    clash = frame.selectExpr("doc_id", "text", "1 as score", "2 as _row", "3 as rank")
    drawn = importance.resample(clash, target)
    assert drawn.columns == clash.columns and sorted(map(tuple, drawn.select("doc_id", "text").collect())) == sorted((d[0], d[1]) for d, w in zip(docs, want) if w[4])


def test_importance_many_equal_rows(spark):
    """Rows that repeat an id and a text share a score; they are ranked one after another without meeting in a task."""
    frame = spark.range(200_000).selectExpr("9 as doc_id", "repeat('same words ', 12) as text")
    got = importance.importance_ranks(frame, spark.createDataFrame([("same",)], "text string"))
    assert [tuple(r) for r in got.selectExpr("count(*)", "count(rank)", "min(rank)", "max(rank)", "count(distinct rank)").collect()] == [(200_000, 50_000, 1, 50_000, 50_000)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1é -\x00z", max_size=200), min_size=1, max_size=5), st.integers(1, 3))
def test_feature_buckets(texts, width):
    for _, _, data, offsets in text_chunks(pa.array(texts)):
        words, found = importance.feature_buckets(data, offsets, width, 997)
        got = [[] for _ in texts]
        for at, have in found:
            for k, part in enumerate(np.split(at, np.cumsum(have)[:-1])):
                got[k] += part.tolist()
        for k, t in enumerate(texts):
            w = features(t)[0]
            assert words[k] == len(w) and got[k] == [zlib.crc32(" ".join(w[i : i + n]).encode()) % 997 for n in range(1, width + 1) for i in range(len(w) - n + 1)]


# ---------------------------------------------------------------- token files
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_tokenizer())


def coded(library, docs):
    """The contract, a document at a time."""
    out, start = [], 0
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == coded(library, docs)


def test_pieces_are_those_of_the_library(library, monkeypatch):
    """Any mixture of letters, digits, signs, white space and the special token; also when pieces are forgotten all the time."""
    rng = random.Random(5)
    parts = ["a", "b", "Z", "é", "ß", "×", "÷", "ñ", "1", "9", "'", "s", "t", "re", "ll", "!", "_", "-", ".", ",", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2009", "日", "本", "ж", "\u0301", "\x7f", "\x00", "\x1c", "\x85", "😀", "<|", "½", "²", "ª", "º", "µ", "Ā"]
    with open(token_files.default_tokenizer(), encoding="utf-8") as f:
        encoder = token_files.Encoder(f.read())
    monkeypatch.setattr(token_files, "CHUNK", 5000)
    for known, more in ((800_000, []), (3000, []), (800_000, ["<|endoftext|>"])):
        monkeypatch.setattr(token_files, "KNOWN_PIECES", known)
        texts = ["".join(rng.choices(parts + more, k=rng.randrange(40))) for _ in range(4000)]
        got = []
        for _, ids, counts in encoder.encode(pa.array(texts)):
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_token_edges(spark, library):
    rng = random.Random(3)
    words = ["the", "and", "x" * 300, "\n\n", "   ", "é", "n't", "12", "#!?", "\t", "日本", " ", "　", "<|endoftext|>", "\r\n", "\x1c", "\x85"]
    docs = [(k, t) for k, t in enumerate(ODD)] + [(50, None), (None, "no id"), (7, "same id"), (60, "".join(rng.choices(words, k=20_000))), (61, "y" * 300_000)]
    docs += [(70 + k, "".join(rng.choice([" ", ""]) + rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' as start", "1 as ids")
    folder = new_folder(spark, "tokens")
    manifest = token_files.write_tokens(frame, folder, file_bytes=20_000)
    want = coded(library, docs)
    want[8:10] = sorted(want[8:10], key=lambda r: r[2:])  # two rows share an id: their order is that of a hash of their texts
    got = sorted(map(tuple, token_files.token_digests(spark, folder).collect()), key=lambda r: r[1])
    assert len(manifest["files"]) > 4 and [r[0] for r in got] == [r[0] for r in want]
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((r[0] or -1, r[2], r[3]) for r in want)
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    lists = {r.start: r.ids for r in token_files.read_tokens(spark, folder).collect()}
    assert all(zlib.crc32(np.array(lists[s], "<u4").tobytes()) == c and len(lists[s]) == n for _, s, n, c in got)
    loader = token_files.Dataset(folder)
    flat = np.concatenate([lists[s] for s in sorted(lists)])
    assert len(loader) == len(docs) and all((loader[k] == lists[r[1]]).all() for k, r in enumerate(got[:40]))
    for start, size in ((0, 10), (1000, 5000), (len(flat) - 3, 10), (0, len(flat)), (len(flat), 5)):
        assert (loader.window(start, size) == flat[start : start + size]).all()
    with pytest.raises(IndexError):
        loader[len(docs)]


def test_token_empty_and_repeated(spark):
    folder = new_folder(spark, "tokens")
    assert token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder)["files"] == []
    assert token_files.token_digests(spark, folder).collect() == [] and len(token_files.Dataset(folder)) == 0
    folder = new_folder(spark, "tokens")
    manifest = token_files.write_tokens(spark.range(5000).selectExpr("3 as doc_id", "repeat('many copies ', 9) as text"), folder)
    assert len(manifest["files"]) > 2 and manifest["documents"] == 5000  # one id, several files
    starts = [r.start for r in token_files.token_digests(spark, folder).orderBy("start").collect()]
    assert starts == [k * manifest["ids"] // 5000 for k in range(5000)]


def test_damaged_token_files(spark, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = token_files.write_tokens(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), folder)
    name = manifest["files"][0]["file"]
    (tmp_path / f"{name}.bin").write_bytes((tmp_path / f"{name}.bin").read_bytes()[:-2])
    with pytest.raises(ValueError, match="as long as"):
        token_files.Dataset(folder)[0]
    (tmp_path / f"{name}.idx").write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="isn't an index"):
        token_files.Dataset(folder)[0]


# ---------------------------------------------------------------- periodic runs
def runs_by_definition(words, times=4, shortest=6):
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            e = i + p
            if e - s >= max(shortest, times * p) and not any(all(words[k] == words[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
    return sorted(out)


def digest(i, text):
    """The contract, a document at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = runs_by_definition(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


def test_runs_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r[0]: tuple(r) for r in got.collect()}
    assert len(rows) == len(docs) and sum(r[1] for r in rows.values()) > 3
    for i, text in docs:
        if len(text or "") < 12_000:  # the definition takes the square of a text's length
            assert rows[i] == digest(i, text)


def test_runs_edges(spark):
    docs = [(k, t) for k, t in enumerate(ODD)] + [(20, None), (None, "a b " * 9), (21, "a " * 6), (22, "a " * 5), (23, "x " + "a b a b c " * 5 + "a b"), (24, "a b c d " * 4), (25, "q " * 3000), (26, "\x0b".join("ab" * 9) + "\x1cz")]
    docs += [(25, "q " * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as runs", "7 as other")
    found = periodic.find_runs(frame)
    assert found.columns == ["doc_id", "text", "other", "n_words", "runs", "collapsed"]
    rows = {}
    for r in found.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert [tuple(x) for x in r.runs] == (runs_by_definition(words) if len(words) < 500 else [(0, len(words), 1)]) and r.n_words == len(words)
        rows[r.doc_id] = r
    assert rows[25].collapsed == "q" and rows[20].collapsed == "" and rows[22].collapsed == "a a a a a" and rows[24].collapsed == "a b c d"
    planted = periodic.run_digests(periodic.find_runs(periodic.plant_repeats(frame.where("doc_id is null or doc_id <> 25"))))
    assert plain(planted.collect()) == plain(digest(i, t) for i, t in docs if i != 25)
    assert periodic.find_runs(frame.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.integers(1, 7), st.integers(2, 9))
def test_runs_equal_their_definition(texts, times, unit):
    texts = [t + t[-unit:] * times for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = periodic.runs_of(np.array([x for t in texts for x in t], dtype=np.int32), offsets)
    assert [got.get(k, []) for k in range(len(texts))] == [runs_by_definition(t) for t in texts]


def test_runs_of_long_texts_are_quick():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50_000, 1_000_000)
    words[300_000:700_000] = np.tile(words[300_000:300_007], 60_000)[:400_000]
    words[800_000:900_000] = np.tile(words[800_000:810_000], 10)
    got = periodic.runs_of(words.astype(np.int32), np.array([0, len(words)]))[0]
    assert {(s, q) for s, _, q in got} == {(300_000, 7), (800_000, 10_000)}


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """2,600 clean documents whose words occur three times each, in groups: every word counts, in whatever order rows come."""
    from pyspark.sql import functions as F

    from orrery.llm import shared, toxicity

    word = lambda i: "w" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    docs = [(i, f"{word(i % 900)} {'vermin' if i % 13 == 0 else 'plain'} text", "en" if i % 3 else "fr") for i in range(2800)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    y = spark.createDataFrame([(i, int(i % 13 == 0)) for i, _, _ in docs], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "GROUP_ROWS", 500)
    model = toxicity.fit(d, y)
    back = {r.doc_id for r in d.where(F.pmod(F.xxhash64(F.lit(toxicity.HELD_BACK), "doc_id"), F.lit(toxicity.HELD_BACK)) == 0).collect()}
    held = {}
    for i, text, _ in docs:
        for w in text.split() if i not in back else ():
            held[w] = held.get(w, 0) + 1
    want = {int(shared.hash_word(w) >> 32) for w, n in held.items() if n >= 3}
    assert len(want) > 500 and want <= set(model.vocabulary.tolist())
    scores = {r.doc_id: (r.toxicity >= 0.5) == (r.doc_id % 13 == 0) for r in toxicity.score(d, model).collect()}
    assert np.mean(list(scores.values())) >= 0.99
    again = toxicity.fit(d.orderBy(F.desc("doc_id")).repartition(3), y)
    assert again.thresholds == model.thresholds and np.array_equal(again.embedding, model.embedding) and np.array_equal(again.output, model.output)
    monkeypatch.setattr(toxicity, "OWN", 50)
    monkeypatch.setattr(toxicity, "SHARED", 64)
    small = toxicity.fit(d, y)
    assert len(small.vocabulary) == 50 and len(small.embedding) == 50 + 64 + 1 and small.rows_of(np.array([12345], np.uint32))[0] > 50


# ---------------------------------------------------------------- near-duplicate join: part keys
def test_part_keys_are_packed(monkeypatch):
    monkeypatch.setattr(jaccard_join, "PACK", 50)
    rng = np.random.default_rng(3)
    key = mix(np.concatenate([rng.integers(0, 300, 900), np.full(400, 7)]).astype(np.uint64))  # a hot key, too
    node = rng.integers(-1000, 1000, len(key))
    want = {}
    for k, x in zip(key.view(np.int64).tolist(), node.tolist()):
        low, high = want.get(k, (x, x))
        want[k] = min(low, x), max(high, x)
    got, cells = {}, {}
    for batch in jaccard_join._packed(key, node, 5):
        assert 0 < sum(len(x) for x in batch.column(1).to_pylist()) <= 8 * 50
        for cell, keys, nodes in zip(*(c.to_pylist() for c in batch.columns)):
            for k, x in zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(nodes, np.int64).tolist(), strict=True):
                assert cells.setdefault(k, cell) == cell and 0 <= cell < 5
                got.setdefault(k, []).append(x)
    assert {k: (min(x), max(x)) for k, x in got.items()} == want and all(len(x) == len(set(x)) <= 2 for x in got.values())
    assert len(set(cells.values())) == 5
    none = np.zeros(0, np.uint64)
    assert list(jaccard_join._packed(none, none.view(np.int64), 5)) == []


def test_no_row_stands_for_a_single_key(spark, monkeypatch):
    """Which keys several sets share is found without a JVM row or hash table entry for each key."""
    plans, save = [], jaccard_join.save

    def seen(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return save(frame)

    monkeypatch.setattr(jaccard_join, "save", seen)
    words = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(words[i // 2 :])) for i in range(40)] + [(90, None), (91, ""), (92, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 5, 80).collect()}
    assert got == {i: 0 for i in range(40)} | {i: i for i in (90, 91, 92)}
    assert not [p for p in plans if "Aggregate [key" in p]
