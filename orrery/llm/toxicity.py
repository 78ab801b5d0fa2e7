"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Features: ASCII-lower-cased words of letters. Every word has three hashes (itself, its
first four and its first six bytes); each hash that enough training documents hold owns an
embedding, all others are zero, and a word's vector is the sum. Filters of widths 1, 2 and
3 run over whole texts, each filter keeps its maximum over the text, and a logistic layer
makes the score. Labels, language, source and identifiers are never inputs of the score.

Training uses every labelled row, in Spark. Rows are dealt by a hash of doc_id into groups of about GROUP_ROWS;
documents that hold a hash, and toxic ones among them, are counted over all rows. In each of ROUNDS rounds every
group trains a copy of the model (a task, numpy, Adam), and what the copies moved is averaged: an
embedding over the groups that moved it, all else over all groups, as sums of whole numbers, so
that order doesn't matter. The model's size is fixed: the OWN most frequent hashes own
embeddings, all others share SHARED ones if there are more. Only counts and sums reach the driver.

Thresholds by language: a fifth of the labelled rows takes no part in training. On all of it, the cut with the
fewest mistakes is sought (scores in BINS steps), where a language's own rows count fully and those of all languages
together as much as PRIOR_ROWS rows: so few rows of a language move its threshold a little, many
decide it.

Nulls and edges: a null or empty text scores as a text without words; a null label trains
nothing; a document labelled twice with different values counts as toxic; of several texts of one
doc_id the least trains; repeated rows are each scored alike, ties at a threshold count as toxic; no
labels at all, or one class only, score every text with that class's share (0.5 if none); an empty
table returns no rows; other columns stay out whatever their names, and one called like the score
gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from orrery.llm.shared import byte_class, fresh, id_bits, maybe_in, remove, save, span_hashes, text_chunks, word_spans

ALPHA = byte_class("alpha")
WIDTHS = (1, 2, 3)
SLOTS = 1 << 21
PADS = max(WIDTHS) - 1
PRIOR_ROWS, HELD_BACK = 40, 5  # rows of all languages beside a language's own; one in so many labelled rows calibrates
GROUP_ROWS, GROUP_BYTES, ROUNDS = 4096, 1 << 26, 2
OWN, SHARED, BINS = 1 << 17, 1 << 14, 1 << 12
UNIT = float(1 << 32)  # what models moved is summed in whole numbers of 1 / UNIT


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x 3) 32-bit hashes of word, four-byte prefix and six-byte prefix, and words per row."""
    starts, ends, counts = word_spans(data, offsets, ALPHA)
    hashes = span_hashes(data)
    out = np.empty((len(starts), 3), dtype=np.uint32)
    for k, size in enumerate((None, 4, 6)):
        h = hashes(starts, ends if size is None else np.minimum(ends, starts + size))
        out[:, k] = (h >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x9E3779B9 * k & 0xFFFFFFFF)
    return out, counts


@dataclass
class ToxicityModel:
    """vocabulary: sorted known hashes; embedding row 0 is zero, row i + 1 belongs to hash i; `shared` more rows belong to all other hashes."""

    vocabulary: np.ndarray
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width * dim, filters)
    bias: dict[int, np.ndarray]
    output: np.ndarray
    offset: float
    prior: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)
    shared: int = 0

    def __post_init__(self) -> None:
        self._slots = None

    def __getstate__(self):
        return self.__dict__ | {"_slots": None}

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding rows; 0, or a shared row, for unknown hashes. A direct table; words that share a slot are found by search."""
        if not len(self.vocabulary):
            return np.zeros(hashes.shape, dtype=np.int32)
        if self._slots is None:
            self._slots = np.zeros(SLOTS, dtype=np.int32)
            slot = self.vocabulary % np.uint32(SLOTS)
            self._slots[slot] = np.arange(1, len(slot) + 1)
            self._crowded = np.zeros(SLOTS, dtype=bool)
            self._crowded[np.flatnonzero(np.bincount(slot, minlength=SLOTS) > 1)] = True
        slot = hashes % np.uint32(SLOTS)
        row = self._slots[slot]
        row = np.where((row > 0) & (self.vocabulary[np.maximum(row, 1) - 1] == hashes), row, 0)
        many = np.nonzero(self._crowded[slot])
        if len(many[0]):
            wanted = hashes[many]
            at = np.minimum(np.searchsorted(self.vocabulary, wanted), len(self.vocabulary) - 1)
            row[many] = np.where(self.vocabulary[at] == wanted, at + 1, 0)
        if self.shared:
            row = np.where(row > 0, row, len(self.vocabulary) + 1 + (hashes % np.uint32(self.shared)).astype(np.int32))
        return row

    def pooled(self, rows: np.ndarray, counts: np.ndarray):
        """Every filter's maximum over each text (docs x filters), with what training needs."""
        padded = counts + PADS
        begin = np.cumsum(padded) - padded
        place = np.arange(len(rows)) + np.repeat(np.arange(len(counts)) * PADS, counts)
        at = np.zeros((int(padded.sum()) + PADS, 3), dtype=np.int32)
        at[place] = rows
        vector = self.embedding[at[:, 0]]
        vector += self.embedding[at[:, 1]]
        vector += self.embedding[at[:, 2]]
        dim, n = self.embedding.shape[1], int(padded.sum())
        out = []
        for w in WIDTHS:
            act = vector[:n] @ self.filters[w][:dim]
            for k in range(1, w):
                act += vector[k : n + k] @ self.filters[w][k * dim : (k + 1) * dim]
            out.append(act)
        act = np.concatenate(out, axis=1)
        return np.maximum.reduceat(act, begin, axis=0), (at, vector, act, begin, padded)

    def logits(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(rows, counts)
        return np.maximum(best + np.concatenate([self.bias[w] for w in WIDTHS]), 0) @ self.output + self.offset

    def scores(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(counts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(rows, counts), -40, 40).astype(np.float64)))


def _features(column) -> list[np.ndarray]:
    """Every text's (words x 3) hashes."""
    out = []
    for i, j, data, offsets in text_chunks(column):
        feats, counts = word_features(data, offsets) if len(data) else (np.zeros((0, 3), np.uint32), np.zeros(j - i, np.int64))
        out += np.split(feats, np.cumsum(counts)[:-1])
    return out


def untrained(known: np.ndarray, seen: np.ndarray, hits: np.ndarray, share: float, shared: int = 0, dim: int = 16, filters: int = 8, seed: int = 7) -> ToxicityModel:
    """The model that training starts from. seen, hits: documents that hold each known hash (then each shared row), and toxic ones among them."""
    rng = np.random.default_rng(seed)
    model = ToxicityModel(known, np.zeros((len(seen) + 1, dim), np.float32), {}, {w: np.full(filters, -0.5, np.float32) for w in WIDTHS}, np.zeros(0), 0.0, share, shared=shared)
    # the first coordinate starts as how far a hash's documents are from the classes' shares, the others as noise
    rate_of = hits.sum() / max(seen.sum(), 1)
    model.embedding[1:] = rng.normal(0, 0.02, (len(seen), dim))
    model.embedding[1:, 0] = np.clip((hits - seen * rate_of) / np.sqrt(seen * rate_of + 1), -2, 8) / 4
    for w in WIDTHS:
        model.filters[w] = rng.normal(0, 0.5 / np.sqrt(w * dim), (w * dim, filters)).astype(np.float32)
        model.filters[w][::dim] += 0.5
    model.output = np.abs(rng.normal(0, 0.2, filters * len(WIDTHS))).astype(np.float32)
    model.offset = float(np.log(share / (1 - share)))
    return model


def train(model: ToxicityModel, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 4, seed=7, rate: float = 0.01, drop: float = 0.25) -> ToxicityModel:
    """Fit the model, in place, on documents' (words x 3) hashes."""
    dim, filters, rng = model.embedding.shape[1], len(model.bias[WIDTHS[0]]), np.random.default_rng(seed)
    rows = [model.rows_of(d) for d in docs]
    state: dict[str, list] = {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, step: int, at=slice(None)) -> None:
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)

    step, offset = 0, np.array([model.offset], np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(order) // 48)):
            step += 1
            counts = np.array([len(rows[i]) for i in part])
            seen_rows = np.concatenate([rows[i] for i in part])
            seen_rows = seen_rows * (rng.random((len(seen_rows), 1)) >= drop)  # words left out of this step
            best, (at, vector, act, begin, padded) = model.pooled(seen_rows, counts)
            bias = np.concatenate([model.bias[w] for w in WIDTHS])
            hidden = np.maximum(best + bias, 0)
            score = 1 / (1 + np.exp(-np.clip(hidden @ model.output + offset[0], -40, 40)))
            miss = (score - labels[part]).astype(np.float32) / len(part)
            inner = (miss[:, None] * model.output) * (hidden > 0)
            adam("o", model.output, hidden.T @ miss + 1e-4 * model.output, step)
            adam("c", offset, np.array([miss.sum()], np.float32), step)
            where = np.stack([begin[d] + np.argmax(act[begin[d] : begin[d] + padded[d]], axis=0) for d in range(len(part))])
            touched, sums = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * filters, (k + 1) * filters)
                g, peak = inner[:, cols], where[:, cols]
                window = np.concatenate([vector[peak + j] for j in range(w)], axis=2)  # docs x filters x (w * dim)
                back = np.einsum("df,df...->df...", g, np.broadcast_to(model.filters[w].T, window.shape))
                for j in range(w):
                    for column in range(3):
                        touched.append(at[(peak + j).ravel(), column])
                        sums.append(back[:, :, j * dim : (j + 1) * dim].reshape(-1, dim))
                adam(f"f{w}", model.filters[w], np.einsum("df,dfx->xf", g, window) + 1e-4 * model.filters[w], step)
                adam(f"b{w}", model.bias[w], g.sum(0), step)
            touched, sums = np.concatenate(touched), np.concatenate(sums)
            use = touched > 0
            if use.any():
                some, back_to = np.unique(touched[use], return_inverse=True)
                grad = np.zeros((len(some), dim), np.float32)
                np.add.at(grad, back_to, sums[use])
                adam("e", model.embedding, grad + 1e-4 * model.embedding[some], step, some)
    model.offset = float(offset[0])
    return model


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A table of all labelled documents, one text each: group, place (order in it), y, lang, back (held back), text."""
    truth = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))
    n, size = truth.count(), docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    group = F.pmod(F.xxhash64(F.lit(GROUP_ROWS), "_id"), F.lit(max(1, -(-n // GROUP_ROWS), -(-size // GROUP_BYTES)))).cast("int").alias("_g")
    back = (F.pmod(F.xxhash64(F.lit(HELD_BACK), "_id"), F.lit(HELD_BACK)) == 0).alias("_back")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    bits = docs.sparkSession.sparkContext.broadcast(id_bits(truth, F.xxhash64("_id"), n))

    @F.pandas_udf("boolean")
    def maybe(hashed: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(bits.value, hashed.to_numpy()))

    own = docs.select("text", F.col("doc_id").alias("_id"), lang).where(F.col("_id").isNotNull()).where(maybe(F.xxhash64("_id")))

    def run(texts, marks):
        least: dict = {}
        order = lambda row: (row[0] is not None, row[0] or "", row[1] is not None, row[1] or "")
        for i, *row in zip(texts.column("_id").to_pylist(), texts.column("text").to_pylist(), texts.column("lang").to_pylist(), strict=True):
            if i not in least or order(row) < order(least[i]):
                least[i] = row
        found = sorted((m for m in marks.select(["_id", "_y", "_g", "_back"]).to_pylist() if m["_id"] in least), key=lambda m: m["_id"])
        cols = [[m["_g"] for m in found], range(len(found)), [m["_y"] for m in found], [least[m["_id"]][1] for m in found], [m["_back"] for m in found], [least[m["_id"]][0] for m in found]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["group", "place", "y", "lang", "back", "text"])

    both = own.select("*", group).groupBy("_g").cogroup(truth.select("*", group, back).groupBy("_g"))
    out = save(both.applyInArrow(run, "group int, place int, y int, lang string, back boolean, text string"))
    bits.unpersist()
    return out


def _counts(rows: DataFrame, min_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes that own an embedding, sorted; documents and toxic documents of each, then of each shared row; how many rows are shared."""

    def run(batches):
        for batch in batches:
            feats = [np.unique(f) for f in _features(batch.column(1))]
            h, at = np.unique(np.concatenate(feats), return_inverse=True)
            y = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(f) for f in feats])
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.bincount(at, minlength=len(h))), pa.array(np.bincount(at, y, len(h)).astype(np.int64))], names=["h", "seen", "hits"])

    counts = rows.select("y", "text").mapInArrow(run, "h long, seen long, hits long").groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits")).where(F.col("seen") >= min_docs)
    most = counts.orderBy(F.desc("seen"), "h").limit(OWN + 1).toArrow()
    own, shared = most.slice(0, OWN).sort_by("h"), SHARED if len(most) > OWN else 0
    known, seen, hits = (own.column(c).to_numpy() for c in ("h", "seen", "hits"))
    if shared:
        least = most.slice(OWN - 1, 1).to_pylist()[0]
        rest = counts.where((F.col("seen") < least["seen"]) | ((F.col("seen") == least["seen"]) & (F.col("h") > least["h"])))
        more = np.zeros((2, shared), np.int64)
        for r in rest.groupBy(F.pmod("h", F.lit(shared)).alias("h")).agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits")).toLocalIterator():
            more[:, r["h"]] = r["seen"], r["hits"]
        seen, hits = np.concatenate((seen, more[0])), np.concatenate((hits, more[1]))
    return known.astype(np.uint32), seen, hits, shared


def _dense(model: ToxicityModel) -> np.ndarray:
    """All parameters but the embedding, as rows as wide as it."""
    flat = np.concatenate([*(model.filters[w].ravel() for w in WIDTHS), *(model.bias[w] for w in WIDTHS), model.output, [model.offset]])
    return np.pad(flat, (0, -len(flat) % model.embedding.shape[1])).reshape(-1, model.embedding.shape[1])


def _set_dense(model: ToxicityModel, values: np.ndarray) -> None:
    flat, at = values.ravel(), 0
    for of in (model.filters, model.bias):
        for w in WIDTHS:
            of[w] = flat[at : at + of[w].size].reshape(of[w].shape).astype(np.float32)
            at += of[w].size
    model.output, model.offset = flat[at : at + len(model.output)].astype(np.float32), float(flat[at + len(model.output)])


def _round(rows: DataFrame, model: ToxicityModel, number: int, options: dict) -> None:
    """Every group trains a copy; the model moves by their mean. Row -k of what moved is row k - 1 of `_dense`."""
    held, dim = rows.sparkSession.sparkContext.broadcast(model), model.embedding.shape[1]
    names = [f"d{k}" for k in range(dim)]

    def run(key, table):
        table = table.sort_by("place").combine_chunks()
        start = held.value
        copy = replace(start, embedding=start.embedding.copy(), filters={w: x.copy() for w, x in start.filters.items()}, bias={w: x.copy() for w, x in start.bias.items()}, output=start.output.copy())
        train(copy, _features(table.column("text")), table.column("y").to_numpy().astype(np.float64), seed=[number, key[0].as_py()], **options)
        moved = copy.embedding.astype(np.float64) - start.embedding
        at = np.flatnonzero(moved.any(axis=1))
        dense = _dense(copy) - _dense(start)
        values = np.rint(np.concatenate((dense, moved[at])) * UNIT).astype(np.int64)
        return pa.table([pa.array(np.concatenate((-1 - np.arange(len(dense)), at))), *(pa.array(v) for v in values.T.copy())], names=["at", *names])

    moves = rows.groupBy("group").applyInArrow(run, ", ".join(f"{c} long" for c in ("at", *names)))
    mean = moves.groupBy("at").agg(*[(F.sum(c) / F.count("*") / UNIT).alias(c) for c in names]).toArrow()
    at, values = mean.column("at").to_numpy(), np.stack([mean.column(c).to_numpy() for c in names], axis=1)
    dense = _dense(model)
    dense[-1 - at[at < 0]] += values[at < 0]
    _set_dense(model, dense)
    model.embedding[at[at >= 0]] += values[at >= 0].astype(np.float32)
    held.unpersist()


def fit(docs: DataFrame, labels: DataFrame, min_docs: int = 3, **options) -> ToxicityModel:
    """Train on all rows of docs (doc_id, text, lang) that labels (doc_id, toxic) has. A hash counts if min_docs documents at least hold it."""
    rows = _labelled(docs, labels)
    learn = rows.where("not back")
    n, toxic = learn.agg(F.count("*"), F.sum("y")).first()
    share = toxic / n if n else 0.5
    known, seen, hits, shared = _counts(learn, min_docs) if 0 < share < 1 and n else (np.zeros(0, np.uint32), np.zeros(0), np.zeros(0), 0)
    if not len(known):
        remove(rows)
        return ToxicityModel(known, np.zeros((1, 16), np.float32), {}, {}, np.zeros(0, np.float32), 0.0, share)
    model = untrained(known, seen, hits, share, shared)
    for number in range(ROUNDS):
        _round(learn, model, number, options)
    into = fresh("toxicity", ["lang", "y", "text"])
    scored = score(rows.where("back").select("lang", "y", "text"), model, into)
    held = scored.groupBy("lang", "y", F.least(F.floor(F.col(into) * BINS), F.lit(BINS - 1)).alias("bin")).count().toArrow()
    scores, y, count = (held.column("bin").to_numpy() + 0.5) / BINS, held.column("y").to_numpy(), held.column("count").to_numpy().astype(np.float64)
    langs = np.array(held.column("lang").to_pylist(), dtype=object)
    for lang in sorted({x for x in langs if x is not None}):
        model.thresholds[lang] = best_threshold(scores, y, count * ((langs == lang) + PRIOR_ROWS / count.sum()))
    remove(rows)
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The cut with the fewest weighted mistakes, as near 0.5 as such a cut lies."""
    cuts = np.unique(np.concatenate((scores, [0.5])))
    cuts = np.concatenate(([0.5], (cuts[1:] + cuts[:-1]) / 2))
    order = np.argsort(scores, kind="stable")
    gain = np.concatenate(([0.0], np.cumsum(np.where(labels > 0.5, weights, -weights)[order])))
    wrong = gain[np.searchsorted(scores[order], cuts, side="left")] + np.sum(weights[labels <= 0.5])
    best = cuts[wrong <= wrong.min() + 1e-9]
    return float(best[np.argmin(np.abs(best - 0.5))])


def score(docs: DataFrame, model: ToxicityModel, into: str = "toxicity") -> DataFrame:
    """docs with the column `into` (0 to 1), over whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name.lower() != into.lower()]

    def run(batches):
        model = held.value
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            for i, j, data, offsets in text_chunks(batch.column(batch.schema.get_field_index("text"))):
                feats, counts = word_features(data, offsets) if len(data) else (np.zeros((0, 3), np.uint32), np.zeros(j - i, np.int64))
                made = pa.array(model.scores(model.rows_of(feats), counts).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in own), made], names=[*(f.name for f in kept), into])

    return docs.mapInArrow(run, StructType([*kept]).add(into, DoubleType()))


def threshold_column(model: ToxicityModel, lang: str = "lang"):
    """The threshold of each row's language; 0.5 for languages without one."""
    if not model.thresholds:
        return F.lit(0.5)
    table = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(lang)), F.lit(0.5))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) without the documents whose score reaches their language's threshold."""
    model, into = fit(docs, labels), fresh("toxicity", docs.columns)
    return score(docs, model, into).where(F.col(into) < threshold_column(model)).drop(into)
