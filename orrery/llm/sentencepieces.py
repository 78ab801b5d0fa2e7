"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut into units that no piece crosses (spaces with the word behind them, or single
characters that occur in no longer piece). New units of equal length advance together (of a unit
longer than LONG overlapping parts of it do, see `Encoder._parts`): every
substring's hash probes the sorted keys of the vocabulary, and for each end position the
maximum over the candidate last pieces is taken for all units at once; its length and piece
are the backpointers. Units already seen come from a bounded cache of the task.

Unigram models maximise the sum of scores. BPE models need the segmentation that their merges
produce, which the same recursion finds: a segmentation is the result of the merges exactly if
every two neighbouring pieces are what the merges make of their joined text. So a candidate
gains 0 if it fits the last piece of the best path before it, else minus infinity, and one
candidate is left. Whether two pieces fit is computed once a pair by merging. A run of spaces before a
word is cut off where the model merges spaces last, and laid out in one pass, so its time is linear in
its length. Ids equal those of the sentencepiece library for models without normalisation rules.

Nulls and edges: a null text has null ids and decodes to null; an empty one has none; unknown
characters become byte pieces (or the unknown id, which does not decode, in models without
them); of equal candidates the merges' rule decides (unigram: the shortest last piece); repeated rows
are each coded alike; very long texts are processed whole; an empty table returns no rows; other
columns pass through, but one that has the name of the result (ids, decoded) gives way to it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from orrery.llm.shared import mix

SPACE = 0x2581
CACHE = 1_000_000
MOST_IDS = 1 << 24  # ids of the units that are kept
LONG, STEP, LAP = 4096, 2048, 256  # units of more characters are coded in parts that begin every STEP and overlap by LAP
ROWS = 2_000
_RNG = np.random.Generator(np.random.PCG64(9))
_A = int(_RNG.integers(1 << 62)) | 1
_INVERSE = pow(_A, -1, 1 << 64)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _power(base: int, n: int) -> np.ndarray:
    row = np.full(n, base, dtype=np.uint64)
    row[:1] = 1
    return np.multiply.accumulate(row)


def _values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x51))


class Spans:
    """Hashes of code point ranges along the last axis."""

    def __init__(self, points: np.ndarray):
        n = points.shape[-1]
        self.total = np.zeros((*points.shape[:-1], n + 1), dtype=np.uint64)
        np.cumsum(_values(points) * _power(_A, n), axis=-1, out=self.total[..., 1:])
        self.down = _power(_INVERSE, n + 1)

    def of(self, start, end):
        return mix((self.total[..., end] - self.total[..., start]) * self.down[start] + np.uint64(1) * (np.asarray(end) - start).astype(np.uint64))


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    unigram: bool
    dummy_prefix: bool

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, path: str | None = None) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path or default_model(), "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models with normalisation rules are not supported")
        return cls([p.piece for p in model.pieces], np.array([p.score for p in model.pieces]), np.array([p.type for p in model.pieces]), model.trainer_spec.model_type == 1, model.normalizer_spec.add_dummy_prefix)

    def __post_init__(self) -> None:
        self.ids = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] in (1, 4)}
        self.bytes_ = np.full(256, -1, dtype=np.int32)
        for k in np.flatnonzero(self.kinds == 6):
            self.bytes_[int(self.pieces[k][3:5], 16)] = k
        self.unknown = int(np.flatnonzero(self.kinds == 2)[0])
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in self.ids]
        sizes = np.array([len(p) for p in points])
        keys = np.empty(len(points), dtype=np.uint64)
        for n in np.unique(sizes):
            keys[sizes == n] = Spans(np.stack([p for p in points if len(p) == n])).of(np.array([0]), np.array([n]))[:, 0]
        order = np.argsort(keys)
        self.widths = np.array([len(p) for p in self.pieces])
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), dtype=np.int32)[order]
        self.longest = max(map(len, points))
        self.joins = np.zeros(0x110000, dtype=bool)  # characters of pieces of two and more
        for p in points:
            if len(p) > 1:
                self.joins[p] = True
        raw = [p.replace("▁", " ").encode() if k != 6 else bytes([int(p[3:5], 16)]) for p, k in zip(self.pieces, self.kinds, strict=True)]
        raw = [b"" if k in (2, 3) else r for r, k in zip(raw, self.kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.floor = float(self.scores[list(self.ids.values())].min()) - 10
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, np.ndarray] = {}
        blank = {len(p): k for p, k in self.ids.items() if not p.strip("▁")}
        self.spaces = np.full(max(blank, default=0) + 1, -1, dtype=np.int32)  # by width
        self.spaces[list(blank)] = list(blank.values())
        wide = [self.scores[k] for n, k in blank.items() if n > 1]
        #: Whether spaces merge with each other last and as they come, and with a word only as its first character.
        self.spaces_last = not self.unigram and 1 in blank and (not wide or max(wide) == min(wide) == self.scores[list(self.ids.values())].min()) and not any("▁" in p[1:] and p.strip("▁") for p in self.ids)

    def merged(self, text: str) -> list[int]:
        """Piece ids of a text by merging the best pair (of equal ones the leftmost) again and again; -1 for unknown characters."""
        ids, scores = self.ids, self.scores
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        waiting = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (k := ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(waiting, (-scores[k], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ids.get(p, -1) for p in parts if p]

    def space_run(self, n: int) -> np.ndarray:
        """Pieces of n spaces where all pieces of spaces have equal scores: each space joins the pieces before it as far as it can."""
        if n not in self.runs:
            if len(self.runs) > 10_000:
                self.runs.clear()
            made: list[int] = []
            for _ in range(n):
                made.append(1)
                while len(made) > 1 and (wide := made[-2] + made[-1]) < len(self.spaces) and self.spaces[wide] >= 0:
                    made[-2:] = [wide]
            self.runs[n] = self.spaces[made] if n else np.zeros(0, np.int32)
        return self.runs[n]

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the merges leave `before` and `piece` side by side; before -1: nothing that could merge."""
        keys, back = np.unique(before.astype(np.int64) * len(self.pieces) + piece, return_inverse=True)
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        out = np.empty(len(keys), dtype=bool)
        for n, key in enumerate(keys.tolist()):
            known = self.pairs.get(key)
            if known is None:
                a, b = divmod(key, len(self.pieces))
                known = self.merged(self.pieces[b]) == [b] if a < 0 else self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
                self.pairs[key] = known
            out[n] = known
        return out[back]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.key_ids[at], -1)

    def viterbi(self, units: np.ndarray) -> list[np.ndarray]:
        """Pieces of units of equal length (a matrix of code points); unknown characters as -1 - code point."""
        n, length = units.shape
        spans, widest = Spans(units), min(length, self.longest)
        pieces = np.full((widest, length + 1, n), -1, dtype=np.int32)  # by width - 1, end, unit
        for w in range(1, widest + 1):
            starts = np.arange(length - w + 1)
            pieces[w - 1, w:] = self.lookup(spans.of(starts, starts + w)).T
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last = np.full((length + 1, n), -1, dtype=np.int32)
        width = np.zeros((length + 1, n), dtype=np.int16)
        for end in range(1, length + 1):
            w = min(end, widest)
            piece = pieces[:w, end]
            value = best[end - w : end][::-1].copy()
            known = piece >= 0
            if self.unigram:
                value += np.where(known, self.scores[piece], -np.inf)
                value[0] = np.where(known[0], value[0], best[end - 1] + self.floor)
            else:
                ask = known & np.isfinite(value)
                before = last[end - w : end][::-1]
                ok = np.zeros_like(known)
                ok[ask] = self.fits(before[ask], piece[ask])
                value = np.where(ok, value, -np.inf)
                value[0] = np.where(known[0], value[0], best[end - 1])
            pick = np.argmax(value, axis=0)
            best[end] = value[pick, np.arange(n)]
            last[end] = piece[pick, np.arange(n)]
            width[end] = pick + 1
        out, at = [[] for _ in range(n)], np.full(n, length)
        live = np.arange(n)
        trace = []
        while len(live):
            end = at[live]
            p = last[end, live].astype(np.int64)
            p = np.where(p >= 0, p, -1 - units[live, end - 1].astype(np.int64))
            trace.append((live, p))
            at[live] -= width[end, live]
            live = live[at[live] > 0]
        order = np.concatenate([t[0] for t in trace])
        value = np.concatenate([t[1] for t in trace])
        sort = np.argsort(order, kind="stable")
        bounds = np.searchsorted(order[sort], np.arange(n + 1))
        value = value[sort]
        out = [value[bounds[k] : bounds[k + 1]][::-1] for k in range(n)]
        return out

    def spell(self, pieces: np.ndarray) -> np.ndarray:
        """Ids with unknown characters as byte pieces."""
        if not len(pieces) or pieces.min() >= 0:
            return pieces.astype(np.int32)
        out: list[int] = []
        for p in pieces.tolist():
            if p >= 0:
                out.append(p)
            elif self.bytes_[0] < 0:
                out.append(self.unknown)
            else:
                out += self.bytes_[list(chr(-1 - p).encode())].tolist()
        return np.array(out, dtype=np.int32)


class Encoder:
    """Encodes lists of texts; keeps the pieces of up to CACHE units."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        v = self.v
        escaped = [("▁" + t if v.dummy_prefix and t else t).replace(" ", "▁") for t in texts]
        points = np.frombuffer("".join(escaped).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.concatenate(([0], np.cumsum([len(t) for t in escaped])))
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        alone = ~v.joins[points]
        begins = alone.copy()
        begins[1:] |= alone[:-1] | ((points[1:] == SPACE) & (points[:-1] != SPACE))
        begins[rows[:-1][rows[:-1] < len(points)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(points))
        names, first, back = np.unique(Spans(points).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(names) > CACHE or len(self.flat) > MOST_IDS:
            self.forget()
        at = np.searchsorted(self.known, names)
        have = np.zeros(len(names), bool)
        if len(self.known):
            have = self.known[np.minimum(at, len(self.known) - 1)] == names
        new = np.flatnonzero(~have)
        if len(new):
            self._learn(names[new], points, starts[first[new]], ends[first[new]])
        at = np.searchsorted(self.known, names)
        unit_at, unit_size = self.at[at][back], self.size[at][back]
        total = np.concatenate(([0], np.cumsum(unit_size)))
        ids = self.flat[np.arange(total[-1]) + np.repeat(unit_at - total[:-1], unit_size)]
        return ids, np.diff(total[np.searchsorted(starts, rows)])

    def _learn(self, names: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        length = ends - starts
        made: list[np.ndarray] = [np.zeros(0, np.int32)] * len(names)
        v = self.v
        run = np.zeros(len(names), dtype=np.int64)  # spaces before the one that may belong to the word
        several = np.flatnonzero((points[starts] == SPACE) & (length > 1) & (points[np.minimum(starts + 1, len(points) - 1)] == SPACE) & (not v.unigram))
        for k in several:
            unit = points[starts[k] : ends[k]]
            run[k] = (int(np.argmax(unit != SPACE)) if (unit != SPACE).any() else len(unit)) - 1
        whole = np.zeros(len(names), dtype=bool)
        if not v.spaces_last:
            whole[several], run[:] = True, 0
        for k in np.flatnonzero(whole):
            text = points[starts[k] : ends[k]].tobytes().decode("utf-32-le", "surrogatepass")
            ids = np.array(v.merged(text), dtype=np.int64)
            made[k] = v.spell(ids) if ids.min() >= 0 else v.spell(self.v_unknown(text))
        begin, length = starts + run, length - run
        for size in np.unique(length[~whole]):
            group = np.flatnonzero((length == size) & ~whole)
            split = size > LONG and not v.unigram
            for part in np.array_split(group, len(group) if split else min(len(group), max(1, int(len(group) * size * min(size, v.longest) // 2_000_000)))):
                units = points[begin[part][:, None] + np.arange(size)]
                for k, got in zip(part, [self._parts(units[0])] if split else v.viterbi(units), strict=True):
                    if run[k]:  # the last space is the word's if a piece holds both, else one of the run
                        alone = got[0] == v.spaces[1]
                        made[k] = np.concatenate((v.space_run(int(run[k] + alone)), v.spell(got[1:] if alone else got)))
                    else:
                        made[k] = v.spell(got)
        sizes = np.array([len(m) for m in made], dtype=np.int64)
        at = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, *made])
        every = np.concatenate((self.known, names))
        order = np.argsort(every, kind="stable")
        self.known = every[order]
        self.at = np.concatenate((self.at, at))[order]
        self.size = np.concatenate((self.size, sizes))[order]

    def _parts(self, unit: np.ndarray) -> np.ndarray:
        """Pieces of a long unit of a BPE model, whose overlapping parts advance together.

        Every two neighbours within a part fit, and a segmentation whose neighbours all fit is the result of the merges. So where
        two parts hold the same piece at the same place, one goes on as the other; where an overlap holds none, the unit is merged.
        """
        v, starts = self.v, np.arange(0, max(len(unit) - LAP, 1), STEP)
        ends = np.minimum(starts + STEP + LAP, len(unit))
        cut: list[np.ndarray] = []
        for size in np.unique(ends - starts)[::-1]:
            some = starts[ends - starts == size]
            for part in np.array_split(some, -(-len(some) // 128)):
                cut += v.viterbi(unit[part[:, None] + np.arange(size)])
        out, done = [], 0  # done: the end of the pieces taken so far
        for k, (start, pieces) in enumerate(zip(starts.tolist(), cut, strict=True)):
            at = start + np.cumsum(np.where(pieces >= 0, v.widths[np.maximum(pieces, 0)], 1))
            if k:
                shared = np.flatnonzero(np.isin(at * len(v.pieces) + pieces, last_at * len(v.pieces) + last))
                if not len(shared):
                    text = unit.tobytes().decode("utf-32-le", "surrogatepass")
                    return self.v_unknown(text)
                done = int(at[shared[0]])
                out[-1] = last[last_at <= done]
                pieces, at = pieces[at > done], at[at > done]
            out.append(pieces)
            last, last_at = pieces, at
        return np.concatenate(out)

    def v_unknown(self, text: str) -> np.ndarray:
        """Pieces of a text that holds unknown characters."""
        parts, out = [], []
        for c in text:
            if c in self.v.ids or c == "▁":
                parts.append(c)
                continue
            out += self.v.merged("".join(parts)) if parts else []
            out.append(-1 - ord(c))
            parts = []
        return np.array(out + (self.v.merged("".join(parts)) if parts else []), dtype=np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        v = self.v
        size = v.raw_size[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        raw = v.raw[np.arange(total[-1]) + np.repeat(v.raw_at[ids] - total[:-1], size)].tobytes()
        cut = total[np.concatenate(([0], np.cumsum(counts)))]
        skip = int(v.dummy_prefix)
        return [raw[a + (skip if raw[a : a + 1] == b" " else 0) : b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _batches(batches, size: int = 2_000_000):
    """Slices of batches of about `size` bytes."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, min(step, ROWS)):
                yield batch.slice(at, min(step, ROWS))


def encode(docs: DataFrame, model: str | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with ids, the piece ids of `text`."""
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kept = [f for f in docs.schema.fields if (keep_text or f.name != text) and f.name.lower() != "ids"]
    schema = StructType([*kept, StructField("ids", ArrayType(IntegerType()))])

    def run(batches):
        encoder = Encoder(held.value)
        for batch in _batches(batches):
            column = batch.column(batch.schema.get_field_index(text))
            ids, counts = encoder.encode([t or "" for t in column.to_pylist()])
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids), mask=column.is_null()) if column.null_count else pa.ListArray.from_arrays(offsets, pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), lists], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def decode(frame: DataFrame, model: str | None = None, into: str = "decoded") -> DataFrame:
    """frame with the text of its ids."""
    held = frame.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kept = [f for f in frame.schema.fields if f.name.lower() != into.lower()]
    schema = StructType([*kept, StructField(into, StringType())])

    def run(batches):
        decoder = Encoder(held.value)
        for batch in _batches(batches):
            column = batch.column(batch.schema.get_field_index("ids"))
            filled = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            counts = np.asarray(filled.value_lengths().fill_null(0))
            texts = decoder.decode(np.asarray(filled.flatten()), counts)
            texts = [None if null else t for t, null in zip(texts, filled.is_null().to_pylist(), strict=True)] if filled.null_count else texts
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return frame.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_hash, n_bytes, and whether decoding the ids gives the text back."""
    coded = encode(docs.select("doc_id", "text"), model)
    back = decode(coded, model)
    return back.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
