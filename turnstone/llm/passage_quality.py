"""Operator 11: document quality by attention over passages.

A document is a bag of passages, a label tells of the whole bag only. Each passage is encoded (which
kinds of characters follow each other, how words vary and repeat, then a learned layer), a gated
attention learns from the labels how much each passage counts, and the score is a logistic function
of the weighted sum of the encodings.

Training is by full gradients: a step sums the gradient of every sampled document in each task, the
driver adds up one vector a task and moves the weights. Scoring reads every text once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, grouped_by_size, small_batches, text_or_empty, texts_of, written

#: Words and characters of a passage at most; characters handled at once, where a passage ends too.
PASSAGE_WORDS, PASSAGE_CHARS, CHUNK_CHARS = 64, 1024, 1 << 17
#: Learned components of a passage, of its gate.
HIDDEN, GATE = 24, 12
#: Distinct labelled texts of each class that training takes (as expected; they are taken by hash),
#: steps, length of a step at first, weight of the penalty on large weights.
SAMPLE, STEPS, RATE, PENALTY = 2_000, 40, 0.08, 1e-3
#: A score from which a document counts as good.
GOOD = 0.3

#: Kinds of characters. All letters but A-Z in upper case and of other scripts are as one.
_KINDS = ("space", "break", "lower", "upper", "digit", "stop", "bang", "comma", "quote", "dash", "bracket", "symbol", "bar", "other")
_SPACE, _BREAK, _LOWER, _UPPER, _DIGIT, _OTHER = 0, 1, 2, 3, 4, len(_KINDS) - 1
_MARKS = {".;:": 5, "!?": 6, ",": 7, "'\"`": 8, "-_/~": 9, "()[]{}<>": 10, "#$%&*@^+=\\": 11, "|": 12}
_N = len(_KINDS)
#: Beside pairs of kinds: words, their length and its spread, distinct ones, repeats of the one before
#: and of the one before that, the commonest, characters.
_WORD_FEATURES = 8
FEATURES = _N * _N + _WORD_FEATURES
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _kind_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = _UPPER if x.isupper() else _LOWER
        elif x.isdigit():
            table[c] = _DIGIT
        elif x.isspace():
            table[c] = _BREAK if x in "\n\r\x0b\x0c  " else _SPACE
    for marks, kind in _MARKS.items():
        table[[ord(c) for c in marks]] = kind
    return table


def passages(text: str) -> Iterator[np.ndarray]:
    """The features of a text's passages, a chunk at a time; an empty text has one passage of zeros."""
    for at in range(0, max(len(text), 1), CHUNK_CHARS):
        yield chunk_features(text[at : at + CHUNK_CHARS])


def chunk_features(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    if not len(codes):
        return np.zeros((1, FEATURES), dtype=np.float32)
    kinds = _kind_table()[codes]
    blank = kinds <= _BREAK
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1
    # each character's passage: by words, and by characters where words are long
    first = begins[::PASSAGE_WORDS].copy()
    if not len(first):
        first = np.zeros(1, dtype=np.int64)
    first[0] = 0
    long = np.diff(np.append(first, len(codes))) > PASSAGE_CHARS
    if long.any():
        stops = np.append(first, len(codes))
        first = np.concatenate([np.arange(a, b, PASSAGE_CHARS) if far else [a] for a, b, far in zip(first, stops[1:], long, strict=True)])
    n = len(first)
    place = np.searchsorted(first, np.arange(len(codes)), side="right") - 1
    pairs = place[1:] * (_N * _N) + kinds[:-1].astype(np.int64) * _N + kinds[1:]
    counts = np.bincount(pairs, minlength=n * _N * _N).reshape(n, _N * _N)
    sizes = np.diff(np.append(first, len(codes)))
    out = np.empty((n, FEATURES), dtype=np.float32)
    out[:, : _N * _N] = np.sqrt(counts / sizes[:, None])
    out[:, _N * _N :] = _word_features(codes, begins, ends, place, sizes, n)
    return out


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base, inverse = int(_ODD), pow(int(_ODD), -1, 1 << 64)
    return tuple(np.cumprod(np.full(CHUNK_CHARS, b, dtype=np.uint64)) for b in (base, inverse))


def _word_hashes(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverses = _powers()
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)])))
    return (sums[ends] - sums[begins]) * inverses[begins]


def _word_features(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, place: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """A word belongs to the passage that it begins in."""
    out = np.zeros((n, _WORD_FEATURES))
    out[:, 7] = np.log1p(sizes) / 8
    if not len(begins):
        return out
    own, lengths, hashes = place[begins], (ends - begins).astype(np.float64), _word_hashes(codes, begins, ends)
    words = np.maximum(np.bincount(own, minlength=n), 1)
    low = np.uint64((1 << 20) - 1)  # more than a chunk has passages
    keyed = np.sort((hashes * _ODD & ~low) | own.astype(np.uint64))
    kinds = np.flatnonzero(np.concatenate(([True], keyed[1:] != keyed[:-1])))
    of, most = (keyed[kinds] & low).astype(np.int64), np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(kinds, len(keyed))))
    mean = np.bincount(own, lengths, minlength=n) / words
    spread = np.sqrt(np.maximum(np.bincount(own, lengths**2, minlength=n) / words - mean**2, 0))
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(words) / 4, np.log1p(mean) / 2, np.log1p(spread) / 2
    out[:, 3], out[:, 6] = np.bincount(of, minlength=n) / words, most / words
    for k in (1, 2):
        same = (hashes[k:] == hashes[:-k]) & (own[k:] == own[:-k])
        out[:, 3 + k] = np.bincount(own[k:][same], minlength=n) / words
    return out


def bags(texts: list[str], made: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, rows, owner) of texts[a:b], about a chunk of texts or a longer one: what is made of the
    features of their passages, and the text of each row, from 0. made gets about a chunk's rows."""
    most = CHUNK_CHARS // PASSAGE_CHARS
    for a, b in grouped_by_size([len(t) for t in texts], CHUNK_CHARS):
        rows, waiting, owner = [], [], []
        for i, t in enumerate(texts[a:b]):
            for f in passages(t):
                waiting.append(f)
                owner.append(np.full(len(f), i))
                if sum(map(len, waiting)) >= most:
                    rows.append(made(np.concatenate(waiting)))
                    waiting = []
        if waiting:
            rows.append(made(np.concatenate(waiting)))
        yield a, b, np.concatenate(rows), np.concatenate(owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """encoding h = tanh(x W + w); gate g = (tanh(h V + v) * sigmoid(h U + u)) q; a document's
    attention is the softmax of g over its passages; score = sigmoid(sum of attention * h . c + d)."""

    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    SHAPES = (("W", (FEATURES, HIDDEN)), ("w", (HIDDEN,)), ("V", (HIDDEN, GATE)), ("v", (GATE,)), ("U", (HIDDEN, GATE)), ("u", (GATE,)), ("q", (GATE,)), ("c", (HIDDEN,)), ("d", (1,)))

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for _, s in cls.SHAPES)

    @classmethod
    def fresh(cls, shift: np.ndarray, scale: np.ndarray, prior: float) -> Model:
        rng = np.random.default_rng(11)
        parts = {n: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or n in "qc" else np.zeros(s) for n, s in cls.SHAPES}
        parts["d"][0] = np.log(prior / (1 - prior))
        return cls(shift, scale, np.concatenate([p.ravel() for p in parts.values()]))

    @classmethod
    def views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of a vector of all weights, by name."""
        out, at = {}, 0
        for name, shape in cls.SHAPES:
            n = int(np.prod(shape))
            out[name], at = flat[at : at + n].reshape(shape), at + n
        return out

    @cached_property
    def parts(self) -> dict[str, np.ndarray]:
        return self.views(self.weights)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Encodings of passages and, in the last column, their gates."""
        x = (x - self.shift) * self.scale
        p = self.parts
        h = np.tanh(x @ p["W"] + p["w"])
        return np.column_stack((h, (np.tanh(h @ p["V"] + p["v"]) * _sigmoid(h @ p["U"] + p["u"])) @ p["q"]))

    def pool(self, rows: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention of each encoded passage, the weighted sum and the score of each of n documents;
        every document owns a row at least."""
        h, g, p = rows[:, :-1], rows[:, -1], self.parts
        most = np.full(n, -np.inf)
        np.maximum.at(most, owner, g)
        e = np.exp(g - most[owner])
        a = e / np.bincount(owner, e, minlength=n)[owner]
        z = np.stack([np.bincount(owner, a * h[:, k], minlength=n) for k in range(HIDDEN)], axis=1)
        return a, z, _sigmoid(z @ p["c"] + p["d"][0])

    def gradient(self, x: np.ndarray, owner: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and its gradient, summed over documents of a label (0 to 1) that count so much each."""
        n, p, rows = len(labels), self.parts, self.encode(x)
        a, z, y = self.pool(rows, owner, n)
        h, out = rows[:, :-1], np.zeros(self.size())
        t, s = np.tanh(h @ p["V"] + p["v"]), _sigmoid(h @ p["U"] + p["u"])
        g = self.views(out)
        loss = -float(counts @ (labels * np.log(y) + (1 - labels) * np.log1p(-y)))
        d_logit = counts * (y - labels)
        g["d"][0], g["c"][:] = d_logit.sum(), d_logit @ z
        d_z = d_logit[:, None] * p["c"]
        d_a = np.einsum("ij,ij->i", h, d_z[owner])
        d_gate = a * (d_a - np.bincount(owner, a * d_a, minlength=n)[owner])
        d_t, d_s = d_gate[:, None] * p["q"] * s * (1 - t**2), d_gate[:, None] * p["q"] * t * s * (1 - s)
        g["q"][:] = d_gate @ (t * s)
        g["V"][:], g["v"][:], g["U"][:], g["u"][:] = h.T @ d_t, d_t.sum(0), h.T @ d_s, d_s.sum(0)
        d_h = (a[:, None] * d_z[owner] + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h**2)
        g["W"][:], g["w"][:] = ((x - self.shift) * self.scale).T @ d_h, d_h.sum(0)
        return loss, out


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that labels are not learned from: crc32(id as text) mod 5 is 0. False for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, label, counts): a sample of distinct labelled texts, about `sample` of each class, taken
    by hash. label is the mean over labelled copies; counts says for how many texts one stands."""
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg((F.col("quality") == 1).cast("double")).alias("label"))
    rows = docs.select(F.col("doc_id").alias("id"), text_or_empty("text").alias("text")).withColumn("h", F.xxhash64("text"))
    known = rows.select("id", "h").join(told, F.col("id") == F.col("doc_id"))
    texts = written(known.groupBy("h").agg(F.min("id").alias("first"), F.avg("label").alias("label")), "labelled")
    good = F.col("label") >= 0.5
    n = {r["good"]: r["count"] for r in texts.groupBy(good.alias("good")).count().collect()}  # two rows
    share = F.when(good, min(1.0, sample / n.get(True, 1))).otherwise(min(1.0, sample / n.get(False, 1)))
    drawn = F.pmod(F.xxhash64("h", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = written(texts.where(drawn < share).select(F.col("h").alias("of"), "first", "label", (1 / share).alias("counts")), "chosen")
    return rows.join(chosen, (F.col("id") == F.col("first")) & (F.col("h") == F.col("of"))).groupBy("of").agg(F.first("text").alias("text"), F.first("label").alias("label"), F.first("counts").alias("counts")).drop("of")


def _bagged(rows: DataFrame) -> DataFrame:
    """(label, counts, x): the features of each text's passages, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, owner in bags(texts_of(batch, "text")):
                ends = np.searchsorted(owner, np.arange(b - a + 1))
                packed = [x[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("label")[a:b], batch.column("counts")[a:b], pa.array(packed, pa.binary())], ["label", "counts", "x"])

    return rows.select("text", "label", "counts").mapInArrow(run, "label double, counts double, x binary")


def _summed(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of a vector over all batches of (features, owner, labels, counts): one a task goes to
    the driver. None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            packed = batch.column("x").to_pylist()
            for a, b in grouped_by_size([len(x) for x in packed], 1 << 24):
                x = np.concatenate([np.frombuffer(p, dtype=np.float32) for p in packed[a:b]]).reshape(-1, FEATURES).astype(np.float64)
                owner = np.repeat(np.arange(b - a), [len(p) // (4 * FEATURES) for p in packed[a:b]])
                part = add(x, owner, batch.column("label")[a:b].to_numpy(), batch.column("counts")[a:b].to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    parts = [np.frombuffer(r["v"]) for r in rows.mapInArrow(run, "v binary").collect()]
    return np.sum(parts, axis=0) if parts else None


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Model | None:
    """A model of labels (doc_id, quality) of rows of docs; None if no row has a label.

    Adam on the mean loss over all labelled texts, as the sample estimates it, with a rate that falls
    to 0 and a penalty on the square of the weights.
    """
    small_batches(docs.sparkSession)
    rows = written(_bagged(sampled(docs, labels, sample)), "passages")
    n = FEATURES

    def moments(x: np.ndarray, owner: np.ndarray, label: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.concatenate((x.sum(0), (x**2).sum(0), [len(x), counts.sum(), counts @ label]))

    sums = _summed(rows, moments)
    if sums is None:
        return None
    passages_, documents, good = sums[2 * n :]
    mean = sums[:n] / passages_
    spread = np.sqrt(np.maximum(sums[n : 2 * n] / passages_ - mean**2, 0))
    model = Model.fresh(mean, 1 / np.maximum(spread, 0.02), (good + 1) / (documents + 2))
    first, second = np.zeros(model.size()), np.zeros(model.size())
    for k in range(1, steps + 1):
        g = _summed(rows, lambda x, owner, label, counts: model.gradient(x, owner, label, counts)[1]) / documents + PENALTY * model.weights
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        model = Model(model.shift, model.scale, model.weights - RATE * min(1.0, 2 * (1 - k / (steps + 1))) * step)
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., score) for every row: how likely its label is 1. Null and empty texts have one
    passage without characters. Without a model every score is 0.5. Equal texts have equal scores."""
    small_batches(docs.sparkSession)
    own = free_prefix(docs) + "text"
    rows = docs.select(id_col, *keep, text_or_empty(text_col).alias(own))
    if model is None:
        return rows.drop(own).withColumn("score", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, encoded, owner in bags(texts_of(batch, own), shared.value.encode):
                out[a:b] = shared.value.pool(encoded, owner, b - a)[2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "score"])

    form = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{form}, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labels outside the held-out fold."""
    model = learn(docs.where(~held_out()), labels)
    out = score(docs.withColumn("held_out", held_out()), model, keep=("held_out",))
    return out.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
