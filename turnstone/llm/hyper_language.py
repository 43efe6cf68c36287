"""Operator 6: language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. An n-gram binds its letters: the vectors,
rotated by their place, are multiplied. A text bundles its n-grams: their vectors are added. A
language's prototype bundles the n-grams of all its labelled texts. A document gets the language
whose prototype has the largest cosine with its own vector.

Prototypes are learned from every labelled row: n-gram counts are summed in each task, then by
(language, n-gram), and bound and bundled on the executors; the driver gets one vector a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, grouped_by_size, small_batches, text_or_empty, texts_of

#: Components of a vector, letters of an n-gram, characters handled at once, remembered n-grams.
DIMENSIONS, ORDER, CHUNK_CHARS, MOST_GRAMS = 1024, 3, 1 << 17, 1 << 15
UNKNOWN = "und"
_END, _BLANK = 0, 32


@cache
def _letter_table() -> np.ndarray:
    """A letter's code point, a blank for all else; 0 marks the end of a text."""
    table = np.array([c if chr(c).isalpha() else _BLANK for c in range(0x110000)], dtype=np.int64)
    table[_END] = _END
    return table


@cache
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng(code).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams, given as their letters' code points, 21 bits each."""
    out = np.ones((len(grams), DIMENSIONS), dtype=np.int8)
    for place in range(ORDER):
        codes, which = np.unique((grams >> np.int64(21 * place)) & np.int64(0x1FFFFF), return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(c)), place) for c in codes])[which] if len(codes) else 1
    return out


class GramMemory:
    """Vectors of n-grams seen before, at most MOST_GRAMS of them."""

    def __init__(self):
        self.keys, self.rows = np.zeros(0, dtype=np.int64), np.zeros((0, DIMENSIONS), dtype=np.int8)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """For sorted, distinct n-grams."""
        new = np.setdiff1d(grams, self.keys, assume_unique=True)
        if len(new):
            if len(self.keys) + len(new) > MOST_GRAMS:
                self.__init__()
                new = grams
            keys = np.concatenate((self.keys, new))
            order = np.argsort(keys)
            self.keys, self.rows = keys[order], np.concatenate((self.rows, gram_vectors(new)))[order]
        return self.rows[np.searchsorted(self.keys, grams)]


@cache
def _memory() -> GramMemory:
    return GramMemory()


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) of all n-grams of texts; case is folded, all but letters is one blank."""
    if not texts:
        return (np.zeros(0, dtype=np.int64),) * 3
    joined = "".join(f" {t.lower()} \0" for t in (t.replace("\0", " ") for t in texts))
    codes = _letter_table()[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)
    codes = codes[keep]
    present = np.flatnonzero(np.bincount(codes))
    small = np.zeros(int(present[-1]) + 1, dtype=np.int64)
    small[present] = np.arange(len(present))
    n, k = len(codes) - ORDER + 1, len(present)
    if n < 1:
        return (np.zeros(0, dtype=np.int64),) * 3
    owner = np.cumsum(codes == _END)
    letters = small[codes]
    packed, whole = letters[:n].copy(), codes[:n] != _END
    for place in range(1, ORDER):
        packed = packed * k + letters[place : n + place]
        whole &= codes[place : n + place] != _END
    if not whole.any():
        return (np.zeros(0, dtype=np.int64),) * 3
    packed, owner = packed[whole], owner[:n][whole]
    if k**ORDER <= 1 << 22:
        kinds = np.flatnonzero(np.bincount(packed, minlength=1))
        place_of = np.zeros(int(kinds[-1]) + 1, dtype=np.int64)
        place_of[kinds] = np.arange(len(kinds))
        which = place_of[packed]
    else:
        kinds, which = np.unique(packed, return_inverse=True)
    grams, rest = np.zeros(len(kinds), dtype=np.int64), kinds.copy()
    for place in reversed(range(ORDER)):
        grams |= present[rest % k].astype(np.int64) << np.int64(21 * place)
        rest //= k
    pairs, counts = np.unique(owner * len(kinds) + which, return_counts=True)
    return pairs // len(kinds), grams[pairs % len(kinds)], counts


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    return grouped_by_size([len(t) for t in texts], CHUNK_CHARS)


def bundle(texts: list[str], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of texts with each prototype, and whether a text has n-grams with letters."""
    out, lettered = np.zeros((len(texts), len(prototypes))), np.zeros(len(texts), dtype=bool)
    for a, b in _chunks(texts):
        owner, gram, count = gram_counts(texts[a:b])
        if not len(gram):
            continue
        grams, which = np.unique(gram, return_inverse=True)
        dense = np.zeros((b - a, len(grams)), dtype=np.float32)
        dense[owner, which] = count
        vectors = dense @ _memory().vectors(grams).astype(np.float32)
        norms = np.linalg.norm(vectors, axis=1)
        out[a:b] = vectors @ prototypes.T / np.maximum(norms, 1e-9)[:, None]
        lettered[a:b] = np.bincount(owner, minlength=b - a) > 0
    return out, lettered


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The unit prototype of each language that labelled rows have, by name."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(lang: str) -> None:
            parts = waiting.pop(lang)
            grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            sums[lang] = grams, np.bincount(which, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)
            waiting[lang] = [sums[lang]]

        for batch in batches:
            texts, langs = texts_of(batch, "text"), np.array(batch.column("lang").to_pylist(), dtype=object)
            for a, b in _chunks(texts):
                owner, gram, n = gram_counts(texts[a:b])
                for lang in set(langs[a:b]):
                    mine = (langs[a:b] == lang)[owner]
                    waiting.setdefault(lang, []).append((gram[mine], n[mine]))
                    if len(waiting[lang]) > 64:
                        fold(lang)
        for lang in list(waiting):
            fold(lang)
            grams, n = sums[lang]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": grams, "n": n})

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            f = batch.to_pandas()
            for lang, part in f.groupby("lang"):
                sums[lang] = sums.get(lang, 0) + part["n"].to_numpy(np.float64) @ gram_vectors(part["gram"].to_numpy(np.int64)).astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "vector": pa.array([v], pa.list_(pa.float64()))})

    def total(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = np.sum(np.stack(part["vector"].to_numpy()), axis=0)
        return pd.DataFrame({"lang": [key[0]], "vector": [v / max(np.linalg.norm(v), 1e-9)]})

    form = "lang string, vector array<double>"
    vectors = counts.mapInArrow(add, form).groupBy("lang").applyInPandas(total, form)
    return {r["lang"]: np.array(r["vector"]) for r in sorted(vectors.collect(), key=lambda r: r["lang"])}  # a row for each language


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., lang_pred, score): the language of the nearest prototype and its cosine, 0 if
    negative. `und` with 0 for texts that are null, have no letters, or if nothing was learned.
    Equal cosines take the first name. Null ids and repeated rows are kept."""
    spark = docs.sparkSession
    small_batches(spark)
    names, own = sorted(prototypes), free_prefix(docs) + "text"
    shared = spark.sparkContext.broadcast(np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosines, lettered = bundle(texts_of(batch, own), shared.value)
            best = cosines.argmax(axis=1) if names else np.zeros(len(cosines), dtype=int)
            known = lettered & bool(names)
            scores = np.clip(cosines[np.arange(len(best)), best], 0, 1) if names else np.zeros(len(best))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([names[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, scores, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(id_col, *keep, text_or_empty(text_col).alias(own))
    form = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{form}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that prototypes are not learned from: crc32(id as text) mod 4 is 2. False for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned on one part, predicted for all rows."""
    prototypes = learn(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), prototypes, keep=("held_out",))
