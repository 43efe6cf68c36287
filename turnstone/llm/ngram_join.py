"""Operator 9: the join of texts whose sets of word 5-grams are alike.

Texts with equal sets are one class. Counts of all shingles go into a table of buckets, about one a
shingle, that is broadcast (its size is bounded). Each class orders its shingles rare-first and
emits the prefix that every partner must share a shingle with; a shingle alone in its bucket is
alone in the corpus, has no partner, and is not emitted. Classes that meet in a shingle are paired
behind the length and positional filters, each pair once, and each pair is verified by itself: the
sets of its two classes come together, and the suffix filter or their intersection decides.

A shingle with more classes than are paired is handled in two steps. First each class is paired
with its neighbours by size and with the head of its stretch, like any other pair; in a group of
near copies this links nearly all. Then, if not all classes of the shingle are in one component of
verified links, the pairs between its components are left: its classes come together in blocks of
like sizes, a task for each two blocks that the length filter allows, and what is linked across
components is found there. No pair is written for these. Links that lie inside a component are not
looked for, as they can't change it.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh_path, grouped_by_size, n_partitions, removed, small_batches, text_or_empty, texts_of, written
from .components import components

WORDS, PERCENT = 5, 75
#: Classes that meet in a shingle and are all paired; classes paired with one head; about as many
#: classes and shingles of a block.
MOST_PAIRED, STAR, BLOCK, BLOCK_SHINGLES = 24, 256, 512, 1 << 18
#: At most so many buckets (half a byte each) are broadcast, beyond it more shingles share one; bits
#: of a range of buckets that is counted at once.
MOST_BUCKET_BITS, RANGE_BITS = 28, 22
#: Counts from which a bucket has level 1, 2, ...; fixed, roughly a geometric row.
LEVELS = np.array([1, 2, 3, 4, 6, 9, 15, 25, 41, 71, 121, 251, 501, 1501, 5001])
#: A shingle of the last level is dealt to so many tasks, and again, in another way, to as many.
SALTS = 64
#: Bytes of texts handled at once.
CHUNK_BYTES = 1 << 20
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)], dtype=np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x94D049BB133111EB], dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

NAME, PAIR = ["hi", "lo"], ["a_hi", "a_lo", "b_hi", "b_lo"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _FACTORS[4]
    return x ^ (x >> np.uint64(31))


def word_names(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit names of the words of data, which ends with white space. A word of up to seven
    bytes is its own name, with its length; a longer one has a digest by a seed."""
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
    white = _WHITE[raw[: len(data)]]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(white) and not white[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    sizes = ends - starts
    eights = np.ndarray(len(data), dtype="<u8", buffer=raw, strides=(1,))  # the eight bytes from each place on
    names = eights[starts] & _LOW[np.minimum(sizes, 7)] | sizes.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(sizes > 7)
    names[long] = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), dtype=np.uint64, count=len(long))
    return starts, _mixed(names)


def shingle_sets(texts: list[str], words: int = WORDS, seed: int = 0) -> list[np.ndarray]:
    """The sorted, distinct hashes of each text's shingles; of its whole word sequence if it is shorter."""
    parts = [t.encode().lower() + b"\n" for t in texts]  # bytes.lower changes A-Z only
    return [s for a, b in grouped_by_size([len(p) for p in parts], CHUNK_BYTES) for s in _sets(parts[a:b], words, seed)]


def _sets(parts: list[bytes], words: int, seed: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        starts, names = word_names(b"".join(parts), seed)
        bounds = np.searchsorted(starts, np.cumsum([0, *map(len, parts)])).tolist()
        n, out = max(0, len(names) - words + 1), []
        rows = np.zeros(n, dtype=np.uint64)
        for j in range(words):
            rows += names[j : n + j] * _FACTORS[j % 5] + np.uint64(j)
        rows = _mixed(rows)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(rows[a : b - words + 1]))
            elif b > a:
                out.append(_mixed(np.array([sum(int(h) * int(_FACTORS[j]) for j, h in enumerate(names[a:b])) + b - a & (1 << 64) - 1], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def name_of(s: np.ndarray) -> bytes:
    """The 128-bit name of a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _halves(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of sets of these sizes that links them."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# -- shingle counts ---------------------------------------------------------------------------

SCANNED = "id long, n long, hi long, lo long, range int, blob binary"


class _Seen(set):
    """Names met in a task; a set met twice is only work done twice, so it may be emptied."""

    def first(self, name: bytes) -> bool:
        if name in self:
            return False
        if len(self) > 500_000:
            self.clear()
        self.add(name)
        return True


def _scan(rows: DataFrame, words: int, seed: int) -> DataFrame:
    """(id, n, name) of every row and, with n -1, (range, blob) of sorted bucket names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, held = _Seen(), [], 0

        def buckets() -> pa.RecordBatch:
            names = np.sort((np.concatenate(waiting) >> np.uint64(64 - MOST_BUCKET_BITS)).astype(np.uint32))
            cuts = np.searchsorted(names, np.arange(1 << MOST_BUCKET_BITS - RANGE_BITS, dtype=np.uint32) << np.uint32(RANGE_BITS))
            pieces = [(k, p) for k, p in enumerate(np.split(names, cuts[1:])) if len(p)]
            n = len(pieces)
            # the four bytes of neighbours' differences apart: all but the lowest are nearly all 0
            blobs = [np.diff(p, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for _, p in pieces]
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_pydict({"id": none, "n": pa.array([-1] * n, pa.int64()), "hi": none, "lo": none, "range": pa.array([k for k, _ in pieces], pa.int32()), "blob": pa.array(blobs, pa.binary())})

        for batch in batches:
            sets = shingle_sets(texts_of(batch, "text"), words, seed)
            full = np.array([len(s) > 0 for s in sets], dtype=bool)
            names = [name_of(s) for s in sets]
            for s, name in zip(sets, names, strict=True):
                if len(s) and seen.first(name):
                    waiting.append(s)
                    held += len(s)
            n, (hi, lo) = len(sets), _halves(names)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": pa.array([len(s) for s in sets], pa.int64()), "hi": pa.array(hi, mask=~full), "lo": pa.array(lo, mask=~full), "range": pa.nulls(n, pa.int32()), "blob": pa.nulls(n, pa.binary())})
            if held > 1 << 20:
                yield buckets()
                waiting, held = [], 0
        if held:
            yield buckets()

    return rows.mapInArrow(run, SCANNED)


def _bucket_levels(ranges: DataFrame, bits: int) -> bytes:
    """The level of each of 2**bits buckets, two in a byte. Counted by range, in streams."""
    shift = MOST_BUCKET_BITS - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("range").to_pylist(), batch.column("blob"), strict=True):
                deltas = np.ascontiguousarray(np.frombuffer(blob.as_buffer(), dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                names = (np.cumsum(deltas, dtype=np.uint64) & np.uint64((1 << RANGE_BITS) - 1)) >> np.uint64(shift)
                first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
                counts.setdefault(k, np.zeros(1 << RANGE_BITS - shift, dtype=np.int64))[names[first].astype(np.int64)] += np.diff(np.append(first, len(names)))
        for k, c in counts.items():
            level = np.searchsorted(LEVELS, c, side="right").astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"range": pa.array([k], pa.int32()), "levels": [(level[0::2] | level[1::2] << 4).tobytes()]})

    made = ranges.repartition(n_partitions(ranges.sparkSession), "range").mapInArrow(run, "range int, levels binary")
    levels = np.zeros(1 << bits - 1, dtype=np.uint8)
    size = 1 << RANGE_BITS - 1 - shift
    for r in made.toLocalIterator():  # half of 2**bits bytes in all
        levels[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r["levels"], dtype=np.uint8)
    return levels.tobytes()  # bytes, unlike arrays, are unpickled without a second copy


# -- candidates ---------------------------------------------------------------------------

POSTING = ["key", "part", "n", "hi", "lo", "pos"]


def _postings(rows: DataFrame, shared, bits: int, words: int, percent: int, seed: int) -> DataFrame:
    """(key, part, n, name, pos) of each class' prefix, once in a task, without shingles that stand
    alone. part: 0, or one of the parts that a very frequent shingle is dealt to; each class is in
    two of those, by either half of its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, seen = np.frombuffer(shared.value, dtype=np.uint8), _Seen()
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in POSTING]
            for s in shingle_sets(texts_of(batch, "text"), words, seed):
                if not len(s) or not seen.first(name := name_of(s)):
                    continue
                bucket = s >> np.uint64(64 - bits)
                level = packed[(bucket >> np.uint64(1)).astype(np.int64)] >> (bucket & np.uint64(1)).astype(np.uint8) * 4 & 15
                p = prefix_size(len(s), percent)
                if (alone := int((level == 1).sum())) >= p:
                    continue  # its whole prefix is without partners
                order = np.lexsort((s, level))[alone:p]
                hi, lo = (int(x[0]) for x in _halves([name]))
                pos, hot = np.arange(alone, p), np.flatnonzero(level[order] == len(LEVELS))
                part = np.zeros(len(order), dtype=np.int64)
                part[hot] = 1 + hi % SALTS
                again = np.concatenate((np.arange(len(order)), hot))
                part = np.concatenate((part, np.full(len(hot), 1 + SALTS + lo % SALTS)))
                for o, x in zip(out, (s[order].view(np.int64)[again], part, np.full(len(again), len(s)), np.full(len(again), hi), np.full(len(again), lo), pos[again]), strict=True):
                    o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], POSTING)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in POSTING))


def _close(c: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i, j of the pairs in runs of equal keys, ordered by size, behind both filters."""
    key, n, pos = c["key"], c["n"], c["pos"]
    ends = np.searchsorted(key, key, side="right")
    for d in range(1, MOST_PAIRED):
        i = np.flatnonzero(np.arange(len(key)) + d < ends)
        if not len(i):
            return
        j = i + d
        near = 100 * n[i] >= percent * n[j]  # the length filter; i has the smaller set
        i, j = i[near], j[near]
        # the positional filter: what is left of either set, this shingle included
        can = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need(n[i], n[j], percent)
        yield i[can], j[can]


class _LongRun:
    """Pairs of a run of many classes, ordered by size, that comes in pieces: each class with the
    head of its stretch and with the two classes before it."""

    def __init__(self, percent: int):
        self.percent, self.head, self.used, self.tail = percent, None, 0, None

    def pairs(self, c: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        n, hi, lo = c["n"], c["hi"], c["lo"]
        at = 0
        while at < len(n):
            if self.head is None:
                self.head, self.used = (int(n[at]), int(hi[at]), int(lo[at])), 1
                at += 1
                continue
            far = int(np.searchsorted(n, self.head[0] * 100 // self.percent, side="right"))
            stop = max(at, min(len(n), far, at + STAR - self.used))
            if stop > at:
                yield np.full(stop - at, self.head[1]), np.full(stop - at, self.head[2]), hi[at:stop], lo[at:stop]
            self.used += stop - at
            at = stop
            if at < len(n):
                self.head = None
        if self.tail is not None:
            n, hi, lo = (np.concatenate(x) for x in zip(self.tail, (n, hi, lo), strict=True))
        for d in (1, 2):
            near = np.flatnonzero(100 * n[:-d] >= self.percent * n[d:])
            new = near[near + d >= (0 if self.tail is None else len(self.tail[0]))]
            yield hi[new], lo[new], hi[new + d], lo[new + d]
        self.tail = n[-2:], hi[-2:], lo[-2:]


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the filters, with key null; and, with b null, the classes a (n, key) of
    each shingle that has too many to pair them all."""

    def rows(pairs: list[tuple[np.ndarray, ...]], many: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names = ["key", *PAIR, "n"]
        if pairs and sum(len(p[0]) for p in pairs):
            x = np.stack([np.concatenate(p) for p in zip(*pairs, strict=True)], axis=1)
            swap = (x[:, 0] > x[:, 2]) | ((x[:, 0] == x[:, 2]) & (x[:, 1] > x[:, 3]))
            x[swap] = x[swap][:, [2, 3, 0, 1]]
            x = x[np.lexsort(x.T)]
            x = x[np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1)))]
            x = x[(x[:, 0] != x[:, 2]) | (x[:, 1] != x[:, 3])]
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([none, *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(4)), none], names)
        if many:
            key, hi, lo, n = (np.concatenate([m[k] for m in many]) for k in ("key", "hi", "lo", "n"))
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(hi), pa.array(lo), none, none, pa.array(n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None  # the last run, if it is short so far
        last, long = None, None  # the last row; the run that is long already, and its state
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy() for k in POSTING}
            same = np.zeros(batch.num_rows, dtype=bool)  # a class that several tasks have met
            same[1:] = np.logical_and.reduce([c[k][1:] == c[k][:-1] for k in ("key", "part", "hi", "lo")])
            same[0] = last is not None and last == tuple(int(c[k][0]) for k in ("key", "part", "hi", "lo"))
            last = tuple(int(c[k][-1]) for k in ("key", "part", "hi", "lo"))
            c = {k: x[~same] for k, x in c.items()}
            if rest is not None:
                c = {k: np.concatenate((rest[k], x)) for k, x in c.items()}
                rest = None
            if not len(c["key"]):
                continue
            begins = np.flatnonzero(np.concatenate(([True], (c["key"][1:] != c["key"][:-1]) | (c["part"][1:] != c["part"][:-1]))))
            ends = np.append(begins[1:], len(c["key"]))
            short = (ends - begins <= MOST_PAIRED) & (c["part"][begins] == 0)
            going = long is not None and long[0] == (int(c["key"][0]), int(c["part"][0]))
            pairs, many = [], []
            for r in np.flatnonzero(~short | (going & (np.arange(len(begins)) == 0))).tolist():
                piece = {k: x[begins[r] : ends[r]] for k, x in c.items()}
                if not (r == 0 and going):
                    long = (int(piece["key"][0]), int(piece["part"][0])), _LongRun(percent)
                pairs += long[1].pairs(piece)
                if piece["part"][0] <= SALTS:  # of a shingle in parts, each class once
                    many.append(piece)
                short[r] = False
            if short[-1]:  # may go on in the next batch
                rest = {k: x[begins[-1] :] for k, x in c.items()}
                short[-1] = False
            few = {k: x[np.repeat(short, ends - begins)] for k, x in c.items()}
            pairs += [(few["hi"][i], few["lo"][i], few["hi"][j], few["lo"][j]) for i, j in _close(few, percent)]
            yield from rows(pairs, many)
        if rest is not None:
            yield from rows([(rest["hi"][i], rest["lo"][i], rest["hi"][j], rest["lo"][j]) for i, j in _close(rest, percent)], [])

    dealt = postings.repartition(n_partitions(postings.sparkSession), "key", "part").sortWithinPartitions("key", "part", "n", "hi", "lo")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in ("key", *PAIR, "n")))


# -- verification ---------------------------------------------------------------------------


def _filter_bits(ids: DataFrame, count: int) -> np.ndarray:
    """A bit for each value of pmod(xxhash64(id)): 16 a value, 32 MB at most."""
    bits = min(1 << 28, 1 << max(16, (16 * count).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    out = np.zeros(bits // 64, dtype=np.uint64)
    rows = ids.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}L) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    for r in rows.toLocalIterator():
        out[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return out


def _sets_of(rows: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """(name, blob) of the classes wanted (name, id), and of a few more: a class may come more than
    once, as often as rows have its first id or share that id's bit."""
    shared = rows.sparkSession.sparkContext.broadcast(_filter_bits(wanted.select("id"), wanted.count()))
    bits = len(shared.value) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            at = batch.column("at").to_numpy()
            hit = np.flatnonzero(shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            if len(hit):
                sets = [s for s in shingle_sets(texts_of(batch.take(pa.array(hit)), "text"), words, seed) if len(s)]
                names = [name_of(s) for s in sets]
                new = [k for k, name in enumerate(names) if seen.first(name)]
                if new:
                    hi, lo = _halves([names[k] for k in new])
                    yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array([sets[k].tobytes() for k in new], pa.binary())], [*NAME, "blob"])

    at = F.pmod(F.xxhash64("id"), F.lit(bits)).alias("at")
    return rows.select(at, "text").mapInArrow(run, "hi long, lo long, blob binary").join(wanted.select(*NAME), NAME, "left_semi")


def suffix_bound(a: np.ndarray, b: np.ndarray, least: int = 0) -> int:
    """No intersection is larger. Elements of a at even ranks cut both sets: halves, then finer parts,
    as long as the bound isn't below least; what two parts have in common is at most the smaller."""
    bound = min(len(a), len(b))
    for cuts in (1, 3, 15):
        if bound < least or len(a) <= cuts:
            break
        at = np.arange(1, cuts + 1) * len(a) // (cuts + 1)
        bound = int(np.minimum(np.diff(at, prepend=0, append=len(a)), np.diff(np.searchsorted(b, a[at]), prepend=0, append=len(b))).sum())
    return bound


def is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are alike: length filter, suffix filter, intersection."""
    least = -(-percent * (len(a) + len(b)) // (100 + percent))
    if min(len(a), len(b)) < least or suffix_bound(a, b, least) < least:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= least


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links. The sets of a class' partners stream past its own."""
    centre = [F.col("a_hi").alias("c_hi"), F.col("a_lo").alias("c_lo")]
    partners = pairs.select(*centre, F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo"), F.lit(1).alias("side"))
    own = pairs.select(*centre, F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"), F.lit(0).alias("side")).distinct()
    met = partners.union(own).join(sets, NAME).select("c_hi", "c_lo", "side", *NAME, "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own, last = None, None, None
        for batch in batches:
            c_hi, c_lo, side, hi, lo = (batch.column(k).to_pylist() for k in ("c_hi", "c_lo", "side", *NAME))
            out = []
            for k, blob in enumerate(batch.column("blob")):
                s = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                if side[k] == 0:
                    # the next batch overwrites nothing: s keeps its buffer
                    centre, own, last = (c_hi[k], c_lo[k]), s, None
                elif centre == (c_hi[k], c_lo[k]) and last != (hi[k], lo[k]):
                    last = hi[k], lo[k]  # a set that came twice is the same pair
                    if is_link(own, s, percent):
                        out.append((*centre, *last))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], PAIR)

    dealt = met.repartition(n_partitions(pairs.sparkSession), "c_hi", "c_lo").sortWithinPartitions("c_hi", "c_lo", "side", *NAME)
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in PAIR))


# -- what is left of shingles with many classes -----------------------------------------------


def linked(sets: list[np.ndarray], side: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different parts that connect all parts that any links connect. side: if
    both sides are there, only pairs across. Intersections are counted over the sets' shingles."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    names, part = np.unique(part, return_inverse=True)
    parent, out = list(range(len(names))), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    two = bool(side.any()) and not side.all()
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], token[shared]
    order = np.argsort(token, kind="stable")
    posted = owner[order]
    begins = np.searchsorted(token[order], np.arange(len(times)))
    set_at = np.searchsorted(owner, np.arange(len(sets) + 1))
    for j in range(len(sets)):
        if two and not side[j]:
            continue
        other = part != part[j]
        other &= np.minimum(sizes, sizes[j]) >= need(sizes, sizes[j], percent)  # the length filter
        if two:
            other &= ~side
        else:
            other[j:] = False
        mine = token[set_at[j] : set_at[j + 1]]
        n = times[mine]
        stops = np.cumsum(n)
        if not len(stops) or not other.any():
            continue
        common = np.bincount(posted[np.repeat(begins[mine] - stops + n, n) + np.arange(stops[-1])], minlength=len(sets))
        for i in np.flatnonzero(other & (common >= need(sizes, sizes[j], percent))).tolist():
            a, b = find(part[i]), find(part[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _rest(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between components of classes (key, node, n, part, name) that share a shingle."""
    first = written(many.groupBy("key").agg(F.min("node").alias("first")), "first")
    groups = written(components(many.join(first, "key").select(F.col("node").alias("a"), F.col("first").alias("b"))), "left")
    width = math.log(100 / percent)
    members = written(many.select("node", "n", "part", *NAME).distinct().join(groups, "node").withColumn("g", F.floor(F.log("n") / width).cast("int")), "members")
    sizes = written(members.groupBy("root", "g").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "sizes")
    # like sizes are in one stretch or two neighbouring ones
    near = lambda d, name: sizes.select("root", (F.col("g") + d).alias("g"), F.col("blocks").alias(name))
    placed = members.join(near(0, "here"), ["root", "g"]).join(near(1, "below"), ["root", "g"], "left").join(near(-1, "above"), ["root", "g"], "left")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("here")).cast("int"))
    to = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array())
    task = lambda g, i, h, j, side: F.struct(g.alias("g"), i.alias("i"), h.alias("h"), j.alias("j"), side.alias("side"))
    g, block = F.col("g"), F.col("block")
    tasks = F.concat(
        to("here", lambda o: task(g, F.least(block, o), g, F.greatest(block, o), block > o)),
        to("below", lambda o: task(g - 1, o, g, block, F.lit(True))),
        to("above", lambda o: task(g, block, g + 1, o, F.lit(False))),
    )
    placed = placed.select("root", "node", "part", *NAME, F.explode(tasks).alias("t")).select("root", "t.*", "node", "part", *NAME)
    keys = ["root", "g", "i", "h", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}
        for batch in batches:
            tasks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            for key, node, part, side, blob in zip(tasks, *(batch.column(k).to_pylist() for k in ("node", "part", "side")), batch.column("blob"), strict=True):
                if key != task:
                    yield from links(held)
                    task, held = key, {}
                held[node] = part, side, np.frombuffer(blob.as_buffer(), dtype=np.uint64)
        yield from links(held)

    def links(held: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        if len({p for p, _, _ in held.values()}) < 2:
            return
        nodes = list(held)
        part, side, sets = (list(x) for x in zip(*held.values(), strict=True))
        if out := linked(sets, np.array(side, dtype=bool), np.array(part), percent):
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in out], pa.int64()), pa.array([nodes[j] for _, j in out], pa.int64())], ["a", "b"])

    dealt = placed.join(sets, NAME).drop(*NAME).repartition(n_partitions(many.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs.

    Two texts link if 100 * intersection >= percent * union of their shingle sets. component_id is
    the smallest id reachable by links. Null text, and text without words, has an empty set and is
    its own component. Repeated rows are kept, and share a component as equal texts do. Null ids
    take part, but never name a component unless it has no other. An empty table gives an empty
    result; other columns are ignored. Sets hold 64-bit hashes and are named by 128 bits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    seed = secrets.randbits(63)  # of digests; no result depends on it, and no text can be made for it
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    path = fresh_path(spark, "shingles")
    _scan(rows, words, seed).write.parquet(path)
    scanned = spark.read.schema(SCANNED).parquet(path)
    narrow = written(scanned.where("n >= 0").select("id", "n", *NAME), "sets")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BUCKET_BITS, max(RANGE_BITS, int(total).bit_length()))
    levels = spark.sparkContext.broadcast(_bucket_levels(scanned.where("n < 0").select("range", "blob"), bits))
    removed(spark, path)  # the buckets are counted, and are the larger part of what is on disk
    found = written(_candidates(_postings(rows, levels, bits, words, percent, seed), percent), "candidates")
    levels.destroy()  # the executors' workers need the memory for what follows
    pairs = written(found.where(F.col("key").isNull()).select(*PAIR).distinct(), "pairs")
    many = found.where(F.col("key").isNotNull()).select("key", F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"), "n").distinct()
    classes = narrow.where("n > 0").groupBy(*NAME).agg(F.min("id").alias("first"))
    ends = pairs.select(F.explode(F.array(*(F.struct(F.col(f"{x}_hi").alias("hi"), F.col(f"{x}_lo").alias("lo")) for x in "ab"))).alias("e")).select("e.*")
    met = ends.union(many.select(*NAME)).distinct()
    sets = written(_sets_of(rows, written(classes.join(met, NAME).select(*NAME, F.col("first").alias("id")), "wanted"), words, seed), "partners")
    links = written(_verified(pairs, sets, percent), "links")
    forget(pairs)
    # Numbers for the names of linked classes and of those in shingles with many.
    linked_ends = links.select(F.explode(F.array(*(F.struct(F.col(f"{x}_hi").alias("hi"), F.col(f"{x}_lo").alias("lo")) for x in "ab"))).alias("e")).select("e.*")
    nodes = written(linked_ends.union(many.select(*NAME)).distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    numbered = lambda x: nodes.select(F.col("hi").alias(f"{x}_hi"), F.col("lo").alias(f"{x}_lo"), F.col("node").alias(x))
    edges = written(links.join(numbered("a"), ["a_hi", "a_lo"]).join(numbered("b"), ["b_hi", "b_lo"]).select("a", "b"), "edges")
    groups = written(components(edges), "groups")
    parts = written(many.join(nodes, NAME).join(groups, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("part"), *NAME), "many")
    open_keys = written(parts.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key"), "open")
    if not open_keys.isEmpty():
        more = written(_rest(written(parts.join(open_keys, "key"), "open-classes"), sets, percent), "more-links")
        if not more.isEmpty():
            # what is connected already takes part as its components' stars
            groups = written(components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "groups", instead_of=groups)
    for table in (found, sets, parts):
        forget(table)
    # The smallest id of each component, then of each class, then of each row.
    roots = written(groups.join(nodes, "node").join(classes, NAME).select(*NAME, "first", "root"), "roots")
    least = written(roots.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = roots.join(least, "root").select(*NAME, "component_id")
    per_class = written(classes.join(named, NAME, "left").select(*NAME, F.coalesce("component_id", "first").alias("component_id")), "classes")
    out = narrow.join(per_class, NAME, "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
