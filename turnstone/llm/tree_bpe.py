"""Operator 8: byte-level BPE as a reduction over a tree.

The ids of a string of bytes form a monoid. `MonoidBpe.encode` encodes both halves (recursively;
equal parts of a string once) and joins them: a window of one id on either side of the seam is
encoded anew, and doubled on the side where it doesn't fit its neighbour. Two neighbouring ids fit
if encoding their bytes gives just those two. A row of ids whose neighbours all fit is the encoding
of its bytes: the first merge across a seam, if there were one, would also be made in the bytes of
the two ids beside it. So when both ends of the window fit, no id outside it can change and the
join is done. A seam that fits nowhere costs one encoding of its bytes, in n log n steps.

Texts are cut into the pattern's matches by `PieceEncoder`, which also cuts long texts where no
match reaches across. Decoding joins bytes up a tree of halves.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, texts_of
from .pieces import LETTER, NUMBER, OTHER, PieceEncoder

#: Strings and windows remembered by a worker; beyond it they are forgotten and made again.
MOST = 150_000
#: Ids decoded at once at a leaf, bytes encoded at once at one.
LEAF_IDS, LEAF_BYTES = 1 << 18, 24
#: More than any rank.
NEVER = 1 << 62


class MonoidBpe:
    """ranks: each token's bytes and rank; every token must be what its own bytes are merged to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.windows: dict[tuple[int, ...], tuple[int, ...]] = {}

    def _merged(self, data: bytes) -> tuple[int, ...]:
        """A string by merging the lowest rank, the leftmost among equals, again and again."""
        ranks = self.ranks
        if len(data) > 2 * LEAF_BYTES:
            return self._merged_by_heap(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            rank = min(pairs)
            if rank == NEVER:
                break
            i = pairs.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        return tuple([ranks[p] for p in parts])

    def _merged_by_heap(self, data: bytes) -> tuple[int, ...]:
        """The same in n log n steps: parts are a linked list, and their pairs wait in a heap."""
        n, ranks = len(data), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n))  # a part's end; where the part before it begins
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the two parts has been merged since
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _window(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        out = self.windows.get(ids)
        if out is None:
            out = self._merged(b"".join([self.bytes_of[i] for i in ids]))
            if len(ids) <= LEAF_BYTES:
                if len(self.windows) > MOST:
                    self.windows.clear()
                self.windows[ids] = out
        return out

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The ids of the bytes of left and right together."""
        if not left or not right:
            return left + right
        a, b = len(left) - 1, 1
        while True:
            inner = self._window(left[a:] + right[:b])
            low = a > 0 and self._window(seam := (left[a - 1], inner[0])) != seam
            high = b < len(right) and self._window(seam := (inner[-1], right[b])) != seam
            if not low and not high:
                return left[:a] + inner + right[b:]
            # twice the window on each side that doesn't fit
            a, b = max(0, a - (len(left) - a)) if low else a, min(len(right), 2 * b) if high else b

    def encode(self, data: bytes, own: dict[bytes, tuple[int, ...]] | None = None) -> tuple[int, ...]:
        """own: what this call has encoded so far, so that a string that repeats itself is quick."""
        if len(data) <= LEAF_BYTES:
            out = self.known.get(data)
            if out is None:
                if len(self.known) > MOST:
                    self.known.clear()
                out = self.known[data] = self._merged(data)
            return out
        own = {} if own is None else own
        out = own.get(data)
        if out is None:
            # a power of two, the larger half: runs of one character are cut where their tokens end
            half = 1 << (len(data) - 1).bit_length() - 1
            out = own[data] = self.join(self.encode(data[:half], own), self.encode(data[half:], own))
        return out


class MonoidDecoder:
    """Bytes of ids: halves are decoded and joined; a leaf is gathered from one flat table."""

    def __init__(self, bytes_of: dict[int, bytes]):
        lengths = np.zeros(max(bytes_of) + 1, dtype=np.int64)
        for i, b in bytes_of.items():
            lengths[i] = len(b)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.pool = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(len(lengths))), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > LEAF_IDS:
            return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])
        n = self.lengths[ids]
        stops = np.cumsum(n)
        return self.pool[np.repeat(self.starts[ids] - stops + n, n) + np.arange(stops[-1] if len(stops) else 0)].tobytes()


def ranks_of(file: bytes) -> dict[bytes, int]:
    """The ranks in a file of lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}


@cache
def kind_of(char: str) -> int:
    """The class of a character in the pattern's own tables: whether it makes one match with a
    letter or a number. White space is known to every table."""
    data = char.encode()
    ranks = {bytes([i]): i for i in range(256)}
    for first in (b"a", b"1"):
        for n in range(1, len(data) + 1):
            ranks[first + data[:n]] = len(ranks)
    table = tiktoken.Encoding("kinds", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for first, kind in (("a", LETTER), ("1", NUMBER)):
        if len(table.encode_ordinary(first + char)) == 1:
            return kind
    return OTHER


@cache
def codec(file: bytes) -> tuple[PieceEncoder, MonoidDecoder]:
    """Encoder and decoder of a rank file, one for each Python worker."""
    bpe = MonoidBpe(ranks_of(file))
    return PieceEncoder(lambda pieces: [bpe.encode(p.encode()) for p in pieces], kind_of=kind_of), MonoidDecoder(bpe.bytes_of)


def encode_decode(docs: DataFrame, ranks_path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of docs.

    ids: with_ids adds the ids themselves; keep: further columns, unchanged. Null text is empty: no ids, digests of nothing. Null ids
    and repeated rows are kept; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(shared.value)
        for batch in batches:
            ids = encoder.ids(texts_of(batch, "text"), np.dtype("<u4"))
            columns = [
                batch.column("id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            columns += [batch.column(c) for c in keep]
            names += keep
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), *keep)
    kept = "".join(f", {c} {dict(docs.dtypes)[c]}" for c in keep)
    out = rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + kept)
    return out.withColumnRenamed("id", id_col)
