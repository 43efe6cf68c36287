"""Byte-level BPE over whole texts, without a token of Python work for repeated pieces.

A byte-level vocabulary first cuts a text into pieces by a fixed pattern and then merges bytes
inside each piece alone. So the ids of a text are those of its pieces in a row, and a piece that
was seen before need not be encoded again. `PieceEncoder` cuts texts with numpy (runs of letters,
numbers, white space and the rest), finds each piece by a 64-bit hash in a bounded open-addressing
table, and hands only pieces it has not met to the encoder that it is given. The table keeps the
pieces themselves: each piece found is compared with the one in the table, character by character,
and one that only shares its hash is encoded anew.

Texts holding code points that this Python's Unicode tables don't know are given to the encoder
whole, since the library's tables may be newer; an encoder that doesn't cut texts itself comes with
a function that tells the class of such a code point.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np

from .common import grouped_by_size

LETTER, NUMBER, SPACE, OTHER, END, UNKNOWN = 0, 1, 2, 3, 4, 5
#: Between two texts of one batch; a noncharacter, which is never cut into pieces.
SEPARATOR = "\U0010ffff"
#: Characters handled at once, and the most pieces and characters of pieces that are remembered.
CHUNK_CHARS, MOST_PIECES, MOST_CHARS = 1 << 19, 1 << 19, 1 << 22
#: White space of the pattern's \s (the Unicode property White_Space).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: One-letter and two-letter endings after an apostrophe that the pattern keeps together.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SAFE_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))
        table[c] = UNKNOWN if category == "Cn" else kind.get(category[0], OTHER)
    table[WHITE] = SPACE
    table[ord(SEPARATOR)] = END
    return table


@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, size=sys.maxunicode + 1, dtype=np.uint64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.full(n, m, dtype=np.uint64))).cumprod(dtype=np.uint64) for m in (_MULTIPLIER, inverse))


def cut_points(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin, for codes that end with a separator. Separators begin pieces too."""
    n = len(codes)
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    first |= kinds == END
    white = kinds == SPACE
    follows = np.zeros(n, dtype=bool)  # a character of a piece comes next
    follows[:-1] = (kinds[1:] != SPACE) & (kinds[1:] != END)
    last = white & follows  # the last of a white run before such a character stands apart
    first |= last
    joined = np.zeros(n, dtype=bool)  # begins a run right after a single blank, which it takes in
    joined[1:] = last[:-1] & (codes[:-1] == 0x20)
    first &= ~joined
    quote = np.flatnonzero((codes[:-1] == 0x27) & first[:-1] & (kinds[1:] == LETTER))
    for ending in ENDINGS:
        at = quote
        for k, letter in enumerate(ending, 1):
            at = at[codes[np.minimum(at + k, n - 1)] == ord(letter)]
        after = at + 1 + len(ending)
        first[at + 1] = False
        first[after[kinds[after] == LETTER]] = True
        quote = np.setdiff1d(quote, at, assume_unique=True)
    return np.flatnonzero(first)


class PieceEncoder:
    """Ids of texts, by an encoder for lists of pieces.

    encode: gets a list of str, returns the ids of each. specials: strings that the encoder treats
    as one token wherever they stand; it gets texts that hold one whole. Memory is bounded: at most
    MOST_PIECES pieces or MOST_CHARS characters of them are remembered (then all are forgotten), and
    CHUNK_CHARS characters are cut at a time. kind_of: the class of a code point that this Python doesn't know; with it every text
    without specials is cut here.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], specials: Sequence[str] = (), most: int = MOST_PIECES, kind_of: Callable[[str], int] | None = None):
        self.encode, self.specials, self.most, self.kind_of = encode, tuple(specials), most, kind_of
        self.classes = classes().copy() if kind_of else classes()
        self._forget()

    def _forget(self) -> None:
        self.count, self.end, self.chars = 0, 0, 0
        self.keys, self.slots = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.int32)
        self.starts, self.lengths = np.zeros(1 << 15, dtype=np.int64), np.zeros(1 << 15, dtype=np.int32)
        self.pool = np.zeros(1 << 17, dtype=np.int32)
        self.piece_starts, self.piece_sizes = np.zeros(1 << 15, dtype=np.int64), np.zeros(1 << 15, dtype=np.int64)
        self.letters = np.zeros(1 << 17, dtype=np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for one not met yet."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, dtype=np.int64)
        at = (hashes >> np.uint64(20)) & mask
        left = np.arange(len(hashes))
        while len(left):
            there = self.keys[at]
            hit = there == hashes[left]
            out[left[hit]] = self.slots[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & mask
        return out

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        at = (hashes >> np.uint64(20)) & mask
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[left[free]]
            mine = self.keys[at] == hashes[left]
            self.slots[at[mine]] = numbers[left[mine]]
            left, at = left[~mine], (at[~mine] + np.uint64(1)) & mask

    def _learn(self, hashes: np.ndarray | None, pieces: list[str]) -> None:
        """Remembers pieces and their ids; without hashes they can't be found again."""
        ids = self.encode(pieces)
        lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(lengths.sum()))
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        letters = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)
        new = self.count + len(pieces)
        needed = ("starts", new), ("lengths", new), ("piece_starts", new), ("piece_sizes", new), ("pool", self.end + len(flat)), ("letters", self.chars + len(letters))
        for name, need in needed:
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate((old, np.zeros(max(need, 2 * len(old)) - len(old), dtype=old.dtype))))
        self.pool[self.end : self.end + len(flat)] = flat
        self.starts[self.count : new] = self.end + np.cumsum(lengths) - lengths
        self.lengths[self.count : new] = lengths
        self.end += len(flat)
        self.letters[self.chars : self.chars + len(letters)] = letters
        self.piece_starts[self.count : new] = self.chars + np.cumsum(sizes) - sizes
        self.piece_sizes[self.count : new] = sizes
        self.chars += len(letters)
        if hashes is None:
            self.count = new
            return
        if 2 * new > len(self.keys):
            known = self.keys != 0
            hashed, numbers = self.keys[known], self.slots[known]
            size = 1 << (4 * new - 1).bit_length()
            self.keys, self.slots = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32)
            self._put(hashed, numbers)
        self._put(hashes, np.arange(self.count, new, dtype=np.int32))
        self.count = new

    def _numbers(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' numbers, and the number of pieces of each text."""
        joined = SEPARATOR.join(texts) + SEPARATOR
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kinds = self.classes[codes]
        if self.kind_of:
            for c in np.unique(codes[kinds == UNKNOWN]).tolist():
                self.classes[c] = self.kind_of(chr(c))
            kinds = self.classes[codes]
            kinds[kinds == END] = self.kind_of(SEPARATOR) if (kinds == END).sum() > len(texts) else END
            kinds[np.cumsum([len(t) + 1 for t in texts]) - 1] = END
        begins = cut_points(codes, kinds)
        ends = np.append(begins[1:], len(codes))
        power, inverse = _powers(1 << (len(codes) - 1).bit_length())
        with np.errstate(over="ignore"):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(_letters()[codes] * power[: len(codes)], dtype=np.uint64)))
            hashes = (sums[ends] - sums[begins]) * inverse[begins]
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(_MULTIPLIER)
        hashes[hashes == 0] = 1
        real = kinds[begins] != END
        counts = np.diff(np.concatenate(([0], np.cumsum(real)[~real])))
        begins, ends, hashes = begins[real], ends[real], hashes[real]
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, one = np.unique(hashes[missing], return_index=True)
            if self.count and (self.count + len(new) > self.most or self.chars > MOST_CHARS):
                self._forget()
                missing = np.arange(len(hashes))
                new, one = np.unique(hashes, return_index=True)
            one = missing[one]
            self._learn(new, [joined[a:b] for a, b in zip(begins[one].tolist(), ends[one].tolist(), strict=True)])
            found[missing] = self._find(hashes[missing])
        return self._checked(found, codes, begins, ends), counts

    def _checked(self, found: np.ndarray, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """found, with numbers of their own for pieces that aren't those of the numbers found."""
        sizes = ends - begins
        other = self.piece_sizes[found] != sizes
        same = np.flatnonzero(~other)
        n = sizes[same]
        if len(same):
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = self.letters[np.repeat(self.piece_starts[found[same]], n) + at] != codes[np.repeat(begins[same], n) + at]
            if differ.any():
                other[same[np.unique(np.repeat(np.arange(len(same)), n)[differ])]] = True
        if (wrong := np.flatnonzero(other)).size:
            pieces = [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(begins[wrong].tolist(), ends[wrong].tolist(), strict=True)]
            distinct = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
            first = self.count
            self._learn(None, list(distinct))
            found[wrong] = [first + distinct[p] for p in pieces]
        return found

    def _parts(self, text: str) -> list[str]:
        """The text, cut where no piece reaches across, if it is long."""
        parts, start = [], 0
        while len(text) - start > CHUNK_CHARS and (m := _SAFE_CUT.search(text, start + CHUNK_CHARS // 2)):
            parts.append(text[start : m.start()])
            start = m.start()
        return [*parts, text[start:]]

    def _plain(self, text: str) -> bool:
        if any(x in text for x in self.specials):
            return False
        if self.kind_of or text.isascii():
            return True
        return not (classes()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)] >= END).any()

    def _spans(self, texts: list[str]):
        """Groups of parts to be handled at once: their texts' positions, and the parts."""
        plain = [self._plain(t) for t in texts]
        parts = [(i, p) for i, t in enumerate(texts) for p in (self._parts(t) if plain[i] else [t])]
        for a, b in grouped_by_size([len(p) for _, p in parts], CHUNK_CHARS):
            odd = [k for k in range(a, b) if not plain[parts[k][0]]]
            begin = a
            for k in [*odd, b]:
                if k > begin:
                    yield [parts[j] for j in range(begin, k)], False
                if k < b:
                    yield [parts[k]], True
                begin = k + 1

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        for group, odd in self._spans(texts):
            if odd:
                out[group[0][0]] += len(self.encode([group[0][1]])[0])
                continue
            numbers, counts = self._numbers([p for _, p in group])
            sums = np.concatenate(([0], np.cumsum(self.lengths[numbers], dtype=np.int64)))
            stops = np.cumsum(counts)
            np.add.at(out, [i for i, _ in group], sums[stops] - sums[stops - counts])
        return out

    def ids(self, texts: list[str], dtype: type = np.uint32) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for group, odd in self._spans(texts):
            if odd:
                out[group[0][0]].append(np.array(self.encode([group[0][1]])[0], dtype=dtype))
                continue
            numbers, counts = self._numbers([p for _, p in group])
            lengths = self.lengths[numbers].astype(np.int64)
            stops = np.concatenate(([0], np.cumsum(lengths)))
            flat = self.pool[np.repeat(self.starts[numbers] - stops[:-1], lengths) + np.arange(stops[-1])].astype(dtype)
            ends = stops[np.cumsum(counts)]
            for (i, _), a, b in zip(group, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i].append(flat[a:b])
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, dtype=dtype) for x in out]
