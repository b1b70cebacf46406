"""Word-like stretches of bytes, found and named for a whole block of texts with numpy.

A stretch of at most INLINE bytes *is* its key: two 64-bit numbers hold its
bytes and its length, so equal keys mean equal bytes.  ``hashed`` gives 64-bit
hashes of stretches of any length.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np

U = np.uint64
INLINE = 15
#: Unicode white space, spelled out: libraries differ in what \s means to them.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
OTHER, LETTER, NUMBER, BLANK = range(4)
_BEFORE_BLANK = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, f"[{SPACE}]+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            out[[ord(c) for c in every[a:b]]] = kind
    return out


def safe_cuts(text: str, most: int) -> list[str]:
    """The text in parts of about ``most`` characters, cut only before white space that follows something else: a split
    starts there, whatever stands around it.  A part is longer where there is no such place."""
    out, at = [], 0
    while len(text) - at > most:
        m = _BEFORE_BLANK.search(text, at + most)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def usual_splits(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes of all texts, start of each split, first split of each text and their number) by the usual pattern: a
    contraction, or letters, digits or others with one space before them, or white space, whose last character is left to
    what follows.

    A split starts where the kind of character changes, but for three rules: of white space that something follows, the
    last character starts anew; if it is a space, what follows joins it; and a single apostrophe that no space joins takes
    the letters of a contraction.
    """
    joined = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = joined.encode("utf-8", "replace")
    n = len(joined)
    points = np.frombuffer(raw, np.uint8) if len(raw) == n else np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    kind = _kinds()[points]
    edge = np.zeros(n + 2, bool)
    edge[np.concatenate([[0], np.cumsum(sizes)])] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(start)
    end = np.append(first[1:], n)
    of = kind[first]

    last = end[of == BLANK]
    last = last[~edge[last]] - 1
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False

    quote = first[(of == OTHER) & (end - first == 1)]
    quote = quote[(points[quote] == 0x27) & start[quote] & ~edge[quote + 1]]
    quote = quote[kind[quote + 1] == LETTER]
    one = points[quote + 1]
    more = ~edge[quote + 2]
    two = np.where(more, points[np.minimum(quote + 2, n - 1)], 0)
    taken = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
    for a, b in ("re", "ve", "ll"):
        taken[(one == ord(a)) & (two == ord(b))] = 2
    quote, taken = quote[taken > 0], taken[taken > 0]
    start[quote + 1] = False
    after = quote + 1 + taken
    after = after[~edge[after]]
    start[after[kind[after] == LETTER]] = True

    places = np.flatnonzero(start)
    begin = np.searchsorted(places, np.concatenate([[0], np.cumsum(sizes)]))
    if points.itemsize > 1:
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        places = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[places]
    return raw, places, begin


def found_splits(texts: list[str], find) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The same for what ``find`` gives for each text."""
    parts = [[x.encode("utf-8", "replace") for x in find(t)] for t in texts]
    sizes = np.array([len(x) for p in parts for x in p], np.int64)
    raw = b"".join(x for p in parts for x in p)
    return raw, np.cumsum(sizes) - sizes, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _eight(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number."""
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").ravel()


def keys(padded: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(n, 2): bytes and length of stretches of at most INLINE bytes.  16 bytes of padding follow the last."""
    out = np.empty((len(begin), 2), U)
    out[:, 0] = _eight(padded, begin) & _MASKS[np.minimum(size, 8)]
    out[:, 1] = (size.astype(U) << U(56)) | (_eight(padded, begin + 8) & _MASKS[np.clip(size - 8, 0, 7)])
    return out


def hashed(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, long: int = 256) -> np.ndarray:
    """A 64-bit hash of each stretch raw[begin:end]: eight bytes at a time are mixed in, so that no two texts meet by the
    algebra of a polynomial; stretches over ``long`` bytes are hashed by BLAKE2b."""
    size = end - begin
    out = mix(size.astype(U))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    short = size <= long
    at, left, some = begin, size, np.flatnonzero(short & (size > 0))
    step = 0
    while len(some):
        part = _eight(padded, at[some] + step) & _MASKS[np.minimum(left[some] - step, 8)]
        out[some] = mix(out[some] * U(0x9E3779B97F4A7C15) + mix(part + U(0xD6E8FEB86659FD93)))
        step += 8
        some = some[left[some] > step]
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[begin[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Table:
    """From keys to places in a pool of numbers, by open addressing over whole arrays."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.keys = np.zeros((size, 2), U)  # a length of 0 marks a free slot
        self.at, self.count, self.met = np.zeros(size, np.int64), np.zeros(size, np.int32), np.zeros(size, bool)
        self.pool, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0

    def _slots(self, k: np.ndarray) -> np.ndarray:
        return (mix(k[:, 0] ^ mix(k[:, 1])) >> U(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where there is none."""
        slot = self._slots(k)
        out = np.full(len(k), -1, np.int64)
        own = self.keys[slot]
        hit = (own == k).all(1)
        out[hit] = slot[hit]
        rest = np.flatnonzero(~hit & (own[:, 1] != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            own = self.keys[slot[rest]]
            hit = (own == k[rest]).all(1)
            out[rest[hit]] = slot[rest[hit]]
            rest = rest[~hit & (own[:, 1] != 0)]
        return out

    def put(self, k: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Adds distinct new keys; values[ends[i - 1]:ends[i]] belong to key i.  Returns their slots."""
        slot, rest = self._slots(k), np.arange(len(k))
        while len(rest):
            free = rest[self.keys[slot[rest], 1] == 0]
            _, first = np.unique(slot[free], return_index=True)
            self.keys[slot[free[first]]] = k[free[first]]
            rest = rest[(self.keys[slot[rest]] != k[rest]).any(1)]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
        begin = np.concatenate([[0], ends[:-1]])
        self.at[slot], self.count[slot], self.met[slot] = self.used + begin, ends - begin, False
        while self.used + len(values) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(values)] = values
        self.used += len(values)
        self.n += len(k)
        return slot

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of all slots one after another, how many each has)."""
        count = self.count[slot].astype(np.int64)
        return self.pool[spread(self.at[slot], count)], count

    def room(self, more: int) -> None:
        """Sees to it that so many keys more leave a tenth of the slots free."""
        if (self.n + more) * 10 > 9 << self.bits:
            self.forget()
        while (self.n + more) * 10 > 9 << self.bits:
            self.bits += 1
            self.clear()

    def forget(self) -> None:
        """Keeps only keys that were met again since they were put or kept."""
        kept = np.flatnonzero(self.met)
        k, (values, count) = self.keys[kept], self.gather(kept)
        self.clear()
        if len(k) * 4 < 1 << self.bits:
            self.put(k, values, np.cumsum(count))


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, … for each pair."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
