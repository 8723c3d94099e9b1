"""64-bit hashes of words and word n-grams, taken over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
CHUNK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A full avalanche of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE, _BASE_INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        step = np.full(max(n, CHUNK), _BASE if name == "up" else _BASE_INVERSE, np.uint64)
        step[0] = 1
        _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers[name]


def word_bounds(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of words before each text; ``breaks`` tells the bytes between words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def byte_values(same: dict[str, str] | None = None) -> np.ndarray:
    """What each byte counts for in a hash: A-Z as a-z, and further characters as the ones they stand for."""
    fold = _LOWER.copy()
    for a, b in (same or {}).items():
        fold[ord(a)] = ord(b)
    return _BYTE[fold]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = byte_values()) -> np.ndarray:
    """A hash per word: a polynomial over its bytes, from sums that run over a chunk of the text."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        part = data[base : ends[last - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _power("up", len(part))[: len(part)], out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mixed((sums[e] - sums[s]) * _power("down", len(part))[s] + (e - s).astype(np.uint64))
        first = last
    return out


def _joined(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = (h ^ (h >> U(29))) * U(0xD6E8FEB86659FD93) + c
    return mixed(h)


def gram_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct n-grams of lower-cased words.

    A text with fewer words than ``width`` has its whole sequence as its one n-gram, a text without words none.
    """
    starts, ends, before = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    whole = _joined([hashes[i : len(hashes) - width + 1 + i] for i in range(width)]) if len(hashes) >= width else None
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(_joined([hashes[i : i + 1] for i in range(a, b)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def seeded_values(seed: int) -> np.ndarray:
    """Byte values of another hash of the same words, for the case that two words share one; 0 gives the usual hash."""
    return byte_values() if not seed else mixed(byte_values() + U(seed))


def same_words(
    a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray
) -> np.ndarray:
    """Whether each word of ``a`` has the very bytes of the word of ``b`` beside it."""
    size = a_ends - a_starts
    same = size == b_ends - b_starts
    left, at = np.flatnonzero(same), 0
    while len(left := left[size[left] > at]):
        equal = a[a_starts[left] + at] == b[b_starts[left] + at]
        same[left[~equal]] = False
        left, at = left[equal], at + 1
    return same


class WordTable:
    """Words with numbers from 0 on, looked up many at once by hash and confirmed by their bytes."""

    def __init__(self, words: list[bytes], keys: list[int] | None = None):
        """``keys`` (64 bits) tell equal words of several tables apart, such as those of different languages."""
        ends = np.cumsum([0, *map(len, words)], dtype=np.int64)
        self.data, self.starts, self.ends = np.frombuffer(b"".join(words), np.uint8), ends[:-1], ends[1:]
        self.keys = None if keys is None else np.array(keys, np.uint64)
        for self.seed in range(64):
            found = self._hashes(self.data, self.starts, self.ends, self.keys)
            self.order = np.argsort(found, kind="stable")
            self.hashes = found[self.order]
            if not len(words) or (self.hashes[1:] != self.hashes[:-1]).all():
                return
        raise ValueError("words are not distinct")

    def __len__(self) -> int:
        return len(self.order)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None) -> np.ndarray:
        found = word_hashes(data, starts, ends, seeded_values(self.seed))
        return found if keys is None else mixed(found + keys)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """The number of each word of lower-cased ``data``, -1 for words the table does not have."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self) or not len(starts):
            return out
        hashes = self._hashes(data, starts, ends, keys)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        known = np.flatnonzero(self.hashes[at] == hashes)
        number = self.order[at[known]]
        same = same_words(data, starts[known], ends[known], self.data, self.starts[number], self.ends[number])
        if keys is not None:
            same &= self.keys[number] == keys[known]
        out[known[same]] = number[same]
        return out


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER.astype(np.uint8)[data]
