"""Counts over the bytes, words and lines of many texts at once, for the classifiers."""

from __future__ import annotations

import numpy as np

from opinloom.llm.hashing import U, _joined, mixed, word_bounds, word_hashes


def byte_class(characters: str) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[np.frombuffer(characters.encode("ascii"), np.uint8)] = 1
    return table


UPPER = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = byte_class("0123456789")
MARK = byte_class(".,;:")
LOUD = byte_class("!?")
SYMBOL = byte_class("#*$%&|<>")
NEWLINE = byte_class("\n")
LETTER = UPPER + byte_class("abcdefghijklmnopqrstuvwxyz")
HIGH = np.r_[np.zeros(128, np.int32), np.ones(128, np.int32)]
CONTINUED = np.r_[np.zeros(128, np.int32), np.ones(64, np.int32), np.zeros(64, np.int32)]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the flags of each text."""
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets]).astype(np.float64)


def of_text(before: np.ndarray) -> np.ndarray:
    """For each item the number of its text, given the number of items before each text."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def distinct(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Number of different hashes in each text."""
    _, at = np.unique(mixed(hashes + text.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(text[at], minlength=texts).astype(np.float64)


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every line that is not empty, and the number of such lines before each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    broken = data == 10
    begin = np.zeros(len(data), bool)
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin[1:] |= broken[:-1]
    starts = np.flatnonzero(begin)
    ends = np.r_[starts[1:], len(data)]
    ends = ends - broken[ends - 1]
    full = ends > starts
    starts, ends = starts[full], ends[full]
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def structure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics of each text (a row each), and its words: their hashes and the text they belong to."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    starts, ends, before = word_bounds(data, offsets)
    hashes, text = word_hashes(data, starts, ends), of_text(before)
    count = np.diff(before).astype(np.float64)
    least_one = np.maximum(count, 1)
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    triples = np.zeros(n)
    if len(hashes) > 2:
        inside = text[2:] == text[:-2]
        triples = distinct(_joined([hashes[:-2], hashes[1:-1], hashes[2:]])[inside], text[2:][inside], n)
    lines, line_before = line_hashes(data, offsets)
    line_count = np.maximum(np.diff(line_before), 1)
    last = data[ends - 1] if len(ends) else data[:0]
    columns = [
        np.log1p(count),
        per_text(np.ones(len(data), np.int8), offsets) / least_one,
        per_text(UPPER[data], offsets) / size,
        per_text(DIGIT[data], offsets) / size,
        per_text(MARK[data], offsets) / size,
        per_text(LOUD[data], offsets) / size,
        per_text(SYMBOL[data], offsets) / size,
        per_text(HIGH[data], offsets) / size,
        per_text(NEWLINE[data], offsets) / size,
        distinct(hashes, text, n) / least_one,
        np.bincount(text[same], minlength=n) / least_one,
        triples / np.maximum(count - 2, 1),
        distinct(lines, of_text(line_before), n) / line_count,
        np.bincount(text, weights=(SYMBOL[last] + LOUD[last]).astype(np.float64), minlength=n) / least_one,
    ]
    return np.stack(columns, axis=1), hashes, text
