"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The words of the items, in pieces that overlap, become suffix automata over word numbers, each of a bounded number of
words and built by a task of its own. Training documents stream through them: every word moves the state on and keeps
the length of the longest match that ends there, so all windows are found in one pass. Many stretches of text walk side
by side, a word of each at a time.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinloom.llm.hashing import WordTable, lowered, word_bounds
from opinloom.llm.shared import Work, plain_text, python_tasks, row_unpacked, sliced, text_bytes, with_row

# words are runs of a-z, 0-9 and everything beyond ASCII, after A-Z are lowered
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
WIDTH = 10
SHARD_WORDS = 250_000  # words in an automaton, about 20 MB
PIECE_WORDS = 4_096  # new words in a piece of an item
SIDE_BY_SIDE = 8  # automata that a task holds at once
LANE = 64  # new words in a stretch of text


class Automaton:
    """The suffix automaton of the pieces of one shard, as arrays.

    ``pieces`` holds (item or None, words, is the whole item); a window is ``width`` consecutive words, or all words of
    an item with fewer.
    """

    def __init__(self, pieces: list[tuple[str | None, list[str], bool]], width: int):
        self.width = width
        names = sorted({w for _, ws, _ in pieces for w in ws})
        self.words = WordTable([w.encode() for w in names])
        number = {w: i for i, w in enumerate(names)}
        following: list[dict[int, int]] = [{}]
        link, longest = [-1], [0]

        def split(p: int, w: int, q: int) -> int:
            """The state of the longest match through ``p`` and ``w``, parted from the longer ones of ``q``."""
            if longest[q] == longest[p] + 1:
                return q
            own = len(link)
            following.append(dict(following[q]))
            link.append(link[q])
            longest.append(longest[p] + 1)
            link[q] = own
            while p >= 0 and following[p].get(w) == q:
                following[p][w] = own
                p = link[p]
            return own

        for _, piece, _ in pieces:
            last = 0
            for w in map(number.__getitem__, piece):
                if w in following[last]:
                    last = split(last, w, following[last][w])
                    continue
                own, p = len(link), last
                following.append({})
                link.append(0)
                longest.append(longest[last] + 1)
                while p >= 0 and w not in following[p]:
                    following[p][w] = own
                    p = link[p]
                if p >= 0:
                    link[own] = split(p, w, following[p][w])
                last = own
        windows = self._windows(pieces, number, following, link, longest)
        self.link, self.longest = np.array(link, np.int64), np.array(longest, np.int64)
        keys = np.array([s * len(names) + w for s, to in enumerate(following) for w in to], np.int64)
        to = np.array([t for edges in following for t in edges.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], to[order]
        self._index(windows)

    def _windows(self, pieces, number, following, link, longest) -> dict[tuple[int, int], set[str]]:
        """Every window as (state, length) with the items that hold it."""
        windows: dict[tuple[int, int], set[str]] = {}
        for item, piece, whole in pieces:
            width = self.width if len(piece) >= self.width else len(piece) if whole else 0
            if not width:
                continue
            state = length = 0
            for w in map(number.__getitem__, piece):
                state, length = following[state][w], length + 1
                while longest[link[state]] >= width:
                    state = link[state]
                length = min(length, longest[state])
                if length >= width:
                    windows.setdefault((state, width), set()).update([] if item is None else [item])
        return windows

    def _index(self, windows: dict[tuple[int, int], set[str]]) -> None:
        """Windows by state, the next state above that has any, and the least length that has any."""
        known = sorted(windows)
        self.items = sorted({i for held in windows.values() for i in held})
        place = {i: n for n, i in enumerate(self.items)}
        self.length = np.array([n for _, n in known], np.int64)
        n = len(self.link)
        self.first = np.searchsorted(np.array([s for s, _ in known], np.int64), np.arange(n + 1))
        self.held = np.array([place[i] for k in known for i in sorted(windows[k])], np.int64)
        self.held_first = np.cumsum([0, *[len(windows[k]) for k in known]], dtype=np.int64)
        self.above, self.least = np.full(n, -1, np.int64), np.full(n, 1 << 40, np.int64)
        for s in np.argsort(self.longest, kind="stable").tolist():
            up = self.link[s]
            if up >= 0:
                self.above[s] = up if self.first[up] < self.first[up + 1] else self.above[up]
                self.least[s] = self.least[up]
            if self.first[s] < self.first[s + 1]:
                self.least[s] = min(self.least[s], self.length[self.first[s] : self.first[s + 1]].min())

    def stream(self, numbers: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, state and longest match wherever a window may end, in texts that ``before`` parts."""
        begin, end = [], []
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            starts = np.arange(a, b, LANE)
            begin.append(np.maximum(starts - self.width + 1, a))
            end.append(np.minimum(starts + LANE, b))
        begin, end = np.concatenate([*begin, np.zeros(0, np.int64)]), np.concatenate([*end, np.zeros(0, np.int64)])
        known = np.r_[0, np.cumsum(numbers >= 0)]
        some = known[end] > known[begin]
        begin, end = begin[some], end[some]
        order = np.argsort(begin - end, kind="stable")  # the longest first
        begin, end = begin[order], end[order]
        state, length = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        found = []
        most = int((end - begin).max(initial=0))
        active = np.searchsorted(-(end - begin), -np.arange(most), "left")
        for t in range(most):
            m = int(active[t])
            at = begin[:m] + t
            word = numbers[at]
            lost = word < 0
            state[:m][lost] = length[:m][lost] = 0
            todo = np.flatnonzero(~lost)
            while len(todo):
                key = state[todo] * len(self.words) + word[todo]
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[i] == key
                state[todo[hit]] = self.next[i[hit]]
                length[todo[hit]] += 1
                todo = todo[~hit]
                up = self.link[state[todo]]
                todo, up = todo[up >= 0], up[up >= 0]
                state[todo], length[todo] = up, self.longest[up]
            ends = np.flatnonzero(length[:m] >= self.least[state[:m]])
            if len(ends):
                found.append((at[ends], state[ends], length[ends]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def windows(self, numbers: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last word and the number of every window that occurs."""
        place, state, length = self.stream(numbers, before)
        found = []
        own = self.first[state] < self.first[state + 1]
        state = np.where(own, state, self.above[state])
        while len(state):
            n = self.first[state + 1] - self.first[state]
            row = np.repeat(np.arange(len(state)), n)
            window = np.repeat(self.first[state] - np.cumsum(n) + n, n) + np.arange(n.sum())
            fits = self.length[window] <= length[row]
            found.append((place[row[fits]], window[fits]))
            up = self.above[state]
            place, state, length = place[up >= 0], up[up >= 0], length[up >= 0]
        if not found:
            return (np.zeros(0, np.int64),) * 2
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def items_in(self, text: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and the items whose windows they hold, each pair once."""
        pairs = np.unique(text * len(self.length) + window) if len(window) else text[:0]
        text, window = pairs // max(len(self.length), 1), pairs % max(len(self.length), 1)
        n = self.held_first[window + 1] - self.held_first[window]
        at = np.repeat(self.held_first[window] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.unique(np.repeat(text, n) * max(len(self.items), 1) + self.held[at])
        return both // max(len(self.items), 1), both % max(len(self.items), 1)


def _pieces(items: DataFrame, width: int) -> DataFrame:
    """``item, words, whole``: every item in pieces that share ``width - 1`` words, equal pieces of an item once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = []
            data, offsets = text_bytes(batch.column(1))
            data = lowered(data)
            starts, ends, before = word_bounds(data, offsets, BREAKS)
            for item, a, b in zip(batch.column(0).to_pylist(), before[:-1].tolist(), before[1:].tolist(), strict=True):
                for s in range(a, b, PIECE_WORDS):
                    s, e = max(a, s - width + 1), min(b, s + PIECE_WORDS)
                    words = b" ".join(data[i:j].tobytes() for i, j in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True))
                    rows.append((item, words.decode(), s == a and e == b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())],
                ["item", "words", "whole"])

    texts = items.select(F.col("item_id").cast("string").alias("item"), plain_text().alias("text"))
    return texts.mapInArrow(cut, "item string, words string, whole boolean").distinct()


def automata(items: DataFrame, work: Work, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``shard, automaton``: a written table with an automaton of about ``shard_words`` words in each row."""
    pieces = work.table(_pieces(items, width), "pieces")
    words = pieces.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0
    shards = math.ceil(words / shard_words)
    if not shards:
        return work.table(work.spark.createDataFrame([], "shard int, automaton binary"), "automata")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = [(i, w.split(" "), o) for i, w, o in zip(rows["item"], rows["words"], rows["whole"], strict=True)]
        return pd.DataFrame({"shard": [key[0]], "automaton": [pickle.dumps(Automaton(held, width))]})

    shard = F.pmod(F.xxhash64("item", "words"), F.lit(shards)).cast("int").alias("shard")
    built = work.table(pieces.select(shard, "*").groupBy("shard").applyInPandas(build, "shard int, automaton binary"), "automata")
    work.drop(pieces)
    return built


def _merged(first: np.ndarray, last: np.ndarray) -> list[int]:
    """Runs of words, begin and end in turn, in order and without overlap."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, first[1:] > last[:-1] + 1]
    at = np.flatnonzero(new)
    return np.stack([first[at], np.r_[last[at[1:] - 1], last[-1]]], axis=1).ravel().tolist()


def _through(marked: DataFrame, blobs: list) -> DataFrame:
    """``marked`` with the runs and items of some automata added."""
    names = marked.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pickle.loads(b.value) for b in blobs]
        for batch in sliced(batches, "text"):
            data, offsets = text_bytes(batch.column(names.index("text")))
            data = lowered(data)
            starts, ends, before = word_bounds(data, offsets, BREAKS)
            text = np.repeat(np.arange(batch.num_rows), np.diff(before))
            runs = batch.column(names.index("runs")).to_pylist()
            items = batch.column(names.index("items")).to_pylist()
            for automaton in held:
                place, window = automaton.windows(automaton.words.numbers(data, starts, ends), before)
                if not len(place):
                    continue
                owner = text[place]
                last = place - before[owner]
                first = last - automaton.length[window] + 1
                order = np.argsort(owner, kind="stable")
                rows, at = np.unique(owner[order], return_index=True)
                for row, part in zip(rows.tolist(), np.split(order, at[1:]), strict=True):
                    old = np.array(runs[row] or [], np.int64).reshape(-1, 2)
                    runs[row] = _merged(np.r_[old[:, 0], first[part]], np.r_[old[:, 1], last[part]])
                rows, which = automaton.items_in(owner, window)
                for row, i in zip(rows.tolist(), which.tolist(), strict=True):
                    items[row].append(automaton.items[i])
            columns = dict(zip(names, batch.columns, strict=True)) | {
                "n_words": pa.array(np.diff(before), pa.int64()), "runs": pa.array(runs, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return marked.mapInArrow(read, marked.schema)


def _marked(docs: DataFrame, items: DataFrame, work: Work, width: int, shard_words: int) -> DataFrame:
    """The rows with ``n_words``, the ``runs`` of hit words and the ``items`` found.

    One automaton at a time passes through the driver, into a broadcast of bounded size. A task holds
    ``SIDE_BY_SIDE`` of them; further ones go over the written result of those before.
    """
    table = automata(items, work, width, shard_words)
    shards = sorted(r.shard for r in table.select("shard").collect())
    marked = docs.select(
        "*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("runs"), F.array().cast("array<string>").alias("items"))
    for first in range(0, max(len(shards), 1), SIDE_BY_SIDE):
        blobs = []
        for shard in shards[first : first + SIDE_BY_SIDE]:
            blobs.append(work.spark.sparkContext.broadcast(bytes(table.where(F.col("shard") == shard).first().automaton)))
        marked = _through(marked, blobs)
        if first + SIDE_BY_SIDE < len(shards):
            marked = work.table(marked, "marked")
    work.drop(table)
    return marked


def _n_hit() -> Column:
    """Number of hit words, from runs that do not overlap."""
    ends = F.filter("runs", lambda _, i: i % 2 == 1)
    begins = F.filter("runs", lambda _, i: i % 2 == 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return total(ends) - total(begins) + F.size(ends)


def overlaps(docs: DataFrame, items: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit``, ``item_ids`` (sorted) and ``contaminated``.

    A word is hit if it lies in an occurrence of ``width`` consecutive words of an item, or of a whole item with fewer.
    Null and empty texts have no words and are never hit; items without words are never found; windows of an item
    without an id hit words but add no id. Repeated rows get equal answers, repeated items count once. Empty tables of
    documents or items are allowed. Texts of any length are read whole. Further columns stay; those named like an added
    column are replaced.
    """
    work = Work(python_tasks(docs.sparkSession))
    marked = _marked(with_row(docs, plain_text().alias("text")), items, work, width, shard_words)
    return row_unpacked(
        marked, docs.columns, "n_words", _n_hit().alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("item_ids"),
        (F.size("runs") > 0).alias("contaminated"))


def decontaminated(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, most_covered: float = 0.5, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``docs`` without contamination: same columns, same types.

    Every span of hit words is cut out of its text, from its first to its last character; a document with a share of
    hit words over ``most_covered`` is dropped. Clean texts, null ones too, stay as they are. The rules of ``overlaps``
    hold otherwise.
    """
    work = Work(python_tasks(docs.sparkSession))
    marked = _marked(with_row(docs, plain_text().alias("text")), items, work, width, shard_words)
    names = marked.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column(names.index("text")).to_pylist()
            for row, runs in enumerate(batch.column(names.index("runs")).to_pylist()):
                if runs:
                    data, offsets = text_bytes(batch.column(names.index("text")).slice(row, 1))
                    starts, ends, _ = word_bounds(lowered(data), offsets, BREAKS)
                    kept = np.ones(len(data), bool)
                    for a, b in zip(runs[::2], runs[1::2], strict=True):
                        kept[starts[a] : ends[b]] = False
                    texts[row] = data[kept].tobytes().decode()
            columns = dict(zip(names, batch.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    clean = F.size("runs") == 0
    cleaned = marked.where(clean | (_n_hit() <= F.lit(float(most_covered)) * F.col("n_words"))).mapInArrow(cut, marked.schema)
    text = F.when(clean, F.col("__row.text")).otherwise(F.col("text"))
    own = [text.alias(c) if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns]
    return cleaned.select(*own)
