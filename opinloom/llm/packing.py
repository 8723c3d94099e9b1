"""Token-id output: documents packed into rows of a fixed length by best-fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from opinloom.llm.shared import plain_text, python_tasks, sliced

ROW_LENGTH = 2048
PAD = 50256
WINDOW_TOKENS = 1 << 22
KEPT_WORDS = 400_000
KEPT_LENGTH = 40


class Tokens:
    """A byte-level BPE from a file of ranks, with a bounded memory of the words it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self.words
        for w in self.find(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encoding.encode_ordinary(w)
                if len(w) <= KEPT_LENGTH:
                    if len(words) >= KEPT_WORDS:
                        words.clear()
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode(ids)


def ship(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The ranks for all tasks; their size is that of the file, whatever the corpus."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return python_tasks(spark).sparkContext.broadcast((ranks, pattern))


_loaded: dict = {}


def tokens(shipped: Broadcast) -> Tokens:
    if shipped.value is not _loaded.get("of"):
        _loaded["of"], _loaded["tokens"] = shipped.value, Tokens(*shipped.value)
    return _loaded["tokens"]


class Capacities:
    """Open rows by the room left in them; a segment tree over all capacities finds the least one that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _changed(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._changed(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The capacity and number of the tightest row with at least this room."""
        at = least + self.leaves
        while self.count[at] == 0:
            # go up until there is a filled branch to the right
            while at & 1:
                at >>= 1
                if not at:
                    return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not self.count[at]:
                at += 1
        capacity = at - self.leaves
        self._changed(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Rows of item numbers: each item, longest first, goes where the least room is left over; ties keep their order."""
    rows: list[list[int]] = []
    open_rows = Capacities(room)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        found = open_rows.take(need)
        if found is None:
            capacity, row = room, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(item)
        if capacity > need:
            open_rows.put(capacity - need, row)
    return rows


PACKED = "sequence_id string, n_tokens int, doc_ids array<{}>, parts array<int>, cu_seqlens array<int>, ids binary, position_ids binary"


def packed(docs: DataFrame, shipped: Broadcast, room: int = ROW_LENGTH) -> DataFrame:
    """Rows of ``room`` ids: segments of documents with their ids, places and cumulative lengths.

    ``ids`` holds ``room`` little-endian 16-bit ids, padded with ``PAD``; ``position_ids`` as many 16-bit positions, which
    begin at 0 with each segment; ``cu_seqlens`` the bounds of the segments, ``doc_ids`` and ``parts`` whose part each is.
    A document longer than a row is cut into parts of ``room`` tokens and a rest; putting its parts together in order
    gives its ids again. A text without tokens (null, empty) takes part in no row. Repeated rows are packed each; a null
    doc_id stays null. Other columns are not read. An empty table gives no rows.

    Each task packs its own documents in windows of about ``WINDOW_TOKENS`` tokens: nothing is shuffled, memory is
    bounded, and a task that is run again packs alike. Room left over is below one row a window plus what best fit leaves.
    """

    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def window(number: int, ids: list, owner: list, part: list) -> pa.RecordBatch:
        rows = best_fit_decreasing(np.array([len(x) for x in ids]), room)
        columns: list[list] = [[] for _ in range(7)]
        for row, items in enumerate(rows):
            bounds = np.cumsum([0, *[len(ids[i]) for i in items]])
            matrix, place = np.full(room, PAD, np.uint16), np.zeros(room, np.uint16)
            for i, start, end in zip(items, bounds, bounds[1:], strict=False):
                matrix[start:end] = ids[i]
                place[start:end] = np.arange(end - start)
            values = (
                f"{TaskContext.get().partitionId()}-{number}-{row}", int(bounds[-1]), [owner[i] for i in items],
                [part[i] for i in items], bounds.tolist(), matrix.tobytes(), place.tobytes())
            for c, v in zip(columns, values, strict=True):
                c.append(v)
        kinds = [pa.string(), pa.int32(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = ["sequence_id", "n_tokens", "doc_ids", "parts", "cu_seqlens", "ids", "position_ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens(shipped)
        ids, owner, part, held, number = [], [], [], 0, 0
        for batch in sliced(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = np.array(of.encode(text), np.uint16)
                for k, start in enumerate(range(0, len(whole), room)):
                    ids.append(whole[start : start + room])
                    owner.append(doc_id)
                    part.append(k)
                held += len(whole)
                if held >= WINDOW_TOKENS:
                    yield window(number, ids, owner, part)
                    ids, owner, part, held, number = [], [], [], 0, number + 1
        if ids:
            yield window(number, ids, owner, part)

    return docs.select("doc_id", plain_text().alias("text")).mapInArrow(pack, PACKED.format(docs.schema["doc_id"].dataType.simpleString()))


def written(docs: DataFrame, shipped: Broadcast, path: str, room: int = ROW_LENGTH) -> None:
    """Writes the packed rows as Parquet: the id matrix is its column ``ids``, row by row."""
    packed(docs, shipped, room).write.parquet(path)


def unpacked(rows: DataFrame) -> DataFrame:
    """``(doc_id, part, ids)`` of packed rows, as written: what is needed to put the documents together again."""
    segment = F.posexplode(F.arrays_zip("doc_ids", "parts"))
    each = rows.select("ids", "cu_seqlens", segment.alias("at", "s"))
    start, end = F.get("cu_seqlens", F.col("at")), F.get("cu_seqlens", F.col("at") + 1)
    return each.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.parts").alias("part"), F.substring("ids", 2 * start + 1, 2 * (end - start)).alias("ids"))
