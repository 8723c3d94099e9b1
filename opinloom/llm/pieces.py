"""SentencePiece encoding and decoding with a table of last tokens.

Byte-pair merges have a local form: a sequence of tokens is the encoding of its text exactly if no two neighbours would
have merged across their boundary. So each prefix of a text has one possible last token: the one piece ending there
that is compatible with the last token of the prefix before it. An automaton finds the pieces that end at each
character; the table of last tokens is filled from left to right, and the ids are read off backwards.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.llm.shared import plain_text, python_tasks, sliced

SPACE = "▁"
KEPT_WORDS = 150_000  # in each of two generations
KEPT_PAIRS = 300_000
KEPT_LENGTH = 40
ROWS_AT_ONCE = 256
ENDLESS = float("inf")


class Vocabulary:
    """The pieces of a byte-pair model with byte fallback and without normalisation, as plain data."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.scores = [model.get_score(i) for i in range(size)]
        self.bytes = {i: int(self.pieces[i][1:-1], 16) for i in range(size) if model.is_byte(i)}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()


class Codec:
    """Encodes and decodes with one vocabulary; lives as long as its Python worker."""

    def __init__(self, words: Vocabulary):
        special = words.bytes.keys() | words.silent | {words.unknown}
        self.ids = {p: i for i, p in enumerate(words.pieces) if i not in special}
        # the order of merges: a higher score is merged earlier
        self.rank = {p: -words.scores[i] for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that hold a space after other characters are not supported")
        self.byte_id = {b: i for i, b in words.bytes.items()}
        self.vocabulary = words
        self.shown = [chr(words.bytes[i]) if i in words.bytes else p.replace(SPACE, " ") for i, p in enumerate(words.pieces)]
        self.cut = re.compile(_cut_pattern(self.ids))
        self.kind = np.uint16 if len(words.pieces) <= 1 << 16 else np.int32
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.spines: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.length = [len(p) for p in words.pieces]
        self.characters = {p for p in self.ids if len(p) == 1}
        # ids that need more than their own text to be shown
        self.hard = {i for i, b in words.bytes.items() if b >= 128} | words.silent | {words.unknown}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or self.split(p) is not None:
                self.automaton.add_word(p, (self.ids[p], len(p)))
        self.automaton.make_automaton()

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Tokens by plain merging, best score first and leftmost among equals; and the last pair merged."""
        token, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.rank.get(token[i] + token[j])) is not None:
                heapq.heappush(heap, (rank, i, token[i] + token[j]))

        for i in range(n - 1):
            offer(i)
        last = None
        while heap:
            _, i, both = heapq.heappop(heap)
            if not token[i] or after[i] >= n or token[i] + token[after[i]] != both:
                continue
            j = after[i]
            last = (token[i], token[j])
            token[i], token[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in token if t], last

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes the piece, or None if merging its characters never does."""
        if piece not in self.parts:
            tokens, last = self.merged(piece)
            self.parts[piece] = last if tokens == [piece] else None
        return self.parts[piece]

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The tokens at one edge while the piece grows, each with the rank of the merge that takes it up."""
        key = (piece, side)
        if key not in self.spines:
            grown, taken = [], ENDLESS
            while True:
                grown.append((piece, taken))
                if len(piece) == 1:
                    break
                taken = self.rank[piece]
                piece = self.split(piece)[side]
            self.spines[key] = grown[::-1]
        return self.spines[key]

    def compatible(self, left: int, right: int) -> bool:
        """True if the two tokens, grown side by side, never merge across their boundary.

        Both edges grow in the order of ranks. A merge across comes first if its rank is below that of the next merge
        on the left and not above that on the right, since equal ranks go from left to right.
        """
        a, b = self.spine(self.vocabulary.pieces[left], 1), self.spine(self.vocabulary.pieces[right], 0)
        i = j = 0
        while True:
            (x, next_x), (y, next_y) = a[i], b[j]
            across = self.rank.get(x + y)
            if across is not None and across < next_x and across <= next_y:
                return False
            if next_x == ENDLESS and next_y == ENDLESS:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def run(self, text: str) -> list[int]:
        """Ids of a run of known characters: the table of last tokens, then back from its end."""
        n = len(text)
        last, fits = [-1] * (n + 1), self.fits
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                key = last[start] << 20 | piece
                ok = fits.get(key)
                if ok is None:
                    if len(fits) >= KEPT_PAIRS:
                        fits.clear()
                    ok = fits[key] = self.compatible(last[start], piece)
                if not ok:
                    continue
            last[end] = piece
        out = []
        while n:
            out.append(last[n])
            n -= self.length[last[n]]
        out.reverse()
        return out

    def word(self, text: str) -> list[int]:
        """Ids of a stretch that no piece crosses; characters without a piece become bytes."""
        if text.count(SPACE) > 1:
            # pieces of several spaces share one score, so their merges have no order of ranks
            return [i for t in self.merged(text)[0] for i in self.known_or_bytes(t)]
        if self.characters.issuperset(text):
            return self.run(text)
        out: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.ids:
                if start < i:
                    out += self.run(text[start:i])
                out += self.known_or_bytes(c)
                start = i + 1
        if start < len(text):
            out += self.run(text[start:])
        return out

    def known_or_bytes(self, token: str) -> list[int]:
        if token in self.ids:
            return [self.ids[token]]
        return [self.byte_id[b] for b in token.encode()]

    def remembered(self, part: str) -> bytes:
        """The ids of a part that the younger memory lacks; when that is full, it becomes the older one."""
        ids = self.words.get(part) or self.older.get(part)
        if ids is None:
            ids = np.array(self.word(part), self.kind).tobytes()
        if len(part) <= KEPT_LENGTH:
            if len(self.words) >= KEPT_WORDS:
                self.older, self.words = self.words, {}
            self.words[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        parts = self.cut.findall(SPACE + text.replace(" ", SPACE))
        known = list(map(self.words.get, parts))
        if None in known:
            known = [self.remembered(part) if ids is None else ids for part, ids in zip(parts, known, strict=True)]
        return np.frombuffer(b"".join(known), self.kind).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: bytes joined to characters, control ids silent, the space put before the text removed."""
        shown, special, raw = [], self.vocabulary, bytearray()
        if self.hard.isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            for i in ids:
                if i in special.bytes:
                    raw.append(special.bytes[i])
                    continue
                if raw:
                    shown.append(_characters(raw))
                    raw = bytearray()
                if i == special.unknown:
                    shown.append(" ⁇ ")
                elif i not in special.silent:
                    shown.append(self.shown[i])
            if raw:
                shown.append(_characters(raw))
            text = "".join(shown)
        first = next((i for i in ids if i not in special.silent), None)
        return text[1:] if first is not None and special.pieces[first].startswith(SPACE) else text


def _cut_pattern(pieces: dict[str, int]) -> str:
    """Cuts a text where no piece can lie: before spaces, around line breaks, between letters and other characters.

    A character counts as a letter only if no piece has it beside one that does not.
    """
    pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1) if p[i] != SPACE}
    if any("\n" in p for p in pairs):
        raise ValueError("pieces that hold a line break beside other characters are not supported")
    letters = {c for pair in pairs for c in pair if c.isalpha()}
    while mixed := {c for pair in pairs if not letters.issuperset(pair) for c in pair if c in letters}:
        letters -= mixed
    inside = "".join(map(re.escape, sorted(letters)))
    words = f"{SPACE}*[{inside}]+|" if letters else ""
    return f"{words}{SPACE}*[^{inside}{SPACE}\n]+|{SPACE}+|\n"


def _characters(raw: bytearray) -> str:
    """UTF-8 of consecutive byte ids; each byte that belongs to no character becomes a replacement character."""
    out, i = [], 0
    while i < len(raw):
        width = next((w for w in (1, 2, 3, 4) if _is_character(raw[i : i + w], w)), 0)
        out.append(raw[i : i + width].decode() if width else "�")
        i += width or 1
    return "".join(out)


def _is_character(raw: bytearray, width: int) -> bool:
    try:
        return len(raw) == width and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_loaded: dict[int, Codec] = {}


def codec(shipped: Broadcast) -> Codec:
    """The worker's codec for a shipped vocabulary."""
    if shipped.value is not _loaded.get("of"):
        _loaded["of"], _loaded["codec"] = shipped.value, Codec(shipped.value)
    return _loaded["codec"]


def ship(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for all tasks; its size is that of the model file, whatever the corpus."""
    return python_tasks(spark).sparkContext.broadcast(Vocabulary(path))


def encoded(docs: DataFrame, shipped: Broadcast, lossless: bool = False) -> DataFrame:
    """``docs`` with ``ids``, the encoding of each whole text, and if asked ``lossless``: whether they decode to it again.

    Columns of these names are replaced.

    A null or empty text has no ids. Repeated rows get equal ids, an empty table stays empty. Very long texts take
    time and memory in proportion to their length.
    """
    new = ["ids", "lossless"][: 1 + lossless]
    own = [c for c in docs.columns if c not in new]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(shipped)
        for batch in sliced(batches, "__text"):
            texts = batch.column(len(own)).to_pylist()
            ids = [np.array(of.encode(t), np.int32) for t in texts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            added = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
            if lossless:
                added.append(pa.array([of.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *added], [*own, *new])

    schema = docs.select(*own).withColumns(dict(zip(new, (F.array(F.lit(0)), F.lit(True)), strict=False))).schema
    return docs.select(*own, plain_text().alias("__text")).mapInArrow(read, schema)


def decoded(rows: DataFrame, shipped: Broadcast) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids``; null or no ids give the empty text."""
    own = [c for c in rows.columns if c != "decoded"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = codec(shipped), own.index("ids")
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                texts = [of.decode(i.as_py() or []) for i in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*own, "decoded"])

    schema = rows.select(*own).withColumn("decoded", F.lit("")).schema
    return rows.select(*own).mapInArrow(read, schema)


def token_digests(docs: DataFrame, shipped: Broadcast) -> DataFrame:
    """doc_id, number of ids, and the hashes of the ids and of the text decoded from them, made text by text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(shipped)
        number = [str(i) for i in range(len(of.length))]
        for batch in sliced(batches, "text"):
            counts, hashes, decodings = [], [], []
            for text in batch.column(1):
                ids = of.encode(text.as_py())
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                decodings.append(hashlib.sha256(of.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decodings, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", plain_text().alias("text")).mapInArrow(read, schema)
