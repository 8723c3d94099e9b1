"""Phrase collocation mining with counting quotient filters.

Words that are frequent in their language get dense numbers, and texts become streams of these. Phrases are counted
level by level: one of k words can only be frequent if both phrases of k - 1 words inside it are. A phrase is a packed
number of k word numbers, permuted by an invertible network; its leading bits are a quotient, kept as a place in a bit
array, and the other bits a remainder, kept in full. So a filter counts without loss, and since its entries lie in
order of the permuted numbers, the filters of all tasks merge like sorted lists, shard by shard.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinloom.llm.hashing import U, WordTable, _joined, lowered, mixed, word_bounds
from opinloom.llm.shared import Work, plain_text, python_tasks, sliced, text_bytes
from opinloom.operators.ordering import ORDINAL, with_dense_ordinal

HARD = ".,;:!?\n\x0b\x0c\r"  # between pieces
SOFT = " \t"  # between words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, LONGEST, TOP = 100, 5, 2000
PART_WORDS = 1 << 20  # words of the dictionary in one broadcast
SIDE_BY_SIDE = 4  # broadcasts that a task holds at once
AT_ONCE = 1 << 17  # phrases counted together
KEPT = 1 << 19  # different phrases that a task holds before it gives its filters away
SHARD_PHRASES = 1 << 20
FILTER_BITS = 26  # at most, of the bit array that tells which shorter phrases are frequent
BUCKETS = 64


def _flags(characters: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[np.frombuffer(characters.encode(), np.uint8)] = True
    return flags


_HARD, _BREAK = _flags(HARD), _flags(HARD + SOFT)


# Packed phrases and their filters.


class Packing:
    """Phrases of ``size`` word numbers of ``bits`` bits each, packed into parts of at most 64 bits and permuted."""

    def __init__(self, size: int, bits: int):
        most = max(1, min(64 // bits, size - 1))
        parts = max(2, math.ceil(size / most))
        self.words = [size // parts + (i < size % parts) for i in range(parts)]
        self.bits, self.widths = bits, [n * bits for n in self.words]

    def _crossed(self, parts: list[np.ndarray], i: int, turn: int) -> np.ndarray:
        others = [p for j, p in enumerate(parts) if j != i]
        h = np.full(len(parts[0]), turn * len(parts) + i + 1, np.uint64)
        for p in others:
            h = mixed((h ^ (h >> U(29))) * U(0xD6E8FEB86659FD93) + p)
        return h & U((1 << self.widths[i]) - 1)

    def permuted(self, grams: np.ndarray) -> list[np.ndarray]:
        """The packed parts of phrases (rows of word numbers), mixed so that the first is evenly spread."""
        parts, at = [], 0
        for n in self.words:
            part = np.zeros(len(grams), np.uint64)
            for j in range(at, at + n):
                part = (part << U(self.bits)) | grams[:, j].astype(np.uint64)
            parts.append(part)
            at += n
        for turn in range(2):
            for i in reversed(range(len(parts))):
                parts[i] = parts[i] ^ self._crossed(parts, i, turn)
        return parts

    def grams(self, parts: list[np.ndarray]) -> np.ndarray:
        """The word numbers of permuted phrases."""
        parts = list(parts)
        for turn in (1, 0):
            for i in range(len(parts)):
                parts[i] = parts[i] ^ self._crossed(parts, i, turn)
        columns = []
        for part, n in zip(parts, self.words, strict=True):
            columns += [(part >> U(self.bits * (n - 1 - j))) & U((1 << self.bits) - 1) for j in range(n)]
        return np.stack(columns, axis=1).astype(np.int64)


def counted(parts: list[np.ndarray], widths: list[int], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal keys as one with the sum of their counts, in order."""
    if not len(parts[0]):
        return parts, np.zeros(0, np.int64)
    if sum(widths) <= 64:
        key = parts[0]
        for p, w in zip(parts[1:], widths[1:], strict=True):
            key = (key << U(w)) | p
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
    else:
        order = np.lexsort(parts[::-1])
        new = np.zeros(len(order), bool)
        new[0] = True
        for p in parts:
            p = p[order]
            new[1:] |= p[1:] != p[:-1]
    at = np.flatnonzero(new)
    sums = np.diff(np.r_[at, len(order)]) if counts is None else np.add.reduceat(counts[order], at)
    return [p[order[at]] for p in parts], sums.astype(np.int64)


def _narrow(numbers: np.ndarray, bits: int) -> np.ndarray:
    return numbers.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= bits))


class QuotientFilter:
    """Sorted distinct keys with counts: the quotient as a bit that says its run is there, the remainder in full.

    A second bit array marks where runs end; counts take a byte, larger ones a further entry.
    """

    def __init__(self, parts: list[np.ndarray], counts: np.ndarray, widths: list[int]):
        self.widths, self.n = widths, len(counts)
        self.quotient_bits = min(widths[0], max(1, self.n.bit_length()))
        rest = widths[0] - self.quotient_bits
        quotient = (parts[0] >> U(rest)).astype(np.int64) if rest < 64 else np.zeros(self.n, np.int64)
        occupied = np.zeros(1 << self.quotient_bits, bool)
        occupied[quotient] = True
        self.occupied = np.packbits(occupied)
        self.run_ends = np.packbits(np.r_[quotient[1:] != quotient[:-1], np.ones(min(self.n, 1), bool)])
        self.remainders = [_narrow(parts[0] & U((1 << rest) - 1), rest), *[_narrow(p, w) for p, w in zip(parts[1:], widths[1:], strict=True)]]
        self.small = np.minimum(counts, 255).astype(np.uint8)
        self.large = counts[counts >= 255]

    def entries(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Keys in order and their counts."""
        rest = self.widths[0] - self.quotient_bits
        ends = np.unpackbits(self.run_ends, count=self.n).astype(np.int64)
        run = np.cumsum(ends) - ends
        quotient = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.quotient_bits))[run].astype(np.uint64)
        first = (quotient << U(rest)) | self.remainders[0].astype(np.uint64)
        counts = self.small.astype(np.int64)
        counts[self.small == 255] = self.large
        return [first, *[r.astype(np.uint64) for r in self.remainders[1:]]], counts


def merged(filters: list[QuotientFilter]) -> tuple[list[np.ndarray], np.ndarray]:
    """The entries of several filters of one shard, equal keys summed."""
    found = [f.entries() for f in filters]
    parts = [np.concatenate(p) for p in zip(*[p for p, _ in found], strict=True)]
    return counted(parts, filters[0].widths, np.concatenate([c for _, c in found]))


# Words and their streams.


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """``lang, word, f`` of all words with ``least`` occurrences in their language; ``docs`` has ``lang, text``."""
    broken = F.translate(F.col("text"), UPPER + HARD + "\t", LOWER + " " * (len(HARD) + 1))
    each = docs.select("lang", F.explode(F.split(broken, " ", -1)).alias("word")).where(F.col("word") != "")
    return each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least)


def _language_key(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def _shipped(numbered: DataFrame, words: int, work: Work) -> Iterator[Broadcast]:
    """The dictionary in parts of bounded size; numbers run on from part to part."""
    for first in range(0, words, PART_WORDS):
        part = numbered.where(F.col(ORDINAL).between(first, first + PART_WORDS - 1)).select("lang", "word", ORDINAL).toArrow()
        rows = sorted(zip(part["ordinal"].to_pylist(), part["lang"].to_pylist(), part["word"].to_pylist(), strict=True))
        keys = {lang: _language_key(lang) for lang in {r[1] for r in rows}}
        table = WordTable([r[2].encode() for r in rows], [keys[r[1]] for r in rows])
        yield work.spark.sparkContext.broadcast((first + 1, table))


@dataclass
class _Words:
    """The words of a slice of texts, by number (0: unknown), with the texts' bytes."""

    data: np.ndarray
    starts: np.ndarray
    before: np.ndarray
    ids: np.ndarray


def _read_words(batches: Iterator[pa.RecordBatch], tables: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, _Words]]:
    """Slices of batches ``lang, text, ids``, with numbers from some parts of the dictionary beside those they came with."""
    held = [b.value for b in tables]
    for batch in sliced(batches, "text"):
        data, offsets = text_bytes(batch.column(1))
        data = lowered(data)
        starts, ends, before = word_bounds(data, offsets, _BREAK)
        count = np.diff(before)
        langs = batch.column(0).dictionary_encode()
        key = np.array([_language_key(x) for x in langs.dictionary.to_pylist()], np.uint64)
        keys = np.repeat(key[langs.indices.to_numpy()], count)
        old = batch.column(2)
        ids = np.zeros(len(starts), np.int32) if old.null_count else np.frombuffer(b"".join(old.to_pylist()), np.int32)
        for first, table in held:
            number = table.numbers(data, starts, ends, keys)
            ids = np.where(number >= 0, number + first, ids).astype(np.int32)
        yield batch, _Words(data, starts, before, ids)


def _numbered(texts: DataFrame, tables: list[Broadcast]) -> DataFrame:
    """``lang, text, ids``: the number of every word as bytes, 0 for unknown ones, from some parts of the dictionary."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in _read_words(batches, tables):
            raw = [w.ids[a:b].tobytes() for a, b in zip(w.before[:-1].tolist(), w.before[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["lang", "text", "ids"])

    return texts.mapInArrow(read, "lang string, text string, ids binary")


def _streams(numbered: DataFrame, tables: list[Broadcast]) -> DataFrame:
    """``lang, n_words, ids``: per slice and language the word numbers with 0 wherever no phrase can go on.

    The last parts of the dictionary are looked up here, so that a task has one Python worker and texts cross to it once.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in _read_words(batches, tables):
            hard = np.cumsum(_HARD[w.data])[w.starts] if len(w.starts) else np.zeros(0, np.int64)
            apart = np.r_[True, hard[1:] != hard[:-1]] if len(hard) else np.zeros(0, bool)
            apart[w.before[:-1][w.before[:-1] < len(w.starts)]] = True
            langs = batch.column(0).dictionary_encode()
            of = np.repeat(langs.indices.to_numpy(), np.diff(w.before))
            rows = [(lang, int((of == i).sum()), _stream(w.ids[of == i], apart[of == i])) for i, lang in enumerate(langs.dictionary.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                ["lang", "n_words", "ids"])

    return numbered.mapInArrow(read, "lang string, n_words long, ids binary")


def _stream(ids: np.ndarray, apart: np.ndarray) -> bytes:
    out = np.zeros(len(ids) + int(apart.sum()), np.int32)
    out[np.arange(len(ids)) + np.cumsum(apart)] = ids
    known = out > 0
    near = np.zeros(len(out), bool)
    near[1:] |= known[:-1]
    near[:-1] |= known[1:]
    out = np.where(near, out, 0)  # a word without a known neighbour is in no phrase
    kept = out > 0
    kept[1:] |= out[:-1] > 0
    return out[kept].tobytes()


# Counting, level by level.


def _gram_bits(columns: list[np.ndarray], bits: int) -> np.ndarray:
    return _joined([c.astype(np.uint64) for c in columns]) >> U(64 - bits)


def _frequent_bits(grams: DataFrame, n: int) -> np.ndarray:
    """A bit array of bounded size with the places of all frequent phrases; other phrases may share a place."""
    bits = min(FILTER_BITS, max(10, (16 * n).bit_length()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                at = _gram_bits(list(rows.T), bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).astype(np.int64)), pa.array((U(1) << (at & U(63))).view(np.int64))], ["at", "bits"])

    words = grams.select("gram").mapInArrow(read, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _level(streams: DataFrame, size: int, packing: Packing, shard_bits: int, known: Broadcast | None) -> DataFrame:
    """``shard, filter``: the filters of each task for phrases of ``size`` words that may be frequent."""
    widths = [packing.widths[0] - shard_bits, *packing.widths[1:]]

    def candidates(ids: np.ndarray) -> np.ndarray:
        columns = [ids[i : len(ids) - size + 1 + i] for i in range(size)]
        fits = np.logical_and.reduce([c > 0 for c in columns])
        if known is not None:
            bits = int(len(known.value) * 64).bit_length() - 1
            shorter = _gram_bits([ids[i : len(ids) - size + 2 + i] for i in range(size - 1)], bits)
            member = (known.value[(shorter >> U(6)).astype(np.int64)] >> (shorter & U(63))) & U(1) == 1
            fits &= member[:-1] & member[1:]
        return np.stack([c[fits] for c in columns], axis=1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, counts, n = [], None, None, 0

        def taken() -> None:
            nonlocal held, counts, waiting, n
            parts, sums = counted(packing.permuted(np.concatenate(waiting)), packing.widths)
            if held is not None:
                parts, sums = counted([np.concatenate(p) for p in zip(held, parts, strict=True)], packing.widths, np.concatenate([counts, sums]))
            held, counts, waiting, n = parts, sums, [], 0

        def filters() -> pa.RecordBatch:
            rest = U(widths[0])
            shard = (held[0] >> rest).astype(np.int64) if shard_bits else np.zeros(len(counts), np.int64)
            cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            rows = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                parts = [held[0][a:b] & U((1 << widths[0]) - 1), *[p[a:b] for p in held[1:]]]
                rows.append((int(shard[a]), pickle.dumps(QuotientFilter(parts, counts[a:b], widths))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "filter"])

        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_py(), np.int32)
                if len(ids) >= size:
                    waiting.append(candidates(ids))
                    n += len(waiting[-1])
                if n >= AT_ONCE:
                    taken()
                    if len(counts) >= KEPT:
                        yield filters()
                        held = counts = None
        if n:
            taken()
        if held is not None and len(counts):
            yield filters()

    return streams.select("ids").mapInArrow(read, "shard long, filter binary")


def _frequent(filters: DataFrame, shards: int, packing: Packing, shard_bits: int, least: int) -> DataFrame:
    """``gram, f``: phrases with ``least`` occurrences, from all filters of each shard."""
    rest = packing.widths[0] - shard_bits

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, n, most = None, [], 0, KEPT

        def given() -> pa.RecordBatch:
            parts, counts = merged(held)
            kept = counts >= least
            first = (parts[0][kept] | (U(shard) << U(rest))) if shard_bits else parts[0][kept]
            grams = packing.grams([first, *[p[kept] for p in parts[1:]]])
            ends = np.arange(0, grams.size + 1, grams.shape[1], dtype=np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends), pa.array(grams.ravel().astype(np.int32))), pa.array(counts[kept])], ["gram", "f"])

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != shard and held:
                    yield given()
                    held, n, most = [], 0, KEPT
                shard = own
                held.append(pickle.loads(raw.as_py()))
                n += held[-1].n
                if n > most:
                    parts, counts = merged(held)
                    held, n = [QuotientFilter(parts, counts, held[0].widths)], len(counts)
                    most = n + KEPT
        if held:
            yield given()

    dealt = filters.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(read, "gram array<int>, f long")


def counted_phrases(docs: DataFrame, work: Work, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words ``id, lang, word, f``, frequent phrases ``gram, f``, and all words of a language ``lang, n``."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), plain_text().alias("text"))
    words = with_dense_ordinal(word_counts(texts, least), "lang", "word")
    total = words.count()
    if total >= 1 << 31:
        raise ValueError("over 2^31 frequent words")
    numbered = texts.withColumn("ids", F.lit(None).cast("binary"))
    tables: list[Broadcast] = []
    for table in _shipped(words, total, work):
        tables.append(table)
        if len(tables) == SIDE_BY_SIDE and total > SIDE_BY_SIDE * PART_WORDS:
            numbered, tables = work.table(_numbered(numbered, tables), "numbered"), []
    streams = work.table(_streams(numbered, tables), "streams")
    totals = streams.groupBy("lang").agg(F.sum("n_words").alias("n"))
    bits = max(1, total.bit_length())
    size = streams.agg(F.sum(F.length("ids"))).first()[0] or 0
    phrases, known = None, None
    for k in range(2, longest + 1):
        packing = Packing(k, bits)
        shard_bits = min(packing.widths[0], max(0, (size // 4 // SHARD_PHRASES).bit_length()))
        filters = _level(streams, k, packing, shard_bits, known)
        found = work.table(_frequent(filters, 1 << shard_bits, packing, shard_bits, least), "phrases")
        phrases = found if phrases is None else phrases.unionByName(found)
        if k < longest:
            n = found.count()
            if not n:
                break
            known = work.spark.sparkContext.broadcast(_frequent_bits(found, n))
    return words.select((F.col(ORDINAL) + 1).cast("int").alias("id"), "lang", "word", "f"), phrases, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase has 2 to ``longest`` words of one piece of text and at least ``least`` occurrences; it is left out if a longer
    one occurs as often. ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: no words); other columns are not
    read, whatever their names. Repeated rows count each time. Ties end at the phrase's bytes, so the order is total. An
    empty table has no phrases. Texts of any length are read whole.
    """
    work = Work(python_tasks(docs.sparkSession))
    words, phrases, totals = counted_phrases(docs, work, least, longest)
    of_lang = words.select(F.col("id").alias("first"), "lang")
    named = work.table(phrases.withColumn("first", F.col("gram")[0]).join(of_lang, "first").select("gram", "f", "lang"), "named")
    known = named.select("gram", "f").unionByName(words.select(F.array("id").alias("gram"), "f"))
    covered = named.where(F.size("gram") > 2).select(
        F.explode(F.array(F.expr("slice(gram, 1, size(gram) - 1)"), F.expr("slice(gram, 2, size(gram) - 1)"))).alias("gram"), "f"
    ).groupBy("gram").agg(F.max("f").alias("longer"))
    open_ = named.join(covered, "gram", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f")))
    cuts = open_.select("gram", "lang", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(gram) - 1)")).alias("cut")).select(
        "*", F.expr("slice(gram, 1, cut)").alias("left"), F.expr("slice(gram, cut + 1, size(gram) - cut)").alias("right"))
    cuts = cuts.join(known.select(F.col("gram").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(known.select(F.col("gram").alias("right"), F.col("f").alias("r")), "right").join(totals, "lang")
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(18,0)) * 1000) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cuts.select("gram", "lang", "a", "n", F.struct(score.alias("score"), "cut", "l", "r").alias("way")).groupBy("gram").agg(
        F.min("way").alias("way"), F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("n").alias("n"))
    scored = scored.select("gram", "lang", "a", "n", "way.score", "way.l", "way.r", F.pmod(F.hash("gram"), F.lit(BUCKETS)).alias("bucket"))
    return _best(scored, words, top)


def _best(scored: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language, over salted parts of each first, with their words."""
    order = [F.col("score").desc(), F.col("a").desc()]
    near = scored.withColumn("place", F.rank().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("place") <= top)
    near = near.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place", "bucket")
    spelt = near.select("gram", F.posexplode("gram").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("gram").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = near.join(spelt, "gram").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
