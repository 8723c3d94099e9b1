import random
import re

import numpy as np
import pytest

from opinloom.llm import phrases
from opinloom.llm.hashing import WordTable

SCHEMA = "lang string, text string, gram int, f string, id int"


def brute(rows, least, longest, top):
    totals, counts = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            ws = re.findall("[^ \t]+", piece)
            totals[lang] = totals.get(lang, 0) + len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    key = (lang, tuple(ws[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    found = {k: c for k, c in counts.items() if c >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in found.items():
        inside = any(g == lang and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                     for (g, q), c in found.items() if len(q) > len(p))
        if inside:
            continue
        n = totals[lang]
        best = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-best[0], -a, " ".join(p).encode(), counts[lang, p[: best[1]]], counts[lang, p[best[1] :]], n))
    return sorted((lang, i, p.decode(), -a, l, r, n, -s) for lang, all_ in out.items()
                  for i, (s, a, p, l, r, n) in enumerate(sorted(all_)[:top], 1))


def found(spark, rows, **options):
    table = spark.createDataFrame([(a, b, 1, "x", 2) for a, b in rows], SCHEMA)
    return sorted(tuple(r) for r in phrases.collocations(table, **options).collect())


def random_rows(rng, n, letters):
    text = lambda: "".join(rng.choice(letters) + rng.choice([" "] * 8 + ["\t ", ", ", "\n", "! "]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "de", None, ""]), text()) for _ in range(n)]


@pytest.mark.parametrize("bits", [1, 2, 7, 13, 20, 25, 31])
@pytest.mark.parametrize("size", [2, 3, 4, 5])
def test_permutation_is_undone(bits, size):
    rng = np.random.default_rng(bits * size)
    grams = rng.integers(0, 1 << bits, (500, size))
    packing = phrases.Packing(size, bits)
    parts = packing.permuted(grams)
    assert (packing.grams(parts) == grams).all()
    assert all(int(p.max()) < 1 << w for p, w in zip(parts, packing.widths, strict=True)) and sum(packing.words) == size


@pytest.mark.parametrize("widths", [[3, 2], [20, 20], [60, 40], [62, 62, 31], [1, 64]])
def test_filters_lose_nothing_and_merge(widths):
    rng = np.random.default_rng(sum(widths))
    total, filters = {}, []
    for n in (0, 1, 700, 50, 3):
        keys = [rng.integers(0, 1 << min(w, 9), n).astype(np.uint64) << np.uint64(max(0, w - 9)) for w in widths]
        counts = rng.integers(1, 600, n)
        parts, sums = phrases.counted(keys, widths, counts)
        for *k, c in zip(*keys, counts, strict=True):
            total[tuple(map(int, k))] = total.get(tuple(map(int, k)), 0) + int(c)
        filters.append(phrases.QuotientFilter(parts, sums, widths))
    parts, counts = phrases.merged(filters)
    assert dict(zip(zip(*[p.tolist() for p in parts], strict=True), counts.tolist(), strict=True)) == total
    assert list(zip(*[p.tolist() for p in parts], strict=True)) == sorted(total)


@pytest.mark.parametrize("seed, letters, least", [(1, "abcd", 5), (2, ["A", "b", "É", "lo", "long-word"], 3), (3, "abcdefghijkl", 4)])
def test_equals_brute_force(spark, monkeypatch, seed, letters, least):
    """Also with a dictionary in several parts and with several shards."""
    rows = random_rows(random.Random(seed), 120, letters)
    assert found(spark, rows, least=least) == brute(rows, least, 5, 2000)
    monkeypatch.setattr(phrases, "PART_WORDS", 3)
    monkeypatch.setattr(phrases, "SIDE_BY_SIDE", 2)
    monkeypatch.setattr(phrases, "SHARD_PHRASES", 100)
    monkeypatch.setattr(phrases, "FILTER_BITS", 10)
    assert found(spark, rows, least=least, top=7) == brute(rows, least, 5, 7)


def test_edges(spark):
    assert found(spark, [], least=1) == []
    assert found(spark, [(None, None), ("en", ""), ("en", " .,\t")], least=1) == []
    assert found(spark, [("en", "one"), ("en", "one")], least=1) == []
    rows = [("und", "A b"), (None, "a B"), ("en", "a b." + " a b c" * 50), ("en", "a  \t b")]
    assert found(spark, rows, least=1) == brute(rows, 1, 5, 2000)


def test_words_with_one_hash_stay_apart(monkeypatch):
    from opinloom.llm import hashing

    real = hashing.word_hashes
    monkeypatch.setattr(hashing, "word_hashes", lambda d, s, e, t=None: real(d, s, e, t) if t is not None and t[97] != hashing.byte_values()[97]
                        else (e - s).astype(np.uint64))
    table = WordTable([b"ab", b"cd", b"abc"])
    assert table.seed > 0
    data = np.frombuffer(b"cd ab abc xy", np.uint8)
    assert table.numbers(data, np.array([0, 3, 6, 10]), np.array([2, 5, 9, 12])).tolist() == [1, 0, 2, -1]


def test_texts_cross_to_python_once(spark, monkeypatch):
    """A task that numbers the words and makes streams of them has one Python worker."""
    plans = {}
    table = phrases.Work.table

    def seen(work, df, purpose):
        plans[purpose] = df._jdf.queryExecution().optimizedPlan().toString()
        return table(work, df, purpose)

    monkeypatch.setattr(phrases.Work, "table", seen)
    rows = [("en", "a b a b"), (None, None)]
    assert found(spark, rows, least=1) == brute(rows, 1, 5, 2000)
    assert plans["streams"].count("MapInArrow") == 1
