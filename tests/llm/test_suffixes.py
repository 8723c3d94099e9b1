import random
import re

import pytest

from opinloom.llm import suffixes

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, n_hit string, __row int, runs string, words string, items string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + width]), set()).add(None if item is None else str(item))
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(ws[i : i + n])]
        out.append((doc_id, len(ws), len(hit), sorted(found - {None}), bool(hit)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    return (spark.createDataFrame([(d, t, "x", 7, "r", "w", "i") for d, t in docs], SCHEMA),
            spark.createDataFrame([(i, t, "own") for i, t in items], "item_id long, text string, item string"))


def found(spark, docs, items, width, shard_words):
    rows = suffixes.overlaps(*tables(spark, docs, items), width, shard_words).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in rows], key=str)


def random_text(rng, most, letters="abc"):
    return "".join(rng.choice(letters) + rng.choice([" ", ", ", "-", "\n", " É"]) for _ in range(rng.randrange(most)))


@pytest.mark.parametrize("seed, width, shard_words", [(1, 3, 10**6), (2, 4, 10**6), (3, 3, 40), (4, 10, 15), (5, 2, 10**6)])
def test_equals_brute_force(spark, seed, width, shard_words):
    """Small alphabets give many repeats; small shards give more automata than a task holds at once."""
    rng = random.Random(seed)
    items = [(rng.randrange(30), random_text(rng, 14)) for _ in range(40)]
    docs = [(i, random_text(rng, 40, "abcde")) for i in range(80)] + [(900, "ab " * 300 + items[0][1] + "x" * 5 + " c" * 200)]
    docs += [(901 + i, f"clean start {t} clean end") for i, (_, t) in enumerate(items)]
    assert found(spark, docs, items, width, shard_words) == brute(docs, items, width)


def test_long_items_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(9000))
    ws = text.split()
    docs = [(i, " ".join(ws[i * 97 : i * 97 + 9 + i % 3])) for i in range(90)] + [(100, text)]
    assert found(spark, docs, [(1, text)], 10, 1000) == brute(docs, [(1, text)], 10)


def test_edges(spark):
    items = [(1, "One two three"), (None, "four five"), (2, None), (3, ""), (4, "..."), (1, "ONE two three"), (7, "one two three")]
    docs = [(1, "x one TWO, three y"), (1, "x one TWO, three y"), (None, "four five"), (3, None), (4, ""), (5, "one two"), (6, "Éone two three")]
    assert found(spark, docs, items, 10, 10**6) == brute(docs, items, 10)
    assert found(spark, docs, [], 10, 10**6) == brute(docs, [], 10)
    assert found(spark, [], items, 10, 10**6) == []
    kept = suffixes.overlaps(*tables(spark, docs, items))
    assert kept.columns == ["doc_id", "text", "__row", "runs", "words", "items", "n_words", "n_hit", "item_ids", "contaminated"]


def test_spans_are_cut_and_covered_documents_dropped(spark):
    items = [(1, "a b c d e")]
    docs = [(1, "x y z w, A b. c d E! v u"), (2, "a b c d e f"), (3, None), (4, "clean  text"), (5, "")]
    left = suffixes.decontaminated(*tables(spark, docs, items), width=5).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, "x y z w, ! v u"), (3, None), (4, "clean  text"), (5, "")]
    assert left[0].runs == "r" and left[0].n_hit == "x"
