import random

import numpy as np
import public_tokenizers
import pytest

from opinloom.llm import packing

SCHEMA = "doc_id long, text string, ids string"


def slow_best_fit(lengths, room):
    left, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in range(len(left)) if left[r] >= lengths[i]]
        if not fits:
            left.append(room)
            rows.append([])
            fits = [len(left) - 1]
        best = min(fits, key=lambda r: left[r])
        left[best] -= lengths[i]
        rows[best].append(i)
    return rows


@pytest.mark.parametrize("room", [1, 7, 64, 100])
def test_as_tight_as_a_search_of_all_rows(room):
    rnd = random.Random(room)
    for _ in range(50):
        lengths = np.array([rnd.randint(1, room) for _ in range(rnd.randint(1, 80))])
        rows = packing.best_fit_decreasing(lengths, room)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(int(lengths[r].sum()) for r in rows) == sorted(int(lengths[r].sum()) for r in slow_best_fit(lengths, room))


def test_round_trip(spark, monkeypatch):
    texts = ["", None, "a", "word " * 3000, "é日本 x\n\n  y", "the end"] + [f"text {i} " * (i % 90) for i in range(200)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", ""), (2, "a", "")]
    shipped = packing.ship(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = packing.tokens(shipped)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    packed = packing.packed(frame, shipped, 64)
    for r in packed.collect():
        ids, place = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(place) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert (ids[r.n_tokens :] == packing.PAD).all()
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert place[a:b].tolist() == list(range(b - a))
    parts = {}
    for r in packing.unpacked(packed).collect():
        parts.setdefault(r.doc_id, []).append((r.part, np.frombuffer(r.ids, "<u2").tolist()))
    for i, text in enumerate(texts):
        got = sorted(parts.get(i, []))
        if i == 2:
            assert [own.decode(p) for _, p in got] == ["a", "a"]
        else:
            assert own.decode([t for _, p in got for t in p]) == (text or "")
            assert [k for k, _ in got] == list(range(len(got)))
    assert own.decode(parts[None][0][1]) == "no id"
    assert packing.packed(frame.limit(0), shipped).collect() == []


def test_memory_of_words_gives_the_same_ids(spark):
    shipped = packing.ship(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = packing.tokens(shipped)
    for text in ["it's  a\n\n test 123!!", "日本 é‍😀 <|endoftext|>", " " * 50 + "x"]:
        assert own.encode(text) == own.encoding.encode_ordinary(text)
