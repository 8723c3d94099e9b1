import random

import public_tokenizers
import pytest
import sentencepiece

from opinloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "a", "  a  b ", "a\nb", "\n", "ａｂ ﬁ", "é é", "▁x", "x ▁ y", "<s> </s> <0x0A> <unk>", "日本語𠮷", "\x00a", "a　b",
    "   ", "a\r\n\tb", "x  ", "a" * 500, "=" * 77, "    def x():\n        return 1", "ab" * 30000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Codec(pieces.Vocabulary(PATH))


def test_equal_to_the_library(own, library):
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("abcdeth ing\n.,é日‍😀▁ 0123") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += [(" " * (i % 2)).join(rnd.choice(own.vocabulary.pieces) for _ in range(8)) for i in range(2000)]
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)


def test_decoding_any_ids(own, library):
    rnd = random.Random(2)
    for _ in range(2000):
        ids = [rnd.randrange(rnd.choice([5, 300, 32000])) for _ in range(rnd.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)


def test_memory_is_bounded(own, monkeypatch, library):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 5)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 5)
    text = "many different words need many different pairs of pieces here"
    assert own.encode(text) == library.encode(text)
    assert len(own.words) <= 6 or len(own.words) > 5


def test_frames(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, None, "clash"), (3, "a", "clash")]
    shipped = pieces.ship(spark, PATH)
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = pieces.decoded(pieces.encoded(frame, shipped), shipped).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == library.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.token_digests(frame.limit(0), shipped).collect() == []
