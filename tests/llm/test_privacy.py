import hashlib
import random
import re

from opinloom.llm import privacy

SCHEMA = "doc_id long, text string, email string, term int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [
        (m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items())
        for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)), [sum(f[3] == k for f in found) for k in PATTERNS]


TEXTS = [
    None, "", "none", "é日 a@b.c and a@b.c_x@d.e.f a@@b.c a@b x.@y.z-", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 007.1.1.1 1.2.3.0300",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 378282246310005 41111111111111111111", "+1 (656) 555-6510 +49.30 1234567 +12 +1234567890123456 ++1 555 555 5555",
    "a@b.c" * 50, "1" * 5000 + ".2" * 3000, "4111 1111 1111 1111 " * 300, "a.b" * 4000 + "@" + "c.d" * 3000, "0" * 16, "x@y.z 10.0.0.1\n+1 202 555 0100\n4111111111111111",
]


def test_base_spans(spark):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("0123456789.@+-( )ab_%é\n") for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("019. -+") for _ in range(rnd.randint(10, 40))) for _ in range(1500)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, TEXTS[3], "", 1), (None, TEXTS[4], "", 1)]
    found = privacy.span_digests(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = TEXTS[4] if r.doc_id is None else texts[r.doc_id]
        spans, counts = brute(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, text
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("term")) == spans


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"common Zaphod. writes from z.b@mail.example about common matters {i}", "", 0) for i in range(5)]
    rows += [(100 + i, f"common matters writes from about number {i}", "", 0) for i in range(2000)]
    rows += [(5000 + i, "Copied words near one.copy@mail.example often", "", 0) for i in range(50)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.spans for r in privacy.span_digests(frame).collect()}
    start = rows[0][1].index("Zaphod")
    assert f"term:{start}:{start + 6}" in got[0].split(",")
    assert got[0].count("term") == 1 and got[100] == ""
    assert "term" not in got[5000]
    clean = {r.doc_id: r for r in privacy.sanitised(frame).collect()}
    assert "z.b@mail" not in clean[0].text and "Zaphod" not in clean[0].text and "[email] about common" in clean[0].text
    assert clean[100].text == rows[5][1] and privacy.sanitised(frame).columns == frame.columns


def test_terms_far_from_a_value_and_in_texts_without_one(spark):
    filler = "common matters " * 40
    rows = [(i, f"Ann-Marie O'Brien, {filler}{i}\n\nreach ab.c@mail.example", "", 0) for i in range(3)]
    rows += [(50, "Yesterday O\u2019Brien and Ann-Marie o'brien left", "", 0)]
    rows += [(100 + i, f"common matters {i} reach yesterday and left", "", 0) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.spans.split(",") for r in privacy.span_digests(frame).collect()}
    assert [s for s in got[0] if "term" in s] == ["term:0:9", "term:10:17"]
    assert got[50] == ["term:22:31", "term:32:39"] and got[100] == [""]
    clean = {r.doc_id: r.text for r in privacy.sanitised(frame).collect()}
    assert clean[50] == "Yesterday O\u2019Brien and [term] [term] left" and clean[1].startswith("[term] [term], common")


def test_terms_of_values_seen_once(spark):
    rows = [(0, "Please ask Zaphod about matters, z.b@mail.example", "", 0), (1, "please ask about matters", "", 0)]
    rows += [(10, "Call Trillian on +1 (656) 555-6510", "", 0), (11, "Call Trillian on +1 (656) 555-7777 then", "", 0)]
    rows += [(100 + i, f"please ask about matters and call on then number {i}", "", 0) for i in range(900)]
    got = {r.doc_id: [s for s in r.spans.split(",") if "term" in s] for r in privacy.span_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == ["term:11:17"], "one text with one address"
    assert got[10] == got[11] == ["term:5:13"], "a new value of the kind in each text"
    assert not any(s for i, s in got.items() if i not in (0, 10, 11))


def test_empty_table(spark):
    assert privacy.span_digests(spark.createDataFrame([], SCHEMA)).collect() == []
