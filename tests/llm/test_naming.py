import hashlib

from opinloom.llm import naming

SCHEMA = "doc_id long, text string, kept string, level int"


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[text or ""]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_identities_equal_texts(spark):
    long = "é" * 5000 + "x" * 30000
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, ""), (5, None), (6, long), (7, long), (8, long + "y"), (9, "z" + long[1:]), (10, "A")]
    rows += [(20 + i, "q" * n) for i, n in enumerate((4095, 4096, 4097, 8192, 8193, 4096 * 3, 4096 * 3, 4096 * 4, 4096 * 5 + 1))]
    rows += [(40 + i, "copy") for i in range(300)] + [(None, "only null")]
    rows = [(*r, "clash", 3) for r in rows]
    assert sorted(map(tuple, naming.duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_repeated_rows_and_null_ids_keep_one(spark):
    rows = [(1, "a", "", 0), (1, "a", "", 0), (None, "a", "", 0), (None, "b", "", 0), (None, "b", "", 0)]
    found = naming.duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in found if r.doc_id) == [(1, 3, False), (1, 3, True)]
    assert [r.kept for r in found if r.doc_id is None].count(True) == 1
    kept = naming.distinct_documents(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == ["Row(doc_id=1, text='a')", "Row(doc_id=None, text='b')"]
    assert kept.columns == ["doc_id", "text", "kept", "level"]


def test_empty_table(spark):
    assert naming.duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
