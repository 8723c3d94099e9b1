import random
import re

import numpy as np

from opinloom.llm import outliers

SCHEMA = "doc_id long, lang string, source string, text string, distance string, x0 int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, at = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            at |= {p + k for p in places for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(at) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(at), failed


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) + ("\n" if rnd.random() < 0.05 else "") for _ in range(n))


def test_base_counts_and_outliers(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["en", "de"]), f"s{i % 3}", prose(rnd, rnd.randint(60, 400)), "", 0) for i in range(1500)]
    odd = [(5000 + i, "en", "s0", " ".join("|#*$" * 12 for _ in range(200 + i)), "", 0) for i in range(3)]
    same = "same line here\n" * 30
    edges = [
        (6000, None, None, None, "", 0), (6001, "en", "s0", "", "", 0), (6002, None, "s1", same, "", 0), (6003, "en", None, "a b a b a b a b", "", 0),
        (6004, "en", "s0", "x" * 70000, "", 0), (6005, "en", "s1", prose(rnd, 30000), "", 0), (6005, "en", "s1", "é ü\x0b 日本 \xa0x\r\n\n \n€", "", 0),
        (None, "xx", "s9", prose(rnd, 100), "", 0), (6006, "en", "s0", "one two three one two three", "", 0)]
    rows += odd + edges + rows[:2]
    found = outliers.judged(spark.createDataFrame(rows, SCHEMA))
    got = found.collect()
    expected = sorted((r[0], *brute(r[3])) for r in rows if r[0] is not None)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(tuple(r[c] for c in columns) for r in got if r.doc_id is not None) == expected
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[r[0]] for r in odd)
    assert sum(kept[i] for i in range(1500)) >= 1490
    assert not any(r.kept for r in got if r.base_failed)


def test_constant_statistics_and_empty_table(spark):
    rows = [(i, "en", "s", " ".join(f"w{j}" for j in range(60)), "", 0) for i in range(300)]
    assert all(r.kept for r in outliers.judged(spark.createDataFrame(rows, SCHEMA)).collect())
    assert outliers.judged(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_estimate(groups, steps):
    """The estimator in numpy: per (lang, source) concentration steps, shrunk to the language and to all rows by count."""
    floors = np.diag(np.square(outliers.FLOORS))
    fitted = {}
    for key, x in groups.items():
        q = np.array([[np.floor(np.sort(c * outliers.FINENESS))[max(0, int(np.ceil(p * len(c))) - 1)] for c in x.T] for p in (0.25, 0.5, 0.75)])
        fitted[key] = ((q[1] + 0.5) / outliers.FINENESS, np.diag(((q[2] - q[0]) / (1.349 * outliers.FINENESS)) ** 2) + floors)

    def distance(x, fit):
        off = x - fit[0]
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(fit[1]), off)

    def pool(parts):
        n = sum(p[0] for p in parts)
        mean = sum(p[0] * p[1] for p in parts) / n
        return n, mean, sum(p[0] * (p[2] + np.outer(p[1], p[1])) for p in parts) / n - np.outer(mean, mean)

    def towards(part, wide):
        share = part[0] / (part[0] + outliers.PRIOR_ROWS)
        return part[0], share * part[1] + (1 - share) * wide[1], share * part[2] + (1 - share) * wide[2]

    for _ in range(steps):
        parts = {}
        for key, x in groups.items():
            bins = np.floor(np.log1p(distance(x, fitted[key])) * outliers.FINENESS)
            edge = np.sort(bins)[int(np.ceil(outliers.SUBSET * len(x))) - 1]
            near = x[bins <= edge]
            parts[key] = (len(near), near.mean(axis=0), np.cov(near.T, bias=True).reshape(5, 5))
        langs = {lang: pool([p for k, p in parts.items() if k[0] == lang]) for lang in {k[0] for k in parts}}
        everything = pool(list(langs.values()))
        langs = {lang: towards(p, everything) for lang, p in langs.items()}
        shrunk = {k: towards(p, langs[k[0]]) for k, p in parts.items()}
        fitted = {k: (p[1], p[2] + floors) for k, p in shrunk.items()}
    return {k: distance(x, fitted[k]) for k, x in groups.items()}


def test_distances_equal_a_plain_estimate(spark):
    """Up to each group's scale, also for groups of a few texts; no size begins to count."""
    rnd = random.Random(9)
    sizes = {("en", "big"): 260, ("en", "small"): 7, ("en", "one"): 1, ("de", "mid"): 60, ("fr", "few"): 3}
    rows = []
    for (lang, source), n in sizes.items():
        for _ in range(n):
            extra = " ".join(rnd.choice(["#", "%%", "plain"]) for _ in range(rnd.randint(0, 12)))
            lines = "\nsame line" * rnd.randint(0, 4)
            rows.append((len(rows), lang, source, f"{prose(rnd, rnd.randint(60, 300))} {extra}{lines}", "", 0))
    found = {r.doc_id: r for r in outliers.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    groups = {}
    for doc_id, lang, source, *_ in rows:
        r = found[doc_id]
        assert not r.base_failed
        n = r.n_words
        groups.setdefault((lang, source), []).append([
            np.log1p(n), np.log(r.word_chars / n), np.log1p(100 * r.n_symbols / n), np.log1p(100 * r.n_dup_lines / n),
            np.arcsin(np.sqrt(min(1, r.n_repeat_words / n)))])
    expected = plain_estimate({k: np.array(v) for k, v in groups.items()}, outliers.STEPS)
    for key, distances in expected.items():
        own = [found[i].distance for i, lang, source, *_ in rows if (lang, source) == key]
        ratio = np.array(own) / distances
        assert np.allclose(ratio, ratio[0], rtol=1e-3), (key, ratio)


def test_plans_stay_short(spark, monkeypatch):
    """What one job plans is held by the driver, many times over."""
    sizes = []
    table = outliers.Work.table

    def counted(work, df, purpose):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return table(work, df, purpose)

    monkeypatch.setattr(outliers.Work, "table", counted)
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["en", "de"]), "s", prose(rnd, 60), "", 0) for i in range(20)]
    assert outliers.judged(spark.createDataFrame(rows, SCHEMA)).count() == 20
    assert max(sizes) <= 40
