import random
import re

from opinloom.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, thread string, depth int"

TALK = [
    (1, 0, "user", "How do I sort a very large table?\nIt has many rows."),
    (1, 1, "assistant", "Use a range partition first, please.\n\nThen sort each part on its own."),
    (1, 2, "user", "Anna wrote:\n> How do I sort a very large table?\n> It has many rows.\nMore details follow here."),
    (1, 3, "assistant", "> Then sort each part\n> on its own.\n>> deeper level of some quote\nThat was the second step."),
    (1, 4, "user", ">  THEN sort each   part on its own.\nWhich memory does it take?"),
    (1, 5, "user", "> a passage that nobody has written\nNothing to link."),
    (1, 6, "user", "> Which memory does it take?"),
    (2, 0, "user", "Then sort each part on its own."),
    (2, 1, "user", "> Use a range partition first, please.\nother conversation"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA)


def test_links_and_threads(spark):
    found = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(frame(spark, TALK)).collect()}
    parents = {k: r.parent_turn for k, r in found.items()}
    assert parents == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 1, (1, 4): 1, (1, 5): None, (1, 6): 4, (2, 0): None, (2, 1): None}
    assert found[1, 6].thread == [1, 4, 6] and found[1, 6].depth == 2 and found[1, 6].text == ""
    assert found[1, 2].text == "More details follow here." and found[1, 3].text == "That was the second step."
    assert found[1, 3].n_quotes == 2 and found[1, 5].n_linked == 0 and found[1, 5].n_quotes == 1
    assert found[1, 0].formatted == "<|user|>\n" + TALK[0][3]
    order = [r.turn for r in sorted((r for r in found.values() if r.conv_id == 1), key=lambda r: r.thread)]
    assert order == [0, 2, 1, 3, 4, 6, 5]


def test_long_reply_chains(spark):
    rows = [(7, i, "user", (f"> statement number {i - 1} of the chain\n" if i else "") + f"statement number {i} of the chain") for i in range(37)]
    found = {r.turn: r for r in quotes.reply_ordered(frame(spark, rows)).collect()}
    assert all(found[i].thread == list(range(i + 1)) for i in range(37))


def test_edges(spark):
    rows = [(1, 0, None, None), (None, 1, "user", "> quoted words of nobody\nx"), (2, None, "user", "> quoted words of nobody"), (3, 1, "user", ">>>"), (3, 1, "user", ">>>"), (4, 0, "a", "b " * 90000), (4, 1, "a", "> b b b b b b\n")]
    found = quotes.reply_ordered(frame(spark, rows))
    assert found.count() == len(rows)
    assert found.columns == ["conv_id", "turn", "role", "text", "parent_turn", "thread", "depth", "n_quotes", "n_linked", "formatted"]
    assert quotes.reply_ordered(frame(spark, rows).limit(0)).collect() == []


def test_written_in_order(spark, tmp_path):
    quotes.written_in_order(frame(spark, TALK), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(TALK)


def brute(rows):
    """Parent and number of found parts of every message, by plain loops."""
    def words(t):
        return (t or "").lower().replace("\u00a0", " ").split()

    def runs(ws, n):
        return {(n, tuple(ws[i : i + n])) for i in range(len(ws) - n + 1)}

    parsed = []
    for conv, turn, _, text in rows:
        own, passages = [], []
        for line in (text or "").split("\n"):
            marks = re.match(r"(?:[ \t]?>)+", line)
            level = marks[0].count(">") if marks else 0
            body = re.sub(r"^(?:[ \t]?>)+[ \t]?", "", line)
            if not level:
                own.append(line)
            elif passages and passages[-1][0] == level and passages[-1][2] == len(own):
                passages[-1][1] += "\n" + body
            else:
                passages.append([level, body, len(own)])
        parsed.append((conv, turn, "\n".join(own), [(a, words(b)) for a, b, _ in passages if words(b)]))
    out = {}
    for conv, turn, _, passages in parsed:
        votes, cited = {}, set()
        for level, ws in passages:
            n = min(len(ws), quotes.WINDOW)
            cited |= {(level, 0, p) for p in runs(ws, n)}
            if len(ws) < quotes.WINDOW:
                cited.add((level, 1, (-1, tuple(ws))))
        for level, whole, part in cited:
            sources = []
            for c, t, own, _ in parsed:
                if c == conv:
                    units = [own, *re.split(r"\n\s*\n", own), *own.split("\n")]
                    held = part[1] in {tuple(words(u)) for u in units} if whole else part in runs(words(own), part[0])
                    sources += [t] if held else []
            if sources and min(sources) < turn:
                w, n = votes.get((level, min(sources)), (0, 0))
                votes[level, min(sources)] = max(w, whole), n + 1
        best = max(((-level, w, n, t) for (level, t), (w, n) in votes.items()), default=None)
        out[conv, turn] = (best[3] if best else None, sum(n for _, n in votes.values()))
    return out


def test_nested_short_and_rewrapped_quotes_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["yes", "please", "no"]
    rows = []
    for conv in range(12):
        talk = []
        for turn in range(9):
            lines = []
            for _ in range(rng.randrange(3) if talk else 0):
                ws = rng.choice(talk).replace("\n", " ").split() or ["yes"]
                a = rng.randrange(len(ws))
                part = ws[a : a + rng.choice([1, 2, 4, 7, 30])]
                cut = rng.randrange(1, len(part) + 1)
                level = rng.choice([1, 1, 2, 3])
                lines += [">" * level + " " + " ".join(p).upper() for p in (part[:cut], part[cut:]) if p] + [rng.choice(["fine", "", "no way"])]
            own = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 6, 12]))) for _ in range(rng.randrange(1, 4)))
            talk.append(own)
            rows.append((conv, turn, "user", "\n".join([*lines, own])))
    found = {(r.conv_id, r.turn): (r.parent_turn, r.n_linked) for r in quotes.reply_ordered(frame(spark, rows)).collect()}
    assert found == brute(rows) and sum(p is not None for p, _ in found.values()) > 20


def test_a_short_and_a_deep_quote_have_parents(spark):
    rows = [(1, 0, "a", "Shall we go?"), (1, 1, "b", "Yes, please"), (1, 2, "a", "> Yes, please\nGood."), (1, 3, "b", ">> Shall we go?\nWe did.")]
    assert {r.turn: r.parent_turn for r in quotes.reply_ordered(frame(spark, rows)).collect()} == {0: None, 1: None, 2: 1, 3: 0}
