"""Conversations without quotes: quoted passages are linked to the messages they come from, which orders the replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinloom.llm.shared import Work, plain_text, with_row

QUOTE = r"^(?:[ \t]?>)+"
# How mail programs announce a quote.
ANNOUNCED = r"(?i)(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
WINDOW = 5  # words


def _normal(text: Column) -> Column:
    """Lower case, any white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\u00a0]+", " "))


def _words(text: Column) -> Column:
    """The words of a text, without regard to line breaks."""
    return F.filter(F.split(_normal(text), " ", -1), lambda w: w != "")


def _parsed(text: Column) -> Column:
    """The lines of a message as (level, body): the number of quote marks before it, and what follows them."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, QUOTE, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(x, QUOTE + "[ \t]?", "").alias("body"))

    return F.transform(F.split(text, r"\r?\n", -1), line)


def _passages(lines: Column) -> Column:
    """Runs of lines of one level, joined."""
    kind = "array<struct<level:int,body:string>>"

    def add(runs: Column, x: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        grown = F.struct(last["level"].alias("level"), F.concat_ws("\n", last["body"], x["body"]).alias("body"))
        same = last["level"] == x["level"]
        return F.when(same, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(grown))).otherwise(F.concat(runs, F.array(x)))

    return F.aggregate(lines, F.array().cast(kind), lambda runs, x: add(runs, x).cast(kind))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """``messages`` with ``own``, the text without quotes and their announcements, and ``quotes``, the quoted passages.

    Lines are cut into passages of one quote level. Only messages with a quote mark are parsed line by line.
    """
    quoted = plain_text().rlike(r"(?m)^[ \t]?>")
    rows = messages.withColumn("__lines", F.when(quoted, _parsed(plain_text())))
    lines = F.col("__lines")
    last = F.size(lines) - 1
    announces = lambda x, i: (x["level"] == 0) & x["body"].rlike(ANNOUNCED) & (i < last) & (F.get(lines, i + 1)["level"] > 0)
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~announces(x, i))
    own = F.when(quoted, F.trim(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"))).otherwise(plain_text())
    passages = F.filter(_passages(lines), lambda p: (p["level"] > 0) & (F.length(_normal(p["body"])) > 0))
    quotes = F.when(quoted, passages).otherwise(F.array().cast("array<struct<level:int,body:string>>"))
    return rows.withColumn("own", own).withColumn("quotes", quotes).drop("__lines")


def _windows(words: Column, size: Column) -> Column:
    """A hash of every run of ``size`` words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(size, F.array_join(F.slice(words, i, size), " ")))


def _wholes(text: Column) -> Column:
    """A hash of the whole text, of each of its paragraphs and of each line, those of fewer words than a window."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n", -1), F.split(text, r"\n", -1))
    short = F.filter(F.transform(parts, _words), lambda w: (F.size(w) > 0) & (F.size(w) < WINDOW))
    return F.transform(short, lambda w: F.xxhash64(F.lit(-1), F.array_join(w, " ")))


def _links(parsed: DataFrame) -> DataFrame:
    """For each message its parent, and how many parts of its quotes were found in earlier messages.

    A quoted passage is taken as its runs of ``WINDOW`` words, so line breaks don't matter; a shorter one as a whole line,
    paragraph or message, and as a run of so many words. Every level is linked. The parent is found at the lowest level
    that has any link: the turn with a whole short passage before others, then with most parts, then the latest. Of
    several turns that wrote a part the first is its author, so a part has one source in a conversation and a common
    line cannot multiply. Messages are cut into runs of the lengths that their conversation asks for, none without
    quotes.
    """
    quoted = parsed.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q")).select(
        "conv_id", "turn", F.col("q.level").alias("level"), _words(F.col("q.body")).alias("words"))
    size = F.least(F.size("words"), F.lit(WINDOW))
    whole = F.when(F.size("words") < WINDOW, F.array(F.xxhash64(F.lit(-1), F.array_join("words", " ")))).otherwise(F.array().cast("array<bigint>"))
    parts = F.concat(
        F.transform(whole, lambda h: F.struct(F.lit(1).alias("whole"), h.alias("part"))),
        F.transform(_windows(F.col("words"), size), lambda h: F.struct(F.lit(0).alias("whole"), h.alias("part"))))
    cited = quoted.select("conv_id", "turn", "level", F.inline(parts)).distinct()
    asked = quoted.groupBy("conv_id").agg(F.collect_set(size).alias("sizes"))
    written = F.concat(_wholes(F.col("own")), F.flatten(F.transform("sizes", lambda n: _windows(F.col("own_words"), n))))
    wrote = parsed.join(asked, "conv_id").withColumn("own_words", _words(F.col("own"))).select("conv_id", "turn", F.explode(F.array_distinct(written)).alias("part"))
    author = wrote.groupBy("conv_id", "part").agg(F.min("turn").alias("source"))
    met = cited.join(author, ["conv_id", "part"]).where(F.col("source") < F.col("turn"))
    votes = met.groupBy("conv_id", "turn", "level", "source").agg(F.max("whole").alias("whole"), F.count("*").alias("n"))
    best = F.max(F.struct(-F.col("level"), "whole", "n", "source"))
    return votes.groupBy("conv_id", "turn").agg(best.alias("best"), F.sum("n").alias("linked")).select(
        "conv_id", "turn", F.col("best.source").alias("parent_turn"), F.col("linked").alias("n_linked"))


def _threads(links: DataFrame, work: Work) -> DataFrame:
    """The path of turns from the root to each reply; paths double in length each round."""
    roots = links.select("conv_id", "turn", F.col("parent_turn").alias("above"), F.array("turn").alias("path"))
    current = work.table(roots, "threads")
    while not current.where(F.col("above").isNotNull()).isEmpty():
        upper = current.toDF("conv_id", "above", "next", "upper")
        path = F.concat(F.coalesce("upper", F.array("above")), F.col("path"))
        joined = current.join(upper, ["conv_id", "above"], "left")
        step = joined.select(
            "conv_id", "turn", F.when(F.col("upper").isNotNull(), F.col("next")).alias("above"),
            F.when(F.col("above").isNull(), F.col("path")).otherwise(path).alias("path"))
        following = work.table(step, "threads")
        work.drop(current)
        current = following
    return current.select("conv_id", "turn", "path")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, with its place among the replies of its conversation.

    ``parent_turn`` is the message it quotes (null if none is found; see ``_links``), ``thread`` the turns from the root of
    its replies to itself, ``depth`` the number of messages above it, ``n_quotes`` the quoted passages of all levels and
    ``n_linked`` the parts of them found in earlier messages; ``formatted`` is the message under its role. Ordered by conv_id and thread, every message
    follows the one it replies to; messages that quote nothing keep the order of turns.

    A null text is empty; a message that is quotes only has an empty text. A null conv_id or turn links with nothing.
    Repeated rows keep their number. Turns equal in one conversation share their links. Extra columns are kept whatever
    their names, those named like a new one are replaced. An empty table stays empty.
    """
    work = Work(messages.sparkSession)
    parsed = parsed_messages(with_row(messages, "conv_id", "turn", "role", "text"))
    links = work.table(_links(parsed.drop("__row")), "links")
    placed = parsed.join(links.join(_threads(links, work), ["conv_id", "turn"]), ["conv_id", "turn"], "left")
    text = F.trim(F.col("own"))
    thread = F.coalesce("path", F.when(F.col("turn").isNotNull(), F.array("turn")), F.array().cast("array<bigint>"))
    done = placed.withColumn("thread", thread).withColumns({
        "depth": F.greatest(F.size("thread") - 1, F.lit(0)), "n_quotes": F.size("quotes"),
        "n_linked": F.coalesce("n_linked", F.lit(0)), "text": text,
        "formatted": F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), text)})
    new = ("parent_turn", "thread", "depth", "n_quotes", "n_linked", "formatted")
    own = [F.col("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in messages.columns if c not in new]
    return done.select(*own, *new)


def written_in_order(messages: DataFrame, path: str) -> None:
    """Writes the conversations in reply order; a long conversation may span several files."""
    reply_ordered(messages).repartitionByRange("conv_id", "thread").sortWithinPartitions("conv_id", "thread").write.parquet(path)
