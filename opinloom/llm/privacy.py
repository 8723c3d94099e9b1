"""Personal data: spans by pattern, and terms that the corpus shows to reveal the people they stand with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinloom.llm.shared import Work, plain_text, row_unpacked, with_row

# The patterns and their order. Possessive repeats match the same and never recurse on long runs; an
# address begins after a character that cannot be part of one, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"
TERM = "term"
# A word begins with a letter; apostrophes and hyphens may join its parts.
WORD = r"\p{L}[\p{L}\p{M}\p{N}]*+(?:['\u2019\u2010-][\p{L}\p{N}][\p{L}\p{M}\p{N}]*+)*+"
LEAST_CONFIDENCE = 0.5
GENERALISED_BITS = 6.0
REMOVED_BITS = 12.0
BUCKETS = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = "struct<start:int,kind:int,end:int>"


def _luhn(digits: Column) -> Column:
    """True if the check digit of a string of digits is right."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, digit(i)).otherwise(doubled(digit(i))))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "email":
        return F.lit(True)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def _matches(kind: str, text: Column) -> Column:
    """Spans of the valid matches of a kind, in code points: what lies between the matches gives their places."""
    pattern = F.lit(PATTERNS[kind])
    found, between = F.regexp_extract_all(text, pattern, 0), F.split(text, PATTERNS[kind], -1)
    none = F.array().cast(f"array<{SPAN}>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc: Column, both: Column) -> Column:
        start = acc["at"] + F.length(both["gap"])
        end = start + F.length(both["match"])
        span = F.struct(start.alias("start"), F.lit(list(PATTERNS).index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(_valid(kind, both["match"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    return F.when(text.rlike(PATTERNS[kind]), F.aggregate(pairs, begin, add)["spans"]).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with an array of spans ``(start, kind, end)`` for each kind of personal data."""
    return docs.withColumns({kind: _matches(kind, F.col("text")) for kind in PATTERNS})


def lower_letters(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _values(text: Column) -> Column:
    """The distinct protected values of a text with their kinds."""
    value = lambda s: F.struct(s["kind"].alias("kind"), lower_letters(F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("value"))
    return F.array_distinct(F.transform(F.concat(*PATTERNS), value))


def _masked(text: Column) -> Column:
    """The text with blanks in place of its protected values, so words keep their places."""

    def blank(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - start)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    spans = F.array_sort(F.concat(*PATTERNS))
    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), blank, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _terms(masked: Column) -> Column:
    """The distinct words of a masked text, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(masked, F.lit(WORD), 0)), F.lower))


def _located(masked: Column, terms: Column, removed: Column) -> Column:
    """Spans of every occurrence of ``terms`` in a masked text; ``removed`` are those of them that are sure."""
    kind = "array<struct<start:int,kind:int,end:int,removed:boolean>>"
    found, between = F.regexp_extract_all(masked, F.lit(WORD), 0), F.split(masked, WORD, -1)

    def add(acc: Column, both: Column) -> Column:
        start = acc["at"] + F.length(both["gap"])
        end = start + F.length(both["word"])
        term = F.lower(both["word"])
        span = F.struct(start.alias("start"), F.lit(len(PATTERNS)).alias("kind"), end.alias("end"), F.array_contains(removed, term).alias("removed"))
        return F.struct(end.alias("at"), F.when(F.array_contains(terms, term), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).cast(kind).alias("spans"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda w, g: F.struct(w.alias("word"), g.alias("gap")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")), add)["spans"]


def _holders(held: DataFrame) -> DataFrame:
    """Which texts hold which protected values: a row for each class of values and text.

    Values of one kind that stand in the same texts are one class, told by the number and the sum of the texts' hashes,
    so a text full of values multiplies its words by its classes only. Whole kinds are classes too.
    """
    each = held.groupBy("kind", "value", "text_key").agg(F.count("*").alias("rows"))
    sums = each.groupBy("kind", "value").agg(
        F.count("*").alias("texts"), F.sum("rows").alias("docs"), F.sum(F.hash("text_key", "text_key").cast("decimal(38,0)")).alias("light"),
        F.sum(F.col("text_key").cast("decimal(38,0)")).alias("sum"))
    named = sums.select("kind", "value", F.xxhash64("kind", "texts", "docs", "light", "sum").alias("entity"), "texts", "docs")
    values = each.join(named, ["kind", "value"]).groupBy("entity", "kind", "text_key").agg(
        F.first("rows").alias("rows"), F.first("texts").alias("entity_texts"), F.first("docs").alias("entity_docs"))
    kinds = each.groupBy("kind", "text_key").agg(F.max("rows").alias("rows"))
    whole = kinds.groupBy("kind").agg(F.count("*").alias("entity_texts"), F.sum("rows").alias("entity_docs"))
    return values.unionByName(kinds.join(F.broadcast(whole), "kind").withColumn("entity", F.lit(None).cast("long")))


def disclosures(words: DataFrame, work: Work) -> DataFrame:
    """Terms that reveal a protected value, and whether they are removed, from the values and terms of every document.

    Of the documents of the whole corpus that hold the term, the share that hold the value is its confidence; against
    the value's own share it gives the bits, log2 P(value | term) / P(value). Every count takes part: from k different
    texts with both, the confidence is smoothed by one text more that has the value as often as the term's evidence for
    the whole kind and the value's share of the kind foretell. Copies of one text are one piece of evidence. The same is
    estimated for the kind itself, smoothed by its own share, so a term with a new value of one kind in each of its
    texts is found, too.

    A confidence of c needs a term in at most 2 / c - 1 times the documents of the value, and the bits bound these:
    words in more documents are left out before pairs are made. ``outside`` tells if texts without values hold a term.
    """
    holding = F.size("values") > 0
    known = words.select(holding.cast("long").alias("in"), F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("term_docs"), (F.count("*") > F.sum("in")).alias("outside"))
    known = work.table(known, "known")
    n = max(words.count(), 1)
    common = known.where(F.col("term_docs") > n * 2.0**-GENERALISED_BITS * (2 / LEAST_CONFIDENCE - 1)).select("term")
    held = work.table(words.select("text_key", F.explode("values").alias("v")).select("text_key", "v.kind", "v.value"), "values")
    holders = work.table(_holders(held), "holders")
    near = words.where(holding).select("text_key", F.explode("terms").alias("term")).join(F.broadcast(common), "term", "left_anti").distinct()
    own = ["entity", "kind", "entity_texts", "entity_docs"]
    pairs = holders.join(near, "text_key").groupBy(*own, "term").agg(F.count("*").alias("texts"), F.sum("rows").alias("together"))
    counted = work.table(pairs.join(known, "term"), "pairs")
    total = F.lit(n)
    smoothed = lambda prior: (F.col("texts") + prior) / (F.col("texts") * F.col("term_docs") / F.col("together") + 1)
    bits = F.log2(F.col("confidence") * total / F.col("entity_docs"))
    kinds = counted.where(F.col("entity").isNull()).withColumn("confidence", smoothed(F.col("entity_docs") / total))
    of_kind = kinds.select("kind", "term", F.col("confidence").alias("kind_confidence"), F.col("entity_texts").alias("kind_texts"))
    values = counted.where(F.col("entity").isNotNull()).join(of_kind, ["kind", "term"])
    values = values.withColumn("confidence", smoothed(F.col("kind_confidence") * F.col("entity_texts") / F.col("kind_texts")))
    found = values.select("term", "outside", "confidence", bits.alias("bits")).unionByName(kinds.select("term", "outside", "confidence", bits.alias("bits")))
    kept = found.where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("bits") >= GENERALISED_BITS))
    done = work.table(kept.groupBy("term").agg((F.max("bits") >= REMOVED_BITS).alias("removed"), F.first("outside").alias("outside")), "disclosures")
    work.drop(held, holders, known, counted)
    return done


def _occurring(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(row_key, term, removed)`` for every row with a disclosing term.

    Most of these terms stand in texts with values only. Words of the other texts are sorted out by a broadcast table of
    at most ``BUCKETS`` hashes of the rest before they are joined.
    """
    each = lambda rows: rows.select("row_key", F.explode("terms").alias("term"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("bucket")
    rest = pairs.where("outside")
    passed = each(words.where(F.size("values") == 0)).withColumn("bucket", bucket).join(
        F.broadcast(rest.select(bucket).distinct()), "bucket", "left_semi")
    inside = each(words.where(F.size("values") > 0)).join(pairs, "term")
    return inside.unionByName(passed.drop("bucket").join(rest, "term"))


def found_spans(docs: DataFrame, work: Work | None = None) -> DataFrame:
    """``docs`` with an array of spans for each kind, and ``terms``: every occurrence of a term that reveals a value.

    Null counts as empty; a text without spans gets empty arrays, an empty table stays empty. Repeated rows share their
    spans. Columns named like a kind are replaced. Terms are counted over whole documents, and those that reveal a value
    are found in every text, also in one that holds no value.
    """
    work = work or Work(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    own = [c for c in docs.columns if c not in (*PATTERNS, "text", "terms", "row_key", "text_key")]
    texts = docs.select(*own, plain_text().alias("text")).withColumns({"row_key": key, "text_key": F.xxhash64("text")})
    based = base_spans(texts)
    text = F.col("text")
    words = work.table(based.select("row_key", "text_key", _values(text).alias("values"), _terms(_masked(text)).alias("terms")), "words")
    pairs = disclosures(words, work)
    terms = _occurring(words, pairs).groupBy("row_key").agg(
        F.collect_set("term").alias("__terms"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("__removed"))
    terms = work.table(terms, "terms")
    work.drop(words, pairs)
    located = F.when(F.col("__terms").isNotNull(), _located(_masked(text), F.col("__terms"), F.col("__removed")))
    return based.join(terms, "row_key", "left").withColumn("terms", located).drop("text_key", "row_key", "__terms", "__removed")


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` sanitised: values become their kind in brackets, terms ``[term]`` or, if sure, nothing.

    Where spans overlap, the one that begins first is replaced and the rest of the others dropped. All other columns stay,
    whatever their names.
    """
    found = found_spans(with_row(docs, "doc_id", "text", without="text"))
    plain = [F.transform(k, lambda s: F.struct(s["start"], s["kind"], s["end"], F.lit(False).alias("removed"))) for k in PATTERNS]
    spans = F.array_sort(F.concat(*plain, F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>"))))
    names = F.array(*[F.lit(f"[{k}]") for k in (*PATTERNS, TERM)])
    text = F.col("text")

    def put(acc: Column, s: Column) -> Column:
        shown = F.when(s["removed"], "").otherwise(F.get(names, s["kind"]))
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), shown)
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(more).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put)
    clean = found.withColumn("__done", done)
    rest = F.substring(text, F.col("__done.at") + 1, F.length(text))
    return row_unpacked(clean.withColumn("text", F.concat(F.col("__done.out"), rest)), docs.columns, without="text")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind, the hash of these spans, and all spans as text."""
    found = found_spans(docs.select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in (*PATTERNS, TERM)])
    shown = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>")), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    listed = found.select("doc_id", *PATTERNS, F.array_sort(F.concat(*PATTERNS)).alias("base"), F.array_sort(F.concat(*PATTERNS, terms)).alias("every"))
    return listed.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.concat_ws(",", F.transform("base", shown)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("every", shown)).alias("spans"))
