"""Quality rules: base counts of each text, and robust multivariate outliers among them by language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinloom.llm.shared import WORD_BREAKS, Work, plain_text, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
SUBSET = 0.75
STEPS = 4
PRIOR_ROWS = 50  # rows that the estimate of a language counts for beside those of one of its sources
# The median of chi-squared with five degrees of freedom, and the distance beyond which a text goes.
MEDIAN_DISTANCE = 4.351
CUT = 120.0
DIMENSIONS = 5
# Least deviation of each transformed statistic: below it, texts count as alike.
FLOORS = (0.35, 0.08, 0.35, 0.30, 0.10)
FINENESS = 32


def _repeated(w: Column, bits: Column) -> Column:
    """Sorted numbers that hold a hash of each three-word window above and its position below."""
    windows = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    number = lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long"))
    return F.sort_array(F.transform(windows, number))


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``.

    A repeated window is found by sorting the windows' hashes within the row: the position in the low bits, as many as
    the row needs, the hash in the rest.
    """
    own = [c for c in docs.columns if c != "text"]
    text = plain_text()
    blank = F.trim(F.translate(text, WORD_BREAKS, " " * len(WORD_BREAKS)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(F.translate(x, WORD_BREAKS, " " * len(WORD_BREAKS))) != "")
    cut = docs.select(
        *own, words(text).alias("__words"), F.length(F.translate(blank, " ", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("__lines"))
    counted = cut.select(
        *own, "__words", "word_chars", "n_symbols", F.size("__words").cast("long").alias("n_words"),
        F.length(F.bin(F.size("__words"))).alias("__bits"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"))
    kept = [*own, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    marked = counted.select(*kept, "__bits", _repeated(F.col("__words"), F.col("__bits")).alias("__s"))
    high = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    s = F.col("__s")
    twice = F.filter(s, lambda x, i: (high(x) == high(F.get(s, i - 1))) | (high(x) == high(F.get(s, i + 1))))
    low = marked.select(*kept, "__bits", twice.alias("__twice"))
    place = F.sort_array(F.transform("__twice", lambda x: x - F.call_function("shiftleft", high(x), F.col("__bits"))))
    placed = low.select(*kept, place.alias("__at"))
    at = F.col("__at")
    covered = F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long"))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select(*kept, F.when(F.size(at) > 0, total).otherwise(0).cast("long").alias("n_repeat_words"))


def _transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / n), F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / n)))]


X = [f"x{i}" for i in range(DIMENSIONS)]
MEANS = [f"m{i}" for i in range(DIMENSIONS)]
FACTOR = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
COVARIANCE = [f"c{i}{j}" for i, j in FACTOR]
SEPARATOR = "\x1f"


def _at(i: int, j: int, prefix: str = "l") -> str:
    return f"{prefix}{i}{j}"


def _factored(rows: DataFrame) -> DataFrame:
    """Columns l of the Cholesky factor from columns c of the covariance, entry by entry."""
    for j in range(DIMENSIONS):
        for i in range(j, DIMENSIONS):
            left = F.col(_at(i, j, "c"))
            for k in range(j):
                left = left - F.col(_at(i, k)) * F.col(_at(j, k))
            entry = F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(_at(j, j))
            rows = rows.withColumn(_at(i, j), entry)
    return rows.select("group", "lang", *MEANS, *[_at(i, j) for i, j in FACTOR])


def _distance(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Rows with ``distance``, the squared Mahalanobis distance, by forward substitution."""
    rows = rows.join(fitted.drop("lang"), "group")
    for i in range(DIMENSIONS):
        left = F.col(X[i]) - F.col(MEANS[i])
        for k in range(i):
            left = left - F.col(_at(i, k)) * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", left / F.col(_at(i, i)))
    return rows.withColumn("distance", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIMENSIONS)), F.lit(0.0)))


def _cumulated(counts: DataFrame, *keys: str) -> DataFrame:
    """A row per key and bin with ``upto``, the rows of the key up to this bin, and ``all`` rows of the key."""
    of_key = Window.partitionBy(*keys)
    return counts.select("*", F.sum("n").over(of_key.orderBy("bin")).alias("upto"), F.sum("n").over(of_key).alias("all"))


def _first_bin(share: float, among: Column | None = None) -> Column:
    """Aggregate: the first bin by which ``share`` of the rows is reached."""
    reached = F.col("upto") >= F.lit(share) * F.col("all")
    return F.min(F.when(reached if among is None else among & reached, F.col("bin")))


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and quartile ranges as uncorrelated deviations, from a histogram of each statistic."""
    long = rows.select("group", F.posexplode(F.array(*[F.floor(F.col(x) * FINENESS) for x in X])).alias("dim", "bin"))
    counts = _cumulated(long.groupBy("group", "dim", "bin").agg(F.count("*").alias("n")), "group", "dim")
    quartiles = counts.groupBy("group").agg(
        *[_first_bin(p, F.col("dim") == i).alias(f"q{k}{i}") for i in range(DIMENSIONS) for k, p in enumerate((0.25, 0.5, 0.75))])
    spread = [(F.col(f"q2{i}") - F.col(f"q0{i}")) / (1.349 * FINENESS) for i in range(DIMENSIONS)]
    return quartiles.select(
        "group", F.substring_index("group", SEPARATOR, 1).alias("lang"),
        *[((F.col(f"q1{i}") + 0.5) / FINENESS).alias(MEANS[i]) for i in range(DIMENSIONS)],
        *[(F.pow(spread[i], 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(_at(i, j, "c")) for i, j in FACTOR])


def _concentrated(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Half of a concentration step: mean and covariance of the nearest rows of each group under the last estimate.

    Sums are taken per group and bin of the distance, so the subset and its moments come from the same pass. A bin is
    inside if the bins before it do not reach ``SUBSET`` of the rows.
    """
    near = _distance(rows, fitted).withColumn("bin", F.floor(F.log1p("distance") * FINENESS))
    off = [F.col(X[i]) - F.col(MEANS[i]) for i in range(DIMENSIONS)]
    sums = [F.sum(o).alias(f"t{i}") for i, o in enumerate(off)] + [F.sum(off[i] * off[j]).alias(_at(i, j, "t")) for i, j in FACTOR]
    bins = near.groupBy("group", "bin").agg(F.count("*").alias("n"), *sums, *[F.first(m).alias(m) for m in MEANS])
    inside = _cumulated(bins, "group").where(F.col("upto") - F.col("n") < F.lit(SUBSET) * F.col("all"))
    names = ["n", *[f"t{i}" for i in range(DIMENSIONS)], *[_at(i, j, "t") for i, j in FACTOR]]
    total = inside.groupBy("group").agg(*[F.sum(c).alias(c) for c in names], *[F.first(m).alias(m) for m in MEANS])
    n = F.col("n")
    return total.select(
        "group", F.substring_index("group", SEPARATOR, 1).alias("lang"), "n",
        *[(F.col(MEANS[i]) + F.col(f"t{i}") / n).alias(MEANS[i]) for i in range(DIMENSIONS)],
        *[(F.col(_at(i, j, "t")) / n - F.col(f"t{i}") / n * F.col(f"t{j}") / n).alias(_at(i, j, "c")) for i, j in FACTOR])


def _pooled(parts: DataFrame, *keys: str) -> DataFrame:
    """Number, means and covariance of the rows of several groups together, from those of each."""
    n = F.sum("n")
    mean = [F.sum(F.col("n") * F.col(m)) / n for m in MEANS]
    second = {c: F.sum(F.col("n") * (F.col(c) + F.col(MEANS[i]) * F.col(MEANS[j]))) / n for c, (i, j) in zip(COVARIANCE, FACTOR, strict=True)}
    pooled = parts.groupBy(*keys).agg(n.alias("n"), *[x.alias(m) for x, m in zip(mean, MEANS, strict=True)], *[x.alias(c) for c, x in second.items()])
    return pooled.withColumns({c: F.col(c) - F.col(MEANS[i]) * F.col(MEANS[j]) for c, (i, j) in zip(COVARIANCE, FACTOR, strict=True)})


def _towards(parts: DataFrame, wider: DataFrame, *keys: str) -> DataFrame:
    """Means and covariance drawn to those of a wider group, which count for ``PRIOR_ROWS`` rows."""
    names = [*MEANS, *COVARIANCE]
    renamed = wider.select(*keys, *[F.col(c).alias(f"w_{c}") for c in names])
    joined = parts.join(renamed, list(keys)) if keys else parts.join(renamed, F.lit(True))
    share = F.col("n") / (F.col("n") + PRIOR_ROWS)
    return joined.withColumns({c: share * F.col(c) + (1 - share) * F.col(f"w_{c}") for c in names}).select(*parts.columns)


def _shrunk(parts: DataFrame) -> DataFrame:
    """The estimate of each group, drawn to that of its language, which is drawn to that of all rows, by row count."""
    langs = _pooled(parts, "lang")
    drawn = _towards(parts, _towards(langs, _pooled(langs)), "lang")
    return drawn.withColumns({_at(i, i, "c"): F.col(_at(i, i, "c")) + FLOORS[i] ** 2 for i in range(DIMENSIONS)})


def judged(docs: DataFrame) -> DataFrame:
    """Per row doc_id, the base counts, ``base_failed``, ``distance`` and ``kept``.

    Texts that pass the base rules are compared within their language and source. Estimates start from medians and
    quartiles and take ``STEPS`` concentration steps on the nearest three quarters, towards the least determinant of the
    covariance. After each step a group's estimate is drawn to that of its language, and this to that of all rows, by
    row count: there is no size at which a group begins to count, and a single text is judged by its language. Distances
    are scaled by their median, drawn to that of the language alike. A small floor on each deviation keeps constant
    statistics from rejecting whatever differs at all.

    Null and blank texts have no words and fail the base rules, as any text under fifty words. Null languages or sources
    form groups of their own. Repeated rows are judged alike and counted as often as they come. Columns other than doc_id,
    text, lang and source are not read; an empty table gives an empty result.
    """
    work = Work(docs.sparkSession)
    named = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")).alias(c) for c in ("lang", "source")]
    stats = base_statistics(docs.select("doc_id", *named, "text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = work.table(stats.withColumn("base_failed", failed).withColumns(dict(zip(X, _transformed(), strict=True))), "statistics")
    passed = stats.where(~F.col("base_failed"))
    passed = passed.withColumn("group", F.concat("lang", F.lit(SEPARATOR), "source"))
    rows = work.table(passed.select("group", *X), "vectors")
    # Small tables between the parts of a step keep each plan short: the driver holds the plans of a job, many times over.
    parts = work.table(_start(rows), "moments")
    fitted = work.table(_factored(parts), "fit")
    work.drop(parts)
    for _ in range(STEPS):
        parts = work.table(_concentrated(rows, fitted), "moments")
        following = work.table(_factored(_shrunk(parts)), "fit")
        work.drop(parts, fitted)
        fitted = following
    far = _distance(rows, fitted).groupBy("group", F.floor(F.log1p("distance") * FINENESS).alias("bin")).agg(F.count("*").alias("n"))
    middle = _cumulated(far, "group").groupBy("group").agg(_first_bin(0.5).alias("middle"), F.max("all").alias("n"))
    middle = work.table(middle.select(
        "group", "n", F.substring_index("group", SEPARATOR, 1).alias("lang"), (F.expm1((F.col("middle") + 1) / FINENESS) / MEDIAN_DISTANCE).alias("own")), "scales")
    of_lang = middle.groupBy("lang").agg((F.sum(F.col("n") * F.col("own")) / F.sum("n")).alias("wide"))
    share = F.col("n") / (F.col("n") + PRIOR_ROWS)
    scale = middle.join(of_lang, "lang").select("group", F.greatest(share * F.col("own") + (1 - share) * F.col("wide"), F.lit(0.05)).alias("scale"))
    final = work.table(fitted.join(scale, "group"), "fit")
    work.drop(middle)
    work.drop(rows, fitted)
    measured = _distance(passed, final)
    answer = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    inside = measured.select(*answer, (F.col("distance") / F.col("scale")).alias("distance"))
    outside = stats.where("base_failed").select(*answer, F.lit(None).cast("double").alias("distance"))
    return inside.unionByName(outside).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUT))
