"""One registered query for each operator, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinloom.llm import factorisation, jaccard, mixing, naming, outliers, packing, phrases, pieces, privacy, quotes, suffixes, toxicity, whitening
from opinloom.llm.shared import documents, held_out, labels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


@query()
def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Three-word shingles at 90 %: component and number of links of every document."""
    return jaccard.near_duplicates(documents(spark, folder), width=3, num=90, den=100)


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return naming.duplicates(documents(spark, folder))


@query(f"""
WITH {mixing.MIXTURE_SQL}
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, more - before)) AS taken FROM reached
""")
def op8_mixing_to_target_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix of sources takes of every document."""
    return mixing.taken_words(documents(spark, folder))


@query()
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "n_chars")
    found = factorisation.scored(docs, factorisation.fit(docs, labels(spark, folder)))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.fit(docs, labels(spark, folder)))
    predicted = (F.col("score") >= 0.5).cast("int")
    return found.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


@query()
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judged(documents(spark, folder))


@query()
def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    shipped = pieces.ship(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.token_digests(documents(spark, folder), shipped)


@query()
def op6_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    shipped = packing.ship(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.packed(documents(spark, folder), shipped)


@query()
def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.reply_ordered(spark.read.parquet(f"{folder}/conversations.parquet"))


@query()
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.span_digests(documents(spark, folder))


def _followed(table: str, key: str) -> str:
    """SQL: every word of the texts of a table with the nine after it, and the number of words from it on."""
    ten = ", ".join(f"lead(word, {i}) OVER along" for i in range(10))
    return rf"""
SELECT row, {key}, spot, [{ten}] AS ten, n_words, n_words - spot + 1 AS remaining
FROM (SELECT row, {key}, unnest(words) AS word, generate_subscripts(words, 1) AS spot, len(words) AS n_words
  FROM (SELECT row_number() OVER () AS row, {key},
      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM {table}))
WINDOW along AS (PARTITION BY row ORDER BY spot)"""


@query(f"""
WITH place AS ({_followed("documents", "doc_id")}),
item AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(remaining, 10) AS n, array_to_string(ten[1:least(remaining, 10)], ' ') AS win
  FROM ({_followed("benchmark", "item_id")}) WHERE remaining >= 10 OR (spot = 1 AND n_words < 10)),
spans AS (SELECT row, spot, n, array_to_string(ten[1:n], ' ') AS win FROM place JOIN (SELECT DISTINCT n FROM item) ON remaining >= n),
found AS (SELECT row, spot, n, item FROM spans JOIN item USING (n, win)),
hits AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(spot, spot + n)) AS word FROM found) GROUP BY row),
held AS (SELECT row, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found) GROUP BY row),
sizes AS (SELECT DISTINCT row, n_words FROM place)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN sizes USING (row) LEFT JOIN hits USING (row) LEFT JOIN held USING (row)
""")
def op13_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in ten consecutive words of a benchmark item, and the items found."""
    found = suffixes.overlaps(documents(spark, folder).select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query()
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding projected on the first 16 whitened components of the distinct integer vectors."""
    found = whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
    return found.drop("embedding")


def _counts_sql() -> str:
    """SQL: how often each phrase of one to five words occurs in the pieces of each language."""
    nexts = ", ".join(f"lead(word, {i}) OVER along AS w{i}" for i in range(1, 5))
    sizes = [" || ' ' || ".join(["word", *[f"w{i}" for i in range(1, k)]]) for k in range(1, 6)]
    return rf"""
pieces AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(text, '[^ \t]+') AS words FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS text FROM documents)),
places AS (SELECT lang, word, {nexts} FROM (SELECT piece, lang, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM pieces)
  WINDOW along AS (PARTITION BY piece ORDER BY spot)),
counts AS ({" UNION ALL ".join(f"SELECT lang, {s} AS phrase, {k} AS size, count(*) AS f FROM places WHERE {s} IS NOT NULL GROUP BY ALL"
                               for k, s in enumerate(sizes, 1))})"""


@query(f"""
WITH {_counts_sql()},
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
found AS (SELECT *, string_split(phrase, ' ') AS words FROM counts WHERE size > 1 AND f >= 100),
inner_parts AS (SELECT lang, array_to_string(words[i:i + size - 2], ' ') AS phrase, max(f) AS longer
  FROM found, (VALUES (1), (2)) AS v(i) WHERE size > 2 GROUP BY ALL),
cuts AS (SELECT lang, phrase, f AS a, cut, array_to_string(words[:cut], ' ') AS before, array_to_string(words[cut + 1:], ' ') AS after
  FROM found ANTI JOIN (SELECT g.lang, g.phrase FROM found g JOIN inner_parts p USING (lang, phrase) WHERE p.longer >= g.f) AS covered USING (lang, phrase),
  (VALUES (1), (2), (3), (4)) AS v(cut) WHERE cut < size),
ways AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, cut, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = before JOIN counts y ON y.lang = c.lang AND y.phrase = after
  JOIN totals t ON t.lang = c.lang),
least AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM least QUALIFY rank <= 2000
""")
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best phrases of two to five words of each language."""
    return phrases.collocations(documents(spark, folder).select("lang", "text"))
