"""Quality rules: line-first cleaning with DataFrame functions only.

Every line is judged by itself (terminal punctuation, navigation, boilerplate, shouting, symbols); failing lines
go, and a document that loses too much of its text is rejected, as is one that fails the base rules.

Defined cases: a null text is the empty text; it has no words and so fails the base rules. Blank lines are neither
judged nor counted as lost. Repeated rows are judged one by one. Every input column stays; a column of the input
that has the name of a result column is replaced by the result (the cleaned text goes to `clean_text`).
An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerview.llm.common import WORD_GAP

#: Fixed values of the base rules.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Rules for lines.
MAX_SYMBOL_SHARE, MIN_UPPER, MAX_UPPER_SHARE, LONG_LINE_WORDS = 0.2, 12, 0.6, 12
NAVIGATION, NO_SYMBOLS = r"\|[^|]*\|[^|]*\|", r"[^#*$%&|<>]+"
BOILERPLATE = r"(?i)cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|lorem ipsum|click here|sign up for|subscribe to our"
TERMINAL = r"[.!?…:;\"'”»)\]]\s*$"
#: A document goes if more than this share of its word characters stood in failing lines.
MAX_LOST_SHARE = 0.5


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column) -> Column:
    """True for a line that the rules remove; blank lines never fail."""
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    words = F.size(F.split(F.trim(line), WORD_GAP))
    symbols = F.length(F.regexp_replace(line, NO_SYMBOLS, "")) > MAX_SYMBOL_SHARE * F.length(line)
    shouting = (upper >= MIN_UPPER) & (upper > MAX_UPPER_SHARE * letters)
    unpunctuated = ~line.rlike(TERMINAL) & line.rlike(r"[^\x20\x09-\x0D]") & (words < LONG_LINE_WORDS)
    return line.rlike(NAVIGATION) | symbols | line.rlike(BOILERPLATE) | shouting | unpunctuated


def _repeat_words(hashes: Column, ordered: Column) -> Column:
    """Words covered by windows that occur twice or more; ordered: (hash, position) pairs in order."""
    repeated = F.filter(ordered, lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)))
    at = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).cast("int").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(at, start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")), lambda s: s["n"])


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_share, clean_text."""
    t = F.col("__t")
    out = df.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn("__w", F.filter(F.split(t, WORD_GAP), lambda w: w != "")).withColumn("__l", F.split(t, "\n"))
    w = F.col("__w")
    out = out.withColumn("n_words", F.size(w).cast("long"))
    first = F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(first, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))
    out = out.withColumn("__h", F.when(F.size(w) >= WINDOW, windows))
    h = F.col("__h")
    out = out.withColumn("__o", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    filled = F.filter(F.col("__l"), lambda x: F.translate(x, SPACES, "") != "")
    out = out.withColumn("__f", filled).withColumn("__k", F.filter(F.col("__l"), lambda x: ~line_fails(x)))
    kept_text = F.array_join(F.col("__k"), "\n")
    out = (
        out.withColumn("word_chars", F.length(F.translate(t, SPACES, "")).cast("long"))
        .withColumn("n_symbols", _count(t, SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", (F.size(F.col("__f")) - F.size(F.array_distinct(F.col("__f")))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("__o").isNull(), F.lit(0).cast("long")).otherwise(_repeat_words(h, F.col("__o"))))
        .withColumn("clean_text", kept_text)
    )
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    lost = F.col("word_chars") - F.length(F.translate(F.col("clean_text"), SPACES, ""))
    some = (F.col("word_chars") > 0) & (F.size("__k") < F.size("__l"))
    out = out.withColumn("lost_share", F.when(some, lost / F.col("word_chars")).otherwise(F.lit(0.0)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= MAX_LOST_SHARE))
    return out.drop("__t", "__w", "__l", "__h", "__o", "__f", "__k")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judge(docs)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, "base_failed", "kept", F.round("lost_share", 6).alias("lost_share"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, the others lose their failing lines."""
    row = F.struct(*docs.columns).alias("__row")  # so that columns with the names of results keep their values
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    kept = F.struct(*(new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns))
    # inline() instead of a filter: a predicate would be pushed down and its whole derivation repeated inside it
    return judge(docs.select(row, "text")).select(F.inline(F.when(F.col("kept"), F.array(kept))))


#: DuckDB SQL for query()'s rows.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l FROM d),
win AS (SELECT k, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS n FROM win) WHERE n > 1),
covered AS (SELECT k, sum(least({WINDOW}, i - coalesce(before, i - {WINDOW}))) AS n FROM
  (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM twice) GROUP BY k),
lines AS (SELECT *, list_filter(l, lambda x: NOT (
  regexp_matches(x, '{NAVIGATION}') OR length(regexp_replace(x, '{NO_SYMBOLS}', '', 'g')) > {MAX_SYMBOL_SHARE} * length(x)
  OR regexp_matches(x, '{BOILERPLATE}')
  OR (length(regexp_replace(x, '\P{{Lu}}+', '', 'g')) >= {MIN_UPPER} AND length(regexp_replace(x, '\P{{Lu}}+', '', 'g')) > {MAX_UPPER_SHARE} * length(regexp_replace(x, '\P{{L}}+', '', 'g')))
  OR (NOT regexp_matches(x, '{TERMINAL.replace("'", "''")}') AND regexp_matches(x, '[^\x20\x09-\x0D]') AND len(string_split_regex(trim(x), '[\x20\x09-\x0D]+')) < {LONG_LINE_WORDS}))) AS good FROM w),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '{NO_SYMBOLS}', '', 'g'))::BIGINT AS n_symbols,
  (len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(array_to_string(good, chr(10)), '[\x20\x09-\x0D]+', '', 'g')) AS good_chars
  FROM lines LEFT JOIN covered USING (k)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN (word_chars - good_chars) / word_chars ELSE 0 END AS lost FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {MAX_LOST_SHARE} AS kept, round(lost, 6) AS lost_share FROM v
"""
