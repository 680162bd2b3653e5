"""Line-first quality rules: judge lines, drop the failures, reject what loses too much.

DataFrame functions only. All work on a text happens inside its own row: no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import words

SYMBOL = r"[#*$%&|<>]"
#: Runs of symbols or of shouting.
MARKS = r"[#*$%&<>!?]{2,}"
STOP = r"[.!?…:;,。！？؟।]"
SEPARATOR = r"[|»«›•·→]"
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "terms and conditions", "cookie",
    "cookies", "javascript", "lorem ipsum", "subscribe to", "sign in", "log in", "read more", "click here", "share this",
    "licensed under", "released under", "copyright (c)",
)
#: A phrase as words of their own: "log in" is not in "my blog in 2019".
BOILERPLATE_PATTERN = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in BOILERPLATE) + r")(?:[^\p{L}\p{N}]|$)"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the loss a document may take."""

    #: Runs of shouting or symbols per word from which a line fails.
    max_marks_per_word: float = 0.3
    #: Separators per word from which a line with at least ``min_separators`` is navigation.
    max_separators_per_word: float = 0.2
    min_separators: int = 2
    #: A line of at least so many words must hold some terminal mark.
    unpunctuated_words: int = 40
    #: Boilerplate phrases condemn lines of up to this many words only.
    boilerplate_words: int = 20
    #: Percentage of the text's word characters that may be lost.
    max_lost_percent: int = 30
    min_words: int = 50
    max_repeat_percent: int = 50


def _word_chars(word_array: Column) -> Column:
    return F.char_length(F.array_join(word_array, ""))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_facts(line: Column) -> Column:
    """What the rules look at, counted once per line."""
    return F.struct(line.alias("line"), _count(line, r"[^\x20\x09-\x0D]+").alias("n"), _count(line, MARKS).alias("marks"),
                    _count(line, SEPARATOR).alias("separators"))


def line_fails(fact: Column, rules: LineRules = LineRules()) -> Column:
    """True for a line with words that breaks the punctuation, navigation or boilerplate rule."""
    n, line = fact["n"], fact["line"]
    punctuation = (fact["marks"] > rules.max_marks_per_word * n) | (
        (n >= rules.unpunctuated_words) & ~line.rlike(STOP))
    navigation = (fact["separators"] >= rules.min_separators) & (
        fact["separators"] >= rules.max_separators_per_word * n)
    boilerplate = (n <= rules.boilerplate_words) & F.lower(line).rlike(BOILERPLATE_PATTERN)
    return (n > 0) & (punctuation | navigation | boilerplate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(),
          keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, counts, ``base_failed``, ``kept``, line counts, ``clean_text``.

    Lines are ``\\n``-split; lines without a word never fail and never count. ``clean_text``
    is the text without its failing lines (null for a null text). A document is kept if
    the base rules pass and the failing lines hold at most ``max_lost_percent`` of its
    word characters. Null, empty and blank texts have no words and fail the base rules.
    Every row is judged by itself: repeated rows get equal rows, null ids stay null.
    ``keep`` names further input columns to carry along; all others are not read.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    df = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"),
                     *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)])
    df = df.withColumns({"__words": words(F.col("__text")), "__lines": F.transform(F.split(text, "\n"), line_facts)})
    last = F.size("__words") - 3
    # a window's hash; two different windows of one text share 64 bits with odds of 1e-11 at 20,000 words
    df = df.withColumn("__win", F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(
            F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))))
    # only texts with a repeated window sort their windows; equal ones are then neighbours
    df = df.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__win")) < F.size("__win"),
        F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.col("__sorted")
    df = df.withColumn("__twice", F.sort_array(F.filter(F.transform(at, lambda x, k: F.when(
        (F.get(at, k - 1)["h"] == x["h"]) | (F.get(at, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())))
    covered = F.aggregate(
        "__twice", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + 3).alias("to"), (acc["n"] + i + 3 - F.greatest(acc["to"], i)).alias("n")),
        lambda acc: acc["n"])
    df = df.withColumn("__real", F.filter("__lines", lambda x: x["n"] > 0))
    df = df.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": _word_chars(F.col("__words")).cast("bigint"),
        "n_symbols": _count(text, SYMBOL).cast("bigint"),
        "n_dup_lines": (F.size("__real") - F.size(F.array_distinct(F.col("__real.line")))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        "__bad": F.filter("__real", lambda x: line_fails(x, rules)),
    })
    lost = F.aggregate("__bad", F.lit(0).cast("bigint"), lambda n, x: n + _word_chars(words(x["line"])))
    df = df.withColumns({
        "n_lines": F.size("__real").cast("bigint"),
        "n_failed_lines": F.size("__bad").cast("bigint"),
        "lost_chars": lost,
        "base_failed": (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
        "clean_text": F.when(F.size("__bad") == 0, F.col("__text")).otherwise(
            F.array_join(F.transform(F.filter("__lines", lambda x: ~line_fails(x, rules)), lambda x: x["line"]), "\n")),
    })
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= rules.max_lost_percent * F.col("word_chars"))
    row = F.struct(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   "base_failed", kept.alias("kept"), "n_lines", "n_failed_lines", "lost_chars", "clean_text",
                   *[F.col(f"__keep{i}").alias(f"kept_{c}") for i, c in enumerate(keep)])
    # a one-element explosion: a later filter on a verdict must not be pushed below the
    # array steps, where it would compute them anew for every element
    return df.select(F.inline(F.array(row)))


#: DuckDB text of ``judge`` with the default rules over ``documents``.
JUDGE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), E'\t\n\x0b\x0c\r', '     ') AS flat FROM documents
), w AS (
  SELECT *, list_filter(string_split(flat, ' '), lambda x: x <> '') AS ws, string_split(t, E'\n') AS ls FROM d
), r AS (
  SELECT *, row_number() OVER () AS rid,
    list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS real FROM w
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM r, unnest(range(1, len(ws) - 1)) AS u(i)
), twice AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid
), lines AS (
  SELECT rid, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
    len(regexp_extract_all(x, '[#*$%&<>!?]{2,}')) AS marks,
    len(regexp_extract_all(x, '[|»«›•·→]')) AS seps,
    len(regexp_extract_all(x, '[.!?…:;,。！？؟।]')) AS stops
  FROM r, unnest(real) AS u(x)
), bad AS (
  SELECT rid, count(*) AS n_failed, sum(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))) AS lost FROM lines
  WHERE marks > 0.3 * n OR (n >= 40 AND stops = 0) OR (seps >= 2 AND seps >= 0.2 * n) OR (n <= 20 AND regexp_matches(lower(x),
    '(?:^|[^\p{L}\p{N}])(?:all rights reserved|privacy policy|terms of use|terms of service|terms and conditions|cookie|cookies|javascript|lorem ipsum|subscribe to|sign in|log in|read more|click here|share this|licensed under|released under|copyright \(c\))(?:[^\p{L}\p{N}]|$)'))
  GROUP BY rid
), j AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(real) - len(list_distinct(real)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(real)::BIGINT AS n_lines, coalesce(n_failed, 0)::BIGINT AS n_failed_lines, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM r LEFT JOIN rep USING (rid) LEFT JOIN bad USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 30 * word_chars) AS kept,
  n_lines, n_failed_lines, lost_chars
FROM j
"""
