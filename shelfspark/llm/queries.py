"""Registered queries of the corpus operators, and their DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import byte_cnn, decontaminate, hard_negatives, language_id, line_dedup, quality_lines, quotes, secrets_scan, sentencepiece_codec, sharding, simhash, turn_repair, url_filter
from shelfspark.llm.common import table
from shelfspark.plans.windows import next_row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@_query
def op9_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)


@_query
def op8_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.judge(table(spark, sf_dir, "documents")).drop("clean_text")


ORACLES["op8_line_first_quality"] = quality_lines.JUDGE_SQL


@_query
def op10_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"))


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op4_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


@_query
def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parent_turn`` is -1 without a resolved quote."""
    return quotes.link_quotes(table(spark, sf_dir, "conversations")).fillna(-1, ["parent_turn"])


@_query
def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking on messages that quote the turn before them, derived from ``conversations``."""
    chat = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chat = next_row(chat.withColumn("back", -F.col("turn")), ["conv_id"], "back", ["text"])  # the turn before
    before = F.col("next_text")
    quote = F.regexp_replace(F.concat(F.lit("\n"), before), "\n", "\n> ")
    threads = quotes.link_quotes(chat.withColumn("text", F.when(before.isNotNull(), F.concat(F.lit("On Monday, they wrote:"), quote, F.lit("\n\n"), "text"))
                                              .otherwise(F.col("text"))))
    return threads.fillna(-1, ["parent_turn"])


@_query
def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking on partial, re-wrapped and nested quotes: of each four turns of ``conversations``
    the second quotes the whole first, the third one sentence of the first over two lines, the
    fourth one sentence of the second, with one of the first quoted in it."""
    said = lambda back: F.concat(F.lit("Point "), F.col("turn") - back, F.lit(" of this talk."))
    chat = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(said(0), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    chat = next_row(chat.withColumn("back", -F.col("turn")), ["conv_id"], "back", ["text"])
    kind = F.col("turn") % 4
    quote = (F.when(kind == 1, F.regexp_replace(F.concat(F.lit("\n"), "next_text"), "\n", "\n> "))
             .when(kind == 2, F.concat(F.lit("> "), F.replace(said(2), F.lit("of "), F.lit("of\n> "))))
             .when(kind == 3, F.concat(F.lit("> > "), said(3), F.lit("\n> "), said(2))))
    threads = quotes.link_quotes(chat.withColumn("text", F.concat(F.coalesce(quote, F.lit("")), F.lit("\n\n"), "text")))
    return threads.fillna(-1, ["parent_turn"])


_OWN = r"regexp_replace(text, '^[\x20\t\n\x0b\f\r]+|[\x20\t\n\x0b\f\r]+$', '', 'g')"
ORACLES["op6_quotation_linking"] = f"""
SELECT conv_id, turn, role, {_OWN} AS body, -1::BIGINT AS parent_turn, turn AS root_turn, 0::BIGINT AS depth,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position
FROM conversations
"""
ORACLES["quoted_replies"] = f"""
SELECT conv_id, turn, role, {_OWN} AS body, coalesce(lag(turn) OVER w, -1) AS parent_turn, first_value(turn) OVER w AS root_turn,
  row_number() OVER w - 1 AS depth, row_number() OVER w AS position
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
"""
ORACLES["quoted_threads"] = f"""
SELECT conv_id, turn, role, {_OWN} AS body, CASE turn % 4 WHEN 0 THEN -1 WHEN 1 THEN turn - 1 ELSE turn - 2 END::BIGINT AS parent_turn,
  (turn - turn % 4)::BIGINT AS root_turn, CASE turn % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END::BIGINT AS depth,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn // 4, CASE turn % 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE turn % 4 END) AS position
FROM (SELECT conv_id, turn, role, 'Point ' || turn || ' of this talk. ' || coalesce(text, '') AS text FROM conversations)
"""


def damaged_conversations(chat: DataFrame) -> DataFrame:
    """The damage that op13's contract deals out; ``present`` is false for dropped rows."""
    clean = chat.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(kind != 0, F.when(kind == 3, 2).otherwise(1))
    return clean.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("present"))


@_query
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(damaged_conversations(table(spark, sf_dir, "conversations")), present="present")


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


ORACLES["op12_hard_negatives"] = hard_negatives.MINE_SQL


@_query
def op11_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
