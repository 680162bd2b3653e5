"""Cleaning pipeline over ``documents``: quality rules, line dedup, SimHash near-dedup,
benchmark decontamination, SentencePiece encoding and decoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet to the shared checkpoint folder and reads them back for the next.
Rows with a null doc_id pass line dedup unchanged and come last in a group of near-duplicates;
null and blank texts end at the first stage; an empty table gives an empty result; extra columns
of any name are carried to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate, line_dedup, quality_lines, sentencepiece_codec, simhash
from shelfspark.llm.common import has_word, table
from shelfspark.session import scratch_path


def _with_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, ``n_chars`` following the text if there is one."""
    return df.select(*[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    other = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = quality_lines.judge(docs, keep=other).where("kept")
    return _with_text(kept.select("doc_id", F.col("clean_text").alias("text"), *[F.col(f"kept_{c}").alias(c) for c in other]),
                      docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents left without a word go."""
    found = line_dedup.dedup_lines(docs)
    *named, deleted = [f"c{i}" for i in range(len(found.columns))]  # docs may have a column of any name
    left = found.toDF(*named, deleted).where((F.col(deleted) == 0) | has_word(F.col(named[docs.columns.index("text")])))
    return _with_text(left.select(*named).toDF(*docs.columns), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id."""
    return simhash.one_of_each(docs, shingle=3, max_bits=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, checked by decoding them."""
    return sentencepiece_codec.round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("sentencepiece", tokenised),
]

#: SQL has no segmentation lattice and no bit-vote fingerprint; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
