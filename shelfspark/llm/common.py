"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import ensure_checkpoint_dir

#: The white space that separates words: U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pinned(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """Words of a text (runs of anything but ``WHITE``); null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20,
           max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` per piece (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column).cast(pa.binary())]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
