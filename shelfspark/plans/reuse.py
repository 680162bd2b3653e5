"""Aggregate once, read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from shelfspark.session import ensure_checkpoint_dir, scratch_path


def materialize_small(df: DataFrame) -> DataFrame:
    """Write an aggregated table to the shared checkpoint folder and read it back.

    For small aggregated tables that an operator reads more than once (its main
    plan plus scalar subqueries): without this, each reader may recompute the
    aggregation from the fact table. The reliable checkpoint also cuts the
    lineage, so a lost executor does not trigger a rescan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write a table of any size as Parquet to the shared checkpoint folder and read it back.

    For row tables that are read several times: later readers scan only the columns they use.
    """
    path = scratch_path(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
