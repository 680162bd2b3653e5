"""Named queries over the driver's tables, each with an independent DuckDB oracle.

Every entry is ``(spark_fn, oracle_sql, rounded)``: ``spark_fn(spark, sf_dir)``
returns the operator's DataFrame; ``oracle_sql`` computes the same table in
plain SQL over the base tables (the catalogue is its first CTE); ``rounded``
lists double columns whose last bits depend on summation order (means, ratios,
fits). Both sides round those to ``DIGITS`` decimals. Money sums are exact on
both sides (DECIMAL(18,4) terms) and are not rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.sources.catalog import CATALOG_SQL, catalog_view

DIGITS = 6


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rounded: list[str] = field(default_factory=list)


REGISTRY: dict[str, Entry] = {}

PREP_SQL = """prep AS (
  SELECT *, coalesce(offer_type, 'No Offer') AS offer_filled,
         final_price * sold_quantity AS revenue,
         CAST(final_price * sold_quantity AS DECIMAL(18,4)) AS rev4
  FROM catalog
)"""


def with_catalog(body: str, prep: bool = True) -> str:
    """Oracle text: the catalogue CTE (and the prepared view), then ``body``.

    ``body`` may start with further CTEs as ``, name AS (...)`` lines.
    """
    head = f"WITH {CATALOG_SQL},\n{PREP_SQL}" if prep else f"WITH {CATALOG_SQL}"
    return f"{head}\n{body}"


def register(name: str, sql: str | None = None, rounded: list[str] | None = None):
    def deco(fn):
        REGISTRY[name] = Entry(fn, sql, list(rounded or []))
        return fn
    return deco


def cat(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return catalog_view(spark, sf_dir, cols)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    e = REGISTRY[name]
    df = e.fn(spark, sf_dir)
    if e.rounded:
        df = df.withColumns({c: F.round(F.col(c), DIGITS) for c in e.rounded})
    return df


def oracle(name: str) -> str | None:
    e = REGISTRY[name]
    if e.sql is None:
        return None
    if not e.rounded:
        return e.sql
    repl = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in e.rounded)
    return f"SELECT * REPLACE ({repl}) FROM (\n{e.sql}\n) AS q"


def load_all() -> dict[str, Entry]:
    # importing the query modules fills REGISTRY
    from shelfspark.plans import queries_catalog, queries_ml, queries_more  # noqa: F401
    return REGISTRY
