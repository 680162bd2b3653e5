"""Dense two-way grids: every row key x every column key, missing cells filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.plans.reuse import materialize_small

def complete_grid(cells: DataFrame, row: str, col: str, value: str, fill=0) -> DataFrame:
    """Long form grid from aggregated ``cells`` (one row per existing (row, col) pair).

    The column domain is one array built by a partial+final ``collect_set``
    (bounded by the number of distinct column keys, like a pivot's value list),
    attached to each row key as a scalar subquery and exploded; existing cells
    are joined back and absent ones get ``fill``.
    """
    domain = cells.select(F.sort_array(F.collect_set(col)).alias("d")).scalar()
    keys = cells.select(row).distinct().select(row, F.explode(domain).alias(col))
    vtype = cells.schema[value].dataType
    return (keys.join(cells, [row, col], "left")
            .select(row, col, F.coalesce(F.col(value), F.lit(fill).cast(vtype)).alias(value)))


def wide_grid(df: DataFrame, row: str, col: str, agg: Column, fill=0) -> DataFrame:
    """Wide (display) form: one column per value of ``col``, missing cells = ``fill``.

    The cells are aggregated once and written (``materialize_small``); the pivot's
    value list and the pivot itself both read those cells, so the input is scanned
    once. The list is the output's own columns: use ``complete_grid`` for a domain
    that is no display's.
    """
    cells = materialize_small(df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
                              .groupBy(row, col).agg(agg.alias("_cell")))
    values = [r[0] for r in cells.select(col).distinct().orderBy(col).collect()]
    wide = cells.groupBy(row).pivot(col, values).agg(F.first("_cell"))  # one cell per (row, col)
    return wide.fillna(fill, subset=[str(v) for v in values]).orderBy(row)
