"""Shared Column rules for nulls, division, text and bands (traps S1-S20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b with null for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(col(a), col(b))


def flag(cond: Column) -> Column:
    """Boolean condition where null counts as false (pandas ``(x == v)`` semantics)."""
    return F.coalesce(cond, F.lit(False))


def share_true(cond: Column) -> Column:
    """Aggregate: fraction of rows where ``cond`` holds; null rows stay in the denominator."""
    return F.avg(flag(cond).cast("int"))


def pct_true(cond: Column) -> Column:
    """Aggregate: percentage of rows where ``cond`` holds (null counts as false)."""
    return F.try_divide(F.count_if(flag(cond)) * F.lit(100.0), F.count(F.lit(1)))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace including newlines."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def first_nonempty(*cols) -> Column:
    """``a or b or ''``: the first value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(""))


def band(c, cuts: list[float], labels: list[str]) -> Column:
    """Label by ascending strict upper cuts: x < cuts[0] -> labels[0], ..., else labels[-1]."""
    c = col(c)
    expr = None
    for cut, label in zip(cuts, labels):
        expr = F.when(c < cut, label) if expr is None else expr.when(c < cut, label)
    return expr.otherwise(labels[-1])


def money_decimal(c) -> Column:
    """A money term as DECIMAL(18,4) so that sums are exact and order independent."""
    return col(c).cast("decimal(18,4)")


def exact_sum(c) -> Column:
    """Aggregate: exact (decimal) sum of a money column, returned as double; 0 if all are null."""
    return F.coalesce(F.sum(money_decimal(c)), F.lit(0)).cast("double")


def unit_sum(c) -> Column:
    """Aggregate: sum of a whole-number column as bigint; 0 if all are null."""
    return F.coalesce(F.sum(col(c)), F.lit(0)).cast("bigint")


def names_where(cond: Column, key) -> Column:
    """Aggregate: the sorted keys for which ``cond`` holds, comma-joined ('' if none).

    For takeaways over one row per group; the text grows with the number of groups named.
    """
    return F.array_join(F.sort_array(F.collect_list(F.when(cond, col(key)))), ", ")


def best_key(value, key, highest: bool = True) -> Column:
    """Aggregate: the row with the highest (or lowest) value, ties to the smallest key.

    Returns a struct ``(v, k)``; ``v`` is negated for ``highest`` so a single
    ``min`` decides both value and tie-break. Runs as a partial + final aggregate.
    Keys whose value is null take no part; without any value the result is null.
    """
    v = col(value)
    return F.min(F.when(v.isNotNull(), F.struct((-v if highest else v).alias("v"), col(key).alias("k"))))


def unpack_best(s: Column, highest: bool = True) -> tuple[Column, Column]:
    """(key, value) columns of a ``best_key`` struct."""
    return s["k"], (-s["v"] if highest else s["v"])
