"""B: profiling of a catalogue DataFrame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.features import RATING_CUT, high_rating
from shelfspark.plans.quantiles import bucket_quantiles, numeric_bounds
from shelfspark.plans.reuse import materialize_small, written

QUARTILES = (0.25, 0.5, 0.75)


def _numeric(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    if cols is not None:
        return list(cols)
    num = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num)]


def _long(row_df: DataFrame, items: list) -> DataFrame:
    """One row of aggregates -> one row per item (``inline`` of an array of structs)."""
    return row_df.select(F.inline(F.array(*items)))


def preview(df: DataFrame, n: int = 5, key: str = "product_id") -> DataFrame:
    """B1: first ``n`` rows in key order (a distributed top-n)."""
    return df.orderBy(F.col(key).asc()).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """B2: row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def schema_profile(df: DataFrame) -> DataFrame:
    """Position, column, type and non-null count of every column (one aggregate pass)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    items = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                      F.lit(t).alias("dtype"), F.col(f"_n{i}").alias("non_null"))
             for i, (c, t) in enumerate(df.dtypes)]
    return _long(counts, items)


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column (NaN is not null, as in Spark)."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    items = [F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n_null"))
             for i, c in enumerate(df.columns)]
    return _long(counts, items)


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
                     accuracy: int = 10000) -> DataFrame:
    """Count, mean, sample std, min, interpolated quartiles, max per numeric column
    (nulls and NaN skipped).

    Exact (default): the numeric columns are written once (the input is usually a join);
    one plain aggregate gives the moments, and the quartiles come from bucket refinement
    (``plans.quantiles``), which shuffles only the values of the few buckets that hold them.
    ``approx=True`` uses one aggregation with ``percentile_approx`` (rank error about
    1 / ``accuracy``) instead.
    """
    cols = _numeric(df, cols)
    if approx:
        clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
        row = df.agg(*[e for i, c in enumerate(cols) for e in (
            F.count(clean[c]).alias(f"_c{i}"), F.avg(clean[c]).alias(f"_m{i}"),
            F.stddev_samp(clean[c]).alias(f"_s{i}"), F.min(clean[c]).alias(f"_lo{i}"),
            F.max(clean[c]).alias(f"_hi{i}"),
            F.percentile_approx(clean[c], list(QUARTILES), accuracy).alias(f"_q{i}"))])
        return _long(row, [F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("count"),
                                    F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std"),
                                    F.col(f"_lo{i}").alias("min"), F.col(f"_q{i}")[0].alias("q25"),
                                    F.col(f"_q{i}")[1].alias("q50"), F.col(f"_q{i}")[2].alias("q75"),
                                    F.col(f"_hi{i}").alias("max")) for i, c in enumerate(cols)])
    narrow = written(df.select(*cols))
    bounds = materialize_small(numeric_bounds(narrow, cols))
    q = bucket_quantiles(narrow, bounds, cols, QUARTILES)
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
                                   for p, name in zip(QUARTILES, ("q25", "q50", "q75"))])
    return (bounds.join(qw, "column", "left")
            .select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


def class_distribution(df: DataFrame, cut: float = RATING_CUT) -> DataFrame:
    """Rows per label (rating >= cut; null rating -> 0) and their percentage."""
    g = df.groupBy(high_rating(cut).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n")).scalar()
    return g.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram with all ``bins`` bins (empty ones count 0).

    bin = least(floor((x - min) / width), bins - 1); the maximum falls in the last
    bin; a constant column puts every value in bin 0.
    """
    x = F.col(col).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    b = vals.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    width = (b["hi"] - b["lo"]) / F.lit(bins)
    idx = F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - b["lo"], width)), F.lit(bins - 1)), F.lit(0))
    counts = vals.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(counts, "bin", "left")
            .select("bin", (b["lo"] + F.col("bin") * width).alias("bin_lo"),
                    F.when(F.col("bin") == bins - 1, b["hi"]).otherwise(b["lo"] + (F.col("bin") + 1) * width)
                    .alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def auto_bins(df: DataFrame, col: str) -> int:
    """Number of bins when none is given: the larger count of two usual rules.

    Widths 2 * IQR / n^(1/3) (exact quartiles, distributed; left out when the IQR is 0) and
    range / (log2(n) + 1); the narrower one is taken, but no less than 1 for a column of integers.
    An empty or constant column has one bin.
    """
    whole = df.schema[col].dataType.typeName() in ("byte", "short", "integer", "long")
    narrow = written(df.select(F.col(col).cast("double").alias("x")))
    bounds = materialize_small(numeric_bounds(narrow, ["x"]))
    b = bounds.first()
    if b is None or b["max"] == b["min"]:
        return 1
    q = {r["prob"]: r["value"] for r in bucket_quantiles(narrow, bounds, ["x"], [0.25, 0.75]).collect()}
    span, n = b["max"] - b["min"], b["count"]
    if not math.isfinite(span):
        raise ValueError(f"{col} has infinite values: no bin width")
    width = span / (math.log2(n) + 1)
    spread = 2 * (q[0.75] - q[0.25]) / n ** (1 / 3)
    width = min(width, spread) if spread > 0 else width
    return max(1, math.ceil(span / max(width, 1.0 if whole else 0.0)))


def auto_histogram(df: DataFrame, col: str) -> DataFrame:
    """Equal-width histogram with ``auto_bins`` bins. An empty column gives one empty bin."""
    return histogram(df, col, auto_bins(df, col))


def value_span(df: DataFrame, col: str) -> DataFrame:
    """Minimum and maximum of a column."""
    return df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)
