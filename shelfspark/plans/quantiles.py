"""Exact statistics of numeric columns that never hold a whole column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.plans.reuse import materialize_small, written
from shelfspark.plans.windows import running_sum


BUCKETS = 4096


def numeric_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, count, mean, std, min, max)`` from one plain aggregate; nulls and NaN skipped."""
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(x[c]).alias(f"_n{i}"), F.avg(x[c]).alias(f"_m{i}"), F.stddev_samp(x[c]).alias(f"_s{i}"),
        F.min(x[c]).alias(f"_lo{i}"), F.max(x[c]).alias(f"_hi{i}"))])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("count"), F.col(f"_m{i}").alias("mean"),
                 F.col(f"_s{i}").alias("std"), F.col(f"_lo{i}").alias("min"), F.col(f"_hi{i}").alias("max"))
        for i, c in enumerate(cols)]))).where("count > 0")


def bucket_quantiles(df: DataFrame, bounds: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(column, prob, value)``: exact interpolated quantiles by bucket refinement.

    A histogram of ``BUCKETS`` equal-width buckets per column (at most columns x BUCKETS rows
    from each task) tells which buckets hold the wanted ranks; only the values of those
    buckets are counted, shuffled and ranked. ``df`` is read twice, so write it before if
    it is a join. ``bounds``: ``numeric_bounds``, one row per column, read into the plan. A
    bucket is named by one integer, column number x BUCKETS + bucket.
    """
    known = [r for r in bounds.select("column", "min", "max").collect() if r["column"] in cols]  # one row per column
    if not known:
        return bounds.select("column", F.lit(0.0).alias("prob"), F.lit(0.0).alias("value")).limit(0)

    def cell(i: int, column: str, lo: float, hi: float) -> Column:
        v = F.col(column).cast("double")
        # a constant column, or an infinite bound: one bucket
        share = F.lit(0.0) if lo == hi else F.nanvl((v - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0))
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        return F.struct(F.when(v.isNotNull() & ~F.isnan(v), bucket + i * BUCKETS).alias("bucket"), v.alias("value"))

    long = df.select(F.inline(F.array(*[cell(i, *r) for i, r in enumerate(known)]))).where("bucket IS NOT NULL")
    column = F.array(*[F.lit(r["column"]) for r in known])[F.floor(F.col("bucket") / BUCKETS).cast("int")]
    hist = materialize_small(long.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("column", column))
    up_to = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("before", F.sum("n").over(up_to) - F.col("n"))  # at most BUCKETS rows per column
    rank = F.col("prob") * (F.col("count") - 1)
    wanted = (bounds.select("column", "count", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
              .select("column", "prob", rank.alias("pos"), F.explode(F.array(F.floor(rank), F.ceil(rank))).alias("rank")))
    places = materialize_small(wanted.join(hist, "column").where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
                               .select("column", "bucket", "before", "prob", "pos", "rank").distinct())
    targets = F.broadcast(places.select("bucket").distinct())  # two per column and probability at most
    counts = long.join(targets, "bucket").groupBy("bucket", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(counts, "n", [F.col("value").asc()], partition=["bucket"], out="upto")
    low = F.col("before") + F.col("upto") - F.col("n")
    found = (ranked.join(F.broadcast(places), "bucket").where((low <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("upto"))))
    both = found.groupBy("column", "prob", "pos").agg(F.min_by("value", "rank").alias("v_lo"), F.max_by("value", "rank").alias("v_hi"))
    return both.select("column", "prob", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("pos") - F.floor("pos"))).alias("value"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(column, prob, value)``: exact interpolated quantiles of each column, nulls skipped."""
    narrow = written(df.select(*cols))
    return bucket_quantiles(narrow, materialize_small(numeric_bounds(narrow, cols)), cols, probs)
