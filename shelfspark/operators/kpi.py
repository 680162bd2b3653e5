"""D: headline KPIs of the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.common import best_key, exact_sum, money_decimal, pct_true, unit_sum, unpack_best
from shelfspark.functions.features import offer_filled, revenue


def prepare(df: DataFrame) -> DataFrame:
    """Fill missing offers and add ``revenue`` (whichever inputs are present)."""
    out = df
    if "offer_type" in df.columns:
        out = out.withColumn("offer_type", offer_filled())
    if {"final_price", "sold_quantity"} <= set(df.columns):
        out = out.withColumn("revenue", revenue())
    return out


def kpi_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct categories, cities, sellers, brands (nulls not counted) and listings."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(
        distinct("category").alias("n_categories"),
        distinct("city").alias("n_cities"),
        distinct("seller").alias("n_sellers"),
        distinct("brand").alias("n_brands"),
        F.count(F.lit(1)).alias("n_products"),
    )


def kpi_totals(df: DataFrame) -> DataFrame:
    """Total revenue and units, mean rating, on-time share and its complement."""
    on_time = pct_true(F.col("delivery_status") == "On-Time")
    return df.agg(
        exact_sum(revenue()).alias("total_revenue"),
        unit_sum("sold_quantity").alias("total_units"),
        F.avg("rating").alias("avg_rating"),
        on_time.alias("on_time_pct"),
    ).withColumn("delayed_pct", F.lit(100.0) - F.col("on_time_pct"))


def kpi_extremes(df: DataFrame, dims: Sequence[str] = ("city", "seller")) -> DataFrame:
    """D3: per dimension, the top and bottom key by revenue (null keys dropped, ties to
    the smaller key).

    One scan: GROUPING SETS ((city), (seller), ...) sums revenue per key of every
    dimension in a single aggregation (rows are expanded once per set before the
    partial aggregate), then one aggregate picks the extremes per dimension.
    """
    dims = list(dims)
    rev = F.coalesce(F.sum(money_decimal(revenue())), F.lit(0)).alias("_rev")
    g = df.groupingSets([[d] for d in dims], *dims).agg(rev, *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    which = None
    key = None
    for d in dims:
        own = F.col(f"_g_{d}") == 0
        which = F.when(own, F.lit(d)) if which is None else which.when(own, F.lit(d))
        key = F.when(own, F.col(d)) if key is None else key.when(own, F.col(d))
    long = (g.select(which.alias("dimension"), key.cast("string").alias("k"),
                     F.col("_rev").cast("double").alias("revenue"))
            .where(F.col("k").isNotNull()))
    r = long.groupBy("dimension").agg(best_key("revenue", "k", True).alias("t"),
                                      best_key("revenue", "k", False).alias("b"))
    top_name, top_rev = unpack_best(F.col("t"), True)
    bot_name, bot_rev = unpack_best(F.col("b"), False)
    return r.select("dimension", top_name.alias("top_name"), top_rev.alias("top_revenue"),
                    bot_name.alias("bottom_name"), bot_rev.alias("bottom_revenue"))


def revenue_extremes(df: DataFrame, dim: str) -> DataFrame:
    """Highest and lowest ``dim`` by revenue (one dimension of ``kpi_extremes``)."""
    return kpi_extremes(df, [dim])


def name_list(df: DataFrame, col: str, n: int = 9) -> DataFrame:
    """The first ``n`` sorted distinct names and how many are left over.

    Only ``n`` names ever reach one task (a distributed top-n); the total is a
    distinct count.
    """
    names = df.where(F.col(col).isNotNull()).select(col).distinct()
    total = names.agg(F.count(F.lit(1))).scalar()
    shown = names.orderBy(col).limit(n)
    return shown.agg(
        F.array_join(F.sort_array(F.collect_list(col)), ", ").alias("names"),
        F.count(F.lit(1)).alias("n_shown"),
    ).select(F.lit(col).alias("dimension"), "names", "n_shown",
             F.greatest(total - F.lit(n), F.lit(0)).cast("bigint").alias("n_more"))
