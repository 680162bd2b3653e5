"""F: the ad hoc questions the reference answered with generated pandas, as operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.common import best_key, exact_sum, unit_sum, unpack_best
from shelfspark.functions.features import offer_filled, revenue
from shelfspark.plans.reuse import materialize_small


def delayed_share_by(df: DataFrame, dim: str = "seller", single_pass: bool = False) -> DataFrame:
    """total and delayed rows per group and the delayed percentage.

    The default is the reference's form: two aggregates and a left equi-join on the
    group key (both sides are already aggregated, so the join is over one row per
    key); ``single_pass`` gives the same table from one conditional aggregate.
    """
    base = df.where(F.col(dim).isNotNull())
    if single_pass:
        t = base.groupBy(dim).agg(F.count(F.lit(1)).alias("total_orders"),
                                  F.count_if(F.col("delivery_status") == "Delayed").alias("delayed_orders"))
    else:
        total = base.groupBy(dim).agg(F.count(F.lit(1)).alias("total_orders"))
        delayed = (base.where(F.col("delivery_status") == "Delayed")
                   .groupBy(dim).agg(F.count(F.lit(1)).alias("delayed_orders")))
        t = (total.join(delayed, dim, "left")
             .select(dim, "total_orders", F.coalesce("delayed_orders", F.lit(0)).cast("bigint").alias("delayed_orders")))
    return t.withColumn("delayed_pct", F.col("delayed_orders") / F.col("total_orders") * 100)


def unit_cells(df: DataFrame, *keys: str, measure: str = "sold_quantity") -> DataFrame:
    """Totals of ``measure`` per key combination, written once (``materialize_small``).

    Questions that first find a leading key and then look inside it (F2, F4) run on
    these cells, so the catalogue is scanned once instead of once per step.
    """
    return materialize_small(df.groupBy(*keys).agg(unit_sum(measure).alias(measure)))


def leader(df: DataFrame, dim: str, measure: str = "sold_quantity"):
    """Scalar struct ``(v, k)`` of the ``dim`` key with the largest ``measure`` total
    (see ``best_key``); usable in any expression as a scalar subquery."""
    return (df.where(F.col(dim).isNotNull()).groupBy(dim).agg(unit_sum(measure).alias("m"))
            .agg(best_key("m", dim, True).alias("b")).select("b").scalar())


def leader_then_leader(df: DataFrame, outer: str = "city", inner: str = "category",
                       measure: str = "sold_quantity") -> DataFrame:
    """the ``outer`` key with the largest total, then its leading ``inner`` key."""
    lead_key, lead_val = unpack_best(leader(df, outer, measure), True)
    i = (df.where(F.col(outer) == lead_key).where(F.col(inner).isNotNull())
         .groupBy(inner).agg(unit_sum(measure).alias("m"))
         .agg(best_key("m", inner, True).alias("b")))
    ik, iv = unpack_best(F.col("b"), True)
    return i.select(lead_key.alias(outer), lead_val.cast("bigint").alias(f"{outer}_{measure}"),
                    ik.alias(inner), iv.cast("bigint").alias(f"{inner}_{measure}"))


def units_by_offer(df: DataFrame, fill: bool = True) -> DataFrame:
    """units per offer type (missing offers -> 'No Offer' unless ``fill`` is off,
    then they are dropped) with the leading offer flagged."""
    base = df.withColumn("offer_type", offer_filled()) if fill else df.where(F.col("offer_type").isNotNull())
    t = base.groupBy("offer_type").agg(unit_sum("sold_quantity").alias("units"))
    lead = t.agg(best_key("units", "offer_type", True).alias("b")).select("b.k").scalar()
    return t.withColumn("is_leader", F.col("offer_type") == lead)


def daily_units(df: DataFrame, city) -> DataFrame:
    """units per ``date_added`` for one city (a name, or a scalar Column)."""
    c = city if not isinstance(city, str) else F.lit(city)
    return (df.where((F.col("city") == c) & F.col("date_added").isNotNull())
            .groupBy("date_added").agg(unit_sum("sold_quantity").alias("units")))


def top_revenue(df: DataFrame, dim: str = "seller") -> DataFrame:
    """the key with the highest revenue."""
    r = (df.where(F.col(dim).isNotNull()).groupBy(dim).agg(exact_sum(revenue()).alias("revenue"))
         .agg(best_key("revenue", dim, True).alias("b")))
    k, v = unpack_best(F.col("b"), True)
    return r.select(k.alias(dim), v.alias("revenue"))


def total_revenue(df: DataFrame) -> DataFrame:
    """total revenue (exact)."""
    return df.agg(exact_sum(revenue()).alias("total_revenue"))


def top_margin(df: DataFrame, dim: str = "category") -> DataFrame:
    """the key with the highest mean profit margin."""
    r = (df.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.avg("profit_margin_pct").alias("m"))
         .agg(best_key("m", dim, True).alias("b")))
    k, v = unpack_best(F.col("b"), True)
    return r.select(k.alias(dim), v.alias("avg_margin"))


def top_products(df: DataFrame, n: int = 10, measure: str = "sold_quantity", key: str = "product_id") -> DataFrame:
    """F8: top ``n`` rows by ``measure`` (ties to the smaller key): a distributed top-n."""
    return df.orderBy(F.col(measure).desc(), F.col(key).asc()).limit(n)


def units_by(df: DataFrame, dim: str = "city") -> DataFrame:
    """units per key."""
    return (df.where(F.col(dim).isNotNull()).groupBy(dim)
            .agg(unit_sum("sold_quantity").alias("units")))
