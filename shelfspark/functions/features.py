"""Engineered catalogue columns (C1-C25). Each returns a Column over catalogue names."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.common import col, flag, safe_div

# Fixed values of the reference's feature definitions.
NO_OFFER = "No Offer"
REFERENCE_DATE = "2023-01-01"
RATING_CUT = 3.8
INVENTORY_EPS = 0.01


def offer_filled(c="offer_type") -> Column:
    """Missing offer -> 'No Offer'."""
    return F.coalesce(col(c), F.lit(NO_OFFER))


def parsed_date(c) -> Column:
    """Date text -> timestamp (already-typed timestamps pass through)."""
    c = col(c)
    return F.coalesce(c.try_cast("timestamp_ntz"), F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz"))


def in_date_range(start=None, end=None, c="date_added") -> Column:
    """C4: date of ``c`` between ``start`` and ``end`` (both inclusive; either may be None)."""
    d = F.to_date(col(c))
    cond = F.lit(True)
    if start is not None:
        cond = cond & (d >= F.lit(str(start)).cast("date"))
    if end is not None:
        cond = cond & (d <= F.lit(str(end)).cast("date"))
    return cond


def revenue() -> Column:
    """final_price * sold_quantity."""
    return F.col("final_price") * F.col("sold_quantity")


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (_dt.date, _dt.datetime)):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def whole_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods from ``start`` to ``end``, floored (pandas ``.dt.days``).

    Calendar ``datediff`` would count midnights instead; seconds are exact and,
    on timestamp_ntz, independent of the session time zone.
    """
    return F.floor(F.timestamp_diff("SECOND", start, end) / F.lit(86400)).cast("int")


def days_to_expiry() -> Column:
    """Floor days from date_added to expiry_date."""
    return whole_days(F.col("date_added"), F.col("expiry_date"))


def days_since_added(ref_date=REFERENCE_DATE) -> Column:
    """Floor days from the reference date to date_added."""
    return whole_days(_ts(ref_date), F.col("date_added"))


def month_added() -> Column:
    """Calendar month 1-12 of date_added."""
    return F.month("date_added")


def sell_through_rate() -> Column:
    """Sold / (sold + stock + 1)."""
    return safe_div(F.col("sold_quantity"), F.col("sold_quantity") + F.col("stock") + 1)


def stock_pressure() -> Column:
    """Stock / (reorder_level + 1)."""
    return safe_div(F.col("stock"), F.col("reorder_level") + 1)


def revenue_proxy() -> Column:
    """final_price * sold_quantity."""
    return revenue()


def discount_amount() -> Column:
    """C11: price - final_price."""
    return F.col("price") - F.col("final_price")


def price_per_gram() -> Column:
    """final_price / (weight_g + 1)."""
    return safe_div(F.col("final_price"), F.col("weight_g") + 1)


def is_delayed() -> Column:
    """1 when delivery_status is 'Delayed', else 0 (null -> 0)."""
    return flag(F.col("delivery_status") == "Delayed").cast("int")


def demand_x_reviews() -> Column:
    """C14."""
    return F.col("demand_index") * F.col("num_reviews")


def popularity_score() -> Column:
    """demand_index * sell_through_rate."""
    return F.col("demand_index") * sell_through_rate()


def delivery_score() -> Column:
    """(1 - is_delayed) / (delivery_time_min + 1) * 100."""
    return safe_div(F.lit(1) - is_delayed(), F.col("delivery_time_min") + 1) * 100


def value_score() -> Column:
    """C17: sold / (final_price + 1)."""
    return safe_div(F.col("sold_quantity"), F.col("final_price") + 1)


def margin_efficiency() -> Column:
    """profit_margin_pct * sell_through_rate / 100."""
    return F.col("profit_margin_pct") * sell_through_rate() / 100


def discount_effectiveness() -> Column:
    """discount_amount * sell_through_rate."""
    return discount_amount() * sell_through_rate()


def review_density(ref_date=REFERENCE_DATE) -> Column:
    """C20: num_reviews / (days_since_added + 1) * 100; null on a zero divisor."""
    return safe_div(F.col("num_reviews"), days_since_added(ref_date) + 1) * 100


def freshness_score() -> Column:
    """days_to_expiry / (shelf_life_days + 1)."""
    return safe_div(days_to_expiry(), F.col("shelf_life_days") + 1)


def inventory_health() -> Column:
    """sell_through_rate / (stock_pressure + 0.01)."""
    return safe_div(sell_through_rate(), stock_pressure() + INVENTORY_EPS)


def is_organic_int() -> Column:
    """C23."""
    return F.col("is_organic").cast("int")


def high_rating(cut: float = RATING_CUT) -> Column:
    """Label rating >= cut; a null rating is 0."""
    return flag(F.col("rating") >= cut).cast("int")


def scenario_price(price="price", discount_pct="discount_pct") -> Column:
    """Price * (1 - discount_pct / 100)."""
    return col(price) * (F.lit(1) - col(discount_pct) / 100)
