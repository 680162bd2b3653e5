"""Training feature tables, serve-time scenario features, request conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import features as C
from shelfspark.functions.common import safe_div
from shelfspark.schemas import (
    CATEGORICAL, POST_CATEGORICAL, POST_CONTRACT, POST_NUMERIC, PRE_CONTRACT, PRE_NUMERIC,
)


def _base(df: DataFrame, ref_date) -> dict[str, Column]:
    return {
        "offer_type": C.offer_filled(),
        "days_to_expiry": C.days_to_expiry(),
        "days_since_added": C.days_since_added(ref_date),
        "month_added": C.month_added(),
        "price_per_gram": C.price_per_gram(),
        "discount_amount": C.discount_amount(),
        "freshness_score": C.freshness_score(),
    }


def engineer_pre_launch(df: DataFrame, ref_date=C.REFERENCE_DATE, keep=("product_id",),
                        label: bool = True) -> DataFrame:
    """6 categorical + 10 numeric pre-launch features (+ ``keep`` columns, label)."""
    feats = _base(df, ref_date)
    out = [F.col(k) for k in keep] + [feats.get(c, F.col(c)).alias(c) for c in CATEGORICAL + PRE_NUMERIC]
    if label:
        out.append(C.high_rating().alias("label"))
    return df.select(*out)


def engineer_post_launch(df: DataFrame, ref_date=C.REFERENCE_DATE, keep=("product_id",),
                         label: bool = True) -> DataFrame:
    """6 categorical + 31 numeric post-launch features (+ ``keep`` columns, label)."""
    feats = {
        **_base(df, ref_date),
        "sell_through_rate": C.sell_through_rate(), "stock_pressure": C.stock_pressure(),
        "revenue_proxy": C.revenue_proxy(), "is_delayed": C.is_delayed(),
        "demand_x_reviews": C.demand_x_reviews(), "popularity_score": C.popularity_score(),
        "delivery_score": C.delivery_score(), "value_score": C.value_score(),
        "margin_efficiency": C.margin_efficiency(), "discount_effectiveness": C.discount_effectiveness(),
        "review_density": C.review_density(ref_date), "inventory_health": C.inventory_health(),
        "is_organic": C.is_organic_int(),
    }
    out = [F.col(k) for k in keep] + [feats.get(c, F.col(c)).alias(c) for c in POST_CATEGORICAL + POST_NUMERIC]
    if label:
        out.append(C.high_rating().alias("label"))
    return df.select(*out)


def scenario_features(df: DataFrame, as_of, stage: str = "post", ref_date=C.REFERENCE_DATE,
                      keep=("product_id",)) -> DataFrame:
    """Serve-time features for products without history (the scoring form).

    ``final_price`` is the scenario price; ``days_to_expiry`` is the shelf life;
    freshness = shelf / (shelf + 1); age and month come from ``as_of``. These
    differ from the training features by design and are kept separate.
    """
    as_of_ts = F.lit(str(as_of)).cast("timestamp_ntz")
    fp = C.scenario_price()
    shelf = F.col("shelf_life_days")
    days = C.whole_days(F.lit(str(ref_date)).cast("timestamp_ntz"), as_of_ts)
    sold, stock = F.col("sold_quantity"), F.col("stock")
    st = safe_div(sold, sold + stock + 1)
    sp = safe_div(stock, F.col("reorder_level") + 1)
    delayed = C.is_delayed()
    base = {
        "offer_type": C.offer_filled(), "final_price": fp,
        "price_per_gram": safe_div(fp, F.col("weight_g") + 1),
        "discount_amount": F.col("price") - fp,
        "freshness_score": safe_div(shelf, shelf + 1),
        "days_since_added": days, "month_added": F.month(as_of_ts),
    }
    if stage == "pre":
        cols, cats = PRE_NUMERIC, CATEGORICAL
        feats = base
    else:
        cols, cats = POST_NUMERIC, POST_CATEGORICAL
        feats = {**base,
                 "days_to_expiry": shelf, "sell_through_rate": st, "stock_pressure": sp,
                 "revenue_proxy": fp * sold, "is_delayed": delayed,
                 "demand_x_reviews": F.col("demand_index") * F.col("num_reviews"),
                 "popularity_score": F.col("demand_index") * st,
                 "delivery_score": safe_div(F.lit(1) - delayed, F.col("delivery_time_min") + 1) * 100,
                 "value_score": safe_div(sold, fp + 1),
                 "margin_efficiency": F.col("profit_margin_pct") * st / 100,
                 "discount_effectiveness": (F.col("price") - fp) * st,
                 "review_density": safe_div(F.col("num_reviews"), days + 1) * 100,
                 "inventory_health": safe_div(st, sp + C.INVENTORY_EPS),
                 "is_organic": C.is_organic_int()}
    return df.select(*[F.col(k) for k in keep],
                     *[feats.get(c, F.col(c)).alias(c) for c in cats + cols])


def conform(df: DataFrame, contract: T.StructType | str = "post", keep=("product_id",)) -> DataFrame:
    """Cast rows to a request contract; flag bad rows instead of failing.

    Missing columns are an error for the whole frame (a schema problem), but for an absent
    ``offer_type``, which gets its default; values that do not cast, fractions in whole-number
    fields, and null values make that row ``success = false`` with a message listing the fields.
    """
    casts = _casts(df, contract)
    bad = F.filter(F.array(*[F.when(v.isNull(), F.lit(n)) for n, v in casts.items()]), lambda x: x.isNotNull())
    return df.select(*[F.col(k) for k in keep if k in df.columns],
                     *[v.alias(n) for n, v in casts.items()],
                     (F.size(bad) == 0).alias("success"),
                     F.when(F.size(bad) > 0, F.concat(F.lit("invalid or missing: "), F.array_join(bad, ", ")))
                     .alias("error"))


def cast_requests(df: DataFrame, contract: T.StructType | str = "post", keep=("product_id",)) -> DataFrame:
    """The rows of ``conform`` without its checks: for rows known to pass them."""
    return df.select(*[F.col(k) for k in keep if k in df.columns], *[v.alias(n) for n, v in _casts(df, contract).items()])


def _casts(df: DataFrame, contract: T.StructType | str) -> dict[str, Column]:
    if isinstance(contract, str):
        contract = POST_CONTRACT if contract == "post" else PRE_CONTRACT
    missing = [f.name for f in contract.fields if f.name not in df.columns and f.name != "offer_type"]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    casts = {}
    for f in contract.fields:
        if f.name not in df.columns:
            v = F.lit(C.NO_OFFER)  # the one field with a default
        elif isinstance(f.dataType, T.StringType):
            v = F.col(f.name).cast("string")
        else:
            v = F.col(f.name).try_cast(f.dataType)
            if isinstance(f.dataType, T.IntegralType):  # 5.5 is no whole number
                number = F.col(f.name).try_cast("double")
                v = F.when(number == F.floor(number), v)
        casts[f.name] = v
    return casts
