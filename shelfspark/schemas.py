"""Explicit schemas. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
TS = T.TimestampNTZType()


def _struct(fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Flat product catalogue: one row per listing.
CATALOG = _struct([
    ("product_id", S), ("product_name", S), ("category", S), ("brand", S), ("city", S),
    ("seller", S), ("packaging_type", S), ("offer_type", S),
    ("price", D), ("final_price", D), ("discount_pct", D), ("profit_margin_pct", D),
    ("weight_g", D), ("shelf_life_days", I), ("date_added", TS), ("expiry_date", TS),
    ("delivery_status", S), ("delivery_time_min", L), ("stock", L), ("sold_quantity", L),
    ("reorder_level", I), ("num_reviews", L), ("demand_index", D), ("is_organic", B),
    ("rating", D),
])

STRING_COLUMNS = [f.name for f in CATALOG.fields if isinstance(f.dataType, T.StringType)]
DOUBLE_COLUMNS = [f.name for f in CATALOG.fields if isinstance(f.dataType, T.DoubleType)]
NUMERIC_COLUMNS = [
    f.name for f in CATALOG.fields
    if isinstance(f.dataType, (T.DoubleType, T.IntegerType, T.LongType))
]

# Saved dialogue log record.
DIALOGUE = _struct([("role", S), ("content", S), ("code_executed", S), ("timestamp", S)])

# One question-answer exchange of a session (input of flatten_exchanges).
EXCHANGES = _struct([("question", S), ("summary", S), ("error", S), ("code_executed", S)])

# The model inputs of the two request contracts, in the reference's order
# (categorical then numeric; the pre-launch and post-launch lists differ in order and size).
CATEGORICAL = ["brand", "city", "seller", "packaging_type", "category", "offer_type"]

PRE_NUMERIC = [
    "price", "final_price", "profit_margin_pct", "weight_g", "shelf_life_days",
    "days_since_added", "month_added", "price_per_gram", "discount_amount", "freshness_score",
]

POST_CATEGORICAL = ["category", "brand", "city", "seller", "packaging_type", "offer_type"]
POST_NUMERIC = [
    "price", "final_price", "discount_pct", "profit_margin_pct", "weight_g", "shelf_life_days",
    "num_reviews", "delivery_time_min", "stock", "sold_quantity", "reorder_level", "demand_index",
    "days_to_expiry", "days_since_added", "month_added",
    "sell_through_rate", "stock_pressure", "revenue_proxy", "is_delayed",
    "demand_x_reviews", "popularity_score", "delivery_score", "value_score",
    "margin_efficiency", "discount_effectiveness", "review_density", "freshness_score",
    "inventory_health", "discount_amount", "price_per_gram", "is_organic",
]

# Integer-typed fields of the request contracts; every other numeric field is double.
CONTRACT_INTS = {
    "shelf_life_days", "days_since_added", "month_added", "num_reviews", "delivery_time_min",
    "stock", "sold_quantity", "reorder_level", "days_to_expiry", "is_delayed", "is_organic",
}


def contract_schema(categorical, numeric) -> T.StructType:
    return _struct([(c, S) for c in categorical]
                   + [(c, I if c in CONTRACT_INTS else D) for c in numeric])


PRE_CONTRACT = contract_schema(CATEGORICAL, PRE_NUMERIC)
POST_CONTRACT = contract_schema(POST_CATEGORICAL, POST_NUMERIC)

PREDICTION = _struct([("prediction", I), ("probability", D), ("success", B), ("error", S)])

RUNS = T.StructType([
    T.StructField("run_id", S), T.StructField("experiment", S), T.StructField("name", S),
    T.StructField("model_path", S), T.StructField("start_time", T.TimestampType()),
    T.StructField("params", T.MapType(S, S)), T.StructField("metrics", T.MapType(S, D)),
])
