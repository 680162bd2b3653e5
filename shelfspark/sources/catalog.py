"""The product catalogue as a Spark view over the star-schema test tables.

The real input is one flat catalogue table (see ``files.read_catalog``). For the
driver's star-schema tables the catalogue is ``lineitem`` joined to part,
supplier, orders -> customer -> nation by left joins on unique keys, so a dimension
that contributes no requested column can be left out of the join without changing any row. ``catalog_view`` does exactly
that: a query asking for category and revenue joins lineitem to part only.
Which physical join is used (broadcast or sort-merge) is left to the planner,
which broadcasts only sides whose measured size is under
``spark.sql.autoBroadcastJoinThreshold``; at scale orders/customer/part are
shuffle-joined on their keys.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.features import in_date_range
from shelfspark.plans.reuse import materialize_small
from shelfspark.schemas import CATALOG

ALL_COLUMNS = [f.name for f in CATALOG.fields]

# Which dimension tables each catalogue column needs (lineitem is always read).
_NEEDS = {
    "product_name": {"part"}, "category": {"part"}, "brand": {"part"},
    "weight_g": {"part"}, "shelf_life_days": {"part"}, "reorder_level": {"part"},
    "is_organic": {"part"}, "seller": {"supplier"}, "date_added": {"orders"},
    "packaging_type": {"orders", "customer"}, "city": {"orders", "customer", "nation"},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _line_columns() -> dict[str, Column]:
    c = F.col
    qty = c("l_quantity")
    price = c("l_extendedprice") / qty
    delayed = c("l_returnflag") == F.lit("R")
    delivery = F.lit(10) + (c("l_orderkey") * 7 + c("l_linenumber") * 11) % 50
    offer = (F.when(c("l_discount") < 0.015, F.lit(None).cast("string"))
             .when(c("l_discount") < 0.045, F.lit("Coupon"))
             .when(c("l_discount") < 0.075, F.lit("FlatDiscount"))
             .otherwise(F.lit("Bundle")))
    rating = (F.lit(50) - F.floor(delivery / 5) - F.when(delayed, 5).otherwise(0)
              - (c("l_partkey") * 3 + c("l_linenumber")) % 6) / F.lit(10.0)
    return {
        "product_id": F.concat_ws("-", *[c(k).cast("string") for k in
                                         ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
                                  qty.cast("bigint").cast("string")),
        "offer_type": offer,
        "price": price,
        "final_price": price * (F.lit(1) - c("l_discount")),
        "discount_pct": c("l_discount") * 100,
        "profit_margin_pct": c("l_tax") * 500,
        "expiry_date": c("l_shipdate"),
        "delivery_status": F.when(delayed, "Delayed").otherwise("On-Time"),
        "delivery_time_min": delivery.cast("bigint"),
        "stock": ((c("l_partkey") * 3 + c("l_suppkey") * 5) % 500).cast("bigint"),
        "sold_quantity": qty.cast("bigint"),
        "num_reviews": ((c("l_orderkey") * 13 + c("l_partkey") * 7) % 1000).cast("bigint"),
        "demand_index": ((c("l_partkey") * 31 + c("l_suppkey") * 17) % 101).cast("double"),
        "rating": rating.cast("double"),
    }


def _dim_columns() -> dict[str, Column]:
    c = F.col
    return {
        "product_name": c("p_name"), "category": c("p_type"), "brand": c("p_brand"),
        "weight_g": c("p_size") * F.lit(10.0), "shelf_life_days": (F.lit(30) + c("p_size") * 7).cast("int"),
        "reorder_level": (F.lit(10) + c("p_size")).cast("int"), "is_organic": c("p_size") % 4 == 0,
        "seller": c("s_name"), "date_added": c("o_orderdate"), "packaging_type": c("c_mktsegment"),
        "city": c("n_name"),
    }


#: Folder column of a written catalogue: the month of ``date_added`` as ``yyyy-MM``.
MONTH_FOLDER = "folder_month"


def line_column(name: str) -> Column:
    """Expression of a catalogue column that comes from lineitem alone (product_id, prices, ...)."""
    return _line_columns()[name]


def catalog_view(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None,
                 fact: DataFrame | None = None) -> DataFrame:
    """Flat catalogue DataFrame with the requested columns (all by default), joined from the
    star tables under ``sf_dir``.

    Every lineitem row is one catalogue row: dimensions are left-joined on their unique
    keys, so a key without a dimension row gives nulls, never a lost row, whichever columns
    are asked for. ``fact`` replaces the lineitem scan with a top-n of its rows (a literal
    n): the joins then run on n rows, and no dimension is shuffled, however large.
    """
    cols = list(columns) if columns is not None else list(ALL_COLUMNS)
    unknown = set(cols) - set(ALL_COLUMNS)
    if unknown:
        raise ValueError(f"unknown catalogue columns: {sorted(unknown)}")
    needs = set().union(*[_NEEDS.get(k, set()) for k in cols]) if cols else set()
    if fact is not None:
        df = materialize_small(fact)
        for name, key, own in (("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey"),
                               ("orders", "l_orderkey", "o_orderkey"), ("customer", "o_custkey", "c_custkey"),
                               ("nation", "c_nationkey", "n_nationkey")):
            if name in needs:
                df = _looked_up(df, table(spark, sf_dir, name), key, own)
    else:
        df = table(spark, sf_dir, "lineitem")
        if "part" in needs:
            df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
        if "supplier" in needs:
            df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        if "orders" in needs:
            # Resolve the orders -> customer -> nation chain at orders size first, so
            # the lineitem-sized side is shuffled once (on orderkey), not per link.
            orders = table(spark, sf_dir, "orders")
            if "customer" in needs:
                orders = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
            if "nation" in needs:
                orders = orders.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    exprs = {**_line_columns(), **_dim_columns()}
    return df.select(*[exprs[k].alias(k) for k in cols])


def _looked_up(few: DataFrame, dim: DataFrame, key: str, own: str) -> DataFrame:
    """Left join of a top-n's rows: their keys pick the dimension's rows (at most one per
    key, so n at most), and those are joined back."""
    keys = few.select(F.col(key).alias("__key")).distinct()
    found = dim.join(F.broadcast(keys), F.col(own) == F.col("__key")).drop("__key")
    return few.join(F.broadcast(found), F.col(key) == F.col(own), "left")


def write_catalog(df: DataFrame, path: str, by_month: bool = True) -> None:
    """Materialise the flat catalogue once (one big join pass) as Parquet.

    Later queries then read only the columns they use, with filters pushed to
    the scan; folders by the month of ``date_added`` let date filters prune whole folders.
    """
    if by_month:
        months = df.withColumn(MONTH_FOLDER, F.date_format("date_added", "yyyy-MM"))
        months.write.mode("overwrite").partitionBy(MONTH_FOLDER).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def read_written_catalog(spark: SparkSession, path: str, columns: Iterable[str] | None = None, start=None,
                         end=None) -> DataFrame:
    """The requested columns of a catalogue written by ``write_catalog``, for a date range.

    The range prunes month folders as well as row groups, also when ``date_added`` is not
    among the columns.
    """
    df = spark.read.parquet(path)
    df = df.where(in_date_range(start, end))
    if MONTH_FOLDER in df.columns:
        df = df.where(month_range(start, end))
    return df.select(*(columns if columns is not None else ALL_COLUMNS))


def month_range(start=None, end=None) -> Column:
    """The folders that can hold dates of the range."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(MONTH_FOLDER) >= str(start)[:7])
    if end is not None:
        cond = cond & (F.col(MONTH_FOLDER) <= str(end)[:7])
    return cond


# The same catalogue in SQL text, used as the first CTE of every oracle query.
CATALOG_SQL = """catalog AS (
  SELECT
    concat(cast(l_orderkey AS VARCHAR), '-', cast(l_partkey AS VARCHAR), '-', cast(l_suppkey AS VARCHAR),
           '-', cast(l_linenumber AS VARCHAR), '-', cast(cast(l_quantity AS BIGINT) AS VARCHAR)) AS product_id,
    p_name AS product_name, p_type AS category, p_brand AS brand, n_name AS city, s_name AS seller,
    c_mktsegment AS packaging_type,
    CASE WHEN l_discount < 0.015 THEN NULL WHEN l_discount < 0.045 THEN 'Coupon'
         WHEN l_discount < 0.075 THEN 'FlatDiscount' ELSE 'Bundle' END AS offer_type,
    l_extendedprice / l_quantity AS price,
    l_extendedprice / l_quantity * (1 - l_discount) AS final_price,
    l_discount * 100 AS discount_pct,
    l_tax * 500 AS profit_margin_pct,
    p_size * 10.0e0 AS weight_g,
    cast(30 + p_size * 7 AS INTEGER) AS shelf_life_days,
    o_orderdate AS date_added,
    l_shipdate AS expiry_date,
    CASE WHEN l_returnflag = 'R' THEN 'Delayed' ELSE 'On-Time' END AS delivery_status,
    cast(10 + (l_orderkey * 7 + l_linenumber * 11) % 50 AS BIGINT) AS delivery_time_min,
    cast((l_partkey * 3 + l_suppkey * 5) % 500 AS BIGINT) AS stock,
    cast(l_quantity AS BIGINT) AS sold_quantity,
    cast(10 + p_size AS INTEGER) AS reorder_level,
    cast((l_orderkey * 13 + l_partkey * 7) % 1000 AS BIGINT) AS num_reviews,
    cast((l_partkey * 31 + l_suppkey * 17) % 101 AS DOUBLE) AS demand_index,
    p_size % 4 = 0 AS is_organic,
    cast((50 - floor((10 + (l_orderkey * 7 + l_linenumber * 11) % 50) / 5)
          - CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END
          - (l_partkey * 3 + l_linenumber) % 6) / 10.0e0 AS DOUBLE) AS rating
  FROM lineitem
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
)"""
