"""Registered catalogue queries: KPIs (D), insights (E), questions (F)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from shelfspark.functions.features import offer_filled
from shelfspark.operators import insights as E
from shelfspark.operators import kpi as D
from shelfspark.operators import questions as Q
from shelfspark.operators.dashboard import filter_dates
from shelfspark.plans.registry import cat, register, with_catalog
from shelfspark.plans.reuse import written
from shelfspark.sources.catalog import catalog_view, line_column, table

REV = ("final_price", "sold_quantity")


def _grp_sql(dim: str) -> str:
    return f"""SELECT {dim}, CAST(sum(rev4) AS DOUBLE) AS revenue, CAST(sum(sold_quantity) AS BIGINT) AS units
FROM prep WHERE {dim} IS NOT NULL GROUP BY {dim}"""


# ------------------------------------------------------------------ catalogue
@register("catalog", with_catalog("SELECT * FROM catalog", prep=False))
def q_catalog(spark, sf):
    return catalog_view(spark, sf)


# ------------------------------------------------------------------ D
@register("kpi_counts", with_catalog("""SELECT count(DISTINCT category) AS n_categories,
  count(DISTINCT city) AS n_cities, count(DISTINCT seller) AS n_sellers,
  count(DISTINCT brand) AS n_brands, count(*) AS n_products FROM prep"""))
def q_kpi_counts(spark, sf):
    return D.kpi_counts(cat(spark, sf, "category", "city", "seller", "brand"))


@register("kpi_totals", with_catalog("""SELECT CAST(sum(rev4) AS DOUBLE) AS total_revenue,
  CAST(sum(sold_quantity) AS BIGINT) AS total_units, avg(rating) AS avg_rating,
  count_if(delivery_status = 'On-Time') * 100.0e0 / count(*) AS on_time_pct,
  100.0e0 - count_if(delivery_status = 'On-Time') * 100.0e0 / count(*) AS delayed_pct
FROM prep"""), rounded=["avg_rating", "on_time_pct", "delayed_pct"])
def q_kpi_totals(spark, sf):
    return D.kpi_totals(cat(spark, sf, *REV, "rating", "delivery_status"))


def _extreme_sql(dim: str) -> str:
    return f"""SELECT '{dim}' AS dimension,
  (SELECT {dim} FROM g_{dim} ORDER BY revenue DESC, {dim} LIMIT 1) AS top_name,
  (SELECT max(revenue) FROM g_{dim}) AS top_revenue,
  (SELECT {dim} FROM g_{dim} ORDER BY revenue, {dim} LIMIT 1) AS bottom_name,
  (SELECT min(revenue) FROM g_{dim}) AS bottom_revenue"""


@register("kpi_totals_1998_1999", with_catalog("""SELECT CAST(sum(rev4) AS DOUBLE) AS total_revenue,
  CAST(sum(sold_quantity) AS BIGINT) AS total_units, avg(rating) AS avg_rating,
  count_if(delivery_status = 'On-Time') * 100.0e0 / count(*) AS on_time_pct,
  100.0e0 - count_if(delivery_status = 'On-Time') * 100.0e0 / count(*) AS delayed_pct
FROM prep WHERE CAST(date_added AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"""),
          rounded=["avg_rating", "on_time_pct", "delayed_pct"])
def q_kpi_totals_range(spark, sf):
    df = cat(spark, sf, *REV, "rating", "delivery_status", "date_added")
    return D.kpi_totals(filter_dates(df, "1998-01-01", "1999-12-31"))


@register("kpi_extremes", with_catalog(f""", g_city AS ({_grp_sql('city')}),
g_seller AS ({_grp_sql('seller')})
{_extreme_sql('city')}
UNION ALL
{_extreme_sql('seller')}"""))
def q_kpi_extremes(spark, sf):
    return D.kpi_extremes(cat(spark, sf, *REV, "city", "seller"))


@register("seller_name_list", with_catalog(""", names AS (SELECT DISTINCT seller FROM prep WHERE seller IS NOT NULL),
shown AS (SELECT seller FROM names ORDER BY seller LIMIT 9)
SELECT 'seller' AS dimension, (SELECT string_agg(seller, ', ' ORDER BY seller) FROM shown) AS names,
  (SELECT count(*) FROM shown) AS n_shown,
  CAST(greatest((SELECT count(*) FROM names) - 9, 0) AS BIGINT) AS n_more"""))
def q_seller_names(spark, sf):
    return D.name_list(cat(spark, sf, "seller"), "seller", 9)


# ------------------------------------------------------------------ E1, E2
MONTHLY_SQL = """SELECT strftime(date_added, '%Y-%m') AS month, CAST(sum(rev4) AS DOUBLE) AS revenue,
  CAST(sum(sold_quantity) AS BIGINT) AS units FROM prep WHERE date_added IS NOT NULL GROUP BY 1"""


@register("monthly_trend", with_catalog(MONTHLY_SQL))
def q_monthly(spark, sf):
    return E.monthly_trend(cat(spark, sf, *REV, "date_added"))


@register("monthly_takeaway", with_catalog(f""", m AS ({MONTHLY_SQL}),
s AS (SELECT avg(revenue) AS avg_revenue FROM m)
SELECT (SELECT month FROM m ORDER BY revenue DESC, month LIMIT 1) AS peak_month,
  (SELECT max(revenue) FROM m) AS peak_revenue,
  (SELECT month FROM m ORDER BY revenue, month LIMIT 1) AS low_month,
  (SELECT min(revenue) FROM m) AS low_revenue, avg_revenue,
  (SELECT month FROM m ORDER BY month LIMIT 1) AS first_month,
  (SELECT revenue FROM m ORDER BY month LIMIT 1) AS first_revenue,
  (SELECT month FROM m ORDER BY month DESC LIMIT 1) AS last_month,
  (SELECT revenue FROM m ORDER BY month DESC LIMIT 1) AS last_revenue,
  CASE WHEN (SELECT revenue FROM m ORDER BY month DESC LIMIT 1) > (SELECT revenue FROM m ORDER BY month LIMIT 1)
       THEN 'up' ELSE 'down' END AS trend,
  ((SELECT max(revenue) FROM m) / avg_revenue - 1) * 100 AS peak_above_avg_pct,
  (1 - (SELECT min(revenue) FROM m) / avg_revenue) * 100 AS low_below_avg_pct
FROM s"""), rounded=["avg_revenue", "peak_above_avg_pct", "low_below_avg_pct"])
def q_monthly_takeaway(spark, sf):
    return E.monthly_takeaway(E.monthly_trend(cat(spark, sf, *REV, "date_added")))


# ------------------------------------------------------------------ E3
@register("category_revenue", with_catalog(_grp_sql("category")))
def q_category_revenue(spark, sf):
    return E.revenue_by(cat(spark, sf, *REV, "category"), "category")


@register("category_takeaway", with_catalog(f""", g AS ({_grp_sql('category')})
SELECT (SELECT category FROM g ORDER BY revenue DESC, category LIMIT 1) AS top,
  (SELECT max(revenue) FROM g) AS top_revenue,
  (SELECT category FROM g ORDER BY revenue, category LIMIT 1) AS bottom,
  (SELECT min(revenue) FROM g) AS bottom_revenue,
  CASE WHEN (SELECT min(revenue) FROM g) > 0 THEN (SELECT max(revenue) FROM g) / (SELECT min(revenue) FROM g)
       ELSE 0.0e0 END AS top_to_bottom"""), rounded=["top_to_bottom"])
def q_category_takeaway(spark, sf):
    return E.revenue_by_takeaway(E.revenue_by(cat(spark, sf, *REV, "category"), "category"), "category")


# ------------------------------------------------------------------ E4, E5
PARETO_SQL = """, g AS (SELECT brand, sum(rev4) AS rev FROM prep WHERE brand IS NOT NULL GROUP BY brand),
r AS (SELECT brand, rev, sum(rev) OVER (ORDER BY rev DESC, brand ROWS UNBOUNDED PRECEDING) AS cum,
        row_number() OVER (ORDER BY rev DESC, brand) - 1 AS position,
        sum(rev) OVER () AS total FROM g),
p AS (SELECT brand, CAST(rev AS DOUBLE) AS revenue, CAST(cum AS DOUBLE) AS cum_revenue,
        CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS cum_pct, CAST(position AS BIGINT) AS position FROM r),
pp AS (SELECT *, position <= (SELECT count(*) FROM p WHERE cum_pct <= 80) AS is_head FROM p)"""


@register("brand_pareto", with_catalog(PARETO_SQL + "\nSELECT * FROM pp"), rounded=["cum_pct"])
def q_pareto(spark, sf):
    return E.pareto(cat(spark, sf, *REV, "brand"), "brand", 80.0)


@register("pareto_takeaway", with_catalog(PARETO_SQL + """
SELECT CAST(count_if(is_head) AS BIGINT) AS n_head, count(*) AS n_total,
  CAST(count(*) - count_if(is_head) AS BIGINT) AS n_rest,
  (SELECT brand FROM pp WHERE position = 0) AS top_key,
  max(CASE WHEN position = 0 THEN revenue END) / max(cum_revenue) * 100 AS top_share_pct,
  max(CASE WHEN position <= 2 THEN cum_revenue END) / max(cum_revenue) * 100 AS top3_share_pct
FROM pp"""), rounded=["top_share_pct", "top3_share_pct"])
def q_pareto_takeaway(spark, sf):
    return E.pareto_takeaway(E.pareto(cat(spark, sf, *REV, "brand"), "brand", 80.0))


# ------------------------------------------------------------------ E6
CITY_SQL = f""", g AS ({_grp_sql('city')}),
c AS (SELECT *, revenue < (SELECT avg(revenue) FROM g) AS below_avg FROM g)"""


@register("city_revenue", with_catalog(CITY_SQL + "\nSELECT * FROM c"))
def q_city_revenue(spark, sf):
    return E.city_revenue(cat(spark, sf, *REV, "city"))


@register("city_takeaway", with_catalog(CITY_SQL + """
SELECT avg(revenue) AS avg_revenue, CAST(count_if(below_avg) AS BIGINT) AS n_below_avg,
  coalesce(string_agg(city, ', ' ORDER BY city) FILTER (WHERE below_avg), '') AS below_avg_names,
  CAST((SELECT sum(CAST(revenue AS DECIMAL(38,4))) FROM (SELECT revenue FROM c ORDER BY revenue DESC, city LIMIT 2)) AS DOUBLE)
  / CAST(sum(CAST(revenue AS DECIMAL(38,4))) AS DOUBLE) * 100 AS top2_share_pct
FROM c"""), rounded=["avg_revenue", "top2_share_pct"])
def q_city_takeaway(spark, sf):
    return E.city_takeaway(E.city_revenue(cat(spark, sf, *REV, "city")))


# ------------------------------------------------------------------ E7, E8
GRID_SQL = """, cells AS (SELECT city, category, CAST(sum(rev4) AS DOUBLE) AS revenue FROM prep
  WHERE city IS NOT NULL AND category IS NOT NULL GROUP BY city, category),
grid AS (SELECT r.city, k.category, coalesce(cells.revenue, 0.0e0) AS revenue
  FROM (SELECT DISTINCT city FROM cells) r CROSS JOIN (SELECT DISTINCT category FROM cells) k
  LEFT JOIN cells ON cells.city = r.city AND cells.category = k.category)"""


@register("city_category_grid", with_catalog(GRID_SQL + "\nSELECT * FROM grid"))
def q_grid(spark, sf):
    return E.cross_grid(cat(spark, sf, *REV, "city", "category"), "city", "category")


# Category domain of the driver's test tables (p_type), used only to name the oracle's columns;
# the Spark side reads the pivot values from the data.
TEST_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("city_category_wide", with_catalog("SELECT city, " + ", ".join(
    f"coalesce(CAST(sum(CASE WHEN category = '{c}' THEN rev4 END) AS DOUBLE), 0.0e0) AS \"{c}\""
    for c in TEST_CATEGORIES) + " FROM prep WHERE city IS NOT NULL AND category IS NOT NULL GROUP BY city"))
def q_grid_wide(spark, sf):
    return E.cross_grid_wide(cat(spark, sf, *REV, "city", "category"), "city", "category")


@register("grid_weakest", with_catalog(GRID_SQL + f""",
g AS ({_grp_sql('city')}),
top2 AS (SELECT city, row_number() OVER (ORDER BY revenue DESC, city) AS r FROM g ORDER BY revenue DESC, city LIMIT 2),
o AS (SELECT city, category, revenue FROM grid ORDER BY revenue, city, category LIMIT 1),
w AS (SELECT grid.city, category, revenue FROM grid JOIN top2 USING (city) ORDER BY revenue, r, category LIMIT 1)
SELECT o.city AS min_row, o.category AS min_col, o.revenue AS min_revenue,
  w.city AS top_min_row, w.category AS top_min_col, w.revenue AS top_min_revenue FROM o, w"""))
def q_grid_weakest(spark, sf):
    return E.grid_weakest(E.cross_grid(cat(spark, sf, *REV, "city", "category")))


# ------------------------------------------------------------------ E9
DELIVERY_SQL = """, d AS (SELECT city, count_if(delivery_status = 'On-Time') * 100.0e0 / count(*) AS on_time_pct,
  avg(delivery_time_min) AS avg_time FROM prep WHERE city IS NOT NULL GROUP BY city),
db AS (SELECT *, CASE WHEN on_time_pct < 70 THEN 'red' WHEN on_time_pct < 85 THEN 'amber' ELSE 'green' END AS band FROM d)"""


@register("delivery_by_city", with_catalog(DELIVERY_SQL + "\nSELECT * FROM db"), rounded=["on_time_pct", "avg_time"])
def q_delivery(spark, sf):
    return E.delivery_by_city(cat(spark, sf, "city", "delivery_status", "delivery_time_min"))


@register("delivery_takeaway", with_catalog(DELIVERY_SQL + """
SELECT (SELECT city FROM db ORDER BY on_time_pct DESC, city LIMIT 1) AS best,
  (SELECT max(on_time_pct) FROM db) AS best_on_time_pct,
  (SELECT city FROM db ORDER BY on_time_pct, city LIMIT 1) AS worst,
  (SELECT min(on_time_pct) FROM db) AS worst_on_time_pct,
  CAST((SELECT count_if(on_time_pct < 70) FROM db) AS BIGINT) AS n_below_70,
  coalesce((SELECT string_agg(city, ', ' ORDER BY city) FROM db WHERE on_time_pct < 70), '') AS below_70_names"""), rounded=["best_on_time_pct", "worst_on_time_pct"])
def q_delivery_takeaway(spark, sf):
    return E.delivery_takeaway(E.delivery_by_city(cat(spark, sf, "city", "delivery_status", "delivery_time_min")))


# ------------------------------------------------------------------ E10
QUAD_SQL = """, q AS (SELECT category, avg(demand_index) AS avg_demand, avg(stock) AS avg_stock
  FROM prep WHERE category IS NOT NULL GROUP BY category),
med AS (SELECT median(avg_demand) AS d, median(avg_stock) AS s FROM q),
qq AS (SELECT q.*, CASE WHEN avg_demand >= d AND avg_stock < s THEN 'Reorder Now'
                        WHEN avg_demand >= d AND avg_stock >= s THEN 'Healthy'
                        WHEN avg_demand < d AND avg_stock >= s THEN 'Overstocked'
                        ELSE 'Phase Out' END AS quadrant FROM q, med)"""


@register("demand_supply_quadrant", with_catalog(QUAD_SQL + "\nSELECT * FROM qq"), rounded=["avg_demand", "avg_stock"])
def q_quadrant(spark, sf):
    return E.demand_supply_quadrant(cat(spark, sf, "category", "demand_index", "stock"))


@register("quadrant_counts", with_catalog(QUAD_SQL + """
SELECT quadrant, count(*) AS n, string_agg(category, ', ' ORDER BY category) AS names FROM qq GROUP BY quadrant"""))
def q_quadrant_counts(spark, sf):
    return E.quadrant_counts(E.demand_supply_quadrant(cat(spark, sf, "category", "demand_index", "stock")))


# ------------------------------------------------------------------ E11
ZONE_SQL = """, m AS (SELECT category, avg(discount_pct) AS avg_discount,
  avg(profit_margin_pct) AS avg_margin, CAST(sum(rev4) AS DOUBLE) AS total_revenue
  FROM prep WHERE category IS NOT NULL GROUP BY category),
med AS (SELECT median(avg_discount) AS d, median(avg_margin) AS mm FROM m)
, z AS (SELECT m.*, CASE WHEN avg_discount > d AND avg_margin < mm THEN 'leakage'
                 WHEN avg_discount < d AND avg_margin > mm THEN 'safe' ELSE 'other' END AS zone
FROM m, med)"""


@register("discount_margin", with_catalog(ZONE_SQL + """
SELECT *, CAST(row_number() OVER (PARTITION BY zone ORDER BY total_revenue DESC, category) AS INTEGER) AS zone_rank
FROM z"""), rounded=["avg_discount", "avg_margin"])
def q_discount_margin(spark, sf):
    return E.discount_margin(cat(spark, sf, *REV, "category", "discount_pct", "profit_margin_pct"))


@register("discount_takeaway", with_catalog(ZONE_SQL + """
SELECT coalesce(string_agg(category, ', ' ORDER BY total_revenue DESC, category) FILTER (WHERE zone = 'leakage'), '') AS leakage_names,
  coalesce(string_agg(category, ', ' ORDER BY category) FILTER (WHERE zone = 'safe'), '') AS safe_names FROM z"""))
def q_discount_takeaway(spark, sf):
    return E.discount_takeaway(E.discount_margin(cat(spark, sf, *REV, "category", "discount_pct", "profit_margin_pct")))


# ------------------------------------------------------------------ E12
OFFER_SQL = """, cells AS (SELECT category, offer_filled AS offer_type, avg(sold_quantity) AS avg_units
  FROM prep WHERE category IS NOT NULL GROUP BY category, offer_filled)"""


@register("offer_effect", with_catalog(OFFER_SQL + "\nSELECT * FROM cells"), rounded=["avg_units"])
def q_offer_effect(spark, sf):
    return E.offer_effect(cat(spark, sf, "category", "offer_type", "sold_quantity"))


@register("offer_grid", with_catalog(OFFER_SQL + """
SELECT a.category, b.offer_type, coalesce(avg_units, 0.0e0) AS avg_units
FROM (SELECT DISTINCT category FROM cells) a CROSS JOIN (SELECT DISTINCT offer_type FROM cells) b
LEFT JOIN cells ON cells.category = a.category AND cells.offer_type = b.offer_type"""), rounded=["avg_units"])
def q_offer_grid(spark, sf):
    df = cat(spark, sf, "category", "offer_type", "sold_quantity").withColumn("offer_type", offer_filled())
    return E.cross_grid(df, "category", "offer_type", F.avg("sold_quantity"), "avg_units")


@register("offer_takeaway", with_catalog(OFFER_SQL + """,
b AS (SELECT * FROM cells ORDER BY avg_units DESC, category, offer_type LIMIT 1),
w AS (SELECT * FROM cells ORDER BY avg_units, category, offer_type LIMIT 1),
o AS (SELECT offer_type, avg(avg_units) AS m FROM cells GROUP BY offer_type)
SELECT b.category AS best_category, b.offer_type AS best_offer_cell, b.avg_units AS best_avg_units,
  w.category AS worst_category, w.offer_type AS worst_offer_cell, w.avg_units AS worst_avg_units,
  (SELECT offer_type FROM o ORDER BY m DESC, offer_type LIMIT 1) AS best_offer
FROM b, w"""), rounded=["best_avg_units", "worst_avg_units"])
def q_offer_takeaway(spark, sf):
    return E.offer_takeaway(E.offer_effect(cat(spark, sf, "category", "offer_type", "sold_quantity")))


# ------------------------------------------------------------------ E13, E18
def _rating_sql(dim: str, on_time: bool) -> str:
    extra = ", count_if(delivery_status = 'On-Time') * 100.0e0 / count(*) AS on_time_pct" if on_time else ""
    return f""", rt AS (SELECT {dim}, avg(rating) AS avg_rating, count(rating) AS n_rated{extra}
  FROM prep WHERE {dim} IS NOT NULL GROUP BY {dim}),
rb AS (SELECT *, CASE WHEN avg_rating < 3.5 THEN 'low' WHEN avg_rating < 4.0 THEN 'mid' ELSE 'high' END AS band FROM rt)"""


@register("category_rating", with_catalog(_rating_sql("category", False) + "\nSELECT * FROM rb"), rounded=["avg_rating"])
def q_category_rating(spark, sf):
    return E.rating_by(cat(spark, sf, "category", "rating"), "category")


@register("rating_takeaway", with_catalog(_rating_sql("category", False) + """
SELECT (SELECT category FROM rb ORDER BY avg_rating DESC, category LIMIT 1) AS best,
  (SELECT max(avg_rating) FROM rb) AS best_rating,
  (SELECT category FROM rb ORDER BY avg_rating, category LIMIT 1) AS worst,
  (SELECT min(avg_rating) FROM rb) AS worst_rating,
  (SELECT avg(avg_rating) FROM rb) AS overall_avg,
  CAST((SELECT count_if(avg_rating < 3.5) FROM rb) AS BIGINT) AS n_low,
  coalesce((SELECT string_agg(category, ', ' ORDER BY category) FROM rb WHERE avg_rating < 3.5), '') AS low_names"""), rounded=["best_rating", "worst_rating", "overall_avg"])
def q_rating_takeaway(spark, sf):
    return E.rating_takeaway(E.rating_by(cat(spark, sf, "category", "rating"), "category"))


@register("seller_rating", with_catalog(_rating_sql("seller", True) + "\nSELECT * FROM rb"),
          rounded=["avg_rating", "on_time_pct"])
def q_seller_rating(spark, sf):
    return E.rating_by(cat(spark, sf, "seller", "rating", "delivery_status"), "seller", with_on_time=True)


# ------------------------------------------------------------------ E14-E16
SPEED_SQL = """, pts AS (SELECT city, avg(delivery_time_min) AS avg_delivery, avg(rating) AS avg_rating,
  count_if(delivery_status = 'Delayed') * 100.0e0 / count(*) AS delayed_pct
  FROM prep WHERE city IS NOT NULL GROUP BY city),
fit AS (SELECT count(*) AS n,
  CASE WHEN var_pop(avg_delivery) = 0 THEN NULL ELSE covar_pop(avg_rating, avg_delivery) / var_pop(avg_delivery) END AS slope,
  avg(avg_rating) - (CASE WHEN var_pop(avg_delivery) = 0 THEN NULL ELSE covar_pop(avg_rating, avg_delivery) / var_pop(avg_delivery) END) * avg(avg_delivery) AS intercept,
  CASE WHEN stddev_pop(avg_delivery) * stddev_pop(avg_rating) = 0 THEN NULL
       ELSE covar_pop(avg_rating, avg_delivery) / (stddev_pop(avg_delivery) * stddev_pop(avg_rating)) END AS r,
  min(avg_delivery) AS x_min, max(avg_delivery) AS x_max
  FROM pts WHERE avg_delivery IS NOT NULL AND avg_rating IS NOT NULL)"""
SPEED_COLS = ("city", "delivery_time_min", "rating", "delivery_status")


@register("speed_vs_rating", with_catalog(SPEED_SQL + "\nSELECT * FROM pts"),
          rounded=["avg_delivery", "avg_rating", "delayed_pct"])
def q_speed(spark, sf):
    return E.speed_vs_rating(cat(spark, sf, *SPEED_COLS))


@register("speed_fit", with_catalog(SPEED_SQL + "\nSELECT * FROM fit"),
          rounded=["slope", "intercept", "r", "x_min", "x_max"])
def q_speed_fit(spark, sf):
    return E.linear_fit(E.speed_vs_rating(cat(spark, sf, *SPEED_COLS)))


@register("speed_takeaway", with_catalog(SPEED_SQL + """
SELECT (SELECT r FROM fit) AS r,
  CASE WHEN (SELECT r FROM fit) < -0.1 THEN 'hurts' ELSE 'not the main driver' END AS direction,
  (SELECT city FROM pts ORDER BY avg_delivery, city LIMIT 1) AS fastest,
  (SELECT min(avg_delivery) FROM pts) AS fastest_minutes,
  (SELECT city FROM pts ORDER BY avg_delivery DESC, city DESC LIMIT 1) AS slowest,
  (SELECT max(avg_delivery) FROM pts) AS slowest_minutes"""), rounded=["r", "fastest_minutes", "slowest_minutes"])
def q_speed_takeaway(spark, sf):
    pts = E.speed_vs_rating(cat(spark, sf, *SPEED_COLS))
    return E.speed_takeaway(pts, E.linear_fit(pts))


@register("fit_line", with_catalog(SPEED_SQL + """
SELECT i, x, slope * x + intercept AS y FROM (
  SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = 99 THEN x_max ELSE x_min + i * ((x_max - x_min) / 99) END AS x,
         slope, intercept
  FROM fit, generate_series(0, 99) AS t(i))"""), rounded=["x", "y"])
def q_fit_line(spark, sf):
    return E.fit_line(E.linear_fit(E.speed_vs_rating(cat(spark, sf, *SPEED_COLS))), 100)


# ------------------------------------------------------------------ E17
SCORE_SQL = """, raw AS (SELECT seller, avg(rating) AS avg_rating,
  count_if(delivery_status = 'On-Time') * 100.0e0 / count(*) AS on_time_pct,
  avg(profit_margin_pct) AS avg_margin, CAST(sum(rev4) AS DOUBLE) AS total_revenue
  FROM prep WHERE seller IS NOT NULL GROUP BY seller),
b AS (SELECT min(avg_rating) a0, max(avg_rating) a1, min(on_time_pct) o0, max(on_time_pct) o1,
             min(avg_margin) m0, max(avg_margin) m1, min(total_revenue) t0, max(total_revenue) t1 FROM raw),
sc AS (SELECT raw.*,
  CASE WHEN a1 = a0 THEN 0.0e0 ELSE (avg_rating - a0) / (a1 - a0) END AS s1,
  CASE WHEN o1 = o0 THEN 0.0e0 ELSE (on_time_pct - o0) / (o1 - o0) END AS s2,
  CASE WHEN m1 = m0 THEN 0.0e0 ELSE (avg_margin - m0) / (m1 - m0) END AS s3,
  CASE WHEN t1 = t0 THEN 0.0e0 ELSE (total_revenue - t0) / (t1 - t0) END AS s4 FROM raw, b),
card AS (SELECT seller, avg_rating, on_time_pct, avg_margin, total_revenue,
  round_even((s1 + s2 + s3 + s4) / 4 * 100, 1) AS score FROM sc)"""


@register("seller_scorecard", with_catalog(SCORE_SQL + "\nSELECT * FROM card"),
          rounded=["avg_rating", "on_time_pct", "avg_margin"])
def q_scorecard(spark, sf):
    return E.scorecard(cat(spark, sf, *REV, "seller", "rating", "delivery_status", "profit_margin_pct"))


@register("scorecard_takeaway", with_catalog(SCORE_SQL + """
SELECT (SELECT seller FROM card ORDER BY score DESC, seller LIMIT 1) AS best,
  (SELECT max(score) FROM card) AS best_score,
  (SELECT seller FROM card ORDER BY score, seller DESC LIMIT 1) AS worst,
  (SELECT min(score) FROM card) AS worst_score"""))
def q_scorecard_takeaway(spark, sf):
    return E.scorecard_takeaway(
        E.scorecard(cat(spark, sf, *REV, "seller", "rating", "delivery_status", "profit_margin_pct")))


# ------------------------------------------------------------------ E19
STOCK_SQL = """, t AS (SELECT category, CAST(sum(sold_quantity) AS BIGINT) AS total_sold,
  CAST(sum(stock) AS BIGINT) AS total_stock FROM prep WHERE category IS NOT NULL GROUP BY category),
ts AS (SELECT *, total_sold / (total_stock + 1) AS sold_to_stock FROM t)"""


@register("sold_vs_stock", with_catalog(STOCK_SQL + "\nSELECT * FROM ts"), rounded=["sold_to_stock"])
def q_sold_vs_stock(spark, sf):
    return E.sold_vs_stock(cat(spark, sf, "category", "sold_quantity", "stock"))


@register("sold_vs_stock_takeaway", with_catalog(STOCK_SQL + """
SELECT (SELECT category FROM ts ORDER BY sold_to_stock DESC, category LIMIT 1) AS at_risk,
  (SELECT max(sold_to_stock) FROM ts) AS at_risk_ratio,
  (SELECT category FROM ts ORDER BY sold_to_stock, category LIMIT 1) AS overstocked,
  (SELECT min(sold_to_stock) FROM ts) AS overstocked_ratio"""), rounded=["at_risk_ratio", "overstocked_ratio"])
def q_sold_vs_stock_takeaway(spark, sf):
    return E.sold_vs_stock_takeaway(E.sold_vs_stock(cat(spark, sf, "category", "sold_quantity", "stock")))


# ------------------------------------------------------------------ F
@register("delayed_share_by_seller", with_catalog(""", tot AS (SELECT seller, count(*) AS total_orders FROM prep
  WHERE seller IS NOT NULL GROUP BY seller),
del AS (SELECT seller, count(*) AS delayed_orders FROM prep WHERE seller IS NOT NULL AND delivery_status = 'Delayed'
  GROUP BY seller)
SELECT tot.seller, total_orders, CAST(coalesce(delayed_orders, 0) AS BIGINT) AS delayed_orders,
  coalesce(delayed_orders, 0) / total_orders * 100 AS delayed_pct
FROM tot LEFT JOIN del ON tot.seller = del.seller"""), rounded=["delayed_pct"])
def q_delayed_share(spark, sf):
    # the one-pass form; the reference's two-aggregate join form gives the same table (tests)
    return Q.delayed_share_by(cat(spark, sf, "seller", "delivery_status"), "seller", single_pass=True)


LEAD_CITY_SQL = """, cu AS (SELECT city, sum(sold_quantity) AS m FROM prep WHERE city IS NOT NULL GROUP BY city),
lc AS (SELECT city, m FROM cu ORDER BY m DESC, city LIMIT 1)"""


@register("leading_city_category", with_catalog(LEAD_CITY_SQL + """,
ic AS (SELECT category, sum(sold_quantity) AS m FROM prep WHERE city = (SELECT city FROM lc)
  AND category IS NOT NULL GROUP BY category),
li AS (SELECT category, m FROM ic ORDER BY m DESC, category LIMIT 1)
SELECT lc.city, CAST(lc.m AS BIGINT) AS city_sold_quantity, li.category, CAST(li.m AS BIGINT) AS category_sold_quantity
FROM lc, li"""))
def q_leader(spark, sf):
    # one scan: (city, category) cells, then both leaders from the cells
    return Q.leader_then_leader(Q.unit_cells(cat(spark, sf, "city", "category", "sold_quantity"), "city", "category"))


@register("units_by_offer", with_catalog(""", u AS (SELECT offer_filled AS offer_type, CAST(sum(sold_quantity) AS BIGINT) AS units
  FROM prep GROUP BY offer_filled)
SELECT *, offer_type = (SELECT offer_type FROM u ORDER BY units DESC, offer_type LIMIT 1) AS is_leader FROM u"""))
def q_units_by_offer(spark, sf):
    return Q.units_by_offer(cat(spark, sf, "offer_type", "sold_quantity"))


@register("units_by_offer_raw", with_catalog(""", u AS (SELECT offer_type, CAST(sum(sold_quantity) AS BIGINT) AS units
  FROM prep WHERE offer_type IS NOT NULL GROUP BY offer_type)
SELECT *, offer_type = (SELECT offer_type FROM u ORDER BY units DESC, offer_type LIMIT 1) AS is_leader FROM u"""))
def q_units_by_offer_raw(spark, sf):
    # as the saved answer computed it: on the raw table, so rows without an offer are dropped
    return Q.units_by_offer(cat(spark, sf, "offer_type", "sold_quantity"), fill=False)


@register("daily_units_top_city", with_catalog(LEAD_CITY_SQL + """
SELECT date_added, CAST(sum(sold_quantity) AS BIGINT) AS units FROM prep
WHERE city = (SELECT city FROM lc) AND date_added IS NOT NULL GROUP BY date_added"""))
def q_daily_units(spark, sf):
    cells = Q.unit_cells(cat(spark, sf, "city", "date_added", "sold_quantity"), "city", "date_added")
    return Q.daily_units(cells, Q.leader(cells, "city")["k"])


@register("top_seller_revenue", with_catalog(f""", g AS ({_grp_sql('seller')})
SELECT seller, revenue FROM g ORDER BY revenue DESC, seller LIMIT 1"""))
def q_top_seller(spark, sf):
    return Q.top_revenue(cat(spark, sf, *REV, "seller"), "seller")


@register("total_revenue", with_catalog("SELECT CAST(sum(rev4) AS DOUBLE) AS total_revenue FROM prep"))
def q_total_revenue(spark, sf):
    return Q.total_revenue(cat(spark, sf, *REV))


@register("top_margin_category", with_catalog(""", g AS (SELECT category, avg(profit_margin_pct) AS m FROM prep
  WHERE category IS NOT NULL GROUP BY category)
SELECT category, m AS avg_margin FROM g ORDER BY m DESC, category LIMIT 1"""), rounded=["avg_margin"])
def q_top_margin(spark, sf):
    return Q.top_margin(cat(spark, sf, "category", "profit_margin_pct"))


@register("top_products", with_catalog("""SELECT product_id, product_name, sold_quantity FROM prep
ORDER BY sold_quantity DESC, product_id LIMIT 10"""))
def q_top_products(spark, sf):
    # the ranking columns come from lineitem alone: take the top 10 there, then look up the names
    li = table(spark, sf, "lineitem").withColumns({"__pid": line_column("product_id"),
                                                   "__q": line_column("sold_quantity")})
    top = Q.top_products(li, 10, "__q", "__pid").drop("__pid", "__q")
    return Q.top_products(catalog_view(spark, sf, ["product_id", "product_name", "sold_quantity"], fact=top), 10)


@register("units_by_city", with_catalog("""SELECT city, CAST(sum(sold_quantity) AS BIGINT) AS units FROM prep
WHERE city IS NOT NULL GROUP BY city"""))
def q_units_by_city(spark, sf):
    return Q.units_by(cat(spark, sf, "city", "sold_quantity"), "city")


# ------------------------------------------------------------------ leaders with null groups
NULLED_SQL = """, k AS (SELECT min(category) AS kc, min(city) AS kt, min(seller) AS ks, min(offer_filled) AS ko,
  min(strftime(date_added, '%Y-%m')) AS km FROM prep),
h AS (SELECT p.*, (category = kc OR city = kt OR seller = ks OR offer_filled = ko OR strftime(date_added, '%Y-%m') = km) AS hit
  FROM prep p, k),
x AS (SELECT category, city, seller, offer_filled AS offer_type, strftime(date_added, '%Y-%m') AS month, stock,
  CASE WHEN NOT hit THEN rev4 END AS rev4, CASE WHEN NOT hit THEN sold_quantity END AS sold,
  CASE WHEN NOT hit THEN rating END AS rating, CASE WHEN NOT hit THEN delivery_time_min END AS mins,
  CASE WHEN NOT hit THEN profit_margin_pct END AS margin FROM h)"""


def _leader_sql(question: str, dim: str, agg: str) -> str:
    g = f"(SELECT {dim} AS n, {agg} AS v FROM x GROUP BY {dim})"
    return f"""SELECT '{question}' AS question, (SELECT n FROM {g} WHERE v IS NOT NULL ORDER BY v DESC, n LIMIT 1) AS best,
  (SELECT max(v) FROM {g}) AS best_value, (SELECT n FROM {g} WHERE v IS NOT NULL ORDER BY v, n LIMIT 1) AS worst,
  (SELECT min(v) FROM {g}) AS worst_value"""


_SUM_REV, _SUM_SOLD = "CAST(coalesce(sum(rev4), 0) AS DOUBLE)", "CAST(coalesce(sum(sold), 0) AS DOUBLE)"


@register("leaders_with_null_groups", with_catalog(NULLED_SQL + "\n" + "\nUNION ALL\n".join([
    _leader_sql("city revenue", "city", _SUM_REV), _leader_sql("seller revenue", "seller", _SUM_REV),
    _leader_sql("month revenue", "month", _SUM_REV), _leader_sql("category revenue", "category", _SUM_REV),
    _leader_sql("offer units", "offer_type", "avg(c)").replace("FROM x GROUP", "FROM (SELECT category, offer_type, avg(sold) AS c FROM x GROUP BY ALL) GROUP"),
    _leader_sql("category rating", "category", "avg(rating)"),
    _leader_sql("city minutes", "city", "-avg(mins)"),
    _leader_sql("category ratio", "category", "coalesce(sum(sold), 0) * 1.0e0 / (sum(stock) + 1)"),
    _leader_sql("category margin", "category", "avg(margin)"),
    _leader_sql("offer total", "offer_type", _SUM_SOLD),
    _leader_sql("city units", "city", _SUM_SOLD)])), rounded=["best_value", "worst_value"])
def q_null_leaders(spark, sf):
    """D3, E2, E3, E12, E13, E15, E19, F2, F3, F5, F7 on a catalogue in which one category, city,
    seller, offer and month have no measures: their means are no leaders, their sums are 0."""
    df = cat(spark, sf, *REV, "category", "city", "seller", "offer_type", "date_added", "stock", "rating",
             "delivery_time_min", "delivery_status", "profit_margin_pct").withColumn("offer_type", offer_filled())
    month = F.date_format("date_added", "yyyy-MM")
    low = df.agg(F.struct(*[F.min(c).alias(c) for c in ("category", "city", "seller", "offer_type")], F.min(month).alias("month"))).scalar()
    hit = reduce(lambda a, b: a | b, [F.col(c) == low[c] for c in ("category", "city", "seller", "offer_type")] + [month == low["month"]])
    # eleven questions read these rows: one join, written
    df = written(df.withColumns({c: F.when(~hit, F.col(c)) for c in (*REV, "rating", "delivery_time_min", "profit_margin_pct")}))

    def row(question, t, best, best_value, worst=None, worst_value=None):
        pick = lambda c, kind: (F.lit(None) if c is None else c if not isinstance(c, str) else F.col(c)).cast(kind)
        return t.select(F.lit(question).alias("question"), pick(best, "string").alias("best"), pick(best_value, "double").alias("best_value"),
                        pick(worst, "string").alias("worst"), pick(worst_value, "double").alias("worst_value"))

    ext = D.kpi_extremes(df, ["city", "seller"])
    ends = ("top_name", "top_revenue", "bottom_name", "bottom_revenue")
    points = E.speed_vs_rating(df)
    least = lambda t, dim, v: t.agg(F.min(F.struct(v, dim))["" + dim]).scalar()
    units, offers = Q.units_by(df, "city"), Q.units_by_offer(df, fill=False)
    margins = df.groupBy("category").agg(F.avg("profit_margin_pct").alias("m"))
    by_offer = E.offer_effect(df).groupBy("offer_type").agg(F.avg("avg_units").alias("m")).where("m IS NOT NULL")
    return reduce(lambda a, b: a.unionByName(b), [
        row("city revenue", ext.where("dimension = 'city'"), *ends), row("seller revenue", ext.where("dimension = 'seller'"), *ends),
        row("month revenue", E.monthly_takeaway(E.monthly_trend(df)), "peak_month", "peak_revenue", "low_month", "low_revenue"),
        row("category revenue", E.revenue_by_takeaway(E.revenue_by(df, "category"), "category"), "top", "top_revenue", "bottom", "bottom_revenue"),
        row("offer units", E.offer_takeaway(E.offer_effect(df)), "best_offer", by_offer.agg(F.max("m")).scalar(),
            least(by_offer, "offer_type", "m"), by_offer.agg(F.min("m")).scalar()),
        row("category rating", E.rating_takeaway(E.rating_by(df)), "best", "best_rating", "worst", "worst_rating"),
        row("city minutes", E.speed_takeaway(points), "fastest", -F.col("fastest_minutes"), "slowest", -F.col("slowest_minutes")),
        row("category ratio", E.sold_vs_stock_takeaway(E.sold_vs_stock(df)), "at_risk", "at_risk_ratio", "overstocked", "overstocked_ratio"),
        row("category margin", Q.top_margin(df), "category", "avg_margin", least(margins.where("m IS NOT NULL"), "category", "m"),
            margins.agg(F.min("m")).scalar()),
        row("offer total", offers.where("is_leader"), "offer_type", "units", least(offers, "offer_type", "units"), offers.agg(F.min("units")).scalar()),
        row("city units", Q.leader_then_leader(df), "city", "city_sold_quantity", least(units, "city", "units"), units.agg(F.min("units")).scalar()),
    ])
