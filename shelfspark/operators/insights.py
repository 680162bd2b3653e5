"""E: dashboard insight queries. Each has a data table and a one-row takeaway.

Group keys never include nulls (pandas ``groupby`` drops them). Money is summed
exactly (DECIMAL terms), so totals do not depend on partitioning. Extremes use
``best_key`` (one aggregate, ties to the smaller key) instead of one-task windows;
one-row values are attached with scalar subqueries instead of cross joins. A small
aggregate that an operator reads more than once (its table plus a median or mean
of it) is written once with ``materialize_small``, so the catalogue is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.common import (
    band, best_key, exact_sum, money_decimal, names_where, pct_true, safe_div, unit_sum, unpack_best,
)
from shelfspark.functions.features import offer_filled, revenue
from shelfspark.plans.grid import complete_grid, wide_grid
from shelfspark.plans.quantiles import bucket_quantiles, numeric_bounds
from shelfspark.plans.reuse import materialize_small
from shelfspark.plans.windows import running_count, running_sums

# Fixed values of the dashboard: colour bands, the Pareto line, the correlation cut, line points.
DELIVERY_BANDS = ([70.0, 85.0], ["red", "amber", "green"])
RATING_BANDS = ([3.5, 4.0], ["low", "mid", "high"])
PARETO_CUT = 80.0
HURTS_R = -0.1
FIT_POINTS = 100


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def _resum(c: str) -> Column:
    """Exact re-sum of a double that already holds a 4-decimal exact sum."""
    return F.coalesce(F.sum(F.col(c).cast("decimal(38,4)")), F.lit(0)).cast("double")


# ---------------------------------------------------------------- E1, E2
def monthly_trend(df: DataFrame) -> DataFrame:
    """Revenue and units by calendar month ``yyyy-MM``."""
    return (df.where(F.col("date_added").isNotNull())
            .groupBy(F.date_format("date_added", "yyyy-MM").alias("month"))
            .agg(exact_sum(revenue()).alias("revenue"),
                 unit_sum("sold_quantity").alias("units")))


def monthly_takeaway(monthly: DataFrame) -> DataFrame:
    """peak/low month, mean, first/last month, direction and distance from the mean."""
    peak, low = best_key("revenue", "month", True), best_key("revenue", "month", False)
    r = monthly.agg(peak.alias("p"), low.alias("l"), F.avg("revenue").alias("avg_revenue"),
                    F.min(F.struct("month", "revenue")).alias("f"),
                    F.max(F.struct("month", "revenue")).alias("z"))
    pm, pv = unpack_best(F.col("p"), True)
    lm, lv = unpack_best(F.col("l"), False)
    avg = F.col("avg_revenue")
    return r.select(
        pm.alias("peak_month"), pv.alias("peak_revenue"), lm.alias("low_month"),
        lv.alias("low_revenue"), avg,
        F.col("f.month").alias("first_month"), F.col("f.revenue").alias("first_revenue"),
        F.col("z.month").alias("last_month"), F.col("z.revenue").alias("last_revenue"),
        F.when(F.col("z.revenue") > F.col("f.revenue"), "up").otherwise("down").alias("trend"),
        ((safe_div(pv, avg) - 1) * 100).alias("peak_above_avg_pct"),
        ((1 - safe_div(lv, avg)) * 100).alias("low_below_avg_pct"),
    )


# ---------------------------------------------------------------- E3, E6, F9
def revenue_by(df: DataFrame, dim: str) -> DataFrame:
    """Revenue and units per ``dim``."""
    return (_keyed(df, dim).groupBy(dim)
            .agg(exact_sum(revenue()).alias("revenue"),
                 unit_sum("sold_quantity").alias("units")))


def revenue_by_takeaway(table: DataFrame, dim: str) -> DataFrame:
    """Top and bottom key, and how many times the bottom the top earns (0 if bottom <= 0)."""
    r = table.agg(best_key("revenue", dim, True).alias("t"), best_key("revenue", dim, False).alias("b"))
    tk, tv = unpack_best(F.col("t"), True)
    bk, bv = unpack_best(F.col("b"), False)
    return r.select(tk.alias("top"), tv.alias("top_revenue"), bk.alias("bottom"),
                    bv.alias("bottom_revenue"),
                    F.when(bv > 0, tv / bv).otherwise(F.lit(0.0)).alias("top_to_bottom"))


def city_revenue(df: DataFrame, dim: str = "city") -> DataFrame:
    """Revenue per city flagged below the (unweighted) mean of the city sums."""
    t = materialize_small(revenue_by(df, dim))
    mean = t.agg(F.avg("revenue")).scalar()
    return t.withColumn("below_avg", F.col("revenue") < mean)


def city_takeaway(table: DataFrame, dim: str = "city") -> DataFrame:
    """Mean city revenue, cities below it (number and names), share of the top two."""
    top2 = table.orderBy(F.col("revenue").desc(), F.col(dim).asc()).limit(2)
    top2_sum = top2.agg(_resum("revenue")).scalar()
    return table.agg(
        F.avg("revenue").alias("avg_revenue"),
        F.count_if(F.col("below_avg")).alias("n_below_avg"),
        names_where(F.col("below_avg"), dim).alias("below_avg_names"),
        _resum("revenue").alias("total_revenue"),
    ).select("avg_revenue", "n_below_avg", "below_avg_names",
             (safe_div(top2_sum, F.col("total_revenue")) * 100).alias("top2_share_pct"))


# ---------------------------------------------------------------- E4, E5
def pareto(df: DataFrame, dim: str = "brand", cut: float = PARETO_CUT) -> DataFrame:
    """Keys by revenue (desc, key asc) with running share; ``is_head`` marks the
    keys up to one past the ``cut`` % line (position <= count of cum_pct <= cut).

    The running sum is distributed (range slices + per-slice offsets) and exact.
    """
    g = _keyed(df, dim).groupBy(dim).agg(F.coalesce(F.sum(money_decimal(revenue())), F.lit(0)).alias("_rev"))
    order = [F.col("_rev").desc(), F.col(dim).asc()]
    ranked = running_sums(g, {"_cum": "_rev", "_pos": F.lit(1).cast("bigint")}, order)
    total = ranked.agg(F.sum("_rev")).scalar()  # read from the checkpointed rows, no second scan
    ranked = ranked.select(
        dim, F.col("_rev").cast("double").alias("revenue"),
        F.col("_cum").cast("double").alias("cum_revenue"),
        (safe_div(F.col("_cum").cast("double"), total.cast("double")) * 100).alias("cum_pct"),
        (F.col("_pos") - 1).alias("position"))
    head_n = ranked.agg(F.count_if(F.col("cum_pct") <= cut)).scalar()
    return ranked.withColumn("is_head", F.col("position") <= head_n)


def pareto_takeaway(p: DataFrame) -> DataFrame:
    """E5: number of head keys, total, remaining, top key with its share, top-3 share."""
    total = F.max("cum_revenue")
    return p.agg(
        F.count_if("is_head").alias("n_head"),
        F.count(F.lit(1)).alias("n_total"),
        F.min(F.struct("position", p.columns[0])).alias("first"),
        F.max(F.when(F.col("position") == 0, F.col("revenue"))).alias("_top1"),
        F.max(F.when(F.col("position") <= 2, F.col("cum_revenue"))).alias("_top3"),
        total.alias("_total"),
    ).select("n_head", "n_total", (F.col("n_total") - F.col("n_head")).alias("n_rest"),
             F.col("first")[p.columns[0]].alias("top_key"),
             (safe_div(F.col("_top1"), F.col("_total")) * 100).alias("top_share_pct"),
             (safe_div(F.col("_top3"), F.col("_total")) * 100).alias("top3_share_pct"))


# ---------------------------------------------------------------- E7, E8
def cross_grid(df: DataFrame, row: str = "city", col: str = "category", agg: Column | None = None,
               value: str = "revenue", fill=0.0) -> DataFrame:
    """Complete row x column grid, long form, missing cells = ``fill``.

    ``agg`` is the cell aggregate (default: exact revenue sum), named ``value``.
    """
    cell = agg if agg is not None else exact_sum(revenue())
    cells = _keyed(df, row, col).groupBy(row, col).agg(cell.alias(value))
    return complete_grid(materialize_small(cells), row, col, value, fill)


def cross_grid_wide(df: DataFrame, row: str = "city", col: str = "category") -> DataFrame:
    """E7 (display form): one column per ``col`` value, missing cells = 0 (a pivot with a
    checked value list, run as one aggregation)."""
    return wide_grid(df, row, col, exact_sum(revenue()), 0.0)


def grid_weakest(grid: DataFrame, row_revenue: DataFrame | None = None, row: str = "city",
                 col: str = "category") -> DataFrame:
    """Lowest grid cell overall (row asc, column asc on ties) and lowest cell
    among the top-2 rows by revenue (higher-revenue row first, then column).

    Row revenue defaults to the exact re-sum of the grid's cells, so the
    catalogue is aggregated once.
    """
    if row_revenue is None:
        row_revenue = grid.groupBy(row).agg(_resum("revenue").alias("revenue"))
    order = [F.col("revenue").desc(), F.col(row).asc()]
    top2 = (row_revenue.orderBy(*order).limit(2)  # two rows: the window below is bounded
            .select(row, F.row_number().over(Window.orderBy(*order)).alias("_r")))
    overall = grid.agg(F.min(F.struct("revenue", row, col)).alias("o"))
    weakest = (grid.join(F.broadcast(top2), row)
               .agg(F.min(F.struct("revenue", "_r", col, row)).alias("w"))).select("w").scalar()
    return overall.select(
        F.col(f"o.{row}").alias("min_row"), F.col(f"o.{col}").alias("min_col"),
        F.col("o.revenue").alias("min_revenue"),
        weakest[row].alias("top_min_row"), weakest[col].alias("top_min_col"),
        weakest["revenue"].alias("top_min_revenue"))


# ---------------------------------------------------------------- E9
def delivery_by_city(df: DataFrame, dim: str = "city") -> DataFrame:
    """On-time % (null status counts as not on time), mean minutes, colour band."""
    cuts, labels = DELIVERY_BANDS
    return (_keyed(df, dim).groupBy(dim)
            .agg(pct_true(F.col("delivery_status") == "On-Time").alias("on_time_pct"),
                 F.avg("delivery_time_min").alias("avg_time"))
            .withColumn("band", band("on_time_pct", cuts, labels)))


def delivery_takeaway(table: DataFrame, dim: str = "city") -> DataFrame:
    """Best and worst key by on-time %, keys below the first band cut (number and names)."""
    r = table.agg(best_key("on_time_pct", dim, True).alias("b"),
                  best_key("on_time_pct", dim, False).alias("w"),
                  F.count_if(F.col("on_time_pct") < DELIVERY_BANDS[0][0]).alias("n_below_70"),
                  names_where(F.col("on_time_pct") < DELIVERY_BANDS[0][0], dim).alias("below_70_names"))
    bk, bv = unpack_best(F.col("b"), True)
    wk, wv = unpack_best(F.col("w"), False)
    return r.select(bk.alias("best"), bv.alias("best_on_time_pct"), wk.alias("worst"),
                    wv.alias("worst_on_time_pct"), "n_below_70", "below_70_names")


# ---------------------------------------------------------------- E10, E11
def _medians(groups: DataFrame, *cols: str) -> list[Column]:
    """Interpolated median of each column over the groups; null if all its values are null."""
    bounds = materialize_small(numeric_bounds(groups, cols))
    found = {r["column"]: r["value"] for r in bucket_quantiles(groups, bounds, cols, [0.5]).collect()}  # one row per column
    return [F.lit(found.get(c)).cast("double") for c in cols]


def demand_supply_quadrant(df: DataFrame, dim: str = "category") -> DataFrame:
    """Group means of demand and stock against the medians of those means (>= is high).

    The medians are exact and distributed, so ``dim`` may have any number of groups.
    """
    q = materialize_small(_keyed(df, dim).groupBy(dim)
                          .agg(F.avg("demand_index").alias("avg_demand"), F.avg("stock").alias("avg_stock")))
    demand, stock = _medians(q, "avg_demand", "avg_stock")
    hi_d, hi_s = F.col("avg_demand") >= demand, F.col("avg_stock") >= stock
    quadrant = (F.when(hi_d & ~hi_s, "Reorder Now").when(hi_d & hi_s, "Healthy")
                .when(~hi_d & hi_s, "Overstocked").otherwise("Phase Out"))
    return q.withColumn("quadrant", quadrant)


def quadrant_counts(q: DataFrame, dim: str = "category") -> DataFrame:
    """E10 takeaway: keys per quadrant and their sorted names."""
    return q.groupBy("quadrant").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.collect_list(dim)), ", ").alias("names"))


def discount_margin(df: DataFrame, dim: str = "category") -> DataFrame:
    """Mean discount, mean margin, revenue per group; leakage zone = discount above
    and margin below their medians, safe zone = the reverse (strict comparisons)."""
    m = materialize_small(_keyed(df, dim).groupBy(dim)
                          .agg(F.avg("discount_pct").alias("avg_discount"),
                               F.avg("profit_margin_pct").alias("avg_margin"),
                               exact_sum(revenue()).alias("total_revenue")))
    discount, margin = _medians(m, "avg_discount", "avg_margin")
    zone = (F.when((F.col("avg_discount") > discount) & (F.col("avg_margin") < margin), "leakage")
            .when((F.col("avg_discount") < discount) & (F.col("avg_margin") > margin), "safe")
            .otherwise("other"))
    # listing order inside a zone: revenue desc, key asc
    ranked = running_count(m.withColumn("zone", zone), [F.col("total_revenue").desc(), F.col(dim).asc()],
                           partition=["zone"], out="zone_rank")
    return ranked.withColumn("zone_rank", F.col("zone_rank").cast("int"))


def discount_takeaway(table: DataFrame, dim: str = "category") -> DataFrame:
    """Names in the leakage zone (by revenue, highest first) and in the safe zone (by name)."""
    leak = F.when(F.col("zone") == "leakage", F.struct((-F.col("total_revenue")).alias("v"), F.col(dim).alias("k")))
    return table.agg(F.array_join(F.sort_array(F.collect_list(leak))["k"], ", ").alias("leakage_names"),
                     names_where(F.col("zone") == "safe", dim).alias("safe_names"))


# ---------------------------------------------------------------- E12
def offer_effect(df: DataFrame) -> DataFrame:
    """Mean units per (category, offer type); missing offers count as 'No Offer'."""
    return materialize_small(df.withColumn("offer_type", offer_filled())
                             .where(F.col("category").isNotNull())
                             .groupBy("category", "offer_type")
                             .agg(F.avg("sold_quantity").alias("avg_units")))


def offer_takeaway(cells: DataFrame) -> DataFrame:
    """Best and worst existing cell; offer type with the highest unweighted mean."""
    key = F.struct("category", "offer_type")
    r = cells.withColumn("_k", key).agg(best_key("avg_units", "_k", True).alias("b"),
                                        best_key("avg_units", "_k", False).alias("w"))
    offers = cells.groupBy("offer_type").agg(F.avg("avg_units").alias("m"))
    best_offer = offers.agg(best_key("m", "offer_type", True).alias("o")).select("o.k").scalar()
    return r.select(F.col("b.k.category").alias("best_category"), F.col("b.k.offer_type").alias("best_offer_cell"),
                    (-F.col("b.v")).alias("best_avg_units"),
                    F.col("w.k.category").alias("worst_category"), F.col("w.k.offer_type").alias("worst_offer_cell"),
                    F.col("w.v").alias("worst_avg_units"), best_offer.alias("best_offer"))


# ---------------------------------------------------------------- E13, E18
def rating_by(df: DataFrame, dim: str = "category", with_on_time: bool = False) -> DataFrame:
    """Mean rating, rated-row count and band per group."""
    cuts, labels = RATING_BANDS
    aggs = [F.avg("rating").alias("avg_rating"), F.count("rating").alias("n_rated")]
    if with_on_time:
        aggs.append(pct_true(F.col("delivery_status") == "On-Time").alias("on_time_pct"))
    return (_keyed(df, dim).groupBy(dim).agg(*aggs)
            .withColumn("band", band("avg_rating", cuts, labels)))


def rating_takeaway(table: DataFrame, dim: str = "category") -> DataFrame:
    """Best and worst group, unweighted mean of group means, groups below 3.5 (number and names)."""
    r = table.agg(best_key("avg_rating", dim, True).alias("b"),
                  best_key("avg_rating", dim, False).alias("w"),
                  F.avg("avg_rating").alias("overall_avg"),
                  F.count_if(F.col("avg_rating") < RATING_BANDS[0][0]).alias("n_low"),
                  names_where(F.col("avg_rating") < RATING_BANDS[0][0], dim).alias("low_names"))
    bk, bv = unpack_best(F.col("b"), True)
    wk, wv = unpack_best(F.col("w"), False)
    return r.select(bk.alias("best"), bv.alias("best_rating"), wk.alias("worst"),
                    wv.alias("worst_rating"), "overall_avg", "n_low", "low_names")


# ---------------------------------------------------------------- E14-E16
def speed_vs_rating(df: DataFrame, dim: str = "city") -> DataFrame:
    """Mean delivery minutes, mean rating and delayed % per group."""
    return (_keyed(df, dim).groupBy(dim)
            .agg(F.avg("delivery_time_min").alias("avg_delivery"),
                 F.avg("rating").alias("avg_rating"),
                 pct_true(F.col("delivery_status") == "Delayed").alias("delayed_pct")))


def linear_fit(points: DataFrame, x: str = "avg_delivery", y: str = "avg_rating") -> DataFrame:
    """Least-squares slope, intercept and r; null (not an error) for a constant x."""
    cov = F.covar_pop(y, x)
    slope = safe_div(cov, F.var_pop(x))
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), slope.alias("slope"),
        (F.avg(y) - slope * F.avg(x)).alias("intercept"),
        safe_div(cov, F.stddev_pop(x) * F.stddev_pop(y)).alias("r"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"))


def speed_takeaway(points: DataFrame, fit: DataFrame | None = None, dim: str = "city") -> DataFrame:
    """R, whether slower delivery hurts (r < -0.1), fastest and slowest group.

    r is computed in the same aggregate as the extremes (one pass over the points);
    ``fit`` is accepted for symmetry with ``linear_fit`` and not needed.

    Ties: fastest is the smaller key, slowest the larger (last in ascending order).
    """
    x, y = "avg_delivery", "avg_rating"
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))  # r over complete pairs, as in linear_fit
    r = points.agg(best_key(x, dim, False).alias("f"), F.max(F.struct(x, dim)).alias("s"),
                   safe_div(F.covar_pop(ys, xs), F.stddev_pop(xs) * F.stddev_pop(ys)).alias("r"))
    rv = F.col("r")
    return r.select(rv.alias("r"),
                    F.when(rv < HURTS_R, "hurts").otherwise("not the main driver").alias("direction"),
                    F.col("f.k").alias("fastest"), F.col("f.v").alias("fastest_minutes"),
                    F.col(f"s.{dim}").alias("slowest"), F.col("s.avg_delivery").alias("slowest_minutes"))


def fit_line(fit: DataFrame, n: int = FIT_POINTS) -> DataFrame:
    """``n`` evenly spaced points on the fitted line between x_min and x_max."""
    step = (F.col("x_max") - F.col("x_min")) / F.lit(max(n - 1, 1))
    pts = fit.select("slope", "intercept", "x_min", "x_max",
                     F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    x = F.when(F.col("i") == n - 1, F.col("x_max")).otherwise(F.col("x_min") + F.col("i") * step)
    return pts.withColumn("x", x).select(
        "i", "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y"))


# ---------------------------------------------------------------- E17
SCORE_METRICS = ["avg_rating", "on_time_pct", "avg_margin", "total_revenue"]


def score_metrics() -> dict[str, Column]:
    """The scorecard's four metrics as aggregates (name -> aggregate Column)."""
    return {"avg_rating": F.avg("rating"),
            "on_time_pct": pct_true(F.col("delivery_status") == "On-Time"),
            "avg_margin": F.avg("profit_margin_pct"),
            "total_revenue": exact_sum(revenue())}


def scorecard(df: DataFrame, dim: str = "seller", metrics: dict[str, Column] | None = None) -> DataFrame:
    """Per group metrics (default: rating, on-time %, margin, revenue); each min-max
    scaled (constant -> 0); score = mean of the available scaled metrics * 100,
    rounded half-even to 1 decimal."""
    metrics = metrics or score_metrics()
    names = list(metrics)
    raw = materialize_small(_keyed(df, dim).groupBy(dim).agg(*[a.alias(n) for n, a in metrics.items()]))
    bounds = raw.agg(F.struct(*[e for m in names for e in
                                (F.min(m).alias(f"{m}_lo"), F.max(m).alias(f"{m}_hi"))])).scalar()
    scaled = [F.coalesce(safe_div(F.col(m) - bounds[f"{m}_lo"], bounds[f"{m}_hi"] - bounds[f"{m}_lo"]),
                         F.when(F.col(m).isNotNull(), F.lit(0.0))) for m in names]
    total = scaled[0]
    for s in scaled[1:]:
        total = F.coalesce(total, F.lit(0.0)) + F.coalesce(s, F.lit(0.0))
    present = sum((F.col(m).isNotNull().cast("int") for m in names[1:]),
                  F.col(names[0]).isNotNull().cast("int"))
    score = safe_div(total, present) * 100
    return raw.withColumn("score", F.bround(score, 1))


def scorecard_takeaway(card: DataFrame, dim: str = "seller") -> DataFrame:
    """First and last of the board ordered by score desc, key asc."""
    r = card.agg(best_key("score", dim, True).alias("b"),
                 F.max(F.struct((-F.col("score")).alias("v"), F.col(dim).alias("k"))).alias("w"))
    return r.select(F.col("b.k").alias("best"), (-F.col("b.v")).alias("best_score"),
                    F.col("w.k").alias("worst"), (-F.col("w.v")).alias("worst_score"))


# ---------------------------------------------------------------- E19
def sold_vs_stock(df: DataFrame, dim: str = "category") -> DataFrame:
    """Units sold vs stock per group with sold / (stock + 1)."""
    return (_keyed(df, dim).groupBy(dim)
            .agg(unit_sum("sold_quantity").alias("total_sold"),
                 unit_sum("stock").alias("total_stock"))
            .withColumn("sold_to_stock", safe_div(F.col("total_sold"), F.col("total_stock") + 1)))


def sold_vs_stock_takeaway(table: DataFrame, dim: str = "category") -> DataFrame:
    """Group most at risk of stock-out (highest ratio) and most overstocked (lowest)."""
    r = table.agg(best_key("sold_to_stock", dim, True).alias("a"),
                  best_key("sold_to_stock", dim, False).alias("o"))
    ak, av = unpack_best(F.col("a"), True)
    ok, ov = unpack_best(F.col("o"), False)
    return r.select(ak.alias("at_risk"), av.alias("at_risk_ratio"),
                    ok.alias("overstocked"), ov.alias("overstocked_ratio"))
