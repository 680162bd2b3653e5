"""The dashboard and question entry points: one prepared, date-filtered catalogue
feeding every KPI and insight table. Building the tables runs jobs: the operators write
their small aggregates once (``materialize_small``); ask for single operators to avoid that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.features import in_date_range
from shelfspark.operators import insights as E
from shelfspark.operators import kpi as D
from shelfspark.plans.reuse import written
from shelfspark.sources.catalog import MONTH_FOLDER, month_range


def filter_dates(df: DataFrame, start=None, end=None) -> DataFrame:
    """C4: keep rows whose date_added falls in [start, end] by date; may be empty.

    The date predicate is pushed to the Parquet scan (row groups are skipped by
    their min/max). On a table of ``write_catalog`` that still has its month folder
    column, the same range on the month prunes folders.
    """
    out = df.where(in_date_range(start, end))
    return out.where(month_range(start, end)) if MONTH_FOLDER in df.columns else out


def dashboard_tables(catalog: DataFrame, start=None, end=None, cache: bool = True) -> dict[str, DataFrame]:
    """Every panel of the dashboard for one date range, keyed by panel name.

    The prepared, filtered catalogue is written once to the checkpoint folder because all
    panels read it, each its own columns (``cache=False``: every panel reads the source).
    """
    df = filter_dates(D.prepare(catalog), start, end)
    if cache:
        df = written(df)
    monthly = E.monthly_trend(df)
    category = E.revenue_by(df, "category")
    city = E.city_revenue(df)
    grid = E.cross_grid(df)
    delivery = E.delivery_by_city(df)
    pareto = E.pareto(df)
    quadrant = E.demand_supply_quadrant(df)
    offers = E.offer_effect(df)
    ratings = E.rating_by(df, "category")
    speed = E.speed_vs_rating(df)
    fit = E.linear_fit(speed)
    card = E.scorecard(df)
    return {
        "kpi_counts": D.kpi_counts(df), "kpi_totals": D.kpi_totals(df), "kpi_extremes": D.kpi_extremes(df),
        "monthly_trend": monthly, "monthly_takeaway": E.monthly_takeaway(monthly),
        "category_revenue": category, "category_takeaway": E.revenue_by_takeaway(category, "category"),
        "brand_pareto": pareto, "pareto_takeaway": E.pareto_takeaway(pareto),
        "city_revenue": city, "city_takeaway": E.city_takeaway(city),
        "city_category_grid": grid, "grid_weakest": E.grid_weakest(grid, city),
        "delivery_by_city": delivery, "delivery_takeaway": E.delivery_takeaway(delivery),
        "demand_supply_quadrant": quadrant, "quadrant_counts": E.quadrant_counts(quadrant),
        "discount_margin": E.discount_margin(df),
        "offer_effect": offers, "offer_takeaway": E.offer_takeaway(offers),
        "category_rating": ratings, "rating_takeaway": E.rating_takeaway(ratings),
        "speed_vs_rating": speed, "speed_fit": fit, "speed_takeaway": E.speed_takeaway(speed, fit),
        "fit_line": E.fit_line(fit), "seller_scorecard": card, "scorecard_takeaway": E.scorecard_takeaway(card),
        "seller_rating": E.rating_by(df, "seller", with_on_time=True),
    }


def register_catalog_view(spark: SparkSession, catalog: DataFrame, name: str = "catalog") -> str:
    """Expose the prepared catalogue to ``spark.sql`` (ad hoc questions in SQL)."""
    D.prepare(catalog).createOrReplaceTempView(name)
    return name
