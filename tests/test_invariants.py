"""Invariants of the insight tables on the driver's tables."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import insights as E
from shelfspark.operators import kpi as D
from shelfspark.sources.catalog import catalog_view
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def cat(spark):
    return catalog_view(spark, SF_SMALL).cache()


def test_pareto_ends_at_100(cat):
    p = E.pareto(cat).orderBy("position").collect()
    assert abs(p[-1]["cum_pct"] - 100.0) < 1e-9
    assert all(a["cum_pct"] <= b["cum_pct"] for a, b in zip(p, p[1:]))
    t = E.pareto_takeaway(E.pareto(cat)).first()
    assert t["n_head"] + t["n_rest"] == t["n_total"] == len(p)


def test_quadrants_partition_categories(cat):
    q = E.demand_supply_quadrant(cat)
    assert q.count() == cat.select("category").distinct().count()
    assert set(r[0] for r in q.select("quadrant").collect()) <= {"Reorder Now", "Healthy", "Overstocked", "Phase Out"}


def test_scores_in_range(cat):
    sc = E.scorecard(cat).agg(F.min("score"), F.max("score")).first()
    assert 0.0 <= sc[0] <= sc[1] <= 100.0


def test_grid_complete(cat):
    n_city = cat.select("city").distinct().count()
    n_cat = cat.select("category").distinct().count()
    assert E.cross_grid(cat).count() == n_city * n_cat


def test_kpis_consistent(cat):
    counts = D.kpi_counts(cat).first()
    assert counts["n_products"] == cat.count()
    tot = D.kpi_totals(cat).first()
    assert abs(tot["on_time_pct"] + tot["delayed_pct"] - 100.0) < 1e-9
    units = E.revenue_by(cat, "city").agg(F.sum("units")).first()[0]
    assert units == tot["total_units"]


def test_name_list_caps_display_only(cat):
    r = D.name_list(cat, "seller", 9).first()
    n = cat.select("seller").distinct().count()
    assert r["n_shown"] == min(9, n) and r["n_more"] == max(n - 9, 0)


def test_histogram_and_class_distribution_totals(cat):
    from shelfspark.operators import profile as B
    h = B.histogram(cat, "final_price", 30).orderBy("bin").collect()
    assert len(h) == 30 and sum(r["n"] for r in h) == cat.where(F.col("final_price").isNotNull()).count()
    assert all(a["bin_hi"] <= b["bin_lo"] + 1e-9 for a, b in zip(h, h[1:]))
    d = B.class_distribution(cat).collect()
    assert sum(r["n"] for r in d) == cat.count() and abs(sum(r["pct"] for r in d) - 100.0) < 1e-9
