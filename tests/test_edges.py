"""Edge frames of FIXTURES.md section 4 not covered by the trap tests."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import dialogue as G
from shelfspark.operators import insights as E


def test_bottom_revenue_zero_ratio(make_catalog):
    df = make_catalog([{"category": "A", "final_price": 10.0}, {"category": "B", "final_price": 0.0}])
    t = E.revenue_by_takeaway(E.revenue_by(df, "category"), "category").first()
    assert t["bottom"] == "B" and t["top_to_bottom"] == 0.0


def test_total_revenue_zero_pareto(make_catalog):
    df = make_catalog([{"brand": "a", "final_price": 0.0}, {"brand": "b", "final_price": 0.0}])
    rows = E.pareto(df).orderBy("position").collect()
    assert [r["brand"] for r in rows] == ["a", "b"] and all(r["cum_pct"] is None for r in rows)


def test_all_delivery_times_equal(make_catalog):
    df = make_catalog([{"city": c, "delivery_time_min": 20, "rating": r} for c, r in [("X", 4.0), ("Y", 3.0)]])
    fit = E.linear_fit(E.speed_vs_rating(df)).first()
    assert fit["slope"] is None and fit["r"] is None and fit["n"] == 2
    assert E.fit_line(E.linear_fit(E.speed_vs_rating(df)), 5).where(F.col("y").isNotNull()).count() == 0


def test_nulls_everywhere(make_catalog):
    df = make_catalog([{"city": None, "seller": None, "offer_type": None, "delivery_status": None, "rating": None},
                       {"city": "X", "seller": "s", "rating": 4.0}])
    assert E.rating_by(df, "seller").count() == 1
    assert E.delivery_by_city(df).first()["on_time_pct"] == 100.0
    offers = {r["offer_type"] for r in E.offer_effect(df).collect()}
    assert offers == {"No Offer"}


def test_equal_grid_cells_tie_break(make_catalog):
    df = make_catalog([{"city": "X", "category": "B", "final_price": 5.0},
                       {"city": "X", "category": "A", "final_price": 5.0},
                       {"city": "Y", "category": "A", "final_price": 9.0},
                       {"city": "Y", "category": "B", "final_price": 9.0}])
    w = E.grid_weakest(E.cross_grid(df), E.revenue_by(df, "city")).first()
    assert (w["min_row"], w["min_col"]) == ("X", "A")
    # top-2 rows: Y (higher revenue) first, so its cells come before X's on equal values? X is lower anyway
    assert (w["top_min_row"], w["top_min_col"]) == ("X", "A")


def test_dialogue_sequence(spark):
    roles = ["user", "user", "assistant", "assistant", "system", "user"]
    log = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(roles)],
                                "conv_id long, turn long, role string, content string")
    pairs = G.pair_exchanges(log).collect()
    assert [(p["turn"], p["answer_turn"]) for p in pairs] == [(1, 2)]
    left = G.drop_exchange(log, 1, 0).orderBy("turn").collect()
    assert [r["turn"] for r in left] == [0, 3, 4, 5]
    assert G.drop_exchange(log, 1, 5).count() == 6  # no such pair: nothing removed


def test_two_fenced_blocks_first_wins(spark):
    text = "intro\n```python\na = 1\n```\nmore\n```python\nb = 2\n```"
    df = G.extract_code(spark.createDataFrame([(text,)], "t string"), "t")
    assert df.first()["code"] == "a = 1"


@pytest.mark.parametrize("snippet", [
    "import os", "import sys", "import subprocess", "import shutil", "open('f')", "os.path", "sys.argv",
    "subprocess.run", "shutil.copy", "eval('1')", "__import__('x')", "f.write('x')", "p.unlink()",
    "l.remove(1)", "rmdir", "rmtree",
])
def test_each_unsafe_pattern(spark, snippet):
    df = G.flag_unsafe_code(spark.createDataFrame([(snippet,), ("df.groupby('a').sum()",)], "code string"))
    flags = [r["unsafe"] for r in df.collect()]
    assert flags == [True, False]


def test_cross_grid_custom_aggregate_and_scorecard_metrics(make_catalog):
    df = make_catalog([{"city": "X", "category": "A", "sold_quantity": 3},
                       {"city": "Y", "category": "B", "sold_quantity": 4}])
    g = {(r["city"], r["category"]): r["units"] for r in
         E.cross_grid(df, agg=F.sum("sold_quantity"), value="units", fill=0).collect()}
    assert g == {("X", "A"): 3, ("X", "B"): 0, ("Y", "A"): 0, ("Y", "B"): 4}
    card = {r["seller"]: r["score"] for r in E.scorecard(
        make_catalog([{"seller": "a", "sold_quantity": 1}, {"seller": "b", "sold_quantity": 9}]),
        metrics={"units": F.sum("sold_quantity")}).collect()}
    assert card == {"a": 0.0, "b": 100.0}


def test_medians_over_many_groups(spark):
    import statistics

    from shelfspark.operators.insights import discount_margin, quadrant_counts, demand_supply_quadrant
    rows = [(f"g{i % 501:03d}", float(i * 37 % 1009), i * 53 % 997, float(i * 11 % 101), float(i * 7 % 89), float(i % 13), i % 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "category string, demand_index double, stock int, discount_pct double, profit_margin_pct double, final_price double, sold_quantity int")
    q = [r.asDict() for r in demand_supply_quadrant(df).collect()]
    d, s = (statistics.median(r[c] for r in q) for c in ("avg_demand", "avg_stock"))
    name = {(True, False): "Reorder Now", (True, True): "Healthy", (False, True): "Overstocked", (False, False): "Phase Out"}
    assert len(q) == 501 and all(r["quadrant"] == name[r["avg_demand"] >= d, r["avg_stock"] >= s] for r in q)
    assert sum(r["n"] for r in quadrant_counts(demand_supply_quadrant(df)).collect()) == 501
    m = [r.asDict() for r in discount_margin(df).collect()]
    for zone in {r["zone"] for r in m}:
        own = sorted((r for r in m if r["zone"] == zone), key=lambda r: (-r["total_revenue"], r["category"]))
        assert [r["zone_rank"] for r in own] == list(range(1, len(own) + 1))
    none = df.withColumn("demand_index", df.demand_index * None)
    assert {r["quadrant"] for r in demand_supply_quadrant(none).collect()} == {"Phase Out"}
