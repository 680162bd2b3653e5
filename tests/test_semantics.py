"""One hand-made frame per value-semantics trap."""

import datetime as dt
import math

from pyspark.sql import functions as F

from shelfspark.functions import common as K
from shelfspark.functions import features as C
from shelfspark.operators import dialogue as G
from shelfspark.operators import insights as E
from shelfspark.operators import kpi as D
from shelfspark.operators import prep as H
from shelfspark.operators import questions as Q
from shelfspark.operators.evaluate import classification_metrics


def test_s1_null_keys_dropped(make_catalog):
    df = make_catalog([{"city": "X"}, {"city": None}, {"city": "Y"}])
    rows = E.revenue_by(df, "city").collect()
    assert sorted(r["city"] for r in rows) == ["X", "Y"]


def test_s2_null_status_counts_as_not_on_time(make_catalog):
    df = make_catalog([{"delivery_status": "On-Time"}, {"delivery_status": None}])
    assert D.kpi_totals(df).first()["on_time_pct"] == 50.0


def test_s3_null_rating_label_zero(spark, make_catalog):
    df = make_catalog([{"rating": None}, {"rating": 3.8}, {"rating": 3.79}])
    assert [r[0] for r in df.select(C.high_rating()).collect()] == [0, 1, 0]


def test_s4_nan_normalised(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert df.select(F.avg(K.nan_to_null("x"))).first()[0] == 2.0


def test_s5_zero_divisor_is_null(make_catalog):
    # date_added one day before the reference date: days_since_added + 1 == 0
    df = make_catalog([{"date_added": dt.datetime(2022, 12, 31)}])
    r = df.select(C.days_since_added("2023-01-01").alias("d"), C.review_density("2023-01-01").alias("rd")).first()
    assert r["d"] == -1 and r["rd"] is None


def test_s6_s7_ties_go_to_smaller_key(make_catalog):
    df = make_catalog([{"city": "B", "final_price": 10.0, "sold_quantity": 1},
                       {"city": "A", "final_price": 10.0, "sold_quantity": 1}])
    r = D.kpi_extremes(df, ["city"]).first()
    assert r["top_name"] == "A" and r["bottom_name"] == "A"


def test_s8_median_interpolates(make_catalog):
    # four categories: median of demand means lies between two of them
    rows = [{"category": c, "demand_index": d, "stock": s}
            for c, d, s in [("a", 10.0, 1), ("b", 20.0, 2), ("c", 30.0, 3), ("d", 40.0, 4)]]
    q = {r["category"]: r["quadrant"] for r in E.demand_supply_quadrant(make_catalog(rows)).collect()}
    assert q == {"a": "Phase Out", "b": "Phase Out", "c": "Healthy", "d": "Healthy"}
    # a group exactly on the median counts as high
    rows2 = rows[:3]
    q2 = {r["category"]: r["quadrant"] for r in E.demand_supply_quadrant(make_catalog(rows2)).collect()}
    assert q2["b"] == "Healthy"


def test_s9_whole_days_floor(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1, 23), dt.datetime(2023, 1, 2, 1)),
                                (dt.datetime(2023, 1, 2, 1), dt.datetime(2023, 1, 1, 23))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(C.whole_days(F.col("a"), F.col("b"))).collect()] == [0, -1]


def test_s10_score_rounds_half_even(make_catalog):
    df = make_catalog([{"seller": "s1"}])
    assert df.select(F.bround(F.lit(0.25), 1)).first()[0] == 0.2


def test_s11_grid_holes_are_zero_and_minimum(make_catalog):
    df = make_catalog([{"city": "X", "category": "A", "final_price": 5.0},
                       {"city": "X", "category": "B", "final_price": 7.0},
                       {"city": "Y", "category": "A", "final_price": 9.0}])
    grid = E.cross_grid(df)
    cells = {(r["city"], r["category"]): r["revenue"] for r in grid.collect()}
    assert cells[("Y", "B")] == 0.0 and len(cells) == 4
    w = E.grid_weakest(grid, E.revenue_by(df, "city")).first()
    assert (w["min_row"], w["min_col"], w["min_revenue"]) == ("Y", "B", 0.0)


def test_s12_mean_of_means_unweighted(make_catalog):
    rows = ([{"category": "A", "offer_type": "Coupon", "sold_quantity": 10}] * 3
            + [{"category": "B", "offer_type": "Coupon", "sold_quantity": 1}]
            + [{"category": "A", "offer_type": "Bundle", "sold_quantity": 6},
               {"category": "B", "offer_type": "Bundle", "sold_quantity": 6}])
    t = E.offer_takeaway(E.offer_effect(make_catalog(rows))).first()
    # Coupon: mean of (10, 1) = 5.5 < Bundle 6 although Coupon's row-weighted mean is 7.75
    assert t["best_offer"] == "Bundle"


def test_s14_constant_scaled_to_zero(make_catalog):
    df = make_catalog([{"seller": "only"}])
    r = E.scorecard(df).first()
    assert r["score"] == 0.0


def test_s15_unseen_category_minus_one(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    enc = H.ordinal_encoder(train, ["c"])
    out = enc.transform(spark.createDataFrame([("a",), ("b",), ("z",)], "c string"))
    assert [r["c_code"] for r in out.orderBy("c").collect()] == [0, 1, -1]


def test_s16_constant_x_fit_is_null(spark):
    pts = spark.createDataFrame([(10.0, 4.0), (10.0, 3.0)], "avg_delivery double, avg_rating double")
    r = E.linear_fit(pts).first()
    assert r["slope"] is None and r["r"] is None


def test_s17_one_class_metrics_are_zero(spark):
    pred = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    r = classification_metrics(pred).first()
    assert r["accuracy"] == 1.0 and r["f1"] == 1.0 and r["macro_f1"] == 0.5


def test_s18_strip_removes_newlines(spark):
    df = spark.createDataFrame([("\n  x = 1\n\t",)], "t string")
    assert df.select(K.strip_ws("t")).first()[0] == "x = 1"


def test_s19_empty_summary_falls_back_to_error(spark):
    ex = spark.createDataFrame([("e1", "q", "", "boom", None), ("e2", "q2", None, None, "code")],
                               "exchange_id string, question string, summary string, error string, code_executed string")
    rows = {(r["exchange_id"], r["role"]): r for r in G.flatten_exchanges(ex, "t").collect()}
    assert rows[("e1", "assistant")]["content"] == "boom"
    assert rows[("e2", "assistant")]["content"] == "" and rows[("e2", "user")]["code_executed"] is None


def test_s20_na_tokens(spark, tmp_path):
    from shelfspark.sources.files import read_catalog
    p = tmp_path / "cat.csv"
    p.write_text("product_id,offer_type,price,city,is_organic,date_added\n"
                 "a,None,NaN,NA,True,2023-01-05 00:00:00\n"
                 "b,Coupon,12.5,,False,2023-01-06 00:00:00\n")
    df = read_catalog(spark, str(p))
    rows = {r["product_id"]: r for r in df.collect()}
    assert rows["a"]["offer_type"] is None and rows["a"]["price"] is None and rows["a"]["city"] is None
    assert rows["a"]["is_organic"] is True and rows["b"]["price"] == 12.5 and rows["b"]["city"] is None
    assert rows["b"]["date_added"] == dt.datetime(2023, 1, 6)
    filled = D.prepare(df.select("offer_type")).collect()
    assert sorted(r[0] for r in filled) == ["Coupon", "No Offer"]


def test_empty_after_date_filter(make_catalog):
    df = make_catalog([{"date_added": dt.datetime(2023, 3, 1)}])
    empty = df.where(F.to_date("date_added").between("2024-01-01", "2024-02-01"))
    assert E.monthly_trend(empty).count() == 0
    assert Q.total_revenue(empty).first()["total_revenue"] == 0.0  # a sum over nothing is 0


def test_even_sized_rounding_and_ties_in_pareto(make_catalog):
    rows = [{"brand": b, "final_price": v, "sold_quantity": 1} for b, v in
            [("a", 40.0), ("b", 40.0), ("c", 10.0), ("d", 10.0)]]
    p = {r["brand"]: r for r in E.pareto(make_catalog(rows)).collect()}
    assert p["a"]["position"] == 0 and p["b"]["position"] == 1
    assert p["b"]["cum_pct"] == 80.0 and p["c"]["is_head"] and not p["d"]["is_head"]
    assert math.isclose(p["d"]["cum_pct"], 100.0)


def test_whole_days_ignore_session_zone_and_dst(spark):
    # 2023-03-12 is a 23-hour day in America/Los_Angeles; timestamp_ntz keeps it 24 hours
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([(dt.datetime(2023, 3, 12), dt.datetime(2023, 3, 13))],
                                   "a timestamp_ntz, b timestamp_ntz")
        assert df.select(C.whole_days(F.col("a"), F.col("b"))).first()[0] == 1
        assert df.select(F.date_format("a", "yyyy-MM")).first()[0] == "2023-03"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
