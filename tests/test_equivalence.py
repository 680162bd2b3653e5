"""Equivalences: alternative forms and distributed plans agree with plain forms."""

import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.operators import dialogue as G
from shelfspark.operators import insights as E
from shelfspark.operators import kpi as D
from shelfspark.operators import questions as Q
from shelfspark.plans.grid import wide_grid
from shelfspark.plans.quantiles import exact_quantiles
from shelfspark.plans.windows import next_row, running_sum
from shelfspark.sources.catalog import catalog_view
from tests.conftest import SF_SMALL


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_delayed_share_join_equals_single_pass(spark):
    df = catalog_view(spark, SF_SMALL, ["seller", "delivery_status"])
    a = Q.delayed_share_by(df, "seller").select("seller", "total_orders", "delayed_orders", "delayed_pct")
    b = Q.delayed_share_by(df, "seller", single_pass=True).select("seller", "total_orders", "delayed_orders",
                                                                    "delayed_pct")
    assert _sorted(a) == _sorted(b)


def test_grid_long_equals_wide(spark):
    df = D.prepare(catalog_view(spark, SF_SMALL, ["city", "category", "final_price", "sold_quantity"]))
    long = {(r["city"], r["category"]): r["revenue"] for r in E.cross_grid(df).collect()}
    wide = wide_grid(df, "city", "category", F.sum(F.col("revenue").cast("decimal(18,4)")).cast("double"), 0.0)
    for r in wide.collect():
        d = r.asDict()
        city = d.pop("city")
        for cat, v in d.items():
            assert abs(long[(city, cat)] - v) < 1e-6


def test_total_equals_sum_of_categories(spark):
    df = catalog_view(spark, SF_SMALL, ["category", "final_price", "sold_quantity"])
    total = Q.total_revenue(df).first()[0]
    parts = E.revenue_by(df, "category").agg(F.sum(F.col("revenue").cast("decimal(38,4)"))).first()[0]
    assert abs(total - float(parts)) < 1e-6


def _greedy_pairs(roles):
    out, i = [], 0
    while i < len(roles) - 1:
        if roles[i] == "user" and roles[i + 1] == "assistant":
            out.append(i)
            i += 2
        else:
            i += 1
    return out


@settings(max_examples=15, deadline=None, derandomize=True)
@given(st.lists(st.sampled_from(["user", "assistant", "system"]), min_size=0, max_size=30))
def test_pairing_equals_greedy_loop(spark, roles):
    rows = [(7, i * 3, r, f"t{i}") for i, r in enumerate(roles)]  # gaps in turn numbers
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    got = sorted(r["turn"] // 3 for r in G.pair_exchanges(log).collect())
    assert got == _greedy_pairs(roles)


def test_next_row_across_buckets(spark):
    rows = [(c, t, f"v{c}-{t}") for c in range(3) for t in random.Random(c).sample(range(200), 40)]
    df = spark.createDataFrame(rows, "g long, t long, v string")
    got = next_row(df, ["g"], "t", ["v"], bucket_size=16)
    w = Window.partitionBy("g").orderBy("t")
    want = df.withColumn("next_t", F.lead("t").over(w)).withColumn("next_v", F.lead("v").over(w))
    assert _sorted(got.select("g", "t", "v", "next_t", "next_v")) == _sorted(
        want.select("g", "t", "v", "next_t", "next_v"))


def test_running_sum_matches_window(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", "c"]), i, rnd.randint(0, 100)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = running_sum(df, "v", [F.col("v").desc(), F.col("i").asc()], partition=["k"], out="cum", slices=7)
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("i").asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("cum", F.sum("v").over(w))
    assert _sorted(got.select("k", "i", "v", "cum")) == _sorted(want.select("k", "i", "v", "cum"))


def test_exact_quantiles_match_pandas(spark):
    rnd = random.Random(3)
    pdf = pd.DataFrame({"x": [rnd.random() * 10 for _ in range(301)],
                        "y": [float(rnd.randint(0, 5)) for _ in range(301)]})
    df = spark.createDataFrame(pdf)
    got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x", "y"], [0.1, 0.25, 0.5, 0.9]).collect()}
    for c in ("x", "y"):
        for p in (0.1, 0.25, 0.5, 0.9):
            assert abs(got[(c, p)] - pdf[c].quantile(p)) < 1e-9


def test_hash_sliced_rank_matches_row_number(spark):
    from shelfspark.plans.windows import hash_slice, running_count
    rows = [(i % 3, f"k{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "label int, key string").withColumn("h", F.md5("key"))
    got = running_count(df, [F.col("h").asc(), F.col("key").asc()], partition=["label"], out="r",
                        slices=5, slice_by=hash_slice(F.col("h"), 5), with_totals=True)
    w = Window.partitionBy("label").orderBy("h", "key")
    want = df.withColumn("r", F.row_number().over(w)).withColumn("r_total", F.count(F.lit(1)).over(
        Window.partitionBy("label")))
    assert _sorted(got.select("label", "key", "r", "r_total")) == _sorted(want.select("label", "key", "r", "r_total"))


def test_kpi_extremes_grouping_sets_equal_per_dimension(spark):
    df = D.prepare(catalog_view(spark, SF_SMALL, ["city", "seller", "final_price", "sold_quantity"]))
    both = {r["dimension"]: r for r in D.kpi_extremes(df, ["city", "seller"]).collect()}
    for d in ("city", "seller"):
        g = E.revenue_by(df, d).collect()
        top = min(g, key=lambda r: (-r["revenue"], r[d]))
        bot = min(g, key=lambda r: (r["revenue"], r[d]))
        assert (both[d]["top_name"], both[d]["bottom_name"]) == (top[d], bot[d])
        assert abs(both[d]["top_revenue"] - top["revenue"]) < 1e-6


def test_next_row_three_levels_hot_key(spark):
    # one hot key with sparse, widely spread positions: several bucket levels are exercised
    rnd = random.Random(7)
    turns = sorted(rnd.sample(range(100000), 300))
    rows = [(0, t, f"v{t}") for t in turns] + [(1, t, f"w{t}") for t in range(5)]
    df = spark.createDataFrame(rows, "g long, t long, v string")
    got = next_row(df, ["g"], "t", ["v"], bucket_size=8, levels=3)
    w = Window.partitionBy("g").orderBy("t")
    want = df.withColumn("next_t", F.lead("t").over(w)).withColumn("next_v", F.lead("v").over(w))
    assert _sorted(got.select("g", "t", "v", "next_t", "next_v")) == _sorted(
        want.select("g", "t", "v", "next_t", "next_v"))


def test_split_threshold_matches_window_definition(spark):
    from shelfspark.operators import prep as H
    rows = [(0, f"a{i}") for i in range(257)] + [(1, "only")] + [(2, f"c{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "label int, key string")
    for frac, digits in [(0.8, 1), (0.4, 2), (0.5, 5)]:
        t = H.class_thresholds(df, "label", "key", frac, 42, digits)
        h = F.md5(F.concat(F.col("key"), F.lit(":42")))
        w = Window.partitionBy("label").orderBy(h, "key")
        want = (df.withColumn("r", F.row_number().over(w))
                .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
                .withColumn("split", F.when(F.col("r") <= F.round(F.col("n") * frac), "train").otherwise("test")))
        got = H.stratified_split(df, "label", "key", frac, 42)
        assert _sorted(got.select("label", "key", "split")) == _sorted(want.select("label", "key", "split"))
        assert t.count() <= 3


def test_describe_approx_close_to_exact(spark):
    from shelfspark.operators.profile import describe_numeric
    df = catalog_view(spark, SF_SMALL, ["price", "rating", "stock"])
    exact = {r["column"]: r for r in describe_numeric(df).collect()}
    approx = {r["column"]: r for r in describe_numeric(df, approx=True).collect()}
    for c in ("price", "rating", "stock"):
        e, a = exact[c], approx[c]
        assert e["count"] == a["count"] and e["min"] == a["min"] and e["max"] == a["max"]
        assert abs(e["mean"] - a["mean"]) < 1e-6 * max(1.0, abs(e["mean"]))
        spread_ = e["max"] - e["min"]
        for q in ("q25", "q50", "q75"):
            assert abs(e[q] - a[q]) <= 0.02 * spread_
