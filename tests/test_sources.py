"""Dialogue log files, JSON records, display text and the catalogue view."""

import json

from pyspark.sql import functions as F

from shelfspark.functions import display as L
from shelfspark.operators import dialogue as G
from shelfspark.operators import insights as E
from shelfspark.sources import files as A
from shelfspark.sources.catalog import catalog_view, write_catalog
from tests.conftest import SF_SMALL


def test_dialogue_missing_corrupt_and_array(spark, tmp_path):
    assert A.read_dialogue(spark, str(tmp_path / "none.json")).count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert A.read_dialogue(spark, str(bad)).count() == 0
    good = tmp_path / "log.json"
    good.write_text(json.dumps([
        {"role": "user", "content": "q1", "code_executed": None, "timestamp": "t"},
        {"role": "assistant", "content": "a1", "code_executed": "x=1", "timestamp": "t"}]))
    rows = A.read_dialogue(spark, str(good)).orderBy("position").collect()
    assert [r["role"] for r in rows] == ["user", "assistant"] and rows[1]["code_executed"] == "x=1"
    assert [r["position"] for r in rows] == [0, 1]


def test_append_and_read_back(spark, tmp_path):
    folder = str(tmp_path / "log")
    ex = spark.createDataFrame([("e1", "q", "s", None, "c")],
                               "exchange_id string, question string, summary string, error string, code_executed string")
    flat = G.flatten_exchanges(ex, "2024-01-01T00:00:00+00:00")
    A.append_dialogue(flat, folder, ["exchange_id", "seq"])
    A.append_dialogue(flat, folder, ["exchange_id", "seq"])
    rows = A.read_dialogue(spark, folder).orderBy("position").collect()
    assert [r["position"] for r in rows] == [0, 1, 2, 3]
    assert [r["role"] for r in rows] == ["user", "assistant", "user", "assistant"]
    log = A.read_dialogue(spark, folder).withColumn("log_id", F.lit(0))
    pairs = G.pair_exchanges(log, "log_id", "position").collect()
    assert [(p["turn"], p["answer_turn"], p["answer"]) for p in pairs] == [(0, 1, "s"), (2, 3, "s")]


def test_to_records(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert json.loads(A.to_records(df).first()[0]) == {"x": 1, "y": "a"}


def test_unsafe_and_extract(spark):
    rows = [("```python\nimport os\nos.remove('x')\n```",), ("plain text",), ("```\nprint(1)\n```",)]
    df = G.extract_code(spark.createDataFrame(rows, "t string"), "t", "code")
    out = G.flag_unsafe_code(df, "code").collect()
    assert out[0]["code"] == "import os\nos.remove('x')" and out[0]["unsafe"]
    assert len(out[0]["unsafe_patterns"]) == 3
    assert out[2]["code"] == "print(1)" and not out[2]["unsafe"]


def test_answer_outcome(spark):
    df = spark.createDataFrame([("boom", None, "c", True, 3), ("", "s", "c", True, 3), ("", "s", "c", True, 0),
                                (None, "s", None, False, 0)],
                               "error string, summary string, code string, display_table boolean, n_result_rows int")
    assert [r["outcome"] for r in G.answer_outcome(df).collect()] == ["error", "table", "text", "chat"]


def test_display_text(spark):
    df = spark.createDataFrame([(509027130.44, 85.25, 3.9337)], "rev double, pct double, r double")
    r = df.select(L.money("rev"), L.percent("pct"), L.stars("r"), L.thousands("rev")).first()
    assert r[0] == "₹50.90 Crs" and r[1] == "85.3%" and r[2] == "★ 3.93" and r[3] == "509,027,130"
    names = spark.createDataFrame([("b",), ("a",)], "n string").agg(L.name_text("n")).first()[0]
    assert names == "a, b"
    none = spark.createDataFrame([], "n string").agg(L.name_text("n")).first()[0]
    assert none == "none"


def test_takeaway_text(spark):
    c = catalog_view(spark, SF_SMALL)
    points = E.speed_vs_rating(c)
    rows = {
        "monthly": E.monthly_takeaway(E.monthly_trend(c)), "category": E.revenue_by_takeaway(E.revenue_by(c, "category"), "category"),
        "pareto": E.pareto_takeaway(E.pareto(c)), "city": E.city_takeaway(E.city_revenue(c)),
        "grid": E.grid_weakest(E.cross_grid(c)), "delivery": E.delivery_takeaway(E.delivery_by_city(c)),
        "quadrant": E.quadrant_counts(E.demand_supply_quadrant(c)), "discount": E.discount_takeaway(E.discount_margin(c)),
        "offer": E.offer_takeaway(E.offer_effect(c)), "rating": E.rating_takeaway(E.rating_by(c)),
        "speed": E.speed_takeaway(points), "scorecard": E.scorecard_takeaway(E.scorecard(c)),
        "stock": E.sold_vs_stock_takeaway(E.sold_vs_stock(c)),
    }
    for kind, row in rows.items():
        text = L.takeaway_text(row, kind).first()[0]
        assert text and "null" not in text, kind
    assert rows["category"].first()["top"] in L.takeaway_text(rows["category"], "category").first()[0]


def test_write_catalog_roundtrip(spark, tmp_path):
    path = str(tmp_path / "catalog")
    view = catalog_view(spark, SF_SMALL)
    write_catalog(view, path)
    back = A.read_catalog(spark, path, fmt="parquet")
    assert back.count() == view.count()
    assert back.where(F.col("folder_month") == "1995-01").count() == view.where(
        F.date_format("date_added", "yyyy-MM") == "1995-01").count()


def test_pruned_view_equals_full_join(spark):
    full = catalog_view(spark, SF_SMALL).select("product_id", "category")
    pruned = catalog_view(spark, SF_SMALL, ["product_id", "category"])
    assert full.exceptAll(pruned).count() == 0 and pruned.exceptAll(full).count() == 0


def test_dashboard_tables_and_sql_view(spark):
    from shelfspark.operators.dashboard import dashboard_tables, filter_dates, register_catalog_view
    cat = catalog_view(spark, SF_SMALL)
    tables = dashboard_tables(cat, "1996-01-01", "1997-12-31")
    assert tables["kpi_counts"].first()["n_products"] == filter_dates(cat, "1996-01-01", "1997-12-31").count()
    months = [r["month"] for r in tables["monthly_trend"].collect()]
    assert min(months) >= "1996-01" and max(months) <= "1997-12"
    assert filter_dates(cat, "2030-01-01", "2030-12-31").count() == 0
    register_catalog_view(spark, cat)
    assert spark.sql("SELECT count(DISTINCT offer_type) FROM catalog").first()[0] == 4


def test_parsed_date(spark):
    from shelfspark.functions.features import parsed_date
    df = spark.createDataFrame([("2023-01-05 10:00:00",), ("2023-01-06",), ("junk",)], "d string")
    got = [r[0] for r in df.select(parsed_date("d")).collect()]
    assert str(got[0]) == "2023-01-05 10:00:00" and str(got[1]) == "2023-01-06 00:00:00" and got[2] is None


def test_written_catalog_gives_the_same_answers_and_prunes(spark, tmp_path):
    from shelfspark.operators import insights as E
    from shelfspark.operators.dashboard import filter_dates
    from shelfspark.sources.catalog import read_written_catalog
    path = str(tmp_path / "flat")
    view = catalog_view(spark, SF_SMALL)
    write_catalog(view, path)
    cols = ["category", "final_price", "sold_quantity"]
    flat = read_written_catalog(spark, path, cols, "1998-01-01", "1998-03-31")
    assert flat.columns == cols
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        flat.explain("formatted")
    parts = [ln for ln in buf.getvalue().splitlines() if ln.startswith("PartitionFilters")]
    assert parts and ">= 1998-01" in parts[0] and "<= 1998-03" in parts[0]
    key = lambda df: sorted(map(tuple, E.revenue_by(df, "category").collect()))
    assert key(flat) == key(filter_dates(view, "1998-01-01", "1998-03-31"))
    from shelfspark.operators.engineer import engineer_pre_launch
    assert filter_dates(engineer_pre_launch(view, "1995-01-01", keep=("date_added",)), "1998-01-01").count() > 0


def test_dangling_keys_lose_no_rows(spark, tmp_path):
    from shelfspark.operators import insights as E
    from shelfspark.operators import questions as Q
    for name in ("lineitem", "part", "supplier", "orders", "customer", "nation"):
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        (df.where("p_partkey > 5") if name == "part" else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    full = catalog_view(spark, str(tmp_path))
    n = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert full.count() == n == catalog_view(spark, str(tmp_path), ["product_id"]).count()
    cols = ["category", "final_price", "sold_quantity"]
    view = catalog_view(spark, str(tmp_path), cols).fillna("?", ["category"])
    total = Q.total_revenue(catalog_view(spark, str(tmp_path), cols[1:])).first()[0]
    assert abs(total - sum(r["revenue"] for r in E.revenue_by(view, "category").collect())) < 1e-3


def test_csv_integers_written_as_floats(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("product_id,sold_quantity,stock,shelf_life_days\na,5.0,7,30.0\nb,2.5,,NA\n")
    rows = {r["product_id"]: r for r in A.read_catalog(spark, str(p)).collect()}
    assert (rows["a"]["sold_quantity"], rows["a"]["stock"], rows["a"]["shelf_life_days"]) == (5, 7, 30)
    assert rows["b"]["sold_quantity"] is None and rows["b"]["stock"] is None and rows["b"]["shelf_life_days"] is None


def test_pre_launch_scenario_features(spark):
    from shelfspark.operators import engineer as C
    from shelfspark.schemas import PRE_CONTRACT
    cat = catalog_view(spark, SF_SMALL)
    scen = C.scenario_features(cat, "2001-09-01", "pre", "1995-01-01")
    assert scen.columns == ["product_id"] + [f.name for f in PRE_CONTRACT.fields]
    checked = C.conform(scen, "pre")
    assert checked.where(~F.col("success")).count() == 0
    r = scen.select("freshness_score", "days_since_added", "month_added").first()
    assert r["month_added"] == 9 and r["days_since_added"] == 2435 and 0 < r["freshness_score"] < 1
