"""Plan properties behind the scale claims (formatted physical plans)."""

import contextlib
import io
import re

import __spark_entry__ as se
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _scans(plan: str) -> dict:
    out, cur = {}, None
    for line in plan.splitlines():
        if line.startswith("Location:"):
            m = re.search(r"/([a-z_]+)\.parquet", line)
            cur = m.group(1) if m else None
        elif line.startswith("ReadSchema:") and cur:
            out.setdefault(cur, []).append(line)
        elif line.startswith("PushedFilters:") and cur:
            out.setdefault(cur + ":filters", []).append(line)
    return out


def test_column_pruning_reaches_the_scan(spark):
    s = _scans(_plan(se.queries()["category_revenue"](spark, SF_SMALL)))
    assert set(k for k in s if ":" not in k) == {"lineitem", "part"}  # no other dimension joined
    assert all(line.count(":") - 1 <= 4 for line in s["lineitem"])  # 4 of 11 lineitem columns


def test_date_filter_pushed_to_orders(spark):
    s = _scans(_plan(se.queries()["kpi_totals_1998_1999"](spark, SF_SMALL)))
    assert any("GreaterThanOrEqual(o_orderdate" in f and "LessThan(o_orderdate" in f for f in s["orders:filters"])


def test_top_n_joins_never_shuffle_a_dimension(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no dimension could be broadcast
    try:
        for name in ("top_products", "catalog_preview"):
            plan = _plan(se.queries()[name](spark, SF_SMALL))
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stratified_split_labels_rows_map_side(spark):
    from pyspark.sql import functions as F

    from shelfspark.functions.features import high_rating
    from shelfspark.operators.prep import stratified_split
    from shelfspark.sources.catalog import catalog_view
    lab = catalog_view(spark, SF_SMALL, ["product_id", "rating"]).select("product_id", high_rating().alias("label"))
    plan = _plan(stratified_split(lab).select("product_id", "split"))
    main = plan.split("===== Subqueries =====")[0]
    assert "Window" not in main and "BroadcastHashJoin" in main
    assert stratified_split(lab).where(F.col("split") == "train").count() > 0
