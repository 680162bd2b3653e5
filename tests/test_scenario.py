"""Scenario scores: one written catalogue, and requests cast without their checks."""

from shelfspark.operators import engineer as C
from shelfspark.operators import models as I
from shelfspark.plans import queries_ml as Q
from shelfspark.plans.queries_more import FIXTURE_REF_DATE
from shelfspark.sources.catalog import catalog_view
from tests.conftest import SF_SMALL


def test_scenario_joins_and_writes_the_catalogue_once(spark, monkeypatch):
    monkeypatch.setattr(I, "POST_LAUNCH_PARAMS", {"rounds": 1, "depth": 2, "rate": 0.1})
    seen, keep = [], Q.written
    monkeypatch.setattr(Q, "written", lambda df: seen.append(df.columns) or keep(df))
    got = Q.q_scenario(spark, SF_SMALL)
    assert seen == [[*Q.SOURCE["post"], "success"]]
    want = C.conform(C.scenario_features(catalog_view(spark, SF_SMALL), "2001-09-01", "post", FIXTURE_REF_DATE), "post").where("success")
    assert sorted(r[0] for r in got.select("product_id").collect()) == sorted(r[0] for r in want.select("product_id").collect())


def test_cast_requests_are_the_checked_ones(spark, make_catalog):
    cat = make_catalog([{}, {"price": None}, {"offer_type": "Bundle"}, {"shelf_life_days": None}])
    asked = C.scenario_features(cat, "2001-09-01", "post")
    checked = C.conform(asked, "post")
    good = checked.where("success").select("product_id")
    assert good.count() == 2
    want = checked.where("success").drop("success", "error")
    got = C.cast_requests(asked.join(good, "product_id", "left_semi"), "post")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
