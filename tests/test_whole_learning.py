"""Registered queries learn from all training rows, and the ways of learning agree."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shelfspark.operators import logistic as L
from shelfspark.operators import models as I
from shelfspark.operators import prep as H
from shelfspark.operators import search as S
from shelfspark.plans import queries_ml as Q
from tests.conftest import SF_MID, SF_SMALL
from tests.test_boosting import frame


def test_post_launch_model_learns_from_all_training_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "POST_LAUNCH_PARAMS", {"rounds": 1, "depth": 2, "rate": 0.1})
    rows = Q._split(Q._features(spark, SF_MID, "post"))
    n = rows.where("split = 'train'").count()
    assert n > 20_000 and Q._post_model(rows).stages[-1].trees[0].cover[0] == n


@pytest.mark.parametrize("name", ["boosted_grid_search", "boosted_random_search", "logistic_grid_search", "model_comparison",
                                  "post_launch_attribution", "post_launch_scores", "production_runs", "scenario_scores", "stream_scores"])
def test_no_query_picks_learning_rows(spark, monkeypatch, name):
    from shelfspark.plans import registry
    few, forest = {"rounds": 1, "depth": 2, "rate": 0.1}, I.forest
    monkeypatch.setattr(I, "POST_LAUNCH_PARAMS", few)
    monkeypatch.setattr(I.train_pre_launch, "__defaults__", (I.REFERENCE_DATE, few, None, True))
    monkeypatch.setattr(I.production_training, "__defaults__", ("catalogue_models", I.REFERENCE_DATE, few, few, None, True))
    monkeypatch.setattr(I, "BOOSTED_GRID", {"rounds": [1], "depth": [2], "rate": [0.1], "leaves": [3]})
    monkeypatch.setattr(I, "forest", lambda: forest(2, 2))
    monkeypatch.setattr(I, "boosted", lambda *a, keep=I.boosted, **kw: keep(*a, **{**kw, "rounds": 1}))

    def refuse(*a, **kw):
        raise AssertionError("learning rows are cut")

    for module, what in ((H, "first_rows"), (I, "first_rows"), (S, "among_first")):
        monkeypatch.setattr(module, what, refuse, raising=False)
    assert registry.load_all()[name].fn(spark, SF_SMALL).count()


@pytest.mark.parametrize("train_rows", [None, 300])
def test_search_by_jobs_equals_search_in_tasks(spark, monkeypatch, train_rows):
    df = frame(spark, 800)
    maps = S.maps_of({"rounds": [2, 3], "depth": [3], "rate": [0.4], "leaves": [5]})
    near = sorted(map(tuple, S.staged_search(df, maps, train_rows, 2).collect()))
    monkeypatch.setattr(S, "IN_TASK_CELLS", 0)
    assert np.allclose(sorted(map(tuple, S.staged_search(df, maps, train_rows, 2).collect())), near) and len(near) == 2


def test_rows_without_a_label_neither_learn_nor_count(spark):
    df = frame(spark, 700)
    maps = S.maps_of({"rounds": [2], "depth": [3], "rate": [0.4], "leaves": [5]})
    more = df.unionByName(df.limit(90).withColumn("label", F.lit(None).cast("double")))
    # the same features, so the same bins
    assert abs(S.staged_search(df, maps, None, 3).first()["cv_macro_f1"] - S.staged_search(more, maps, None, 3).first()["cv_macro_f1"]) < 0.02


def test_optima_equal_single_fits(spark):
    df = frame(spark, 900).cache()
    rows = df.withColumn("values", vector_to_array("features"))
    problems = [L.Problem(f, penalty, both) for f in range(3) for penalty in (0.5, 1e-3) for both in (False, True)]
    for p, got in zip(problems, L.optima(rows, problems, 4, 200)):
        learn = df.where(F.col("fold") != p.fold)
        est = I.logistic_penalised(1.0, 1.0, max_iter=200) if p.penalise_intercept else I.logistic(1.0, 1.0, max_iter=200)
        model = est.setRegParam(p.penalty).setTol(1e-9).fit(I.mirrored(I.with_constant(learn)) if p.penalise_intercept else learn)
        want = model.coefficients.toArray() if p.penalise_intercept else np.append(model.coefficients.toArray(), model.intercept)
        assert np.allclose(got, want, atol=2e-4)
    nowhere = rows.withColumn("values", F.transform("values", lambda v: v * float("nan")))
    with pytest.raises(ValueError, match="NaN"):  # as Spark's learner does
        L.optima(nowhere, problems[:2], 4, 5)
