"""Training, scoring and streaming: no oracle, so properties and round trips."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import engineer as C
from shelfspark.operators import evaluate as J
from shelfspark.operators import models as I
from shelfspark.operators import prep as H
from shelfspark.operators import scoring as K
from shelfspark.plans.queries_more import FIXTURE_REF_DATE
from shelfspark.schemas import CATEGORICAL, POST_CATEGORICAL, POST_CONTRACT, POST_NUMERIC, PRE_NUMERIC
from shelfspark.sources import store
from shelfspark.sources.catalog import catalog_view
from shelfspark.streaming.scoring import score_stream, start_scoring
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def feats(spark):
    return C.engineer_post_launch(catalog_view(spark, SF_SMALL), FIXTURE_REF_DATE).cache()


@pytest.fixture(scope="module")
def model(feats):
    return I.fit_pipeline(H.with_class_weights(feats, "label"), POST_CATEGORICAL, POST_NUMERIC,
                          I.boosted(5, 3, 0.1))


def test_split_shares_and_folds(feats):
    s = H.stratified_split(feats)
    n = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for lab in (0, 1):
        tot = n[(lab, "train")] + n[(lab, "test")]
        assert n[(lab, "train")] == round(0.8 * tot)
    folds = H.assign_folds(feats, k=5).groupBy("fold").count().collect()
    sizes = [r["count"] for r in folds]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2


def test_weights_sum_to_n(feats):
    w = H.with_class_weights(feats).agg(F.sum("weight"), F.count(F.lit(1))).first()
    assert abs(w[0] - w[1]) < 1e-6


def test_scores_are_probabilities_and_decisions(model, feats):
    out = K.decide(K.score(model, feats, keep=("product_id", "label")))
    r = out.agg(F.min("probability"), F.max("probability"), F.count(F.lit(1))).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] == feats.count()
    bad = out.where((F.col("is_high") != (F.col("probability") >= 0.45)) | (F.col("score") > 100))
    assert bad.count() == 0


def test_model_beats_majority_baseline(model, feats):
    pred = model.transform(feats)
    m = J.classification_metrics(pred).first()
    assert m["macro_f1"] > 0.5  # a constant predictor scores <= 0.5


def test_save_load_same_predictions(spark, model, feats, tmp_path):
    path = store.save_model(model, str(tmp_path / "m"))
    again = store.load_model(path)
    a = K.score(model, feats).orderBy("product_id").collect()
    b = K.score(again, feats).orderBy("product_id").collect()
    assert a == b


def test_runs_latest(spark, tmp_path):
    runs = str(tmp_path / "runs")
    store.log_run(spark, runs, "exp", "first", {"rounds": 5}, {"f1": 0.5}, "/m1")
    second = store.log_run(spark, runs, "exp", "second", {"rounds": 6}, {"f1": 0.6}, "/m2")
    latest = store.latest_run(store.read_runs(spark, runs), "exp").first()
    assert latest["run_id"] == second and latest["metrics"]["f1"] == 0.6
    assert store.latest_run(store.read_runs(spark, runs), "other").count() == 0
    with pytest.raises(LookupError):
        store.require_latest_model(spark, runs, "other")


def test_batch_equals_stream(spark, model, feats, tmp_path):
    src, sink, ckpt = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ckpt")
    requests = C.conform(feats, "post").select("product_id", *[f.name for f in POST_CONTRACT.fields])
    requests = requests.withColumn("price", F.when(F.col("product_id") == F.lit(
        feats.orderBy("product_id").first()["product_id"]), F.lit(None)).otherwise(F.col("price")))
    requests.write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = start_scoring(spark, model, src, schema, sink, ckpt)
    q.awaitTermination(120)
    streamed = spark.read.parquet(sink)
    batch = score_stream(model, spark.read.parquet(src))
    cols = ["product_id", "prediction", "probability", "is_high", "score", "confidence", "success", "error"]
    assert sorted(map(tuple, streamed.select(cols).collect()), key=str) == sorted(
        map(tuple, batch.select(cols).collect()), key=str)
    bad = streamed.where(~F.col("success")).collect()
    assert len(bad) == 1 and "price" in bad[0]["error"] and bad[0]["prediction"] is None


def test_compare_and_grid_search(spark):
    f = C.engineer_pre_launch(catalog_view(spark, SF_SMALL), FIXTURE_REF_DATE)
    s = H.stratified_split(f)
    train = H.with_class_weights(s.where("split = 'train'")).cache()
    preds = I.compare_estimators(train, s.where("split = 'test'"),
                                 {"lr": I.logistic(1.0, float(train.count())), "rf": I.forest(5, 3)},
                                 CATEGORICAL, PRE_NUMERIC)
    table = J.compare_models(preds).collect()
    assert sorted(r["model"] for r in table) == ["lr", "rf"]
    folded = H.with_class_weights(H.assign_folds(f, k=3))
    enc = I.fit_pipeline(folded, CATEGORICAL, PRE_NUMERIC, None)
    data = enc.transform(folded).select("features", F.col("label").cast("double"), "weight", "fold")
    grid = {"regParam": [1e-3, 1e-1], "maxIter": [5, 20]}
    cv = I.random_search(data, I.logistic(), grid, n=3, seed=1)
    best = I.best_params(cv, grid).collect()
    assert len(cv.avgMetrics) == 3 and {r["param"] for r in best} == {"regParam", "maxIter"}


def test_importance_and_contributions(spark, model, feats):
    names = I.feature_names(POST_CATEGORICAL, POST_NUMERIC)
    imp = J.feature_importance(model.stages[-1], names).collect()
    assert len(imp) == len(names) and abs(sum(r["importance"] for r in imp) - 1.0) < 1e-6
    scaled = model.transform(feats)
    contrib = J.linear_contributions(scaled, [1.0] * len(names), names).collect()
    assert len(contrib) == len(names) and all(r["mean_abs"] >= 0 for r in contrib)
    perm = J.permutation_importance(model, feats, ["delivery_time_min"], "product_id").collect()
    assert len(perm) == 1


def test_production_training_roundtrip(spark, tmp_path):
    from shelfspark.sources.catalog import catalog_view as cv
    cat = cv(spark, SF_SMALL)
    small = {"rounds": 2, "depth": 2, "rate": 0.1}
    runs = I.production_training(cat, str(tmp_path / "models"), str(tmp_path / "runs"), "exp",
                                 FIXTURE_REF_DATE, small, small)
    assert set(runs) == {"pre_launch_model", "post_launch_model"}
    paths = set()
    for name, feats in (("pre_launch_model", C.engineer_pre_launch(cat, FIXTURE_REF_DATE)),
                        ("post_launch_model", C.engineer_post_launch(cat, FIXTURE_REF_DATE))):
        own = store.require_latest_model(spark, str(tmp_path / "runs"), "exp", name)
        assert K.score(own, feats).count() == cat.count()
        paths.add(store.latest_run(store.read_runs(spark, str(tmp_path / "runs")), "exp", name).first()["model_path"])
    assert len(paths) == 2 and all(any(run in x for x in paths) for run in runs.values())
    model = store.require_latest_model(spark, str(tmp_path / "runs"), "exp")
    latest = store.latest_run(store.read_runs(spark, str(tmp_path / "runs")), "exp").first()
    assert latest["params"]["rounds"] == "2"
    feats = (C.engineer_post_launch(cat, FIXTURE_REF_DATE) if latest["name"] == "post_launch_model"
             else C.engineer_pre_launch(cat, FIXTURE_REF_DATE))
    assert K.score(model, feats).count() == cat.count()


def test_metrics_equal_duckdb_on_same_predictions(model, feats):
    import duckdb
    pdf = model.transform(feats).select(F.col("label").cast("int").alias("label"),
                                        F.col("prediction").cast("int").alias("prediction")).toPandas()
    con = duckdb.connect()
    con.register("p", pdf)
    tp, fp, fn, tn = con.execute("""SELECT count_if(label = 1 AND prediction = 1), count_if(label = 0 AND prediction = 1),
        count_if(label = 1 AND prediction = 0), count_if(label = 0 AND prediction = 0) FROM p""").fetchall()[0]
    acc = (tp + tn) / (tp + tn + fp + fn)
    p1, r1 = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
    f1 = 2 * p1 * r1 / (p1 + r1) if p1 + r1 else 0.0
    m = J.classification_metrics(model.transform(feats)).first()
    assert abs(m["accuracy"] - acc) < 1e-12 and abs(m["precision"] - p1) < 1e-12 and abs(m["f1"] - f1) < 1e-12
    cm = {(r["label"], r["prediction"]): r["n"] for r in J.confusion_matrix(model.transform(feats)).collect()}
    assert cm == {(1, 1): tp, (0, 1): fp, (1, 0): fn, (0, 0): tn}


def test_reference_search_spaces(spark):
    assert len(I.param_grid(I.boosted(), I.BOOSTED_GRID)) == 81
    assert len(I.param_grid(I.forest(), I.FOREST_GRID)) == 12
    g = I.logistic_grid(1000.0)
    assert len(g["regParam"]) == 4 and abs(g["regParam"][2] - 1e-3) < 1e-15


def test_tune_logistic(spark):
    f = C.engineer_pre_launch(catalog_view(spark, SF_SMALL), FIXTURE_REF_DATE)
    folded = H.with_class_weights(H.assign_folds(f, k=3))
    enc = I.fit_pipeline(folded, CATEGORICAL, PRE_NUMERIC, None)
    data = enc.transform(folded).select("features", F.col("label").cast("double"), "weight", "fold").cache()
    cv, grid = I.tune(data, "logistic", random_maps=2, folds=3)
    assert len(cv.avgMetrics) == 2 and I.best_params(cv, grid).count() == 1


def test_population_std_scaling(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    rows = [("a", 1.0, 10.0), ("b", 3.0, 10.0), ("a", 5.0, 10.0), ("b", 7.0, 10.0)]
    df = spark.createDataFrame(rows, "c string, x double, k double")
    m = I.fit_pipeline(df, ["c"], ["x", "k"], None, population_std=True)
    got = np.array([r[0] for r in m.transform(df).select(vector_to_array("features")).collect()])
    x = np.array([1.0, 3.0, 5.0, 7.0])
    assert np.allclose(got[:, 1], (x - x.mean()) / x.std())  # population std, as the reference
    assert np.allclose(got[:, 2], 0.0)  # constant column -> 0
    codes = np.array([0, 1, 0, 1], dtype=float)
    assert np.allclose(got[:, 0], (codes - codes.mean()) / codes.std())


def test_stream_in_several_micro_batches(spark, model, feats, tmp_path):
    src, sink, ckpt = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ckpt")
    requests = C.conform(feats, "post").select("product_id", *[f.name for f in POST_CONTRACT.fields])
    requests.repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = start_scoring(spark, model, src, schema, sink, ckpt, max_files_per_trigger=1)
    q.awaitTermination(180)
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(batches) >= 3
    streamed = spark.read.parquet(sink).select("product_id", "probability").orderBy("product_id").collect()
    batch = score_stream(model, spark.read.parquet(src)).select("product_id", "probability").orderBy("product_id").collect()
    assert streamed == batch


def test_bounded_search_scores_every_held_out_row(spark):
    f = C.engineer_pre_launch(catalog_view(spark, SF_SMALL), FIXTURE_REF_DATE, keep=("product_id",))
    folded = H.with_class_weights(H.assign_folds(f, k=3))
    enc = I.fit_pipeline(folded, CATEGORICAL, PRE_NUMERIC, None)
    data = enc.transform(folded).select("product_id", "features", F.col("label").cast("double"), "weight", "fold").cache()
    est, maps = I.logistic(), I.param_grid(I.logistic(), {"regParam": [1e-3, 1.0]})
    got = I.bounded_search(data, est, maps, 200, "product_id", folds=3).avgMetrics
    for i, m in enumerate(maps):
        f1 = []
        for k in range(3):
            first = data.orderBy(H.hash_order("product_id"), "product_id").limit(300).where(F.col("fold") != k)
            held = data.where(F.col("fold") == k)
            f1.append(J.classification_metrics(est.fit(first, m).transform(held)).first()["macro_f1"])
        assert abs(got[i] - sum(f1) / 3) < 1e-9


def test_grid_search_query_covers_all_rows(spark, monkeypatch):
    from shelfspark.plans import queries_ml as Q
    seen = []
    search = I.logistic_search
    monkeypatch.setattr(Q, "TRAIN_ROWS", 300)
    monkeypatch.setattr(I, "logistic_search", lambda data, *a, **kw: seen.append(data) or search(data, *a, **kw))
    assert Q.q_grid(spark, SF_SMALL).count() == 8
    n = catalog_view(spark, SF_SMALL).count()
    assert n > 300 and seen[0].count() == n and abs(seen[0].agg(F.sum("weight")).first()[0] - n) < 1e-6


def test_sampled_learner_encodes_and_scales_by_all_training_rows(spark, monkeypatch):
    import numpy as np

    from shelfspark.plans import queries_ml as Q
    monkeypatch.setattr(Q, "TRAIN_ROWS", 50)
    monkeypatch.setattr(I, "POST_LAUNCH_PARAMS", {"rounds": 1, "depth": 2, "rate": 0.1})
    got = Q._post_model(Q._split(Q._features(spark, SF_SMALL, "post")))
    train = Q._split(Q._features(spark, SF_SMALL, "post")).where("split = 'train'")
    want = I.fit_pipeline(train, POST_CATEGORICAL, POST_NUMERIC, None)
    codes = lambda m: sorted(map(tuple, m.stages[0].codes(spark).collect()))
    assert codes(got) == codes(want)
    assert np.allclose(got.stages[2].mean.toArray(), want.stages[2].mean.toArray())
    assert np.allclose(got.stages[2].std.toArray(), want.stages[2].std.toArray())


def test_dictionary_encoder(spark, tmp_path):
    from pyspark.ml import PipelineModel
    rows = [("b", "x"), ("a", None), ("é", "x"), ("a", "y'\"z"), (None, ""), ("B", "10"), ("b", "9")]
    df = spark.createDataFrame(rows, "p string, q string")
    model = H.ordinal_encode(df, ["p", "q"])
    values = {c: sorted({r[i] for r in rows if r[i] is not None}, key=lambda v: v.encode()) for i, c in enumerate("pq")}
    new = spark.createDataFrame([*rows, ("zz", "x"), ("a", "unseen")], df.schema)
    code = lambda c, v: values[c].index(v) if v in values[c] else -1
    want = sorted(((p, q, code("p", p), code("q", q)) for p, q in map(tuple, new.collect())), key=repr)
    assert sorted(map(tuple, model.transform(new).collect()), key=repr) == want
    model.write().overwrite().save(str(tmp_path / "enc"))
    again = PipelineModel.load(str(tmp_path / "enc"))
    assert sorted(map(tuple, again.transform(new).collect()), key=repr) == want
    own = sorted(map(tuple, H.label_encode(df, ["p"]).select("p", "p_code").collect()), key=repr)
    assert own == sorted(((p, code("p", p)) for p, _ in rows), key=repr)
    empty = H.ordinal_encode(df.limit(0), ["p"]).transform(df)
    assert {r["p_code"] for r in empty.collect()} == {-1}


def test_second_solver_penalises_the_intercept(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors
    r = np.random.default_rng(5)
    x = r.standard_normal((80, 2))
    y = (x[:, 0] + 1.5 + 0.7 * r.standard_normal(80) > 0).astype(float)
    w = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum())))
    df = I.with_constant(spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)], ["features", "label", "weight"]))
    for C_ in (0.1, 10.0):
        est = I.logistic_penalised(C_, float(w.sum()), max_iter=1000).setTol(1e-12)
        got = est.fit(I.mirrored(df)).coefficients.toArray()
        a, t = np.hstack([x, np.ones((80, 1))]), np.zeros(3)
        for _ in range(100):  # Newton on C * loss + |t|^2 / 2, the intercept included
            p = 1 / (1 + np.exp(-a @ t))
            grad = C_ * a.T @ (w * (p - y)) + t
            t = t - np.linalg.solve(C_ * (a.T * (w * p * (1 - p))) @ a + np.eye(3), grad)
        assert np.allclose(got, t, atol=1e-4)
    maps = I.logistic_maps(I.logistic(), 80.0)
    assert len(maps) == 8 and {m["solver"] for m, _ in maps} == {"lbfgs", "liblinear"}


def test_automatic_bins(spark):
    import numpy as np
    from shelfspark.operators import profile as B
    r = np.random.default_rng(6)
    for values, kind in ((np.round(r.standard_normal(500), 3), "double"), (r.integers(0, 9, 300), "int"),
                         (r.exponential(3, 64), "double"), (r.integers(0, 10**6, 200), "long")):
        rows = [(v.item(),) for v in values] + [(None,)]
        df = spark.createDataFrame(rows, f"x {kind}")
        whole = values.dtype.kind == "i"
        counts = [len(np.histogram_bin_edges(values, rule)) - 1 for rule in ("fd", "sturges")]
        assert B.auto_bins(df, "x") == (min(max(counts), int(np.ptp(values))) if whole else max(counts))
        assert sum(x["n"] for x in B.auto_histogram(df, "x").collect()) == len(values)
    assert B.auto_bins(spark.createDataFrame([(0.0,)] * 90 + [(1.0,)], "x double"), "x") == 8  # no IQR: log2(91) + 1
    assert B.auto_bins(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x") == 1
    assert [tuple(x)[-1] for x in B.auto_histogram(spark.createDataFrame([(None,)], "x double"), "x").collect()] == [0]
