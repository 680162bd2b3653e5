"""Rewritten steps give what the plain ones give, and plans do not repeat work."""

import hashlib

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.operators import attribution as A
from shelfspark.operators import boosting as B
from shelfspark.operators import engineer as C
from shelfspark.operators import models as I
from shelfspark.operators import prep as H
from shelfspark.operators.evaluate import compare_models
from shelfspark.plans import queries_ml as Q
from shelfspark.plans import registry
from shelfspark.plans.queries_more import FIXTURE_REF_DATE
from shelfspark.schemas import CATALOG
from shelfspark.session import hashed_joins
from shelfspark.sources.catalog import catalog_view
from shelfspark.sources.files import conform_catalog
from tests.conftest import SF_SMALL


def _boosted(width, rounds, depth, leaves, n=3000):
    rng = np.random.default_rng(width)
    kinds = rng.choice([2, 5, 12, 64], width)
    draw = lambda k: (rng.random((k, width)) * kinds).astype(np.uint8)
    bins = draw(n)
    label = ((bins / kinds) @ rng.normal(size=width) + rng.normal(size=n) * 0.3 > 0).astype(float)
    start, trees = B.boost_in_task(bins, label, np.ones(n), 64, rounds, depth, 0.1, leaves)
    return start, trees, draw(20_000)


@pytest.mark.parametrize("depth,leaves", [(4, 16), (8, 50), (B.NO_DEPTH_LIMIT, 100)])
def test_leaf_tables_equal_a_walk(depth, leaves):
    start, trees, bins = _boosted(9, 6, depth, leaves)
    trees.append(B.Tree(*np.zeros((4, 1), np.int64), np.array([0.25]), np.ones(1), np.zeros(1)))  # a lone leaf
    want, after = np.full(len(bins), start), {}
    for k, t in enumerate(trees, 1):
        want += t.value[t.leaf_of(bins)]
        after[k] = want.copy()
    tables = B.LeafTables(trees, 9)
    assert np.array_equal(tables.add(np.full(len(bins), start), bins), want)
    for k, margin in tables.stages(start, bins, [2, len(trees)]):
        assert np.array_equal(margin, after[k])


def test_attribution_tables_equal_patterns(monkeypatch):
    monkeypatch.setattr(A, "TABLE_FEATURES", 4)  # some leaves are too deep for a table
    _, trees, bins = _boosted(14, 4, B.NO_DEPTH_LIMIT, 60)
    paths = [p for t in trees for p in A.leaf_paths(t)]
    own = A.Attribution(trees, 14)
    assert own.deep and own.tables
    assert np.allclose(own.of(bins), A.contributions(paths, bins, 14), atol=1e-12)


def test_first_rows_and_split_without_a_second_write(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("product_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    want = sorted(H.first_rows(df, 100).collect()), sorted(H.stratified_split(df).collect())

    def refuse(_):
        raise AssertionError("written again")

    monkeypatch.setattr(H, "written", refuse)
    assert (sorted(H.first_rows(df, 100, reread=True).collect()), sorted(H.stratified_split(df, reread=True).collect())) == want


def test_fit_without_persist_moves_no_rows(spark, monkeypatch):
    df = spark.range(200).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), F.rand(1).alias("x"))
    want = [r[0] for r in I.fit_pipeline(df, ["k"], ["x"], None).transform(df).orderBy("x").select("features").collect()]

    def refuse(_):
        raise AssertionError("rows dealt out")

    monkeypatch.setattr(I, "spread", refuse)
    got = [r[0] for r in I.fit_pipeline(df, ["k"], ["x"], None, persist=False).transform(df).orderBy("x").select("features").collect()]
    assert np.allclose([v.toArray() for v in got], [v.toArray() for v in want])


def test_linear_counts_equal_transform(spark):
    df = spark.range(600).select(
        "id", array_to_vector(F.array(F.randn(1), F.randn(2), F.randn(3))).alias("features"), F.when(F.col("id") % 50 != 7, F.col("id") % 2).cast("double").alias("label"),
        F.lit(1.0).alias("weight"), (F.floor(F.col("id") / 2) % 2).cast("int").alias("fold")).localCheckpoint()
    rows = I.with_constant(df)
    est = I.logistic(1.0, 1.0)
    named = I.logistic_maps(est, 600.0, cs=[1])
    learn = I.mirrored(rows.where("label IS NOT NULL"))
    models = [[est.fit(learn.where(F.col("fold") != f), m) for _, m in named] for f in range(2)]
    got = {(r["fold"], r["map"]): r for r in I.linear_counts(rows, models).collect()}
    assert len(got) == 4
    for f in range(2):
        for i in range(2):
            pred = models[f][i].transform(rows.where(F.col("fold") == f)).select(F.lit("m").alias("model"), "label", "prediction")
            r = got[f, i]
            assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == pred.where("label IS NOT NULL").count()
            want = compare_models(pred).first()
            assert r["tp"] + r["tn"] == round(want["accuracy"] * (r["tp"] + r["fp"] + r["fn"] + r["tn"]))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_csv_tokens_are_looked_up_once_a_column(spark):
    raw = spark.createDataFrame([("5.0", "NA", "1")], "stock string, price string, num_reviews string")
    out = conform_catalog(raw)
    assert _plan(out).count("#N/A N/A") <= 3
    assert out.select("stock", "price", "num_reviews").first() == (5, None, 1)


def test_kpi_cards_join_the_catalogue_once(spark):
    registry.load_all()
    assert "Join" not in _plan(registry.run("kpi_cards", spark, SF_SMALL).select("total_revenue"))


def test_scenario_plan_holds_no_request_checks(spark):
    registry.load_all()
    assert "invalid or missing" not in _plan(registry.run("scenario_scores", spark, SF_SMALL))


def test_features_are_made_from_a_narrow_written_catalogue(spark, monkeypatch):
    seen = []
    keep = Q.written
    monkeypatch.setattr(Q, "written", lambda df: seen.append(set(df.columns)) or keep(df))
    for stage, make in (("post", C.engineer_post_launch), ("pre", C.engineer_pre_launch)):
        got = Q._features(spark, SF_SMALL, stage)
        want = make(catalog_view(spark, SF_SMALL), FIXTURE_REF_DATE)
        assert seen.pop() <= set(CATALOG.names) and not seen
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_a_coarse_histogram_finds_the_exact_row(spark):
    keys = [f"k{i}" for i in range(3000)] + ["k5", "k5", None]
    df = spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "product_id string, label int")
    order = sorted((hashlib.md5(f"{k}:42".encode()).hexdigest(), k) for k in keys if k is not None)
    assert H.first_rows(df, 1, reread=True).count() == 0  # the null key comes first
    for n in (2, 77, 2999):
        assert sorted(r[0] for r in H.first_rows(df, n, reread=True).where("product_id IS NOT NULL").collect()) == sorted(k for h, k in order if (h, k) <= order[n - 2])
    assert 2 * 16 ** H.HASH_BUCKET_DIGITS <= 10_000  # a task's histogram stays small beside its rows


def test_shuffled_joins_hash_the_small_side(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        with hashed_joins(spark):
            df = spark.range(5000).join(spark.range(50).withColumnRenamed("id", "k"), F.col("id") % 60 == F.col("k"), "left")
            assert df.collect() and "ShuffledHashJoin" in df._jdf.queryExecution().executedPlan().toString()
        again = spark.range(5000).join(spark.range(50).withColumnRenamed("id", "k"), F.col("id") % 60 == F.col("k"), "left")
        assert again.collect() and "ShuffledHashJoin" not in again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)


def test_plain_values_equal_the_pipeline(spark):
    df = spark.range(300).select(F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), F.col("id") % 11)).alias("k"), F.rand(3).alias("x"),
                                 F.lit(2.5).alias("same"), (F.col("id") % 5).cast("int").alias("n"))
    holes = df.withColumn("x", F.when(F.col("n") != 3, F.col("x")))
    for fit_on, rows in ((df, df), (df, holes), (holes, holes)):
        prep = I.fit_pipeline(fit_on, ["k"], ["x", "same", "n"], None)
        got = I.with_values(prep.transform(rows), PipelineModel(stages=prep.stages[1:])).select("values", "features").collect()
        assert got and all(np.array_equal(r["values"], r["features"].toArray(), equal_nan=True) for r in got)


def test_folds_of_written_rows_are_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i}" if i % 90 else None, i % 3 if i % 70 else None, i) for i in range(900)] + [("k7", 1, -1)] * 2,
                               "product_id string, label int, v int")
    want = sorted(H.assign_folds(df).drop("v").collect(), key=repr)
    w = Window.partitionBy("label").orderBy(H.hash_order("product_id"), "product_id")
    plain = df.select("product_id", "label", ((F.row_number().over(w) - 1) % 5).alias("fold"))
    assert want == sorted(plain.collect(), key=repr)
    seen, keep = [], H.written
    monkeypatch.setattr(H, "written", lambda rows: seen.append(rows.columns) or keep(rows))
    got = H.assign_folds(df, write=True)
    assert sorted(got.drop("v").collect(), key=repr) == want and len(seen) == 1 and "_h" not in seen[0]
    assert sorted(r["v"] for r in got.collect()) == sorted(r["v"] for r in df.collect())


def test_grid_search_shuffles_and_writes_no_vectors(spark, monkeypatch):
    wide, picked = [], []
    for module in (H, Q, I):
        monkeypatch.setattr(module, "written", lambda rows, keep=module.written: wide.append(rows) or keep(rows))
    monkeypatch.setattr(I, "first_rows", lambda rows, *a, keep=I.first_rows, **kw: picked.append(rows.columns) or keep(rows, *a, **kw))
    monkeypatch.setattr(Q, "TRAIN_ROWS", 300)
    assert Q.q_grid(spark, SF_SMALL).count() == 8
    with_vectors = [d.count() for d in wide if "features" in d.columns]
    assert with_vectors and max(with_vectors) <= 375 and len(wide) == 2  # the sample's alone, and the catalogue's
    assert not {"features", "values", "brand_code"} & set(picked[0])
