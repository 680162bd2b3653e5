import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfspark.operators import attribution as A
from shelfspark.operators import boosting as B
from shelfspark.operators import models as I
from shelfspark.operators import search as S
from shelfspark.operators.evaluate import classification_metrics
from shelfspark.operators.prep import first_rows, hash_order


def plain_tree(bins, g, h, leaves, depth):
    """Best-first growth by masks: [(place, feature, bin)] in the order of the splits."""
    def best(rows):
        G, H = g[rows].sum(), h[rows].sum()
        found = (0.0, 0, 0)
        for f in range(bins.shape[1]):
            for b in range(bins.max() + 1):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if min(len(left), len(right)) < B.MIN_ROWS or min(h[left].sum(), h[right].sum()) < B.MIN_HESSIAN:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - G ** 2 / H
                if gain > found[0]:
                    found = (gain, f, b)
        return found

    open_, out = {1: np.arange(len(bins))}, []
    while len(open_) < leaves:
        ways = [(-best(r)[0], p, *best(r)[1:]) for p, r in open_.items() if p.bit_length() <= depth]
        ways = [w for w in ways if w[0] < 0]
        if not ways:
            break
        _, p, f, b = min(ways)
        rows = open_.pop(p)
        open_[2 * p], open_[2 * p + 1] = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
        out.append((p, f, b))
    return out, open_


def places(order):
    return sorted((n.place, n.feature, n.bin) for n in order if n.split)


@pytest.mark.parametrize("ahead", [False, True])
def test_grower_against_plain_best_first(ahead):
    r = np.random.default_rng(1)
    for leaves, depth in ((2, 9), (5, 9), (7, 2), (12, 9), (30, 4), (1, 3)):
        bins = r.integers(0, 6, (160, 4))
        g, h = r.integers(-8, 9, 160) / 4, r.choice([0.25, 0.5, 1.0], 160)  # sums are exact
        old, B.MIN_ROWS = B.MIN_ROWS, 3
        try:
            counted = B.InPlace(bins, 6, g, h, depth)
            tree, order = B.grow(counted.root(), leaves, 0.1, counted, ahead)
            want, groups = plain_tree(bins, g, h, leaves, depth)
        finally:
            B.MIN_ROWS = old
        assert places(order) == sorted(want) and tree.leaves == len(groups) <= leaves and tree.depth() <= depth
        leaf = tree.leaf_of(bins)
        by_place = {n.place: i for i, n in enumerate(order)}
        for p, rows in groups.items():
            assert (leaf[rows] == by_place[p]).all() and tree.cover[by_place[p]] == len(rows)
            assert np.isclose(tree.value[by_place[p]], -0.1 * g[rows].sum() / h[rows].sum())


def frame(spark, n=900, seed=2):
    r = np.random.default_rng(seed)
    x = np.round(r.standard_normal((n, 4)), 1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.1).astype(float)
    rows = [(f"k{i}", Vectors.dense(x[i]), float(y[i]), float(1 + i % 2), i % 3) for i in range(n)]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
    schema = StructType([StructField("product_id", StringType()), StructField("features", VectorUDT()), StructField("label", DoubleType()),
                         StructField("weight", DoubleType()), StructField("fold", IntegerType())])
    return spark.createDataFrame(rows, schema).repartition(5)


def test_learning_by_jobs_equals_learning_in_a_task(spark):
    df = frame(spark)
    for kw in ({"depth": 3, "leaves": 31}, {"leaves": 9}):
        far = B.LeafBoosted(rounds=12, rate=0.3, **kw).fit(df)  # crosses a rewrite of the margins
        near = B.LeafBoosted(rounds=12, rate=0.3, inTask=True, **kw).fit(df)
        assert far.start == near.start and len(far.trees) == 12
        for a, b in zip(far.trees, near.trees):
            assert a.leaves <= kw["leaves"] and a.depth() <= kw.get("depth", 99)
            assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)


def test_model_learns_saves_and_loads(spark, tmp_path):
    df = frame(spark, 1500)
    model = B.LeafBoosted(rounds=40, rate=0.2, leaves=8, inTask=True).fit(df)
    out = model.transform(df)
    assert classification_metrics(out).first()["accuracy"] > 0.93
    p = out.select("product_id", "probability", "prediction").collect()
    assert all(0 <= r["probability"][1] <= 1 and r["prediction"] == float(r["probability"][1] > 0.5) for r in p)
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df).select("product_id", "probability").collect()
    assert {r["product_id"]: r["probability"] for r in again} == {r["product_id"]: r["probability"] for r in p}
    assert abs(model.gains.sum() - 1) < 1e-9 and model.gains[3] < 0.1


def test_no_rows_one_class_and_missing_values(spark):
    df = frame(spark, 60)
    assert B.LeafBoosted(rounds=2).fit(df.limit(0)).transform(df).where("prediction = 1").count() == 0
    one = B.LeafBoosted(rounds=2, inTask=True).fit(df.withColumn("label", F.lit(1.0)))
    assert one.transform(df).where("prediction = 1").count() == 60
    null_labels = df.withColumn("label", F.when(F.col("fold") == 0, F.col("label")))
    assert len(B.LeafBoosted(rounds=2, inTask=True).fit(null_labels).trees) == 2
    assert B.binned(np.array([[np.nan, 1.0]]), [np.array([0.0, 1.0]), np.array([0.0, 1.0])]).tolist() == [[2, 1]]


def enumerated(model, bins):
    """Shapley values over all subsets of features, by the recursive expectation."""
    n = len(model.edges)

    def value(x, present):
        def down(t, node):
            if t.left[node] == node:
                return t.value[node]
            a, b = t.left[node], t.right[node]
            if t.feature[node] in present:
                return down(t, a if x[t.feature[node]] <= t.bin[node] else b)
            return (t.cover[a] * down(t, a) + t.cover[b] * down(t, b)) / t.cover[node]
        return model.start + sum(down(t, 0) for t in model.trees)

    out = np.zeros((len(bins), n))
    for r, x in enumerate(bins):
        v = {s: value(x, s) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        for i in range(n):
            for s in v:
                if i not in s:
                    out[r, i] += factorial(len(s)) * factorial(n - 1 - len(s)) / factorial(n) * (v[tuple(sorted((*s, i)))] - v[s])
    return out, value(bins[0], ())


def test_attribution_against_subset_enumeration(spark):
    df = frame(spark, 700)
    model = B.LeafBoosted(rounds=5, rate=0.3, leaves=14, inTask=True).fit(df)
    x = np.array([r["features"].toArray() for r in df.limit(25).collect()])
    want, base = enumerated(model, B.binned(x, model.edges))
    paths = [p for t in model.trees for p in A.leaf_paths(t)]
    assert np.allclose(A.contributions(paths, B.binned(x, model.edges), 4), want, atol=1e-9)
    assert abs(A.expected_margin(model) - base) < 1e-9
    got = A.tree_contributions(model, df).collect()
    assert len(got) == 700 and all(abs(r["base"] + sum(r["contributions"]) - r["margin"]) < 1e-8 for r in got)
    ranked = A.attribution_ranking(A.tree_contributions(model, df), ["a", "b", "c", "d"]).collect()
    means = np.abs(np.array([r["contributions"] for r in got])).mean(axis=0)
    assert [r["feature"] for r in sorted(ranked, key=lambda r: r["rank"])] == [n for _, n in sorted(zip(-means, "abcd"))]
    assert A.attribution_ranking(A.tree_contributions(model, df), ["a", "b", "c", "d"], top=2).count() == 2


def test_staged_search_equals_separate_fits(spark):
    df = frame(spark, 600)
    grid = {"rounds": [3, 6], "depth": [2, 4], "rate": [0.1, 0.4], "leaves": [3, 5, 9]}
    maps = S.maps_of(grid)
    assert len(maps) == 24 and len(S.maps_of(I.BOOSTED_GRID)) == 81 and len({S._fit_key(m) for m in S.maps_of(I.BOOSTED_GRID)}) == 21
    got = {(r["rounds"], r["depth"], r["rate"], r["leaves"]): r for r in S.staged_search(df, maps, 10_000, 3).collect()}
    assert len(got) == 24 and sorted(r["rank"] for r in got.values()) == list(range(1, 25))
    edges = B.bin_edges(df, "features", 4)
    rows = df.orderBy("product_id").collect()
    bins, label, weight, fold = B.binned(np.array([r["features"].toArray() for r in rows]), edges), *(np.array([r[c] for r in rows]) for c in ("label", "weight", "fold"))
    for m in (maps[0], maps[7], maps[-1]):
        f1 = []
        for f in range(3):
            held = fold == f
            start, trees = B.boost_in_task(bins[~held], label[~held], weight[~held], max(map(len, edges)) + 1, m["rounds"], m["depth"], m["rate"], m["leaves"])
            p = B._add_trees(np.full(held.sum(), start), bins[held], trees) > 0
            y = label[held] == 1
            f1.append(np.mean([2 * (a & b).sum() / max((a.sum() + b.sum()), 1) for a, b in ((y, p), (~y, ~p))]))
        assert abs(got[tuple(m[a] for a in S.AXES)]["cv_macro_f1"] - np.mean(f1)) < 1e-12
    best = S.best_of(S.staged_search(df, maps[:5], 10_000, 3), grid).collect()
    assert [r["param"] for r in best] == list(S.AXES)


def test_first_rows_without_a_sort(spark):
    df = frame(spark, 500)
    want = [r["product_id"] for r in df.orderBy(hash_order("product_id"), "product_id").limit(77).collect()]
    got = first_rows(df, 77)
    assert sorted(r["product_id"] for r in got.collect()) == sorted(want)
    assert "TakeOrdered" not in got._jdf.queryExecution().toString()
    assert first_rows(df, 10_000).count() == 500 and first_rows(df.limit(0), 5).count() == 0


def test_more_rows_than_a_task_learns_from_are_dealt_out(spark, monkeypatch):
    df = frame(spark)
    dealt, used = B.boost_dealt, []
    monkeypatch.setattr(B, "boost_dealt", lambda *a: used.append(1) or dealt(*a))
    near = B.LeafBoosted(rounds=5, rate=0.3, leaves=9).fit(df)
    assert not used
    monkeypatch.setattr(B, "IN_TASK_CELLS", 900 * 4 - 1)
    monkeypatch.setattr(B, "BLOCK_CELLS", 400)  # several blocks a task
    far = B.LeafBoosted(rounds=5, rate=0.3, leaves=9).fit(df)
    assert used and abs(far.start - near.start) < 1e-12 and len(far.trees) == 5
    for a, b in zip(far.trees, near.trees):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and (a.cover == b.cover).all() and np.allclose(a.value, b.value)
    assert far.trees[0].cover[0] == 900  # all rows learn


def test_combined_bins_count_what_single_bins_count():
    r = np.random.default_rng(4)
    bins = (r.random((30_000, 7)) * [2, 3, 64, 17, 64, 40, 1]).astype(np.uint8)
    g, h = r.standard_normal(30_000), r.random(30_000)
    cells = B.Cells.of(bins, 64)
    assert len(cells.groups) < 7 and sorted(sum(cells.groups, [])) == list(range(7))
    every = np.arange(30_000, dtype=np.int32)
    for rows in (every, every[5::3], every[:40], every[:0]):
        want = np.stack([[np.bincount(bins[rows, f], v, 64) for f in range(7)] for v in (g[rows], h[rows], np.ones(len(rows)))])
        assert np.allclose(cells.hist(rows, g, h), want)
        assert (cells.bins_of(3, rows) == bins[rows, 3]).all()
        left, right = cells.split(4, 20, rows)
        assert (left == rows[bins[rows, 4] <= 20]).all() and (right == rows[bins[rows, 4] > 20]).all()
