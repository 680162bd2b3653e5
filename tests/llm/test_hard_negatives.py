import math
import random

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm.hard_negatives import Anchors, Rows, encode, interval, mine, scores

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, low=50, high=95):
    ok = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in ok:
        if not is_anchor(a[0]):
            continue
        dot = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        ranked = sorted((r for r in ok if r != a), key=lambda r: (-dot(r), r[0]))
        for p in [r for r in ranked if r[1] == a[1]][:5]:
            ps = dot(p)
            hard = [r for r in ranked if r[1] != a[1] and low * ps <= 100 * dot(r) <= high * ps][:3]
            out += [(a[0], p[0], k + 1, n[0], ps, dot(n)) for k, n in enumerate(hard)]
    return sorted(out)


def test_against_all_pairs(spark):
    r = random.Random(3)
    rows = []
    for i in range(260):
        v = [float(np.float32(r.gauss(0, 1))) for _ in range(r.choice([70, 70, 70, 20, 0]))]
        rows.append((i, v, r.randrange(4)))
    rows += [(i + 300, rows[3][1], r.randrange(3)) for i in range(90)]              # one common vector: ties
    rows += [(None, rows[0][1], 1), (600, None, 1), (601, [1.0, None], 1), (602, [float("nan")], 1), (603, [float("inf")], 2),
             (604, rows[1][1], None), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (20, rows[8][1], 2),
             (700, [3e4] * 70, 0), (-10, [-3e4] * 70, 0), (720, [0.0] * 70, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({"id": F.lit("x"), "ints": F.lit(1), "anchor": F.lit(True), "rest": F.lit(0)})
    want = brute(rows, lambda i: i % 10 == 0)
    for block in (7, 16_384):  # many blocks of few anchors, and one
        assert sorted(map(tuple, mine(clash, F.col("vec_id") % 10 == 0, block=block).collect())) == want
    assert len(want) > 200


def test_empty_and_without_anchors(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], SCHEMA)
    assert mine(df.limit(0), F.lit(True)).count() == 0
    assert mine(df, F.lit(False)).count() == 0
    assert mine(df, F.lit(True)).count() == 0


def test_intervals_hold_and_rule_pairs_out():
    rng = np.random.default_rng(0)
    for dim, size in ((64, 256), (100, 256), (3, 5), (64, 1 << 40)):
        x = np.floor(rng.standard_normal((400, dim)) * size).astype(np.int64)
        x[0] = 0
        rows = Rows(np.arange(400), np.zeros(400, np.int64), x, *encode(x))
        anchors = Anchors(np.arange(50), np.zeros(50, np.int64), x[:50])
        low, high = interval(anchors, np.arange(50), rows)
        true = x[:50].astype(object) @ x.T.astype(object)
        assert (low <= true).all() and (true <= high).all()
        fifth = np.sort(true.astype(float), axis=1)[:, -5]
        if dim == 64:
            assert (high >= fifth[:, None]).mean() < 0.25  # most pairs are never scored


def test_scores_are_exact_beyond_float_precision():
    x = np.array([[1 << 30, 1, 7], [3, (1 << 30) + 1, 5]], np.int64)
    rows, anchors = Rows(np.arange(2), np.zeros(2, np.int64), x, *encode(x)), Anchors(np.arange(2), np.zeros(2, np.int64), x)
    a, r = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    assert scores(anchors, a, rows, r).tolist() == [sum(int(p) * int(q) for p, q in zip(x[i], x[j])) for i, j in zip(a, r)]
