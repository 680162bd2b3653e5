import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import byte_cnn as B
from shelfspark.llm.common import table
from tests.conftest import SF_MID


def plain_chunk(net, text, start):
    """Pooled responses of one chunk by loops."""
    ch = [text[start + k] if start + k < len(text) else B.PAD for k in range(B.CHUNK)]
    best = np.zeros(B.FILTERS)
    for t in range(B.CHUNK - B.WIDTH + 1):
        z = net.bias.astype(float).copy()
        for w in range(B.WIDTH):
            z += net.embed[ch[t + w]].astype(float) @ net.kernel[w]
        for lag in range(1, B.LAGS + 1):
            same = sum(t + w >= lag and ch[t + w] == ch[t + w - lag] != B.PAD for w in range(B.WIDTH))
            z += same / B.WIDTH * net.repeat[lag - 1]
        best = np.maximum(best, z)
    return best


def random_net(seed):
    r = np.random.default_rng(seed)
    net = B.Net.fresh(seed)
    net.bias += r.standard_normal(B.FILTERS).astype(np.float32)
    net.base += 0.3
    return net


def test_scores_against_plain_loops():
    net, r = random_net(1), random.Random(1)
    texts = [b"", None, b"a", "é là ".encode(), bytes(r.randrange(256) for _ in range(512)), b"the the " * 70, bytes(r.choice(b"ab ") for _ in range(1400))]
    want = []
    for t in texts:
        t = t or b""
        h = np.array([plain_chunk(net, t, s) for s in B.chunk_starts(len(t))])
        x = np.concatenate([h.max(axis=0), h.mean(axis=0)]) @ net.out + net.base[0]
        want.append(1 / (1 + np.exp(-x)))
    assert np.allclose(B.score_texts(net, texts), want, atol=1e-5)


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        starts = list(B.chunk_starts(n))
        covered = {k for s in starts for k in range(s, min(s + B.CHUNK, n))}
        assert covered == set(range(n)) and all(b - a == B.CHUNK - B.OVERLAP for a, b in zip(starts, starts[1:]))
        assert len(starts) == 1 or starts[-2] + B.CHUNK < n


def test_a_change_anywhere_in_a_very_long_text_counts():
    net = random_net(2)
    long = b"plain words in a row. " * 200_000
    far = long[:3_000_000] + b"$%&*#@ XQZ" + long[3_000_000:]
    a, b = B.score_texts(net, [long, far])
    assert a != b


def test_gradient_against_differences():
    net, r = random_net(3), np.random.default_rng(3)
    for f in ("embed", "kernel", "repeat", "bias", "out", "base"):
        setattr(net, f, getattr(net, f).astype(np.float64))
    chunks = r.integers(97, 110, (5, B.CHUNK)).astype(np.int16)
    sizes, label, weight = np.array([2, 1, 2]), np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])
    _, g = B.gradient(net, chunks, sizes, label, weight)
    for name in ("embed", "kernel", "repeat", "bias", "out", "base"):
        x = getattr(net, name)
        for at in [tuple(r.integers(0, n) for n in x.shape) for _ in range(6)] + [np.unravel_index(np.abs(getattr(g, name)).argmax(), x.shape)]:
            kept = x[at]
            x[at] = kept + 1e-3
            up, _ = B.gradient(net, chunks, sizes, label, weight)
            x[at] = kept - 1e-3
            down, _ = B.gradient(net, chunks, sizes, label, weight)
            x[at] = kept
            assert abs((up - down) / 2e-3 - getattr(g, name)[at]) < 2e-3


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    got = B.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held) > 90


def test_held_out_labels_and_other_columns_play_no_part(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["red", "blue", "tree"]) + (" $$" if i % 2 else "") for _ in range(r.randint(1, 60)))) for i in range(120)]
    docs += [(None, "no id"), (7, None), (8, ""), (9, docs[3][1]), (9, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = [(i, 1 - i % 2) for i in range(110)] + [(0, 1), (5, None), (None, 1), (9999, 0), (2, 1), (2, 0)]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    lab = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    a = key(B.classify(df, lab(labels)))
    b = key(B.classify(df.withColumns({"id": F.lit("x"), "label": F.lit(1), "score": F.lit(2)}), lab([(i, 1 - q if out(i) and q is not None else q) for i, q in labels]).withColumn("toxic", F.lit(1))))
    assert a == b and len(a) == len(docs)
    assert sum(x[3] == 1 - x[0] % 2 for x in a if x[0] is not None and x[0] < 110) > 100


def test_few_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x["score"] for x in B.classify(df, none).collect()] == [0.5, 0.5]
    assert [x["predicted"] for x in B.classify(df, spark.createDataFrame([(2, 0)], none.schema)).collect()] in ([0, 0], [1, 1])
    assert B.classify(df.limit(0), none).count() == 0
