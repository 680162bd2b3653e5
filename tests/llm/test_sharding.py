import random
import zlib

from shelfspark.llm.sharding import shard_by_bytes


def test_contiguous_balanced_gapless(spark):
    r = random.Random(1)
    docs = [(i, r.choice([None, "", "é" * r.randrange(400), "x" * r.randrange(3000)]), 1) for i in r.sample(range(10_000), 300)]
    docs += [(docs[0][0], docs[0][1], 1), (None, "n", 1)]
    got = shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string, shard int"), 7).collect()
    size = lambda t: len((t or "").encode()) + 16
    total, biggest = sum(size(t) for _, t, _ in docs), max(size(t) for _, t, _ in docs)
    assert len(got) == len(docs)
    key = lambda x: (x["doc_id"] is not None, x["doc_id"], x["size"])
    assert [x["shard"] for x in sorted(got, key=key)] == sorted(x["shard"] for x in got)
    for s in range(7):
        rows = [x for x in got if x["shard"] == s]
        assert sorted(x["slot"] for x in rows) == list(range(len(rows)))
        assert abs(sum(x["size"] for x in rows) - total / 7) <= biggest
    crc = {i: (size(t), zlib.crc32((t or "").encode())) for i, t, _ in docs}
    assert all((x["size"], x["text_crc32"]) == crc[x["doc_id"]] and x["law"] == "bytes" and x["grown_shard"] is None for x in got)


def test_prefix_law_against_a_plain_loop(spark):
    docs = [(i, "a" * (i * 37 % 101)) for i in range(60)]
    got = {x["doc_id"]: x["shard"] for x in shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()}
    total, before = sum(len(t) + 16 for _, t in docs), 0
    for i, t in docs:
        assert got[i] == min(4, (2 * before + len(t) + 16) * 5 // (2 * total))
        before += len(t) + 16


def test_empty_and_one_row(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert shard_by_bytes(df.limit(0), 40).count() == 0
    assert [x["slot"] for x in shard_by_bytes(df, 40).collect()] == [0]
