import random

import pytest
import xxhash

from shelfspark.llm.line_dedup import dedup_lines


def brute(docs, min_words):
    """Deleted line numbers by id: the longest run at each line that also starts earlier."""
    def body(t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return h - (1 << 64) if h >> 63 else h
    docs = sorted(((i, body(t), t) for i, t in docs if i is not None and t is not None), key=lambda x: x[:2])
    seqs = [(i, [x.strip() for x in t.split("\n") if x.split()]) for i, _, t in docs]
    out = {}
    for a, (i, ls) in enumerate(seqs):
        gone = set()
        for s in range(len(ls)):
            best = 0
            for b in range(a + 1):
                other = seqs[b][1]
                for u in range(len(other) if b < a else s):
                    k = 0
                    while s + k < len(ls) and u + k < len(other) and ls[s + k] == other[u + k]:
                        k += 1
                    best = max(best, k)
            if best and sum(len(x.split()) for x in ls[s:s + best]) >= min_words:
                gone |= set(range(s, s + best))
        out[i] = "\n".join(ls[k] for k in range(len(ls)) if k not in gone), len(gone)
    return out


@pytest.mark.parametrize("seed,min_words", [(0, 4), (1, 7), (2, 1), (3, 20)])
def test_equals_the_longest_previous_factor(spark, seed, min_words):
    r = random.Random(seed)
    line = {c: " ".join(r.choice("xyz") for _ in range(r.randint(1, 5))) + c for c in "abcd"}
    docs = [(i, "\n".join(line[r.choice("abcd")] for _ in range(r.randint(0, 16)))) for i in range(30)]
    docs += [(40, docs[3][1]), (41, "\n".join([docs[4][1]] * 3)), (42, "\n".join(["same old line"] * 50)), (43, "unique\n" + docs[5][1])]
    got = {x["doc_id"]: (x["text"], x["n_deleted_lines"]) for x in
           dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=min_words).collect()}
    want = brute(docs, min_words)
    assert {i: n for i, (_, n) in got.items()} == {i: want[i][1] for i, _ in docs}
    assert {i: "\n".join(x for x in t.split("\n") if x.split()) for i, (t, _) in got.items()} == {i: want[i][0] for i, _ in docs}


def test_edges(spark):
    run = " ".join(f"w{i}" for i in range(60))
    rows = [(1, run, 9, 9), (2, "a\n\n" + run + "\nb", 9, 9), (3, None, 9, 9), (4, "", 9, 9), (5, " \n", 9, 9), (None, run, 9, 9),
            (2, "a\n\n" + run + "\nb", 9, 9), (6, "short line", 9, 9), (7, "short line", 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, runs int")
    got = dedup_lines(df)
    assert got.columns == [*df.columns, "n_deleted_lines"]
    out = sorted((x["doc_id"] or 0, x["text"], x["n_deleted_lines"]) for x in got.where("doc_id IS NULL OR text IS NOT NULL").collect())
    assert out == [(0, run, 0), (1, run, 0), (2, "a\n\nb", 1), (2, "a\n\nb", 1), (4, "", 0), (5, " \n", 0), (6, "short line", 0), (7, "short line", 0)]
    assert got.where("text IS NULL").count() == 1 and dedup_lines(df.limit(0)).count() == 0
