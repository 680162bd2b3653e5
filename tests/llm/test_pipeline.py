import random

import pytest

import corpus_pipeline as P
from shelfspark.llm.decontaminate import normalise
from shelfspark.llm.pieces import load_vocabulary
from shelfspark.llm.sentencepiece_codec import decode_ids
from tests.llm.test_line_dedup import brute as line_brute
from tests.llm.test_quality import brute as quality_brute
from tests.llm.test_simhash import brute_components, brute_fp

PASSAGE = "It was a bright cold day in April, and the clocks were striking thirteen; the hall smelt of cabbage and old mats."


def corpus():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(900)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n)) + "."
    shared = line(70)
    docs = [(i, "\n".join(line(r.randint(8, 25)) for _ in range(r.randint(4, 9)))) for i in range(30)]
    docs += [(30, docs[0][1]), (31, docs[1][1]), (32, docs[2][1])]  # exact copies
    for i in (33, 34, 35):  # near copies: a word changed in every line, so no line repeats
        docs.append((i, "\n".join(x.replace(" ", " qq ", 1) if n == 0 else x.replace(".", " qq.") if n == 1 else x + " " for n, x
                                  in enumerate(docs[i - 30][1].split("\n"))).replace(" \n", "\n").rstrip(" ")))
    long = " ".join(line(25).rstrip(".") for _ in range(60))
    docs += [(40, long + "."), (41, long + " end.")]  # one line each: near, not equal
    docs += [(42, line(30) + "\n" + shared + "\n" + line(20)), (43, line(40) + "\n" + shared + "\n" + line(9))]
    docs += [(44, line(30) + "\n" + line(30) + " " + PASSAGE), (45, "\n".join(["Home | News | Help | Login"] * 20)),
             (46, None), (47, ""), (48, "too short"), (49, line(60) + "\nAll rights reserved.")]
    return docs


def expected(docs):
    rows = [(i, quality_brute(t)) for i, t in docs]
    rows = [(i, q[10]) for i, q in rows if q[6]]
    lines = line_brute(rows, 50)
    rows = [(i, lines[i][0]) for i, _ in rows if lines[i][1] == 0 or lines[i][0].split()]
    fp = {i: brute_fp(t) for i, t in rows}
    group = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    return {i: t for i, t in rows if group[i] == i and normalise(PASSAGE) not in normalise(t)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus()],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_run_equals_the_stages_by_brute_force(spark, folder):
    vocab = load_vocabulary()
    got = {x["doc_id"]: x for x in P.run(spark, folder).collect()}
    want = expected(corpus())
    assert got.keys() == want.keys() and {30, 31, 32, 41, 44, 45, 46, 47, 48}.isdisjoint(got) and {0, 1, 2, 40, 42, 43, 49} <= got.keys()
    assert all(x["exact"] and decode_ids(vocab, x["ids"]) == want[i] for i, x in got.items())


def test_stages_keep_columns_and_take_odd_rows(spark, folder):
    rows = [(None, "w " * 3 + "\n", 1, 1, 1, 1), (1, None, 1, 1, 1, 1), (1, "", 1, 1, 1, 1), (2, "\n".join(f"word{i} and more." for i in range(40)), 1, 1, 1, 1),
            (2, "\n".join(f"word{i} and more." for i in range(40)), 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, leaks int, n_deleted_lines int, component_id int")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, df, folder).columns == df.columns
        assert stage(spark, df.limit(0), folder).count() == 0
    assert [x["doc_id"] for x in P.quality_rules(spark, df, folder).collect()] == [2, 2]
    assert P.dedup_lines(spark, df, folder).count() == 5
    assert P.STAGES[-1][1](spark, df, folder).where("NOT exact").count() == 0
