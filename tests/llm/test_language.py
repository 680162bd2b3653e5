import zlib

from pyspark.sql import functions as F

from shelfspark.llm.language_id import held_out, identify
from tests.conftest import SF_SMALL


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    out = [x for x in got if x["held_out"]]
    assert sum(x["lang_pred"] == x["lang"] for x in out) >= 0.97 * len(out) > 20
    assert all(0 <= x["score"] <= 1 for x in got)


def test_edges(spark):
    rows = [(i, "the cat and the dog", "en", 1) for i in range(8)] + [(i, "der hund und die katze", "de", 1) for i in range(8, 16)]
    rows += [(20, None, "en", 1), (21, "123 !? ", "en", 1), (22, "the dog", None, 1), (None, "und der hund", "xx", 1), (22, "the dog", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {}
    for x in identify(df).collect():
        got.setdefault(x["doc_id"], []).append((x["lang_pred"], x["held_out"]))
    assert got[20][0][0] == got[21][0][0] == "und" and len(got[22]) == 2
    assert got[22][0][0] == "en" and got[None] == [("de", False)]  # xx is not learned from a row without an id
    assert identify(df.limit(0)).count() == 0
    unknown = identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(x["lang_pred"], x["score"]) for x in unknown} == {("und", 0.0)}


def test_languages_outside_training_are_not_learned(spark):
    out = spark.range(200).where(held_out(F.col("id"))).selectExpr("id AS doc_id", "'zz yy' AS text", "'zz' AS lang")
    rest = spark.range(200).where(~held_out(F.col("id"))).selectExpr("id AS doc_id", "'the cat' AS text", "'en' AS lang")
    assert {x["lang_pred"] for x in identify(out.unionByName(rest)).collect()} == {"en"}
