"""A JSON array of objects, read by as many tasks as its bytes need.

The text source cuts the file at every ``}``, whatever byte range a task has. Whether a piece
starts inside a string depends on all quotes before it, its depth on all braces outside strings
before it: both are prefix sums over the pieces, once each piece's effect is known for either
start. A record ends where the depth falls back to one outside a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.plans.reuse import materialize_small, written
from shelfspark.plans.windows import running_sums


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _net(parts: Column, odd: int) -> Column:
    """Opening minus closing signs in the parts at even (odd = 0) or odd places."""
    text = F.array_join(F.filter(parts, lambda p, i: i % 2 == odd), "")
    return _count(text, "{[") - _count(text, "}]")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, index: str = "position") -> DataFrame:
    """One row for each object of the array, with its place in it (from 0).

    Records that do not fit the schema are dropped and keep their number. A text whose strings or
    brackets do not close, or that is no array, gives no rows. No task reads more than its share
    of the file; a record's own pieces are put together by its number.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # an escape never spans a piece: \} is none
    facts = written(pieces.withColumn("plain", plain).withColumn("parts", F.split("plain", '"', -1)).select(
        "block", "id", "value", (F.size("parts") - 1).cast("bigint").alias("quotes"),
        _net(F.col("parts"), 0).cast("bigint").alias("even"), _net(F.col("parts"), 1).cast("bigint").alias("odd")))
    order, slices = [F.col("block").asc(), F.col("id").asc()], {"slice_by": F.col("block")}  # a slice is a byte range
    seen = running_sums(facts, {"upto": "quotes"}, order, **slices)
    outside = F.col("upto") % 2 == 0
    net = F.when((F.col("upto") - F.col("quotes")) % 2 == 0, F.col("even")).otherwise(F.col("odd")) - outside.cast("bigint")
    nested = written(running_sums(seen.select("block", "id", "value", outside.alias("outside"), net.alias("net")), {"depth": "net"}, order, **slices))
    ends = F.col("outside") & (F.col("depth") == 1)
    numbered = running_sums(nested.withColumn("ends", ends.cast("bigint")), {"done": "ends"}, order, **slices)
    # the text after the last brace closes the array, and its missing brace counts as one more
    sound = materialize_small(nested.agg(F.max_by(F.col("outside") & (F.col("depth") == -1), F.struct("block", "id")).alias("ok"),
                                         F.min_by(F.ltrim(F.col("value"), F.lit(" \t\r\n")), F.struct("block", "id")).alias("head"))
                              .select((F.col("ok") & F.col("head").startswith("[")).alias("sound")))
    bad = "_bad"
    joined = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "id", "value"))), lambda p: p["value"]), "}"), F.lit("}"))
    records = (numbered.groupBy((F.col("done") - F.col("ends")).alias(index)).agg(joined.alias("text"), F.max("ends").alias("whole"))
               .where("whole = 1"))
    parsed = F.from_json(F.ltrim(F.col("text"), F.lit(" \t\r\n,[")), T.StructType([*schema.fields, T.StructField(bad, T.StringType())]),
                         {"columnNameOfCorruptRecord": bad})
    return (records.select(index, parsed.alias("r")).where(F.col(f"r.{bad}").isNull() & F.col("r").isNotNull() & sound.select("sound").scalar())
            .select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields], index))
