"""A1-A4: catalogue CSV/Parquet reader, dialogue log reader/appender, JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.common import nan_to_null
from shelfspark.plans.reuse import written
from shelfspark.schemas import CATALOG, DIALOGUE
from shelfspark.sources.batches import append_batch, batch_rows, compact, read_batches
from shelfspark.sources.json_array import read_json_array

# Text tokens a CSV reader treats as missing in any column
# (the pandas defaults, so an offer literally written "None" is missing).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def conform_catalog(raw: DataFrame, schema: T.StructType = CATALOG) -> DataFrame:
    """Text columns -> typed catalogue: NA tokens -> null everywhere, NaN -> null."""
    text = {f.name: F.col(f"`{f.name}`").cast("string") for f in schema.fields if f.name in raw.columns}
    # a step of its own: numbers are read in two ways, and each would look the token up again
    raw = raw.select(*[F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c).alias(n) for n, c in text.items()])
    out = []
    for f in schema.fields:
        if f.name not in text:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            v = c
        elif isinstance(f.dataType, T.BooleanType):
            v = F.lower(c).try_cast("boolean")
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)):
            # integers may be written as "5.0" (a writer that turned the column to float)
            d = c.try_cast("double")
            v = F.coalesce(c.try_cast(f.dataType),
                           F.when(d == F.floor(d), d.try_cast(f.dataType)))
        else:
            v = c.try_cast(f.dataType)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                v = nan_to_null(v)
        out.append(v.alias(f.name))
    return raw.select(*out)


def read_catalog(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = CATALOG) -> DataFrame:
    """A1: the flat catalogue from CSV (header; every column read as text, then
    conformed by name: absent columns are null) or Parquet (typed; NaN -> null)."""
    if fmt == "csv":
        # columns are matched by header name, every value read as text (no inference pass)
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        return conform_catalog(raw, schema)
    df = spark.read.parquet(path)
    return df.select(*[nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


LOG_SCHEMA = T.StructType(DIALOGUE.fields + [T.StructField("position", T.LongType(), True)])
_BATCH_SCHEMA = T.StructType(DIALOGUE.fields + [T.StructField("seq", T.LongType(), True)])
_IMPORT = f"{0:017d}_array"  # the batch that holds a former JSON array; sorts before all others


def empty_dialogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_SCHEMA)


def _log_folder(spark: SparkSession, path: str) -> str:
    """Where the log's batches are: ``path`` itself, or beside the array that it began as."""
    return f"{path}.log" if path_exists(spark, path) and not _is_dir(spark, path) else path


def read_dialogue(spark: SparkSession, path: str) -> DataFrame:
    """A2: the dialogue log with its record ``position``; a missing or corrupt log is
    an empty table.

    A single file is one JSON array of records, read in byte ranges (``sources.json_array``);
    the position is the record's index. A folder holds committed batches of JSON lines
    (``append_dialogue``): the position counts through the batches in their order. An array
    that was appended to is read from its batches.
    """
    if not path_exists(spark, path):
        return empty_dialogue(spark)
    folder = _log_folder(spark, path)
    batches = batch_rows(spark, folder)
    if folder != path and _IMPORT not in batches:
        return read_json_array(spark, path, DIALOGUE)
    before, starts = 0, []
    for ident, n in batches.items():
        starts.append((ident, before))
        before += n
    offsets = spark.createDataFrame(starts, "batch string, _before long")  # one row a batch
    rows = read_batches(spark, folder, "json", _BATCH_SCHEMA).join(F.broadcast(offsets), "batch")
    return rows.select(*[f.name for f in DIALOGUE.fields], (F.col("_before") + F.col("seq")).alias("position"))


def append_dialogue(log: DataFrame, path: str, order=None, batch_id: str | None = None) -> str:
    """A3: append records to the log as one committed batch; returns the batch id.

    Records follow ``order`` (column names of ``log``; its own ``position`` when not given). Nothing
    of the log is read or rewritten, concurrent appends keep both batches, and a ``batch_id`` that
    is in the log already is ignored. A log that is one JSON array stays as it is: its records
    become the first batch of ``<path>.log``, and until that batch is committed readers take the array.
    """
    spark = log.sparkSession
    folder = _log_folder(spark, path)
    if folder != path and _IMPORT not in batch_rows(spark, folder):
        array = written(read_json_array(spark, path, DIALOGUE))
        _append_ordered(array, folder, ["position"], _IMPORT)
    return _append_ordered(log, folder, [order] if isinstance(order, str) else list(order or ["position"]), batch_id)


def _append_ordered(log: DataFrame, folder: str, keys: list[str], batch_id: str | None) -> str:
    from shelfspark.plans.windows import running_count
    ranked = running_count(log, [F.col(k).asc() for k in keys], out="__pos").withColumn("seq", F.col("__pos") - 1)
    return append_batch(ranked.select(*[F.col(f.name).cast(f.dataType) for f in _BATCH_SCHEMA.fields]), folder, "json", batch_id)


def compact_dialogue(spark: SparkSession, path: str) -> bool:
    """A3: merge the log's batches into one snapshot; positions stay."""
    return compact(spark, _log_folder(spark, path), "json", _BATCH_SCHEMA)


def to_records(df: DataFrame) -> DataFrame:
    """A4: each row as one JSON object string."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("record"))
