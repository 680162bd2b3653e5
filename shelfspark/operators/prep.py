"""H: training preparation (encoding, scaling, splits, class weights, folds).

Splits and folds are defined by an md5 order of ``key || ':' || seed`` so they
are reproducible in Spark and in plain SQL. Per-class positions come from a
distributed running count (``running_count``): no per-label window, which with a
two-valued label would put half the data in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.plans.reuse import materialize_small, written
from shelfspark.plans.windows import hash_slice, running_count
from shelfspark.session import scratch_path

SEED = 42
TRAIN_FRACTION = 0.8
FOLDS = 5


def hash_order(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """H1: alphabetical integer codes per column (fit and apply on the same data)."""
    return ordinal_encoder(df, cols, suffix).transform(df)


def dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code): each column's distinct values, numbered alphabetically from 0.

    Values are made distinct by one partial and final aggregate and numbered by the distributed
    running count, so a column of any number of values never meets in one task or the driver.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    values = df.select(F.inline(pairs)).where("value IS NOT NULL").distinct()
    ranked = running_count(values, [F.col("value").asc()], partition=["column"], out="_rank")
    return ranked.select("column", "value", (F.col("_rank") - 1).cast("int").alias("code"))


class DictionaryModel(Model, MLWritable, MLReadable):
    """H1, H2: adds the code column of every encoded column; unseen and null values get -1.

    The dictionary is a Parquet table; every column meets its part in a left join whose strategy the
    planner picks by the part's size.
    """

    def __init__(self, path: str = "", cols: Sequence[str] = (), suffix: str = "_code"):
        super().__init__()
        self.path, self.cols, self.suffix = path, list(cols), suffix

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("column string, value string, code int").parquet(self.path)

    def _transform(self, df: DataFrame) -> DataFrame:
        table = self.codes(df.sparkSession)
        for i, c in enumerate(self.cols):
            own = table.where(F.col("column") == c).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
            df = (df.join(own, F.col(c).cast("string") == F.col(f"__v{i}"), "left").drop(f"__v{i}")
                  .withColumn(f"{c}{self.suffix}", F.coalesce(f"__c{i}", F.lit(-1))).drop(f"__c{i}"))
        return df

    def write(self) -> _DictionaryWriter:
        return _DictionaryWriter(self)

    @classmethod
    def read(cls) -> _DictionaryReader:
        return _DictionaryReader()


class _DictionaryWriter(MLWriter):
    def __init__(self, model: DictionaryModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sc, {"cols": self.model.cols, "suffix": self.model.suffix})
        self.model.codes(SparkSession.getActiveSession()).write.parquet(f"{path}/codes")


class _DictionaryReader(MLReader):
    def load(self, path: str) -> DictionaryModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        model = DictionaryModel(f"{path}/codes", meta["cols"], meta["suffix"])
        model._resetUid(meta["uid"])
        return model


def ordinal_encoder(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> PipelineModel:
    """H2: fitted alphabetical encoder; values unseen at fit time get -1 when applied."""
    path = scratch_path(df.sparkSession, f"codes-{uuid.uuid4().hex}")
    dictionary(df, cols).write.parquet(path)
    return PipelineModel(stages=[DictionaryModel(path, cols, suffix)])


def ordinal_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> PipelineModel:
    """H2: same as ``ordinal_encoder`` (fit on ``df``; apply the model to scoring rows)."""
    return ordinal_encoder(df, cols, suffix)


def assemble_scaled(feature_cols: Sequence[str], out: str = "features") -> list:
    """H3: vector of all features (codes act as numbers) -> zero mean, unit variance.

    Spark's scaler divides by the sample standard deviation (the reference's by
    the population one); a constant column becomes 0 in both.
    """
    return [VectorAssembler(inputCols=list(feature_cols), outputCol="_raw", handleInvalid="keep"),
            StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True)]


def _class_rank(df: DataFrame, label: str, key: str, seed: int, write: bool = False) -> DataFrame:
    """``_rank``: position in hash order within the class; ``_rank_total``: class size.

    Rows are ordered by an md5 hash, so slices come straight from the hash prefix
    (no sampling pass, no checkpoint) and every slice gets an even share of rows. ``write``:
    the rows are written once, for ``df`` is dear and its rows are read several times.
    """
    order = [F.col("_h").asc(), F.col(key).asc()]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    h = hash_order(key, seed)
    # its 16 bytes have the order of its 32 digits
    return running_count(df.withColumn("_h", F.unhex(h)), order, partition=[label], out="_rank",
                         slices=n, slice_by=hash_slice(h, n), with_totals=True,
                         fix=(lambda rows: written(rows.drop("_h"))) if write else None)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class (one row per label value: its size is the number of classes)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


HASH_BUCKET_DIGITS = 3  # 16^3 hash-prefix buckets per class, and as many again in the bucket found


def class_thresholds(df: DataFrame, label: str = "label", key: str = "product_id",
                     frac: float = TRAIN_FRACTION, seed: int = SEED,
                     digits: int = HASH_BUCKET_DIGITS, reread: bool = False) -> DataFrame:
    """One row per class: the (hash, key) of its round(frac * n)-th row in hash order.

    No sort of the data: a histogram of hash prefixes per class (partial
    aggregate, at most classes * 16^digits rows a task) locates the bucket holding
    the k-th row; a histogram of that bucket's rows by twice the digits narrows it
    down, and only about n / 16^(2 * digits) rows per class are ranked. ``reread``: ``df`` is
    written already, so it is read twice rather than written again as hashes.
    """
    base = df.select(F.col(label).alias("_y"), F.col(key).cast("string").alias("_k"),
                     hash_order(key, seed).alias("_h"))
    return _hash_thresholds(base, lambda total: F.round(total * F.lit(frac)), digits, reread).withColumnRenamed("_y", label)


def _hash_thresholds(base: DataFrame, rank_of: Callable[[Column], Column], digits: int = HASH_BUCKET_DIGITS,
                     reread: bool = False) -> DataFrame:
    """(_y, _threshold): per ``_y`` the (_h, _k) of the row at ``rank_of(rows of _y)`` in hash order."""
    # narrow and written once, unless its source is: the histogram and the boundary buckets both read it
    base = base if reread else written(base)
    near = materialize_small(_bucket_rows(base, digits, rank_of(F.sum("_n").over(Window.partitionBy("_y"))).cast("bigint")))
    cand = _bucket_rows(near, 2 * digits, F.col("_r"))
    wr = Window.partitionBy("_y").orderBy("_h", "_k")
    picked = cand.withColumn("_i", F.row_number().over(wr)).where(F.col("_i") == F.col("_r"))
    return picked.select("_y", F.struct("_h", "_k").alias("_threshold"))


def _bucket_rows(rows: DataFrame, digits: int, want: Column) -> DataFrame:
    """(_y, _k, _h, _r): per ``_y`` the rows of the hash-prefix bucket that holds the row at rank ``want``, and
    that row's rank in the bucket. ``want`` is made of a bucket's ``_n`` (rows) and of ``_r``, if given."""
    rows = rows.withColumn("_b", F.substring("_h", 1, digits))
    known = [F.max("_r").alias("_r")] if "_r" in rows.columns else []
    hist = rows.groupBy("_y", "_b").agg(F.count(F.lit(1)).alias("_n"), *known)
    before = Window.partitionBy("_y").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 16^digits rows at most
    hist = hist.withColumns({"_want": want, "_upto": F.sum("_n").over(before)})
    edge = (hist.where((F.col("_upto") - F.col("_n") < F.col("_want")) & (F.col("_want") <= F.col("_upto")))
            .select("_y", "_b", (F.col("_want") - (F.col("_upto") - F.col("_n"))).alias("_r")))
    found = rows.drop("_r").join(F.broadcast(edge), ["_y", "_b"])  # one row per class
    return found.select("_y", "_k", "_h", "_r")


def first_rows(df: DataFrame, n: int, key: str = "product_id", seed: int = SEED, reread: bool = False) -> DataFrame:
    """The first ``n`` rows in hash order of ``key`` (all, if fewer; ties in the key come along).

    A filter against the (hash, key) of the n-th row, which a histogram of hash prefixes finds:
    no task sorts or gathers rows. ``df`` is read twice, with ``reread`` (``class_thresholds``) three times.
    """
    return df.where(among_first(df, n, key, seed, reread))


def among_first(df: DataFrame, n: int, key: str = "product_id", seed: int = SEED, reread: bool = False) -> Column:
    """Is a row of ``df`` among its ``first_rows``?"""
    base = df.select(F.lit(0).alias("_y"), F.col(key).cast("string").alias("_k"), hash_order(key, seed).alias("_h"))
    last = materialize_small(_hash_thresholds(base, lambda total: F.least(total, F.lit(n)), reread=reread)).select("_threshold").scalar()
    return F.struct(hash_order(key, seed).alias("_h"), F.col(key).cast("string").alias("_k")) <= last


def stratified_split(df: DataFrame, label: str = "label", key: str = "product_id",
                     frac: float = TRAIN_FRACTION, seed: int = SEED, reread: bool = False) -> DataFrame:
    """H4: exact per-class split: the first round(frac * n_class) rows of each class in
    hash order are 'train', the rest 'test'.

    Rows are labelled map-side against a per-class threshold (``class_thresholds``,
    one row per class, broadcast), so the data itself is never sorted or shuffled.
    """
    t = F.broadcast(materialize_small(class_thresholds(df, label, key, frac, seed, reread=reread)))
    row = F.struct(hash_order(key, seed).alias("_h"), F.col(key).cast("string").alias("_k"))
    return (df.join(t, label, "left")
            .withColumn("split", F.when(F.col("_threshold").isNotNull() & (row <= F.col("_threshold")), "train")
                        .otherwise("test"))
            .drop("_threshold"))


def random_split(df: DataFrame, key: str = "product_id", frac: float = TRAIN_FRACTION,
                 seed: int = SEED) -> DataFrame:
    """H5: plain split by a hash threshold (no shuffle at all): 'train' when the first
    8 hex digits of the hash are below frac * 16^8."""
    threshold = format(int(frac * 16 ** 8), "08x")
    return df.withColumn("split", F.when(F.substring(hash_order(key, seed), 1, 8) < F.lit(threshold), "train")
                         .otherwise("test"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """H6: balanced weights n / (k * n_class) per class."""
    c = class_counts(df, label)
    tot = c.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return c.withColumn("weight", tot["n"] / (tot["k"] * F.col("n")))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """H6: attach the class weight to every row (broadcast: one row per class); rows without
    a label stay, without a weight. Weights are worked out once, not by every reader of the rows."""
    w = materialize_small(class_weights(df, label).select(label, F.col("weight").alias(out)))
    return df.join(F.broadcast(w), label, "left")


def assign_folds(df: DataFrame, label: str = "label", key: str = "product_id", k: int = FOLDS,
                 seed: int = SEED, write: bool = False) -> DataFrame:
    """H7: stratified folds: position in hash order within the class, modulo k. ``write`` as in ``_class_rank``."""
    ranked = _class_rank(df, label, key, seed, write)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank", "_rank_total")
