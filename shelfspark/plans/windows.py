"""Order-dependent window plans that scale past one task.

A window with no PARTITION BY (or one partitioned by a hot key) sends every row
to a single task. ``running_sums`` splits the global order into slices (sampled
ranges, or a hash prefix when rows are ordered by a hash), computes the window
inside each slice in parallel, and stitches slices together with a small
per-slice table whose size is bounded by the number of slices. ``next_row``
windows per (key, position bucket) and solves the bucket boundaries the same
way, recursively.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import ensure_checkpoint_dir

_SLICE = "__rs_slice"


def _slices(df: DataFrame, slices: int | None) -> int:
    if slices:
        return int(slices)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a null key meets a null key (groups have them, too)."""
    other = right.withColumnsRenamed({k: f"__rk_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__rk_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"__rk_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    values: Mapping[str, str | Column],
    order: Sequence[Column],
    partition: Sequence[str] = (),
    slices: int | None = None,
    slice_by: Column | None = None,
    with_totals: bool = False,
    fix: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add one column per ``values`` entry: the sum of that value over rows up to and
    including this one (and ``<name>_total``, the sum over the whole partition key,
    when ``with_totals``).

    Rows are ordered by ``order`` (a total order: include a unique tie-break),
    restarting for each ``partition`` key. Equivalent to
    ``sum(v) OVER (PARTITION BY partition ORDER BY order ROWS UNBOUNDED PRECEDING)``
    but the rows are range-partitioned into ``slices`` parallel tasks; a per-slice
    total table (at most ``slices`` rows per partition key) supplies each slice's
    offset. Use exact types (bigint, decimal) so that the stitched sums equal a
    sequential sum exactly.

    ``slice_by``: an integer Column in [0, slices) that never decreases along
    ``order`` within a partition key (e.g. a prefix of a hash the rows are ordered
    by). It replaces the sampled range partitioning: no sampling pass over the
    input, and since the slice is a plain function of the row, no checkpoint. The
    offset table then goes to every task (``slices`` rows per partition key, of which
    there should be few, as classes are), so rows are shuffled once. ``fix`` may write
    the rows with their sums inside the slice, which are read twice.
    """
    n = _slices(df, slices)
    names = list(values)
    tmp = {o: f"__rs_v{i}" for i, o in enumerate(names)}
    keys = [F.col(p).asc() for p in partition] + list(order)
    base = df.withColumns({tmp[o]: (v if isinstance(v, Column) else F.col(v)) for o, v in values.items()})
    w_local = (Window.partitionBy(_SLICE, *partition).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = {f"{t}_l": F.sum(t).over(w_local) for t in tmp.values()}
    if slice_by is not None:
        local = base.withColumn(_SLICE, slice_by).withColumns(sums)
        local = fix(local) if fix else local
    else:
        ranged = base.repartitionByRange(n, *keys).withColumn(_SLICE, F.spark_partition_id())
        # The slice id comes from sampled range bounds, so it must be fixed once:
        # the reliable checkpoint is read by both the offset table and the final
        # join (it also survives the loss of an executor).
        ensure_checkpoint_dir(df.sparkSession)
        local = ranged.withColumns(sums).checkpoint(eager=True)
    totals = local.groupBy(_SLICE, *partition).agg(*[F.sum(t).alias(f"{t}_t") for t in tmp.values()])
    w_prev = (Window.partitionBy(*partition).orderBy(_SLICE)
              .rowsBetween(Window.unboundedPreceding, -1))
    w_all = Window.partitionBy(*partition)
    offsets = totals.select(_SLICE, *partition, *[
        F.coalesce(F.sum(f"{t}_t").over(w_prev), F.lit(0).cast(totals.schema[f"{t}_t"].dataType)).alias(f"{t}_o")
        for t in tmp.values()], *[F.sum(f"{t}_t").over(w_all).alias(f"{t}_a") for t in tmp.values()])
    if fix:
        ensure_checkpoint_dir(df.sparkSession)
        offsets = offsets.checkpoint(eager=True)
    if not partition or slice_by is not None:
        offsets = F.broadcast(offsets)  # one row per slice: bounded by ``slices``
    out = _null_safe_join(local, offsets, [_SLICE, *partition])
    out = out.withColumns({o: F.col(f"{t}_l") + F.col(f"{t}_o") for o, t in tmp.items()})
    if with_totals:
        out = out.withColumns({f"{o}_total": F.col(f"{t}_a") for o, t in tmp.items()})
    return out.drop(_SLICE, *[c for t in tmp.values() for c in (t, f"{t}_l", f"{t}_o", f"{t}_a")])


def running_sum(
    df: DataFrame,
    value: str | Column,
    order: Sequence[Column],
    partition: Sequence[str] = (),
    out: str = "running",
    slices: int | None = None,
) -> DataFrame:
    """Add ``out`` = running sum of ``value`` (see ``running_sums``)."""
    return running_sums(df, {out: value}, order, partition, slices)


def running_count(df: DataFrame, order: Sequence[Column], partition: Sequence[str] = (),
                  out: str = "rank", slices: int | None = None, slice_by: Column | None = None,
                  with_totals: bool = False, fix: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """1-based position of each row in ``order`` within ``partition`` (row_number, distributed)."""
    return running_sums(df, {out: F.lit(1).cast("bigint")}, order, partition, slices, slice_by, with_totals, fix)


def hash_slice(hex_hash: Column, slices: int) -> Column:
    """Slice id in [0, slices) from the first 8 hex digits of a hash: order preserving,
    so rows ordered by the hash can be sliced without sampling."""
    return F.floor(F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("double") * slices / float(16 ** 8)).cast("int")


def next_row(
    df: DataFrame,
    partition: Sequence[str],
    order: str,
    cols: Sequence[str],
    prefix: str = "next_",
    bucket_size: int = 4096,
    levels: int = 2,
) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` in the next row by integer ``order`` within ``partition``.

    Same result as ``lead(c) OVER (PARTITION BY partition ORDER BY order)``. The
    window runs per (partition, order // bucket_size) bucket, so a single huge
    partition (one conversation with a third of all rows) is spread over many
    tasks. The last row of each bucket takes the first row of the next non-empty
    bucket from a per-bucket table (one row per bucket); that table is itself
    solved the same way, ``levels`` deep, so no window ever holds more than about
    ``bucket_size`` rows per key at the top level for up to ``bucket_size ** levels``
    positions.
    """
    tag = f"__nr{levels}"
    b, first, after = f"{tag}_b", f"{tag}_first", f"{tag}_after"
    base = df.withColumn(b, F.floor(F.col(order) / F.lit(bucket_size)))
    w = Window.partitionBy(*partition, b).orderBy(order)
    local = base.withColumns({f"{tag}_n_{c}": F.lead(c).over(w) for c in [order, *cols]})
    firsts = base.groupBy(*partition, b).agg(
        F.min(F.struct(F.col(order).alias(order), *[F.col(c).alias(c) for c in cols])).alias(first))
    if levels > 1:
        firsts = next_row(firsts, partition, b, [first], prefix=f"{tag}_nx_", bucket_size=bucket_size,
                          levels=levels - 1).select(*partition, b, F.col(f"{tag}_nx_{first}").alias(after))
    else:
        firsts = firsts.select(*partition, b, F.lead(first).over(Window.partitionBy(*partition).orderBy(b))
                               .alias(after))
    joined = _null_safe_join(local, firsts, [*partition, b], "left")
    last_in_bucket = F.col(f"{tag}_n_{order}").isNull()
    out = joined.withColumns({prefix + c: F.when(last_in_bucket, F.col(after)[c]).otherwise(F.col(f"{tag}_n_{c}"))
                              for c in [order, *cols]})
    return out.drop(b, after, *[f"{tag}_n_{c}" for c in [order, *cols]])
