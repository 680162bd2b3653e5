"""Tables that several writers append to: committed batches, and snapshots that merge them.

A batch is written to a staging folder and becomes part of the table by one rename to
``batch=<id>-<rows>``; readers take committed folders only. Ids begin with the time of the append, so
they order the batches; a batch id that is committed already is ignored, so a repeated append
changes nothing. Appending reads no data of the table. ``compact`` merges small batches
into ``snapshot=<id>-<rows>``, which names the batches that it holds: readers take the newest snapshot
and the batches that it does not name, so a batch committed meanwhile is not lost. A rename is
atomic on HDFS and local disks; on object stores it needs a store that offers one.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"(batch|snapshot)=(\w+)-(\d+)$")
_PLACE = T.StructType([T.StructField("batch", T.StringType()), T.StructField("seq", T.LongType())])


def new_batch_id() -> str:
    return f"{time.time_ns() // 1000:017d}_{uuid.uuid4().hex[:12]}"


class _Folder:
    """The few file-system calls needed, on whatever store the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        if not self.fs.exists(self.path("")):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(""))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def publish(self, staged: str, name: str) -> bool:
        return not self.fs.exists(self.path(name)) and self.fs.rename(self.path(staged), self.path(name))


def _state(folder: _Folder) -> tuple[str | None, dict[str, int], dict[str, str]]:
    """(newest snapshot, rows of its batches, {id: folder} of later batches); one folder an id."""
    found = sorted(m.groups() + (m.group(0),) for m in map(_NAME.match, folder.names()) if m)
    snapshots = [f for f in found if f[0] == "snapshot"]
    newest = max(snapshots, key=lambda f: (int(f[2]), f[1]))[3] if snapshots else None
    held = json.loads(folder.read(f"{newest}/_batches.json")) if newest else {}
    later: dict[str, str] = {}
    for kind, ident, _, name in found:
        if kind == "batch" and ident not in held:
            later.setdefault(ident, name)
    return newest, held, later


def _rows(name: str) -> int:
    return int(_NAME.match(name).group(3))


def append_batch(rows: DataFrame, root: str, fmt: str, batch_id: str | None = None) -> str:
    """Commit ``rows`` (which may have a ``seq`` column) as one batch; returns its id."""
    spark = rows.sparkSession
    ident = batch_id or new_batch_id()
    if not re.fullmatch(r"\w+", ident):
        raise ValueError(f"a batch id holds letters, digits and _: {ident!r}")
    folder = _Folder(spark, root)
    _, held, later = _state(folder)
    if ident in held or ident in later:
        return ident
    staged = f"_staging/{uuid.uuid4().hex}"
    rows.write.format(fmt).save(f"{folder.root}/{staged}")
    n = spark.read.schema(rows.schema).format(fmt).load(f"{folder.root}/{staged}").count()  # the new rows only
    if not folder.publish(staged, f"batch={ident}-{n}"):
        folder.delete(staged)
        if ident not in _state(folder)[2]:
            raise OSError(f"batch {ident} could not be committed to {root}")
    return ident


def batch_rows(spark: SparkSession, root: str) -> dict[str, int]:
    """{batch id: rows} of all committed batches, in their order."""
    _, held, later = _state(_Folder(spark, root))
    return dict(sorted({**held, **{i: _rows(n) for i, n in later.items()}}.items()))


def read_batches(spark: SparkSession, root: str, fmt: str, schema: T.StructType) -> DataFrame:
    """All committed rows with their ``batch`` id; empty if there are none.

    ``schema`` is the batches' own; snapshots have the ``batch`` column besides.
    """
    newest, _, later = _state(_Folder(spark, root))
    full = T.StructType([*schema.fields, _PLACE["batch"]])
    root = root.rstrip("/")
    out = spark.createDataFrame([], full)
    if newest:
        out = spark.read.schema(full).format(fmt).load(f"{root}/{newest}/part-*")
    if later:
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\w+)-\d+/[^/]*$", 1)
        loaded = spark.read.schema(schema).format(fmt).load([f"{root}/{n}/part-*" for n in later.values()])
        out = (out if newest else out.limit(0)).unionByName(loaded.select("*", name.alias("batch")))
    return out


def compact(spark: SparkSession, root: str, fmt: str, schema: T.StructType) -> bool:
    """Merge the newest snapshot and the batches after it into a new one; merged folders go.

    False if there was nothing to merge, or another writer published a snapshot first.
    """
    folder = _Folder(spark, root)
    newest, held, later = _state(folder)
    if not later:
        return False
    merged = {**held, **{i: _rows(n) for i, n in later.items()}}
    staged = f"_staging/{uuid.uuid4().hex}"
    read_batches(spark, root, fmt, schema).write.format(fmt).save(f"{folder.root}/{staged}")
    folder.write(f"{staged}/_batches.json", json.dumps(merged))
    if _state(folder)[0] != newest or not folder.publish(staged, f"snapshot={max(merged)}-{sum(merged.values())}"):
        folder.delete(staged)
        return False
    for name in [*later.values(), *([newest] if newest else [])]:
        folder.delete(name)
    return True
