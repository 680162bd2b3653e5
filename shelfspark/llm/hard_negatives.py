"""Hard negatives of anchor vectors by rotated one-bit codes with exact integer scores.

Every vector is rotated by one random orthogonal matrix and written as a few one-bit codes:
the signs of the rotated vector, then the signs of what the codes before leave over. With a
code its alignment is stored, the mean absolute component, by which the code vector comes
nearest to the rest; the length of the last rest is stored, too. An anchor is rotated
likewise and rounded to ``PLANES`` bits a component, so its product with a code vector is a
weighted sum of popcounts. By Cauchy-Schwarz the true inner product lies within

    rest of x * length of q  +  length of x's code vector * rounding error of q

of that estimate. This holds for every pair, not just likely: a pair whose interval misses what
is wanted cannot be in the result, every other pair is scored in exact integers.

Anchors are searched in blocks of at most ``BLOCK``: a block is broadcast, and each block is two
passes over all rows (positives, then negatives in the score windows that the positives set),
each written before the next begins. Tasks return their own best rows for each anchor, which
are merged by a window over (anchor).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import remove_path, scratch_path

BLOCK = 16_384   # anchors broadcast at once
CODES = 4        # one-bit codes of a vector
PLANES = 6       # bits of an anchor's rotated component
_ANCHOR_TILE, _ROW_TILE = 512, 1024
_SEED = 42


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """(..., dim) booleans as (..., words) unsigned 64-bit words, zero-filled."""
    dim = bits.shape[-1]
    words = -(-max(dim, 1) // 64)
    full = np.zeros((*bits.shape[:-1], words * 64), bool)
    full[..., :dim] = bits
    return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, length of the rest) of each row: (n, codes, words), (n, codes), (n,)."""
    rest = vectors.astype(np.float64) @ _rotation(vectors.shape[1])
    bits, align = [], []
    for _ in range(codes):
        positive = rest >= 0
        a = np.abs(rest).mean(axis=1) if rest.shape[1] else np.zeros(len(rest))
        rest = rest - a[:, None] * np.where(positive, 1.0, -1.0)
        bits.append(_packed(positive))
        align.append(a)
    return np.stack(bits, axis=1), np.stack(align, axis=1), np.linalg.norm(rest, axis=1)


class Rows:
    """Encoded rows of one batch."""

    def __init__(self, ids, labels, ints, codes, align, rest):
        self.ids, self.labels, self.ints, self.codes, self.align, self.rest = ids, labels, ints, codes, align, rest
        dim = ints.shape[1]
        ones = np.bitwise_count(codes).sum(axis=2, dtype=np.int64)
        self.tilt = (align * (2 * ones - dim)).sum(axis=1)   # code vector times the vector of ones
        self.weight = align.sum(axis=1)
        signs = np.unpackbits(codes.view(np.uint8), axis=2, bitorder="little")[:, :, :dim] * 2.0 - 1
        self.code_length = np.linalg.norm((signs * align[:, :, None]).sum(axis=1), axis=1)
        self.length = np.linalg.norm(ints.astype(np.float64), axis=1)

    def take(self, index: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        for k, v in self.__dict__.items():
            setattr(out, k, v[index])
        return out


class Anchors:
    """A block of anchors: exact vectors and their rounded rotated bit planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray):
        self.ids, self.labels, self.ints = ids, labels, ints
        turned = ints.astype(np.float64) @ _rotation(ints.shape[1])
        self.low = turned.min(axis=1, initial=np.inf) if ints.shape[1] else np.zeros(len(ids))
        top = turned.max(axis=1, initial=-np.inf) if ints.shape[1] else np.zeros(len(ids))
        step = (top - self.low) / (2 ** PLANES - 1)
        self.step = np.where(step > 0, step, 1.0)
        level = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, 2 ** PLANES - 1).astype(np.int64)
        self.total = level.sum(axis=1)
        self.planes = np.stack([_packed(level >> b & 1 == 1) for b in range(PLANES)], axis=1)
        self.error = np.linalg.norm(turned - self.low[:, None] - self.step[:, None] * level, axis=1)
        self.length = np.linalg.norm(ints.astype(np.float64), axis=1)


def interval(anchors: Anchors, at: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the inner product of the anchors ``at`` with all ``rows``, as (len(at), len(rows))."""
    words = rows.codes.shape[2]
    total = np.zeros((len(at), len(rows.ids)))
    for c in range(rows.codes.shape[1]):
        shared = np.zeros((len(at), len(rows.ids)), np.int32)
        for b in range(PLANES):
            for w in range(words):
                both = anchors.planes[at, b, w][:, None] & rows.codes[None, :, c, w]
                shared += np.left_shift(np.bitwise_count(both), b, dtype=np.int32)
        total += rows.align[None, :, c] * shared
    estimate = anchors.low[at, None] * rows.tilt + anchors.step[at, None] * (2 * total - anchors.total[at, None] * rows.weight)
    # the last term covers the rounding of the floating-point sums
    spread = (anchors.length[at, None] * rows.rest + anchors.error[at, None] * rows.code_length
              + 1e-9 * anchors.length[at, None] * rows.length + 1e-9)
    return estimate - spread, estimate + spread


def _exact_type(anchors: Anchors, rows: Rows) -> type:
    """A type in which no partial sum of an inner product can be rounded."""
    bound = anchors.length.max(initial=0) * rows.length.max(initial=0) * 1.01
    return np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64


def scores(anchors: Anchors, a: np.ndarray, rows: Rows, r: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (a[k], r[k])."""
    kind = _exact_type(anchors, rows)
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 1 << 16):
        x, q = rows.ints[r[k:k + (1 << 16)]].astype(kind), anchors.ints[a[k:k + (1 << 16)]].astype(kind)
        out[k:k + (1 << 16)] = np.einsum("ij,ij->i", q, x)
    return out


class _Best:
    """The best ``n`` (score, id) of every key: higher scores first, then smaller ids."""

    def __init__(self, keys: int, n: int):
        self.n = n
        self.key = self.score = self.id = np.empty(0, np.int64)
        self.bar = np.full(keys, np.iinfo(np.int64).min)  # the n-th score so far

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        top = place < self.n
        self.key, self.score, self.id = key[top], score[top], ids[top]
        last = place[top] == self.n - 1
        self.bar[self.key[last]] = self.score[last]


Visit = Callable[[Rows], None]


def _batches(rows: Iterator[pa.RecordBatch], dim: int) -> Iterator[Rows]:
    for b in rows:
        if not b.num_rows:
            continue
        n, words = b.num_rows, -(-max(dim, 1) // 64)
        flat = lambda name, kind: b.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
        ints = flat("ints", np.int64).reshape(n, dim)
        codes = np.ascontiguousarray(flat("codes", np.int64)).view(np.uint64).reshape(n, -1, words)
        align = flat("align", np.float64).reshape(n, -1)
        column = lambda name: b.column(name).to_numpy(zero_copy_only=False)
        yield Rows(column("id"), column("label"), ints, codes, align, column("rest"))


def _tiles(rows: Rows, anchors: np.ndarray) -> Iterator[tuple[Rows, np.ndarray]]:
    for r in range(0, len(rows.ids), _ROW_TILE):
        part = rows.take(slice(r, r + _ROW_TILE))
        for a in range(0, len(anchors), _ANCHOR_TILE):
            yield part, anchors[a:a + _ANCHOR_TILE]


def _positives(batches: Iterator[pa.RecordBatch], anchors: Anchors, n: int, dim: int) -> Iterator[pa.RecordBatch]:
    best = _Best(len(anchors.ids), n)
    for rows in _batches(batches, dim):
        for label in np.intersect1d(rows.labels, anchors.labels):
            same = rows.take(np.flatnonzero(rows.labels == label))
            for part, at in _tiles(same, np.flatnonzero(anchors.labels == label)):
                _, high = interval(anchors, at, part)
                i, r = np.nonzero(high >= best.bar[at, None])
                a = at[i]
                # an anchor is not its own positive
                own = anchors.ids[a] == part.ids[r]
                own[own] = (anchors.ints[a[own]] == part.ints[r[own]]).all(axis=1)
                a, r = a[~own], r[~own]
                best.add(a, scores(anchors, a, part, r), part.ids[r])
    yield pa.RecordBatch.from_arrays([pa.array(best.key), pa.array(best.id), pa.array(best.score)], ["anchor", "id", "score"])


class Windows:
    """Score windows of a block's (anchor, positive) pairs, ``n`` places for each anchor."""

    def __init__(self, anchors: int, n: int, a: np.ndarray, place: np.ndarray, ids: np.ndarray, score: np.ndarray, low: int, high: int):
        self.n = n
        self.positive, self.score = np.zeros((anchors, n), np.int64), np.zeros((anchors, n), np.int64)
        self.low, self.high = np.ones((anchors, n), np.int64), np.zeros((anchors, n), np.int64)  # empty: low > high
        self.positive[a, place], self.score[a, place] = ids, score
        self.low[a, place], self.high[a, place] = -(-low * score // 100), high * score // 100


def _negatives(batches: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows, n: int, dim: int) -> Iterator[pa.RecordBatch]:
    best = _Best(windows.low.size, n)
    searched = np.flatnonzero((windows.low <= windows.high).any(axis=1))
    some = windows.low <= windows.high
    top = np.where(some, windows.high, np.iinfo(np.int64).min).max(axis=1, initial=np.iinfo(np.int64).min)
    for rows in _batches(batches, dim):
        for part, at in _tiles(rows, searched):
            # below the n-th score of each of an anchor's windows nothing is wanted
            bar = np.maximum(windows.low, best.bar.reshape(windows.low.shape))[at]
            least = np.where(some[at], bar, np.iinfo(np.int64).max).min(axis=1)
            low, high = interval(anchors, at, part)
            i, r = np.nonzero((high >= least[:, None]) & (low <= top[at, None]) & (anchors.labels[at, None] != part.labels))
            a = at[i]
            score = scores(anchors, a, part, r)
            for w in range(windows.n):
                inside = (windows.low[a, w] <= score) & (score <= windows.high[a, w])
                best.add(a[inside] * windows.n + w, score[inside], part.ids[r[inside]])
    a, w = np.divmod(best.key, windows.n)
    columns = {"key": best.key, "anchor_id": anchors.ids[a], "positive_id": windows.positive[a, w], "negative_id": best.id,
               "positive_score": windows.score[a, w], "negative_score": best.score}
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns.values()], list(columns))


def encoded(rows: DataFrame, dim: int) -> DataFrame:
    """``rows`` (id, label, ints of length ``dim``) with their codes, alignments and rests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ints = b.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            codes, align, rest = encode(ints)
            lists = lambda x, kind: pa.array(list(x.reshape(b.num_rows, -1)), pa.list_(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, lists(codes.view(np.int64), pa.int64()), lists(align, pa.float64()), pa.array(rest)],
                                             [*b.schema.names, "codes", "align", "rest"])

    return rows.mapInArrow(run, "id bigint, label bigint, anchor boolean, ints array<bigint>, codes array<bigint>, align array<double>, rest double")


EMPTY = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x becomes floor(scale * x); a score is the integer inner product. An anchor's
    positives are its first ``positives`` other rows of its label, higher scores first, then
    smaller ids. For each pair the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score are returned.

    Rows with a null id, label or vector, or a null or non-finite component take no part.
    Rows equal in id, label and vector count once; rows that share an id only are different
    rows. Shorter vectors are filled with zeros. Scores must fit 64 bits. Ties go to the
    smaller id. Other columns are not read. Without rows or anchors the result is empty.
    """
    spark = rows.sparkSession
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ids = F.col(id_col).cast("bigint")
    sound = rows.where(ids.isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite)
    sound = sound.select(ids.alias("id"), F.col(label_col).cast("bigint").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
                         F.transform(v, lambda x: F.floor(x * F.lit(scale))).alias("ints"))
    dim = sound.agg(F.max(F.size("ints"))).first()[0] or 0
    filled = sound.withColumn("ints", F.concat("ints", F.array_repeat(F.lit(0).cast("bigint"), dim - F.size("ints"))))
    # dealt by id, so that equal rows meet; the codes are written once and read by every pass
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = filled.repartition(parts, "id").groupBy("id", "label", "ints").agg(F.bool_or("anchor").alias("anchor"))
    folder = scratch_path(spark, f"hard-negatives-{uuid.uuid4().hex}")
    encoded(once.select("id", "label", "anchor", "ints"), dim).write.parquet(f"{folder}/rows")
    table = spark.read.parquet(f"{folder}/rows")
    all_rows = table.select("id", "label", "ints", "codes", "align", "rest")

    count = table.where("anchor").count()
    blocks = -(-2 * count // block)  # half full on average, so that an uneven hash stays below the bound
    for k in range(blocks):
        mine_now = table.where("anchor").where(F.pmod(F.xxhash64("id", "label", "ints"), F.lit(blocks)) == k).select("id", "label", "ints").toArrow()
        if not mine_now.num_rows:
            continue
        ints = mine_now.column("ints").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        held = Anchors(mine_now.column("id").to_numpy(), mine_now.column("label").to_numpy(), ints)
        sent = spark.sparkContext.broadcast(held)
        near = all_rows.mapInArrow(lambda b, sent=sent: _positives(b, sent.value, positives, dim), "anchor bigint, id bigint, score bigint")
        by_anchor = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        found = near.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives).toArrow()  # at most positives * block rows
        column = lambda name: found.column(name).to_numpy().astype(np.int64)
        windows = Windows(len(held.ids), positives, column("anchor"), column("place") - 1, column("id"), column("score"), low, high)
        sent_windows = spark.sparkContext.broadcast(windows)
        far = all_rows.mapInArrow(lambda b, sent=sent, w=sent_windows: _negatives(b, sent.value, w.value, negatives, dim),
                                  "key bigint, anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
        by_pair = Window.partitionBy("key").orderBy(F.desc("negative_score"), "negative_id")
        (far.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= negatives)
         .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
         .write.mode("append").parquet(f"{folder}/result"))
        sent.destroy()
        sent_windows.destroy()
    remove_path(spark, f"{folder}/rows")
    return spark.read.schema(EMPTY).parquet(f"{folder}/result") if blocks else spark.createDataFrame([], EMPTY)


#: The same result by scoring every pair, for DuckDB.
MINE_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER w::INTEGER AS rank, n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""
