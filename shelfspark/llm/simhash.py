"""SimHash near-duplicates through an inverted index of fingerprint bytes, with count filtering.

A 64-bit fingerprint is eight positional bytes. Fingerprints at most ``d`` bits apart
differ in at most ``d`` bytes, so their tally of shared positional bytes is at least
``8 - d``: the guaranteed minimum of the count filter. Postings of single bytes would pair
everything within 1/256 of the corpus, so the bytes are dealt into ``d + 2`` groups, of which
such a pair shares two whole ones: an index entry holds the fingerprints that agree in two
groups (for d = 2, six entries of four bytes a fingerprint). Of the pairs that meet in an
entry, those whose tally over all eight bytes reaches the minimum are kept, and their bit
distance is verified. Entries of more than ``PAIRED`` different fingerprints are dealt anew by
the sets of ``8 - d`` bytes around theirs, in one of which every pair that reaches the minimum
meets: at most 256^d members, solved without listing their pairs (``_flip_links``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import pinned
from shelfspark.llm.components import connected_components
from shelfspark.plans.reuse import written

SEED = 42
_BLOCK = 1 << 16
#: Entries of up to so many fingerprints tally their pairs.
PAIRED = 256


def simhash(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of word shingles (A-Z lower-cased, repeats included, XXH64).

    Fewer words than ``shingle``: the whole sequence is the one shingle. No word: 0.
    """
    import xxhash

    ws = (text or b"").lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    end = np.cumsum(size)
    first, last = (end - size)[: len(ws) - shingle + 1], end[shingle - 1:] - 1
    one = np.zeros(64, np.int64)
    for k in range(0, len(first), _BLOCK):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], seed)
                         for s, e in zip(first[k:k + _BLOCK].tolist(), last[k:k + _BLOCK].tolist(), strict=True)), np.uint64)
        one += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * one > len(first), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 carry: str | None = None) -> DataFrame:
    """(id, fp): the SimHash of every row's whole text, as the signed long of its 64 bits;
    with ``carry`` also that column, as ``carry``.

    Null and empty texts and texts of white space get 0. Only the two named columns are
    read, so other columns and their names don't matter. Repeated rows stay repeated.
    """
    extra = [F.col(carry).alias("carry")] if carry else []
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra)
    carried = ["carry"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in b.column("text").cast(pa.binary())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64)), *[b.column(c) for c in carried]], ["id", "fp", *carried])

    kinds = "".join(f", {c} {narrow.schema[c].dataType.simpleString()}" for c in carried)
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, fp bigint{kinds}")


def _mask(positions: tuple[int, ...]) -> int:
    """The signed 64-bit mask that keeps these bytes."""
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def posted_sets(max_bits: int) -> list[tuple[int, ...]]:
    """The byte positions of each index entry: all groups but ``max_bits`` of ``max_bits + 2``."""
    n = min(8, max_bits + 2)
    groups = [tuple(int(p) for p in g) for g in np.array_split(np.arange(8), n)]
    return [sum(kept, ()) for kept in combinations(groups, max(1, n - max_bits))]


def finer_sets(positions: tuple[int, ...], max_bits: int) -> list[tuple[int, ...]]:
    """The sets of ``8 - max_bits`` positions that hold the given ones."""
    rest = [p for p in range(8) if p not in positions]
    more = max(0, 8 - min(max_bits, 7) - len(positions))
    return [tuple(sorted((*positions, *extra))) for extra in combinations(rest, more)]


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes two fingerprints share, from their XOR."""
    y = x | x >> np.uint64(4)
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return 8 - np.bitwise_count(y & np.uint64(0x0101010101010101))


def _tallied_links(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Linked pairs (i < j) of distinct fingerprints by count filter and verification, and how many
    pairs reached the guaranteed minimum."""
    x = fp[:, None] ^ fp[None, :]
    i, j = np.nonzero(np.triu(shared_bytes(x) >= 8 - max_bits, 1))
    near = np.bitwise_count(x[i, j]) <= max_bits
    return i[near], j[near], len(i)


def _flip_links(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of distinct fingerprints, both ways: a sorted lookup of ``fp ^ flip`` for every
    flip of at most ``max_bits`` bits that are not the same in all, in flips x members steps."""
    order = np.argsort(fp)
    ranked = fp[order]
    free = np.bitwise_or.reduce(fp ^ fp[0])
    bits = [np.uint64(1) << np.uint64(k) for k in range(64) if int(free) >> k & 1]
    pairs_i, pairs_j = [np.empty(0, int)], [np.empty(0, int)]
    for k in range(1, max_bits + 1):
        for flip in combinations(bits, k):
            want = fp ^ np.bitwise_or.reduce(np.array(flip, np.uint64))
            at = np.minimum(np.searchsorted(ranked, want), len(fp) - 1)
            hit = ranked[at] == want
            pairs_i.append(np.nonzero(hit)[0])
            pairs_j.append(order[at[hit]])
    return np.concatenate(pairs_i), np.concatenate(pairs_j)


def _link_entry(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """For distinct fingerprints of one index entry: the smallest index each one reaches over links."""
    n = len(fp)
    label = np.arange(n)
    fp = fp.view(np.uint64)
    i, j = _tallied_links(fp, max_bits)[:2] if n <= PAIRED else _flip_links(fp, max_bits)
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches: Iterator[pa.RecordBatch], named: bool = False) -> Iterator[tuple]:
    """(fp, node) of each (entry, key) group of at least two, from batches sorted by them; ``named``
    adds the entry."""
    held: list[np.ndarray] = []
    held_key = None
    for b in batches:
        entry, key, fp, node = (b.column(c).to_numpy(zero_copy_only=False) for c in ("entry", "key", "fp", "node"))
        if not len(entry):
            continue
        cut = np.flatnonzero((entry[1:] != entry[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(entry)]])
        many = (ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            k = (int(entry[s]), int(key[s]))
            part = np.stack([fp[s:e], node[s:e]])
            if k == held_key:
                held.append(part)
                continue
            if held and sum(p.shape[1] for p in held) > 1:
                yield (*np.concatenate(held, axis=1), *([held_key[0]] if named else []))
            held, held_key = [part], k
    if held and sum(p.shape[1] for p in held) > 1:
        yield (*np.concatenate(held, axis=1), *([held_key[0]] if named else []))


def _posted(rows: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(entry, key, fp, node) of each row in each of the position sets; ``entry`` numbers the set."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(s))) for s in sets])
    return rows.select("fp", "node", F.posexplode(keys).alias("entry", "key"))


def _dealt(entries: DataFrame) -> DataFrame:
    return entries.repartition("entry", "key").sortWithinPartitions("entry", "key", "fp")


def index_entries(distinct: DataFrame, max_bits: int = 2) -> tuple[DataFrame, DataFrame | None]:
    """Rows (fp, node, entry, key) of the inverted index, from one row (fp, node) each: entries of
    up to ``PAIRED`` fingerprints, and the larger ones dealt by finer sets (None if there are none).

    Entries are counted first (a partial and a final count), so no task gets a large one.
    """
    sets = posted_sets(max_bits)
    entries = _posted(distinct, sets)
    large = written(entries.groupBy("entry", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRED).drop("n"))
    if large.isEmpty():
        return entries, None
    fine = sorted({f for s in sets for f in finer_sets(s, max_bits)})
    around = F.array(*[F.array(*[F.lit(fine.index(f)) for f in finer_sets(s, max_bits)]) for s in sets])
    masks = F.array(*[F.lit(_mask(f)) for f in fine])
    anew = (entries.join(large, ["entry", "key"], "left_semi")
            .select("fp", "node", F.explode(F.get(around, F.col("entry"))).alias("entry"))
            .withColumn("key", F.col("fp").bitwiseAND(F.get(masks, F.col("entry")))))
    return entries.join(large, ["entry", "key"], "left_anti"), anew


def _linked(entries: DataFrame, max_bits: int) -> DataFrame:
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for fp, node in _groups(batches):
            first = np.concatenate([[True], fp[1:] != fp[:-1]])  # two large entries may deal a row to one finer set
            fp, node = fp[first], node[first]
            label = _link_entry(fp, max_bits)
            own = np.flatnonzero(label != np.arange(len(fp)))
            a.append(node[own])
            b.append(node[label[own]])
            if sum(map(len, a)) > _BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return _dealt(entries).mapInArrow(link, "a bigint, b bigint")


def fingerprint_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) between nodes of linked fingerprints, from one row (fp, node) each.

    Every link lies on a path of edges; an entry of k linked members gives at most k - 1.
    """
    entries, anew = index_entries(distinct, max_bits)
    links = _linked(entries, max_bits)
    return links if anew is None else links.unionByName(_linked(anew, max_bits))


def tally_counts(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(entry, met, reached, linked) for each position set of the index, from one row (fp, node) each:
    pairs that met in its entries of up to ``PAIRED`` fingerprints, those whose tally of shared bytes
    reached the guaranteed minimum, and those verified by bit distance."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for fp, _, entry in _groups(batches, named=True):
            i, _, reached = _tallied_links(fp.view(np.uint64), max_bits)
            out.append((entry, len(fp) * (len(fp) - 1) // 2, reached, len(i)))
            if len(out) == _BLOCK:
                yield _counts(out)
                out = []
        yield _counts(out)

    rows = _dealt(index_entries(distinct, max_bits)[0]).mapInArrow(count, "entry bigint, met bigint, reached bigint, linked bigint")
    return rows.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("met", "reached", "linked")])


def _counts(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    table = np.array(rows, np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(4)], ["entry", "met", "reached", "linked"])


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2,
            carry: str | None = None) -> DataFrame:
    """(id, fp, component_id, component) and ``carry`` for every row: ``component`` is the smallest
    fingerprint of the row's group, ``component_id`` its smallest id (null if no row has one)."""
    rows = pinned(fingerprints(docs, id_col, text_col, shingle, carry))
    nodes = pinned(rows.groupBy("fp").agg(F.min("id").cast("bigint").alias("least")))
    links = fingerprint_links(nodes.select("fp", F.col("fp").alias("node")), max_bits)
    linked = pinned(connected_components(links).withColumnRenamed("node", "fp").join(nodes, "fp"))  # linked fingerprints only
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = (nodes.join(linked.join(names, "component").select("fp", "component", F.col("component_id").alias("shared")), "fp", "left")
             .select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("shared")).alias("component_id")))
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    ``fingerprint``: 16 lower-case hex digits. ``component_id``: the smallest id reachable
    over fingerprints at most ``max_bits`` bits apart, itself included. Equal fingerprints
    are one node of the index, so copies are never paired with each other. Ids are
    integers; rows with a null id link like all others, and a group in which no row has an id
    has a null component_id. Repeated ids give repeated rows. An empty table gives no rows.
    """
    return grouped(docs, id_col, text_col, shingle, max_bits).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each group stays, that with the
    smallest id (null ids last), then the smallest hash of its text.

    Rows are told apart by id and text, so one id with several texts loses only what another row
    stands for; of rows equal in both, one stays. Other columns may have any names.
    """
    key = "__simhash_row"
    text = F.coalesce(F.concat(F.lit("="), F.col(text_col).cast("string")), F.lit("-"))
    marked = docs.withColumn(key, F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text)))
    rows = pinned(grouped(marked, id_col, text_col, shingle, max_bits, key).select("component", "carry", F.struct(F.col("id").isNull(), "id", "carry").alias("place")))
    first = rows.groupBy("component").agg(F.min("place").alias("first"))
    gone = rows.join(first, "component").where(F.col("place") != F.col("first")).select(F.col("carry").alias(key)).distinct()
    again = pinned(rows.groupBy(F.col("carry").alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key).join(gone, key, "left_anti"))
    left = marked.join(gone.unionByName(again), key, "left_anti")
    twice = marked.join(again, key, "left_semi").dropDuplicates([key])
    return left.unionByName(twice).drop(key)
