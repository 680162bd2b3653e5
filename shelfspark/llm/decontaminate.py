"""Benchmark decontamination by the q-gram lemma.

A benchmark item's segments are its stretches of a fixed length at every offset. Texts that
align with a segment of length L with at most k edits share at least L - q + 1 - k q of its
q-grams, all within k neighbouring diagonals (text position minus item position). So q-grams
shared with an item are gathered in overlapping diagonal bands, the offsets at which a window
of segment length holds enough of them are kept, and a banded alignment verifies these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import pinned, slices

Q = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_BLOCK = 32


@dataclass(frozen=True)
class Leak:
    """Segment length in characters; edits allowed per character of a segment."""

    segment: int = 80
    edit_rate: float = 0.08
    #: Benchmark characters held by one broadcast index; more are searched in further passes.
    block_chars: int = 2_000_000
    #: Also report items of fewer than Q characters.
    short_items: bool = True


def normalise(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def folded(text: str) -> np.ndarray:
    """One byte per character; equal characters have equal bytes (so q-grams are never lost)."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return ((c ^ (c >> 8) ^ (c >> 16)) & 0xFF).astype(np.uint8)


def qgrams(chars: np.ndarray) -> np.ndarray:
    """The code of the Q bytes at every position (the last ones run into zero bytes)."""
    padded = np.concatenate([chars, np.zeros(Q, np.uint8)])
    return np.ndarray((len(chars),), "<u8", padded, strides=(1,)).copy()


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)


class Segments(Sequence):
    """(item, offset in the item, characters) of every segment, cut when asked for."""

    def __init__(self, items: list[tuple[int, str]], first: np.ndarray, length: int):
        self.items, self.first, self.length = items, first, length

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, i: int) -> tuple[int, int, str]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        n = int(np.searchsorted(self.first, i, side="right")) - 1
        (item, text), at = self.items[n], i - int(self.first[n])
        return item, at, text[at:at + self.length]


class Index:
    """Q-grams of benchmark items: code -> (item number, offset) postings."""

    def __init__(self, items: list[tuple[int, str]], rules: Leak):
        self.rules = rules
        folded_items = [(item, normalise(text)) for item, text in items]
        plain = [(item, t) for item, t in folded_items if len(t) >= Q]
        #: items too short for a q-gram, by their number of words
        self.short: dict[int, dict[str, list[int]]] = {}
        for item, t in folded_items:
            if rules.short_items and 0 < len(t) < Q:
                self.short.setdefault(t.count(" ") + 1, {}).setdefault(t, []).append(item)
        chars = np.array([len(t) for _, t in plain], np.int64)
        self.longest = int(chars.max(initial=0))
        self.n_segments = np.maximum(chars - rules.segment, 0) + 1
        self.first_segment = np.concatenate([[0], np.cumsum(self.n_segments)]).astype(np.int64)
        self.segments = Segments(plain, self.first_segment, rules.segment)
        # all segments of an item are equally long
        self.item_size = np.minimum(chars, rules.segment)
        # at least one shared q-gram must be left over by the budget
        k = np.minimum((rules.edit_rate * self.item_size).astype(np.int64), (self.item_size - Q) // Q)
        self.item_bound = self.item_size - Q + 1 - k * Q
        self.k, self.bound = np.repeat(k, self.n_segments), np.repeat(self.item_bound, self.n_segments)
        self.k_max = int(k.max(initial=0))
        codes = [qgrams(folded(t))[: len(t) - Q + 1] for _, t in plain]
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        off = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.codes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.item, self.off = item[order].astype(np.int32), off[order].astype(np.int32)
        self.present = np.zeros(1 << _BITS, bool)
        self.present[_slot(self.codes)] = True

    def candidates(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, band) that reach the segment's bound in a run of characters."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(self.codes) or len(chars) < Q:
            return none
        codes = qgrams(chars)
        hit = self.present[_slot(codes)]
        # a band's q-grams lie within segment + 2 (k + 1) positions: skip stretches with too few
        blocks = np.add.reduceat(hit, np.arange(0, len(hit), _BLOCK), dtype=np.int32)
        reach = (self.rules.segment + 2 * (self.k_max + 1)) // _BLOCK + 2
        total = np.concatenate([[0], np.cumsum(blocks)])
        here = np.arange(len(blocks))
        dense = total[np.minimum(here + reach, len(blocks))] - total[here] >= self.item_bound.min()
        live = np.flatnonzero(dense)
        if not len(live):
            return none
        cover = np.zeros(len(blocks) + 1, np.int32)
        np.add.at(cover, live, 1)
        np.add.at(cover, np.minimum(live + reach, len(blocks)), -1)
        active = np.repeat(np.cumsum(cover)[:-1] > 0, _BLOCK)[: len(hit)]
        pos = np.flatnonzero(hit & active)
        at = np.searchsorted(self.codes, codes[pos]).clip(max=len(self.codes) - 1)
        exact = self.codes[at] == codes[pos]
        pos, at = pos[exact], at[exact]
        n = self.first[at + 1] - self.first[at]
        post = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item, off = self.item[post].astype(np.int64), self.off[post].astype(np.int64)
        band = (np.repeat(pos, n) - off + self.longest) // (self.k_max + 1)
        key = np.concatenate([item << 40 | band, item << 40 | np.maximum(band - 1, 0)])
        off = np.concatenate([off, off])
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        many = count[where] >= self.item_bound[key >> 40]
        key, off = key[many], off[many]
        order = np.lexsort((off, key))
        key, off = key[order], off[order]
        # ``bound`` neighbours of a band within one segment length: offsets whose segment holds them all
        item = key >> 40
        last = np.arange(len(key)) + self.item_bound[item] - 1
        inside = last < len(key)
        last = np.minimum(last, len(key) - 1)
        span = self.item_size[item] - Q
        ok = inside & (key[last] == key) & (off[last] - off <= span)
        key, item, low, high = key[ok], item[ok], np.maximum(off[last] - span, 0)[ok], off[ok]
        high = np.minimum(high, self.n_segments[item] - 1)
        # both ends rise within a band: drop what the range before has
        again = np.flatnonzero(key[1:] == key[:-1]) + 1
        low[again] = np.maximum(low[again], high[again - 1] + 1)
        n = np.maximum(high - low + 1, 0)
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(self.first_segment[item], n) + at, np.repeat(key & ((1 << 40) - 1), n)

    def band_start(self, seg: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Where each segment starts on its band's first diagonal."""
        offset = seg - self.first_segment[np.searchsorted(self.first_segment, seg, side="right") - 1]
        return band * (self.k_max + 1) - self.longest + offset

    def verify(self, seg: np.ndarray, regions: list[str], width: int) -> np.ndarray:
        """Fewest edits that turn each segment into a part of its region, moving only along
        the band's ``width`` diagonals (``regions`` start at the band's first diagonal and
        are padded with NUL, which matches nothing)."""
        n, length = len(seg), self.rules.segment
        pattern = _matrix([self.segments[i][2] for i in seg.tolist()], length)
        text = _matrix(regions, length + width)
        size = np.array([len(self.segments[i][2]) for i in seg.tolist()])
        step = np.arange(width)
        row = np.zeros((n, width), np.int32)
        best = np.zeros(n, np.int32)
        for i in range(length):
            t = text[:, i:i + width]
            row_next = row + ((t != pattern[:, i:i + 1]) | (t == 0))  # diagonal b: text position i + b
            row_next[:, :-1] = np.minimum(row_next[:, :-1], row[:, 1:] + 1)
            row = np.minimum.accumulate(row_next - step, axis=1) + step
            done = size == i + 1
            best[done] = row[done].min(axis=1)
        return best

    def short_items(self, text: str) -> list[dict]:
        """Items of fewer than Q characters that stand in a normalised text as whole words, at
        their first place: the edit budget of so few characters is 0."""
        out = []
        words = text.split(" ")
        for n, named in self.short.items():
            runs = set(words) if n == 1 else {" ".join(words[i:i + n]) for i in range(len(words) - n + 1)}
            for run in runs & named.keys():
                out += [{"item_id": item, "offset": 0, "at": f" {text} ".index(f" {run} "), "edits": 0} for item in named[run]]
        return out

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the verified segments: item, offset in the item, position, edits."""
        found: list[list[dict]] = [[] for _ in texts]
        plain = [normalise(t) if t else "" for t in texts]
        width = 2 * (self.k_max + 1) + 2 * self.k_max
        # NULs between texts: no q-gram holds two texts, and a region that begins before its
        # text begins in the gap or the text right before, however short that is
        gap = np.zeros(max(Q, width), np.uint8)
        parts, first, at = [], [], 0
        for t in plain:
            c = folded(t)
            parts += [c, gap]
            first.append(at)
            at += len(c) + len(gap)
        if self.short:
            for row, t in zip(found, plain, strict=True):
                row += self.short_items(t)
        seg, band = self.candidates(np.concatenate(parts) if parts else gap)
        if not len(seg):
            return found
        starts = np.array(first)
        begin = self.band_start(seg, band) - self.k_max
        # a band at a border may belong to either neighbour
        for shift in (0, 1):
            row = np.searchsorted(starts, np.maximum(begin, 0), side="right") - 1 + shift
            size = np.array([len(t) for t in plain])
            ok = row < len(plain)
            ok[ok] &= (starts[row[ok]] < begin[ok] + width + self.rules.segment) & (size[row[ok]] > 0)
            for c in np.array_split(np.flatnonzero(ok), max(1, int(ok.sum()) // 4096)):
                if not len(c):
                    continue
                local = begin[c] - starts[row[c]]
                regions = [("\0" * -a + plain[r][: a + self.rules.segment + width] if a < 0
                            else plain[r][a:a + self.rules.segment + width])
                           for a, r in zip(local.tolist(), row[c].tolist(), strict=True)]
                edits = self.verify(seg[c], regions, width)
                for i in np.flatnonzero(edits <= self.k[seg[c]]).tolist():
                    item, offset, _ = self.segments[int(seg[c][i])]
                    found[int(row[c][i])].append({"item_id": item, "offset": offset, "at": max(int(local[i]), 0),
                                                  "edits": int(edits[i])})
        return found


def _matrix(texts: list[str], width: int) -> np.ndarray:
    flat = "".join(t[:width].ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, "<u4").reshape(len(texts), width)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", rules: Leak = Leak()) -> DataFrame:
    """All rows and columns of ``docs``, and ``leaks``: array of (item_id, offset, at, edits).

    One entry per verified benchmark segment: its item and offset there, about where it
    lies in the normalised text, and the edits. The benchmark is the stated query set: its
    total length is measured first, then blocks of about ``block_chars`` characters are
    indexed and broadcast one after the other, each in a pass of its own over the rows that
    the pass before wrote: no broadcast and no worker's memory grows with either table.
    Null and empty texts have no leaks; null and blank items are never found. Items of fewer
    than Q normalised characters are found as whole words without edits. Rows are searched by themselves; repeated items each
    report. Other columns may have any names; one named ``leaks`` gives two such columns.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text")).where(
        "item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // rules.block_chars))
    named = {f"c{i}": c for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*named)
    at = docs.columns.index(text_col)
    kind = "array<struct<item_id: bigint, offset: int, at: int, edits: int>>"
    arrow_kind = pa.list_(pa.struct([("item_id", pa.int64()), ("offset", pa.int32()), ("at", pa.int32()), ("edits", pa.int32())]))
    fields = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in named)
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()
        listed = spark.sparkContext.broadcast(sorted((r["item"], r["text"]) for r in rows))

        def run(batches: Iterator[pa.RecordBatch], listed=listed) -> Iterator[pa.RecordBatch]:
            index = Index(listed.value, rules)
            for b in slices(batches, f"c{at}", 4 << 20):
                leaks = index.search(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaks, arrow_kind)], [*b.schema.names, f"leaks{block}"])

        plain = plain.mapInArrow(run, f"{fields}, leaks{block} {kind}")
        fields += f", leaks{block} {kind}"
        if block < n_blocks - 1:
            plain = pinned(plain)
            listed.unpersist()
    leaks = F.array_sort(F.concat(*[F.col(f"leaks{i}") for i in range(n_blocks)]))
    return plain.select(*[F.col(c) for c in named], leaks.alias("leaks")).toDF(*docs.columns, "leaks")


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: Leak = Leak()) -> DataFrame:
    """(id, item_id, n_segments, min_edits, first_at): one row per document and item found."""
    found = find_leaks(docs.select(id_col, text_col), benchmark, text_col, rules=rules)
    one = found.where(F.size("leaks") > 0).select(F.col(id_col), F.explode("leaks").alias("leak"))
    return one.groupBy(id_col, F.col("leak.item_id").alias("item_id")).agg(
        F.countDistinct("leak.offset").alias("n_segments"), F.min("leak.edits").alias("min_edits"),
        F.min("leak.at").alias("first_at"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rules: Leak = Leak()) -> DataFrame:
    """The rows of ``docs`` in which no benchmark segment was found.

    Items of fewer than Q normalised characters are no segments here: an answer like "yes" in
    a text is no copy. ``leaked_pairs`` names them.
    """
    found = find_leaks(docs, benchmark, text_col, rules=replace(rules, short_items=False))
    *named, leaks = [f"c{i}" for i in range(len(found.columns))]  # docs may have a column of any name
    return found.toDF(*named, leaks).where(F.size(leaks) == 0).select(*named).toDF(*docs.columns)
