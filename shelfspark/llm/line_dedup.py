"""Line dedup: suffix array over line-ID sequences by distributed prefix doubling.

The corpus is one sequence of lines per document (lines without a word left out). Suffix
ranks by their first 1, 2, 4, ... lines come from doubling: the rank by 2h lines is the
order of the pair (rank by h lines here, rank by h lines h further on). Suffixes that
agree on their first m lines form an interval of the suffix array with a longest common
prefix of m or more; its name is the pair of ranks by 2^j lines at both ends of those m
lines (2^j <= m < 2^(j+1)).

A repeated run counts if it has ``min_words`` words. Every line of such a run lies in the
shortest run of ``min_words`` words that starts or that ends at some line of it, and those
windows are repeated as well. So looking up the intervals of the windows is enough: their
union is the union of all maximal repeated runs, and at most log2(min_words) doublings are
needed, however long the runs are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import pinned, slices
from shelfspark.plans.windows import running_count

MIN_WORDS = 50
_DOC = ["id", "body"]


def windows_of(n_words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines in the shortest window of ``min_words`` words that starts, and that ends, at
    each line (0: none does)."""
    to = np.cumsum(n_words)
    before = to - n_words
    here = np.arange(len(to))
    last = np.searchsorted(to, before + min_words, side="left")
    first = np.searchsorted(before, to - min_words, side="right") - 1
    return np.where(last < len(to), last - here + 1, 0), np.where(first >= 0, here - first + 1, 0)


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, body, seq, line, check, ahead, behind) for each line with a word, from (id, body, text).

    ``line`` and ``check`` are 96 bits of hash of the line without white space around it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, "text", 4 << 20):
            row, seq, line, check, ahead, behind = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                lines = [(x.strip(), n) for x in (text or b"").split(b"\n") if (n := len(x.split()))]
                if not lines:
                    continue
                a, z = windows_of(np.array([n for _, n in lines], np.int64), min_words)
                row.append(np.full(len(lines), i))
                seq.append(np.arange(len(lines), dtype=np.int32))
                line += [xxhash.xxh64_intdigest(x) for x, _ in lines]
                check += [xxhash.xxh32_intdigest(x) for x, _ in lines]
                ahead.append(a.astype(np.int32))
                behind.append(z.astype(np.int32))
            if row:
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(at), b.column("body").take(at), pa.array(np.concatenate(seq)),
                     pa.array(np.array(line, np.uint64).view(np.int64)), pa.array(np.array(check, np.int64)),
                     pa.array(np.concatenate(ahead)), pa.array(np.concatenate(behind))],
                    ["id", "body", "seq", "line", "check", "ahead", "behind"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "body", "text").mapInArrow(
        run, f"id {kind}, body bigint, seq int, line bigint, check bigint, ahead int, behind int")


def _named(df: DataFrame, pair: list[str], out: str) -> DataFrame:
    """Add ``out``: the position of the row's pair among the different pairs, in their order.

    Pairs are made distinct (partial, then final) before they are numbered, so a pair that
    holds a third of all rows is numbered once; the numbering is a distributed running count.
    """
    order = running_count(df.select(*pair).distinct(), [F.col(c).asc() for c in pair], out=out)
    return df.join(order, pair)


def repeated_windows(lines: DataFrame) -> DataFrame:
    """(id, body, start, m) of windows whose lines occur earlier in the corpus, from ``line_table``.

    Order is by id, then text hash, then line. Rows that repeat id and text are one document.
    """
    # written, so that the join below shuffles both sides itself and can split a very common line
    often = pinned(lines.groupBy("line", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line", "check"))
    live = lines.join(often, ["line", "check"]).dropDuplicates([*_DOC, "seq"])
    in_doc = Window.partitionBy(*_DOC).orderBy("seq")
    # a stretch of live lines: windows over a line that occurs once are not repeated
    island = live.withColumn("island", F.col("seq") - F.row_number().over(in_doc))
    stretch = Window.partitionBy(*_DOC, "island")
    suffixes = pinned(_named(island.withColumns({"lo": F.min("seq").over(stretch), "hi": F.max("seq").over(stretch)}),
                             ["line", "check"], "r0").drop("line", "check"))
    fits_ahead = (F.col("ahead") > 0) & (F.col("seq") + F.col("ahead") - 1 <= F.col("hi"))
    fits_behind = (F.col("behind") > 0) & (F.col("seq") - F.col("behind") + 1 >= F.col("lo"))
    longest = suffixes.agg(F.max(F.greatest(F.when(fits_ahead, F.col("ahead")).otherwise(0),
                                            F.when(fits_behind, F.col("behind")).otherwise(0))).alias("m")).first()["m"] or 0
    level = 0
    while 2 << level <= longest:
        further = F.lead(f"r{level}", 1 << level).over(Window.partitionBy(*_DOC, "island").orderBy("seq"))
        pair = suffixes.withColumn("next", F.coalesce(further, F.lit(0)))  # ranks start at 1: an end comes first
        suffixes = pinned(_named(pair, [f"r{level}", "next"], f"r{level + 1}").drop("next"))
        level += 1
    ranks = F.array(*[F.col(f"r{j}") for j in range(level + 1)])
    at = suffixes.select(*_DOC, "seq", ranks.alias("ranks"))
    windows = (suffixes.where(fits_ahead).select(*_DOC, F.col("seq").alias("start"), F.col("ahead").alias("m"))
               .unionByName(suffixes.where(fits_behind).select(
                   *_DOC, (F.col("seq") - F.col("behind") + 1).alias("start"), F.col("behind").alias("m")))
               .distinct()
               .withColumn("j", F.floor(F.log2(F.col("m").cast("double") + 0.5)).cast("int")))
    head = windows.join(at.withColumnRenamed("seq", "start"), [*_DOC, "start"]).withColumn("head", F.get("ranks", F.col("j"))).drop("ranks")
    both = head.withColumn("seq", (F.col("start") + F.col("m") - F.pow(F.lit(2), F.col("j"))).cast("int"))
    both = pinned(both.join(at, [*_DOC, "seq"]).withColumn("tail", F.get("ranks", F.col("j"))).select(
        *_DOC, "start", "m", "head", "tail"))
    place = F.struct(*_DOC, "start")
    interval = pinned(both.groupBy("m", "head", "tail").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                      .where("n > 1").drop("n"))  # written for the same reason
    return both.join(interval, ["m", "head", "tail"]).where(place != F.col("first")).select(*_DOC, "start", "m")


def delete_runs(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """Text without the lines of ``runs`` (start, m) over its lines with words; how many went."""
    lines = text.split("\n")
    real = [i for i, x in enumerate(lines) if x.encode("utf-8", "surrogatepass").strip()]
    gone = {real[k] for s, m in runs for k in range(s, s + m)}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with the later copies of repeated line runs deleted from
    the text, and ``n_deleted_lines``.

    A run of whole lines with at least ``min_words`` words that occurs more than once keeps
    its first place (by id, then text hash, then line) and is deleted elsewhere; runs may
    overlap their earlier copy. Lines without a word belong to no run and stay. Null, empty
    and blank texts have no lines and stay as they are. Rows with a null id have no place:
    they are neither changed nor count as copies. Rows that repeat id and text are one
    document and share one verdict. Other columns may have any names but ``n_deleted_lines``.
    """
    named = {f"c{i}": c for i, c in enumerate(docs.columns)}
    ids, texts = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    plain = docs.toDF(*named).withColumn(texts, F.col(texts).cast("string")).withColumn("body", F.xxhash64(texts))
    source = plain.where(F.col(ids).isNotNull()).select(F.col(ids).alias("id"), "body", F.col(texts).alias("text"))
    runs = repeated_windows(pinned(line_table(source, min_words)))
    # bounded by a document's own lines
    per_doc = runs.groupBy(*_DOC).agg(F.collect_list(F.struct("start", "m")).alias("runs")).withColumnRenamed("id", ids)
    marked = plain.join(per_doc, [ids, "body"], "left").select(*named, "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = list(named).index(texts)
        for b in batches:
            text, count = b.column(at), np.zeros(b.num_rows, np.int64)
            hit = np.flatnonzero(b.column("runs").is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                out = text.to_pylist()
                for i in hit.tolist():
                    out[i], count[i] = delete_runs(out[i], [(r["start"], r["m"]) for r in b.column("runs")[i].as_py()])
                text = pa.array(out, text.type)
            cols = [text if i == at else b.column(i) for i in range(len(named))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count)], [*named, "n"])

    fields = ", ".join(f"{c} {marked.schema[c].dataType.simpleString()}" for c in named)
    return marked.mapInArrow(run, f"{fields}, n bigint").toDF(*docs.columns, "n_deleted_lines")
