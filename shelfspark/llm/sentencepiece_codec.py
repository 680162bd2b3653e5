"""SentencePiece encoding (Unigram Viterbi) and decoding of whole texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import slices
from shelfspark.llm.pieces import ESCAPED, MARK, VOCABULARY, Lattice, Vocabulary, by_length, load_vocabulary

#: A worker segments about so many bytes of text at a time.
SLICE_BYTES = 2 << 20
_CHUNK = re.compile(r" *[^ \n]+|\n| +")


def chunks(text: str) -> list[str]:
    """Parts of a text (one space put before it) that segment independently: no piece
    holds a marker behind other characters, or a line end."""
    return _CHUNK.findall(" " + text) if text else []


def marked(chunk: str) -> bytes:
    """UTF-8 with spaces as markers; a marker character of the text itself is escaped, so
    that it comes out as byte pieces and decodes to itself."""
    return chunk.encode("utf-8", "surrogatepass").replace(MARK, ESCAPED).replace(b" ", MARK)


def encode_words(vocab: Vocabulary, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best segmentation of each word: (ids one after the other, offsets, log scores)."""
    count, score = np.zeros(len(ws), np.int64), np.zeros(len(ws))
    parts = []
    for at in by_length(ws):
        ids, off, top = Lattice(vocab, [ws[i] for i in at.tolist()]).best(vocab.edge_scores)
        count[at], score[at] = np.diff(off), top
        parts.append((at, ids, off))
    offset = np.concatenate([[0], np.cumsum(count)])
    flat = np.empty(int(offset[-1]), np.int32)
    for at, ids, off in parts:
        flat[_ranges(offset[at], np.diff(off))] = ids
    return flat, offset, score


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., then start[1], ...: ``size`` numbers of each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def encode_texts(vocab: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, offsets by text, log score by text).

    Each different chunk is segmented once.
    """
    seen: dict[str, int] = {}
    code: list[int] = []
    n_codes = [0]
    for t in texts:
        code += [seen.setdefault(c, len(seen)) for c in chunks(t or "")]
        n_codes.append(len(code))
    if not code:
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts))
    flat, offset, score = encode_words(vocab, [marked(c) for c in seen])
    codes = np.array(code)
    size = np.diff(offset)[codes]
    ids = flat[_ranges(offset[codes], size)]
    bounds = np.array(n_codes)
    to = np.concatenate([[0], np.cumsum(size)])[bounds]
    # each text's scores are added by themselves, whatever its neighbours are
    total = np.array([score[codes[a:b]].sum() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    return ids, to, total


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> str:
    """Pieces to text: byte pieces to bytes, markers to spaces, the leading one dropped.
    Ids outside the vocabulary and control ids decode to nothing."""
    table = [p if len(p) == 1 else p.replace(MARK, b" ") for p in vocab.pieces]
    return _text(b"".join(table[i] for i in ids if 0 <= i < len(table)))


def _text(raw: bytes) -> str:
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class Decoder:
    """``decode_ids`` for many texts: the pieces' bytes in one buffer, gathered by id."""

    def __init__(self, pieces: list[bytes]):
        table = [p if len(p) == 1 else p.replace(MARK, b" ") for p in pieces]
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        ids = ids.astype(np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.size))]
        return _text(self.flat[_ranges(self.start[ids], self.size[ids])].tobytes())


def _encoded(vocab: Vocabulary, texts: list[str | None]) -> tuple[pa.ListArray, pa.Array]:
    """Ids and log score of each text as Arrow columns, null for a null text."""
    ids, to, score = encode_texts(vocab, texts)
    null = np.array([t is None for t in texts])
    offsets = pa.array(to.astype(np.int32), pa.int32(), mask=np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(score, pa.float64(), mask=null)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text, ids, log_prob): the best segmentation of every whole text.

    Null text: null ids and log_prob. Empty text: no ids, log_prob 0. Rows are encoded by
    themselves: repeated rows repeat, null ids stay, other columns are not read.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary).plain())
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*vocab.value)
        for b in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*b.columns, *_encoded(own, b.column("text").to_pylist())], ["id", "text", "ids", "log_prob"])

    schema = f"id {narrow.schema['id'].dataType.simpleString()}, text string, ids array<int>, log_prob double"
    return narrow.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "text": text_col})


def decode(encoded: DataFrame, ids_col: str = "ids", out: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of ``encoded`` and ``out``: the text of each row's ids (null for null)."""
    vocab = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary).pieces)
    named = {f"c{i}": c for i, c in enumerate(encoded.columns)}
    plain = encoded.toDF(*named)  # clashing names of other columns don't matter
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(vocab.value)
        for b in batches:
            lists = b.column(at)
            texts = [own.text(x.values.to_numpy(zero_copy_only=False)) if (x := lists[row]).is_valid else None
                     for row in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*named, "out"])

    fields = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in named)
    return plain.mapInArrow(run, f"{fields}, out string").toDF(*encoded.columns, out)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids, n_ids, log_prob, decoded_crc32, exact): encode, decode, compare.

    Both ways run on one slice of texts after the other in the same worker, so neither the
    decoded texts nor a second worker's copy of the ids are held beside it. ``exact`` is
    null-safe: a null text decodes to null, with null ids, n_ids, log_prob and decoded_crc32.
    Rows are taken by themselves; other columns are not read; an empty table gives no rows.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary).plain())
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*vocab.value)
        back = Decoder(own.pieces)
        for b in slices(batches, "text", SLICE_BYTES):
            texts = b.column("text").to_pylist()
            ids, log_prob = _encoded(own, texts)
            flat, to = ids.values.to_numpy(), ids.offsets.to_pylist()
            crc: list[int | None] = []
            exact = []
            for i, t in enumerate(texts):
                decoded = None if t is None else back.text(flat[to[i]:to[i + 1]])
                crc.append(None if decoded is None else zlib.crc32(decoded.encode("utf-8", "surrogatepass")))
                exact.append(decoded == t)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), ids, pc.list_value_length(ids), log_prob, pa.array(crc, pa.int64()), pa.array(exact, pa.bool_())],
                ["id", "ids", "n_ids", "log_prob", "decoded_crc32", "exact"])

    schema = (f"id {narrow.schema['id'].dataType.simpleString()}, ids array<int>, n_ids int, log_prob double, "
              "decoded_crc32 bigint, exact boolean")
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
