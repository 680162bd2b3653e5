"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. A text's
probability is the sum over all its segmentations into pieces (forward algorithm), which
is a product over words because no piece crosses a word's start.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import pinned, slices
from shelfspark.llm.pieces import ESCAPED, MARK, VECTOR_BYTES, VOCABULARY, Lattice, Vocabulary, by_length, load_vocabulary

UNDETERMINED = "und"
#: Weight of an edge is scaled by this per byte, which keeps products of a word near 1.
_PER_BYTE = 12.0
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Training:
    """Expectation-maximisation rounds over the word counts; pseudo-count of a piece."""

    rounds: int = 2
    smoothing: float = 0.1


def split_words(text: str) -> list[str]:
    return text.lower().split()


def marked(word: str) -> bytes:
    return MARK + word.encode("utf-8", "surrogatepass").replace(MARK, ESCAPED)


def word_log_probs(vocab: Vocabulary, ws: list[bytes], log_p: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations of each word.

    ``log_p``: (pieces + 1, languages), the last row being an unknown character's.
    """
    out = np.empty((len(ws), log_p.shape[1]))
    for at in by_length(ws, max(1 << 14, (2 << 20) // log_p.shape[1])):
        part = [ws[i] for i in at.tolist()]
        size = np.fromiter(map(len, part), np.int64, len(part))
        lat = Lattice(vocab, part)
        if size.max() <= VECTOR_BYTES:
            weight = np.exp(log_p)[lat.piece] * (_PER_BYTE ** (lat.end - lat.start))[:, None]
            with np.errstate(divide="ignore"):
                got = np.log(lat.forward(weight)[lat.end_of]) - (size * np.log(_PER_BYTE))[:, None]
            if not np.isfinite(got).all():  # beyond the range of plain products
                got = lat.log_forward(log_p[lat.piece])[lat.end_of]
        else:
            got = lat.log_forward(log_p[lat.piece])[lat.end_of]
        out[at] = got
    return out


def expected_counts(vocab: Vocabulary, ws: list[bytes], lang: np.ndarray, n: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """(languages, pieces + 1): expected uses of each piece in ``n`` copies of each word."""
    out = np.zeros((log_p.shape[1], log_p.shape[0]))
    for at in by_length(ws):
        lat = Lattice(vocab, [ws[i] for i in at.tolist()])
        of = lang[at][lat.word]
        lw = log_p[lat.piece, of]
        size = lat.end_of - lat.first
        plain = size.max() <= VECTOR_BYTES
        if plain:
            w = np.exp(lw) * _PER_BYTE ** (lat.end - lat.start)
            a, b = lat.forward(w), lat.backward(w)
            total = a[lat.end_of]
            plain = bool((total > 1e-290).all())
            if plain:
                share = a[lat.start] * w * b[lat.end] / total[lat.word]
        if not plain:
            a, b = lat.log_forward(lw), lat.log_backward(lw)
            share = np.exp(a[lat.start] + lw + b[lat.end] - a[lat.end_of][lat.word])
        np.add.at(out, (of, lat.piece), share * n[at][lat.word])
    return out


def _probabilities(counts: np.ndarray, smoothing: float) -> np.ndarray:
    smooth = counts + smoothing
    return np.log(smooth / smooth.sum(axis=1, keepdims=True)).T


@dataclass(frozen=True)
class Model:
    """``langs`` in ascending order; ``log_p``: (pieces + 1, languages)."""

    langs: list[str]
    log_p: np.ndarray


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over all rows with a text and a language.

    Words are counted per Arrow slice before the shuffle, so a language that holds most of
    the corpus, or a word in every text, arrives as one row per slice.
    """
    narrow = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 16 << 20):
            count: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                count.setdefault(lang, Counter()).update(split_words(text))
            for lang, c in count.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()),
                     pa.array(c.values(), pa.int64())], ["lang", "word", "n"])

    rows = narrow.where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "lang string, word string, n bigint")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY,
          training: Training = Training()) -> Model:
    """Piece probabilities per language from all rows with a text and a language.

    The first round weighs segmentations by the vocabulary's own scores. Expected counts
    are summed per task before they are shuffled; what the driver collects is one number
    per language and piece: bounded by the vocabulary, whatever the corpus.
    """
    spark = docs.sparkSession
    vocab = load_vocabulary(vocabulary)
    shared = spark.sparkContext.broadcast(vocab.plain())
    table = pinned(word_counts(docs, text_col, lang_col))
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    log_p = np.repeat(vocab.edge_scores[:, None], max(len(langs), 1), axis=1)
    for _ in range(training.rounds if langs else 0):
        given = spark.sparkContext.broadcast((langs, log_p))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            names, now = given.value
            own = Vocabulary(*shared.value)
            number = {x: i for i, x in enumerate(names)}
            total = np.zeros((len(names), now.shape[0]))
            for b in slices(batches, "word", 4 << 20, 1 << 20):
                lang = np.fromiter((number[x] for x in b.column("lang").to_pylist()), np.int64, b.num_rows)
                total += expected_counts(own, [marked(w) for w in b.column("word").to_pylist()], lang,
                                         b.column("n").to_numpy().astype(float), now)
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["l", "piece", "c"])

        # whole multiples of 2^-20 add up alike in any order
        got = (table.mapInArrow(run, "l int, piece int, c double")
               .groupBy("l", "piece").agg(F.sum(F.round(F.col("c") * (1 << 20)).cast("decimal(38,0)")).alias("c"))).collect()
        counts = np.zeros((len(langs), log_p.shape[0]))
        for r in got:
            counts[r["l"], r["piece"]] = float(r["c"]) / (1 << 20)
        log_p = _probabilities(counts, training.smoothing)
    return Model(langs, log_p)


def score_texts(vocab: Vocabulary, model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior share for each text; each word is scored once."""
    seen: dict[str, int] = {}
    codes, ends = [], [0]
    for t in texts:
        if t is not None and _LETTER.search(t):
            codes += [seen.setdefault(w, len(seen)) for w in split_words(t)]
        ends.append(len(codes))
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.langs or not codes:
        return lang, score
    per_word = word_log_probs(vocab, [marked(w) for w in seen], model.log_p)
    all_codes = np.array(codes)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if b > a:
            total = per_word[all_codes[a:b]].sum(axis=0)
            top = int(total.argmax())  # of equal languages the first in order
            lang[i] = model.langs[top]
            score[i] = 1.0 / np.exp(total - total[top]).sum()
    return lang, score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, lang_pred, score) of every row from its whole text alone.

    ``score`` is the language's share of the text's probability over all languages, each
    equally likely beforehand. Texts that are null or hold no letter, and all texts if no
    language was learned, get ``und`` with score 0. Repeated rows repeat.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((load_vocabulary(vocabulary).plain(), (model.langs, model.log_p)))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, learned = Vocabulary(*shared.value[0]), Model(*shared.value[1])
        for b in slices(batches, "text", 16 << 20):
            lang, score = score_texts(own, learned, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score)],
                                             ["id", "lang_pred", "score"])

    schema = f"id {narrow.schema['id'].dataType.simpleString()}, lang_pred string, score double"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, held_out, lang_pred, score): learn from the rows not held out, predict all.

    Rows with a null id are predicted but not learned from.
    """
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    model = train(known, text_col, lang_col, vocabulary)
    return predict(docs, model, id_col, text_col, vocabulary).select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
