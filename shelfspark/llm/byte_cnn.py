"""Document quality by a byte-level convolutional network, trained and run in numpy.

A text's UTF-8 bytes are cut into overlapping chunks of ``CHUNK`` bytes that cover the whole
document. At each position a filter of ``WIDTH`` bytes reads the learned embeddings of its
bytes and, for each lag up to ``LAGS``, how many of them equal the byte that many places
before (so a repeated word shows). Rectified responses are max-pooled over the chunk; the
largest and the mean of a document's chunk vectors go into one logistic output.

Training takes a bounded sample of labelled rows (``TRAIN_DOCS`` for each class, chosen by a hash;
at most ``TRAIN_CHUNKS`` chunks a document, evenly spread over it) and runs in one task; the
parameters, some 40 KB, go to all scoring tasks. Scoring reads every byte of every text and
holds ``_BLOCK`` chunks at a time, whatever a text's length.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import slices

CHUNK, OVERLAP = 512, 64
WIDTH, LAGS, EMBED, FILTERS = 6, 16, 8, 24
PAD = 256  # stands after the end of a text
TRAIN_DOCS, TRAIN_CHUNKS = 1500, 16
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.01, 1e-4
_BLOCK = 128
_STEP = CHUNK - OVERLAP
_SPOTS = CHUNK - WIDTH + 1


@dataclass
class Net:
    embed: np.ndarray    # (257, EMBED)
    kernel: np.ndarray   # (WIDTH, EMBED, FILTERS)
    repeat: np.ndarray   # (LAGS, FILTERS)
    bias: np.ndarray     # (FILTERS,)
    out: np.ndarray      # (2 * FILTERS,) for the largest and the mean of the chunks
    base: np.ndarray     # (1,)

    @staticmethod
    def fresh(seed: int = 42) -> Net:
        r = np.random.default_rng(seed)
        n = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        return Net(n(0.5, PAD + 1, EMBED), n((WIDTH * EMBED) ** -0.5, WIDTH, EMBED, FILTERS), n(0.1, LAGS, FILTERS),
                   np.zeros(FILTERS, np.float32), n(0.1, 2 * FILTERS), np.zeros(1, np.float32))

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **{k.name: getattr(self, k.name) for k in fields(self)})
        return f.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Net:
        with np.load(io.BytesIO(data)) as z:
            return Net(**{k.name: z[k.name] for k in fields(Net)})


def chunk_starts(size: int) -> range:
    """Starts of the chunks that cover ``size`` bytes (one, if there are none)."""
    return range(0, max(size - OVERLAP, 1), _STEP)


def chunk_matrix(text: np.ndarray, starts: list[int] | range) -> np.ndarray:
    out = np.full((len(starts), CHUNK), PAD, np.int16)
    for i, s in enumerate(starts):
        part = text[s:s + CHUNK]
        out[i, :len(part)] = part
    return out


def _repeats(chunks: np.ndarray) -> np.ndarray:
    """(n, spots, LAGS): share of a filter's bytes that equal the byte ``lag`` places before."""
    out = np.empty((len(chunks), _SPOTS, LAGS), np.float32)
    sums = np.zeros((len(chunks), CHUNK + 1), np.int16)
    for lag in range(1, LAGS + 1):
        same = np.zeros(chunks.shape, bool)
        np.logical_and(chunks[:, lag:] == chunks[:, :-lag], chunks[:, lag:] != PAD, out=same[:, lag:])
        np.cumsum(same, axis=1, out=sums[:, 1:])
        np.multiply(sums[:, WIDTH:] - sums[:, :-WIDTH], np.float32(1 / WIDTH), out=out[:, :, lag - 1], casting="unsafe")
    return out


def pooled(net: Net, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, FILTERS) pooled responses, the spot of each, and the repeats."""
    repeats = _repeats(chunks)
    z = repeats.reshape(-1, LAGS) @ net.repeat
    z += net.bias
    z = z.reshape(len(chunks), _SPOTS, FILTERS)
    index, part = chunks.astype(np.intp), np.empty_like(z)
    for w in range(WIDTH):
        np.take(net.embed @ net.kernel[w], index[:, w:w + _SPOTS], axis=0, out=part, mode="clip")
        z += part
    spot = z.argmax(axis=1)
    top = np.take_along_axis(z, spot[:, None, :], axis=1)[:, 0, :]
    return np.maximum(top, 0), spot, repeats


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_texts(net: Net, texts: list[bytes | None]) -> np.ndarray:
    """Probability of label 1 for each whole text; a null text counts as empty."""
    most, total = np.full((len(texts), FILTERS), -np.inf, np.float32), np.zeros((len(texts), FILTERS), np.float64)
    count = np.zeros(len(texts), np.int64)
    block: list[np.ndarray] = []
    owner: list[int] = []

    def fold() -> None:
        h, _, _ = pooled(net, np.concatenate(block))
        np.maximum.at(most, owner, h)
        np.add.at(total, owner, h)
        np.add.at(count, owner, 1)
        block.clear()
        owner.clear()

    for d, text in enumerate(texts):
        data = np.frombuffer(text or b"", np.uint8)
        starts = chunk_starts(len(data))
        at = 0
        while at < len(starts):
            some = starts[at:at + _BLOCK - len(owner)]
            block.append(chunk_matrix(data, some))
            owner.extend([d] * len(some))
            at += len(some)
            if len(owner) >= _BLOCK:
                fold()
    if owner:
        fold()
    features = np.concatenate([most.astype(np.float64), total / np.maximum(count, 1)[:, None]], axis=1)
    return _sigmoid(features @ net.out.astype(np.float64) + float(net.base[0]))


def gradient(net: Net, chunks: np.ndarray, sizes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, Net]:
    """Weighted mean log loss of a batch of documents and its gradient.

    ``sizes`` gives how many consecutive ``chunks`` each document has.
    """
    h, spot, repeats = pooled(net, chunks)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    most = np.maximum.reduceat(h, begins, axis=0)
    mean = np.add.reduceat(h, begins, axis=0) / sizes[:, None]
    features = np.concatenate([most, mean], axis=1)
    p = _sigmoid(features @ net.out + net.base[0])
    share = weight / weight.sum()
    loss = float(-(share * np.where(label == 1, np.log(p), np.log1p(-p))).sum())
    delta = ((p - label) * share).astype(np.float32)
    # back to the chunks: the mean reaches all of a document's, the largest only the first of them
    back = delta[doc, None] * net.out[FILTERS:] / sizes[doc, None]
    best = (h == most[doc]) & (np.cumsum(h == most[doc], axis=0) - (np.cumsum(h == most[doc], axis=0) - (h == most[doc]))[begins][doc] == 1)
    back += best * (delta[doc, None] * net.out[:FILTERS])
    back = (back * (h > 0)).astype(np.float32)
    n = np.arange(len(chunks))
    d_embed, d_kernel = np.zeros_like(net.embed), np.zeros_like(net.kernel)
    for w in range(WIDTH):
        seen = chunks[n[:, None], spot + w]                       # (n, FILTERS)
        d_kernel[w] = np.einsum("nf,nfe->ef", back, net.embed[seen])
        np.add.at(d_embed, seen, back[:, :, None] * net.kernel[w].T)
    d_repeat = np.einsum("nf,nfl->lf", back, repeats[n[:, None], spot])
    return loss, Net(d_embed, d_kernel, d_repeat, back.sum(axis=0), features.T.astype(np.float32) @ delta, delta.sum(keepdims=True))


def train(texts: list[bytes], label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 42) -> Net:
    """Adam over shuffled batches of documents, with a falling rate and weight decay."""
    net, rng = Net.fresh(seed), np.random.default_rng(seed)
    docs = []
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        starts = chunk_starts(len(data))
        spread = sorted({int(k) for k in np.linspace(0, len(starts) - 1, min(len(starts), TRAIN_CHUNKS))})
        docs.append(chunk_matrix(data, [starts[k] for k in spread]))
    sizes = np.array([len(d) for d in docs])
    names = [f.name for f in fields(Net)]
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    steps = epochs * -(-len(docs) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            _, g = gradient(net, np.concatenate([docs[k] for k in pick]), sizes[pick], label[pick], weight[pick])
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k in names:
                x, grad = getattr(net, k), getattr(g, k)
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                x -= (rate * (m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8) + RATE * DECAY * x)).astype(np.float32)
    return net


def held_out_row(id_col: str, parts: int = 3, out: int = 1) -> Column:
    """True for ids whose crc32 (as text) leaves ``out`` modulo ``parts``; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % parts == out, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int = TRAIN_DOCS) -> DataFrame:
    """(text, label, weight): about ``per_class`` labelled rows of each class that are not held out.

    The rows are those with the smallest hashes of the id: the share that gives ``per_class`` rows
    of a class. An id with several labels takes their majority; a draw or a null label gives
    none. ``weight`` restores the classes' own shares.
    """
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out_row(id_col))
             .groupBy(F.col(id_col).alias("id")).agg(F.avg((F.col(label_col) > 0).cast("int")).alias("share"))
             .where("share <> 0.5").select("id", (F.col("share") > 0.5).cast("int").alias("label")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = {k: min(1.0, per_class / n) for k, n in counts.items()}
    total = sum(counts.values())
    pick = F.lit(False)
    weight = F.lit(1.0)
    for k, n in counts.items():
        low_hash = F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < F.lit(int(share[k] * (1 << 32)))
        pick = pick | ((F.col("label") == k) & low_hash)
        weight = F.when(F.col("label") == k, F.lit(n / (share[k] * n) / total)).otherwise(weight)
    chosen = known.where(pick).withColumn("weight", weight)  # about 2 * per_class rows
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.where(~held_out_row(id_col)).select(F.col(id_col).alias("id"), text.alias("text"))
            .join(F.broadcast(chosen), "id").select("text", "label", "weight").limit(4 * per_class))  # ids may repeat


def fit(examples: DataFrame, epochs: int = EPOCHS) -> Net | float:
    """Train on (text, label, weight) rows in one task; with fewer than two classes their only label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("label").to_pylist(), b.column("weight").to_pylist(), strict=True)]
        rows.sort()  # whatever order the shuffle delivered
        label = np.array([r[1] for r in rows], np.int64)
        if len(set(label.tolist())) < 2:
            net, only = None, float(label[0]) if len(label) else 0.5
        else:
            net, only = train([r[0] for r in rows], label, np.array([r[2] for r in rows]), epochs).to_bytes(), None
        yield pa.RecordBatch.from_arrays([pa.array([net], pa.binary()), pa.array([only], pa.float64())], ["net", "only"])

    row = examples.repartition(1).mapInArrow(run, "net binary, only double").first()
    if row is None:
        return 0.5
    return row["only"] if row["net"] is None else Net.from_bytes(bytes(row["net"]))


def scored(docs: DataFrame, net: Net | float, id_col: str, text_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            if isinstance(net, float):
                p = np.full(b.num_rows, net)
            else:
                p = score_texts(net, b.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p)], ["id", "score"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             per_class: int = TRAIN_DOCS) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    ``score``: probability of label 1 from the text alone; ``predicted`` is 1 from 0.5. Null
    and empty texts get the score of an empty text. Rows with a null id are scored and not
    held out; repeated rows are scored each. With labels of one class only every score is that
    label, without any 0.5. Other columns are not read. An empty table gives no rows.
    """
    net = fit(sample(docs, labels, id_col, text_col, label_col, per_class))
    out = scored(docs, net, id_col, text_col).withColumnRenamed("id", id_col)
    return out.select(id_col, held_out_row(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
