"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are read in chunks that overlap by a filter's width less
one, so that every window of bytes lies in exactly one chunk. Bytes are
embedded, learned filters run over all windows, and each filter's maximum over
the chunk is kept. The chunks' maxima, weighted by the windows they cover, are
averaged over the whole document and go, with the log of its length, through a
small dense layer into one probability.

The network is trained on a bounded sample of labelled documents, a few chunks
of each; scores read every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_sample, extended, free_name

#: Bounds of the training sample: labelled documents, and chunks of each one.
SAMPLE_ROWS, SAMPLE_CHUNKS = 8192, 4
#: Shortest beginning of a document that teaches as a document of its own, in bytes.
BEGINNING = 20
#: Windows of a chunk, bytes of a window, numbers of an embedded byte, filters, units of the dense layer.
CHUNK, WIDTH, EMBEDDED, FILTERS, UNITS = 512, 8, 6, 24, 16
#: Bytes behind the end of a text are this one; its embedding is zero.
PAD = 256
#: Chunks that go through the filters together.
GROUP = 64
STEPS, BATCH, RATE, SEED = 800, 96, 0.01, 13
#: Remainder of crc32(doc_id as text) modulo 4 whose documents are not learned from.
HELD_OUT = 2


def held_out(key: str = "doc_id") -> Column:
    """True for rows that are kept for evaluation; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == HELD_OUT, F.lit(False))


def n_chunks(n_bytes: int) -> int:
    """Chunks of a text: as many as its windows need; one for texts of no whole window."""
    return max(1, -(-(n_bytes - WIDTH + 1) // CHUNK))


def chunk(text: bytes, k: int) -> tuple[np.ndarray, int]:
    """Bytes of the k-th chunk, padded to CHUNK windows, and the windows of the text in it (one at least)."""
    part = np.frombuffer(text, np.uint8)[k * CHUNK : (k + 1) * CHUNK + WIDTH - 1]
    out = np.full(CHUNK + WIDTH - 1, PAD, np.int16)
    out[: len(part)] = part
    return out, max(1, len(part) - WIDTH + 1)


@dataclass
class Network:
    """Weights: embedding of bytes, filters and their bias, dense layer, output."""

    embedding: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    @classmethod
    def untrained(cls, seed: int = SEED, share: float = 0.5) -> Network:
        """Random weights; the bias of the output is the log odds of the share."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        embedding = rng.standard_normal((PAD + 1, EMBEDDED)).astype(np.float32) * 0.5
        embedding[PAD] = 0
        zeros = lambda n: np.zeros(n, np.float32)
        return cls(embedding, normal(WIDTH * EMBEDDED, FILTERS), zeros(FILTERS), normal(FILTERS + 1, UNITS), zeros(UNITS), normal(UNITS), np.array([np.log(share / (1 - share))], np.float32))

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Embedded windows: chunk, window, WIDTH * EMBEDDED."""
        seen = np.lib.stride_tricks.sliding_window_view(self.embedding[chunks].reshape(len(chunks), -1), WIDTH * EMBEDDED, axis=1)
        return seen[:, ::EMBEDDED]

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """Every filter's response to every window: chunk, window, filter."""
        x = np.ascontiguousarray(self.windows(chunks))
        return (x.reshape(-1, WIDTH * EMBEDDED) @ self.filters).reshape(len(chunks), -1, FILTERS)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Maximum of every filter over each chunk, not below zero."""
        return np.maximum(self.responses(chunks).max(axis=1) + self.filter_bias, 0)

    def probability(self, pooled: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """One probability for each document from its averaged maxima and its length."""
        hidden = np.maximum(_with_length(pooled, n_bytes) @ self.dense + self.dense_bias, 0)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.output + self.output_bias).astype(float), -30, 30)))


def _with_length(pooled: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    return np.concatenate([pooled, (np.log1p(n_bytes) / 10).astype(np.float32)[:, None]], axis=1)


@dataclass
class Sample:
    """Labelled documents: chunks with the document and the weight of each one, and lengths and labels of documents."""

    chunks: np.ndarray
    document: np.ndarray
    weight: np.ndarray
    n_bytes: np.ndarray
    labels: np.ndarray


def _gradients(net: Network, s: Sample, chosen: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss of some documents; rows are their chunks."""
    chunks, weight = s.chunks[rows], s.weight[rows][:, None]
    number = np.zeros(len(s.labels), np.int64)
    number[chosen] = np.arange(len(chosen))
    of = number[s.document[rows]]
    found = net.responses(chunks)
    at = found.argmax(axis=1)
    best = np.take_along_axis(found, at[:, None], axis=1)[:, 0] + net.filter_bias
    pooled = np.zeros((len(chosen), FILTERS), np.float32)
    np.add.at(pooled, of, weight * np.maximum(best, 0))
    x = _with_length(pooled, s.n_bytes[chosen])
    before = x @ net.dense + net.dense_bias
    hidden = np.maximum(before, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.output + net.output_bias, -30, 30)))
    up = ((p - s.labels[chosen]) / len(chosen)).astype(np.float32)
    down = (up[:, None] * net.output) * (before > 0)
    to_best = (down @ net.dense.T)[of, :FILTERS] * weight * (best > 0)
    places = at[:, :, None] + np.arange(WIDTH)  # chunk, filter, byte of the strongest window
    seen = np.take_along_axis(chunks[:, None, :], places, axis=2)
    embedded = net.embedding[seen].reshape(len(chunks), FILTERS, -1)
    filters = np.einsum("cfe,cf->ef", embedded, to_best)
    embedding = np.zeros_like(net.embedding)
    np.add.at(embedding, seen, (to_best[:, :, None] * net.filters.T).reshape(*seen.shape, EMBEDDED))
    embedding[PAD] = 0
    return [embedding, filters, to_best.sum(axis=0), x.T @ down, down.sum(axis=0), hidden.T @ up, up.sum(keepdims=True)]


def train(s: Sample, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, decay: float = 1e-4, seed: int = SEED) -> Network:
    """Adam over batches of documents, both labels known; the order depends on the seed alone."""
    share = float(np.clip(s.labels.mean(), 0.01, 0.99)) if len(s.labels) else 0.5
    net, rng = Network.untrained(seed, share), np.random.default_rng(seed)
    if not len(s.labels) or s.labels.min() == s.labels.max():
        net.output[:] = 0  # nothing tells the labels apart: every text gets the share
        return net
    weights = [net.embedding, net.filters, net.filter_bias, net.dense, net.dense_bias, net.output, net.output_bias]
    mean, spread = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    first = np.searchsorted(s.document, np.arange(len(s.labels) + 1))
    for t in range(1, steps + 1):
        chosen = np.unique(rng.integers(0, len(s.labels), batch))
        rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in chosen])
        now = rate * min(1.0, 2 * (1 - (t - 1) / steps))
        for w, g, m, v in zip(weights, _gradients(net, s, chosen, rows), mean, spread, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) + decay * w)
        net.embedding[PAD] = 0
    return net


def with_beginnings(s: Sample) -> Sample:
    """The sample and, as documents of their own, the first BEGINNING to 16 * BEGINNING bytes of each one, so that short texts are known."""
    n = len(s.labels)
    first = np.searchsorted(s.document, np.arange(n))
    kept = BEGINNING << (np.arange(n) % 5)
    chunks = s.chunks[first].copy()
    chunks[np.arange(chunks.shape[1]) >= kept[:, None]] = PAD
    n_bytes = np.minimum(s.n_bytes, kept)
    parts = ((s.chunks, chunks), (s.document, n + np.arange(n)), (s.weight, np.ones(n, np.float32)), (s.n_bytes, n_bytes), (s.labels, s.labels))
    return Sample(*map(np.concatenate, parts))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Sample:
    """Chunks of at most SAMPLE_ROWS labelled documents that are not held out, at most SAMPLE_CHUNKS evenly spread ones of each.

    The documents are those of lowest hash of their ids. A document labelled more
    than once has the highest label; of rows that share an id one teaches.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = bounded_sample(known, "id", SAMPLE_ROWS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                raw = text.as_buffer().to_pybytes()
                n = n_chunks(len(raw))
                which = range(n) if n <= SAMPLE_CHUNKS else [k * (n - 1) // (SAMPLE_CHUNKS - 1) for k in range(SAMPLE_CHUNKS)]
                found.append((len(raw), b"".join(chunk(raw, k)[0].tobytes() for k in which)))
            size, kept = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(kept, pa.binary())], names=["id", "label", "n_bytes", "chunks"])

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "label").mapInArrow(cut, f"id {known.schema['id'].dataType.simpleString()}, label int, n_bytes long, chunks binary")
    one = rows.groupBy("id").agg(F.min(F.struct("n_bytes", "chunks", "label")).alias("r")).orderBy("id").collect()  # bounded by the sample
    each = [np.frombuffer(r.r.chunks, np.int16).reshape(-1, CHUNK + WIDTH - 1) for r in one]
    n_bytes, document = np.array([r.r.n_bytes for r in one], np.int64), np.repeat(np.arange(len(one)), [len(c) for c in each])
    chunks = np.concatenate(each) if each else np.zeros((0, CHUNK + WIDTH - 1), np.int16)
    covered = np.maximum(1, (chunks != PAD).sum(axis=1) - WIDTH + 1).astype(np.float32)
    weight = covered / np.bincount(document, covered, len(one))[document].astype(np.float32) if len(one) else covered
    return Sample(chunks, document, weight.astype(np.float32), n_bytes, np.array([float(r.r.label == 1) for r in one], np.float32))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """The network, trained on the bounded sample; without both labels it gives every text their share."""
    return train(with_beginnings(training_sample(docs, labels, id_col, text_col, label_col)))


def pooled_documents(net: Network, texts: Iterator[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Averaged maxima and lengths of n texts, GROUP chunks at a time; null counts as empty."""
    pooled, weight, n_bytes = np.zeros((n, FILTERS)), np.zeros(n), np.zeros(n, np.int64)
    chunks, of, windows = [], [], []

    def flush() -> None:
        np.add.at(pooled, of, net.pooled(np.stack(chunks)) * np.array(windows)[:, None])
        np.add.at(weight, of, windows)
        chunks.clear(), of.clear(), windows.clear()

    for i, text in enumerate(texts):
        n_bytes[i] = len(text or b"")
        for k in range(n_chunks(int(n_bytes[i]))):
            part, seen = chunk(text or b"", k)
            chunks.append(part), of.append(i), windows.append(seen)
            if len(chunks) == GROUP:
                flush()
    if chunks:
        flush()
    return (pooled / np.maximum(weight, 1)[:, None]).astype(np.float32), n_bytes


def score_documents(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of docs and cnn_score (0 to 1), cnn_predicted (1 from the threshold on).

    Null texts count as empty, which have one chunk of nothing. Whole texts are read, in
    bounded memory beyond the text itself. Repeated rows are scored each time; new names get
    underscores where the input has them.
    """
    names = docs.columns
    score, predicted = free_name("cnn_score", names), free_name("cnn_predicted", names)
    at = names.index(docs.select(text_col).columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column(at))
            p = net.probability(*pooled_documents(net, texts, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())], names=[*names, score, predicted])

    return docs.mapInArrow(run, extended(docs.schema, {score: "double", predicted: "int"}))
