"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Learned filters of `WIDTH` bytes (a weight for
every byte at every place of the filter, as a one-hot input has it) run over each chunk, are rectified and max-pooled;
the pooled features are averaged over the chunks and combined by a logistic unit into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import extend, shield, table
from strandmill.llm.language import held_out

FILTERS, WIDTH, CHUNK = 16, 5, 256
#: The label-1 probability from which `predicted` is 1.
THRESHOLD = 0.3


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def chunk_features(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled activations of chunks (n, CHUNK + WIDTH - 1) and the place of each maximum, a few chunks at a time."""
        pooled, places = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
        for first in range(0, len(chunks), 128):
            part = chunks[first : first + 128]
            out = self.filters[0][part[:, :CHUNK]]
            for k in range(1, WIDTH):
                out += self.filters[k][part[:, k : k + CHUNK]]
            place = places[first : first + 128] = out.argmax(axis=1)
            pooled[first : first + 128] = np.take_along_axis(out, place[:, None], axis=1)[:, 0] + self.bias
        return np.maximum(pooled, 0), places

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.offset, -30, 30)))


def chunked(text: str | None) -> np.ndarray:
    """The text's chunks: each has `CHUNK` filter places and shares `WIDTH` - 1 bytes with the next; one at least.

    The last chunk is moved back to end with the text; a text shorter than a chunk is padded with zero bytes.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    span = CHUNK + WIDTH - 1
    if len(data) < span:
        data = np.pad(data, (0, span - len(data)))
    starts = np.arange(0, len(data) - span + 1, CHUNK)
    if starts[-1] + span < len(data):
        starts = np.append(starts, len(data) - span)
    return np.lib.stride_tricks.sliding_window_view(data, span)[starts]


def score(network: Network, texts: list[str | None]) -> np.ndarray:
    """The probability of label 1 of each whole text, in bounded memory."""
    sums, sizes, waiting = np.zeros((len(texts), FILTERS)), np.zeros(len(texts)), []

    def flush() -> None:
        owner = np.concatenate([np.full(len(c), i) for i, c in waiting])
        features, _ = network.chunk_features(np.concatenate([c for _, c in waiting]))
        np.add.at(sums, owner, features)
        np.add.at(sizes, owner, 1)
        waiting.clear()

    total = 0
    for i, text in enumerate(texts):
        chunks = chunked(text)
        for first in range(0, len(chunks), 128):
            part = chunks[first : first + 128]
            waiting.append((i, part))
            total += len(part)
            if total >= 128:
                flush()
                total = 0
    if waiting:
        flush()
    return network.probability(sums / np.maximum(sizes, 1)[:, None])


def fit(samples: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.02, seed: int = 5) -> Network:
    """Fits the network by Adam on the chunks of labelled texts."""
    rng = np.random.default_rng(seed)
    prior = float(np.clip(labels.mean(), 0.01, 0.99))
    net = Network(
        rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.5, FILTERS).astype(np.float32),
        float(np.log(prior / (1 - prior))),
    )
    state = [[np.zeros_like(p, dtype=np.float32) for _ in range(2)] for p in (net.filters, net.bias, net.weights, np.zeros(1))]
    step, size = 0, 32
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        order = rng.permutation(len(samples))
        for first in range(0, len(order), size):
            batch = order[first : first + size]
            chunks = np.concatenate([samples[i] for i in batch])
            counts = np.array([len(samples[i]) for i in batch])
            owner = np.repeat(np.arange(len(batch)), counts)
            pooled, place = net.chunk_features(chunks)
            features = np.add.reduceat(pooled, np.cumsum(counts) - counts, axis=0) / counts[:, None]
            error = ((net.probability(features) - labels[batch]) / len(batch)).astype(np.float32)
            back = (error[:, None] * net.weights / counts[:, None])[owner] * (pooled > 0)
            slope = np.zeros_like(net.filters)
            rows, columns = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None]
            for k in range(WIDTH):
                spots = chunks[rows, place + k].astype(np.int64) * FILTERS + columns
                slope[k] = np.bincount(spots.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            slopes = [slope + 1e-5 * net.filters, back.sum(axis=0), features.T @ error, np.array([error.sum()])]
            step += 1
            moves = []
            for (mean, square), g in zip(state, slopes, strict=True):
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                moves.append(pace * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8))
            net.filters -= moves[0].astype(np.float32)
            net.bias -= moves[1].astype(np.float32)
            net.weights -= moves[2].astype(np.float32)
            net.offset -= float(moves[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = 2400) -> Network | None:
    """Fits on the whole texts of at most `rows` labelled rows, those with the smallest hash of doc_id; None without any.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from.  Null texts count as empty.  A doc_id that repeats,
    in `docs` or `labels`, gives a row for each pair, in an order of hashes, and the bound holds for all of them; labels
    other than 0 and 1 and rows without doc_id are left out.
    """
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    total = usable.count()
    if not total:
        return None
    rank = F.xxhash64(F.lit(23), "doc_id").bitwiseAND(F.lit((1 << 62) - 1))
    limit = int(min(1.0, 1.3 * rows / total) * (1 << 62))
    chosen = usable.withColumn("rank", rank).where(F.col("rank") <= limit).orderBy("rank", "quality").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("rank", "quality", "text")
    found = sample.orderBy("rank", F.xxhash64("text"), "quality").limit(rows).toPandas()
    if not len(found):
        return None
    return fit([chunked(t) for t in found["text"]], found["quality"].to_numpy(dtype=np.float32))


def _score(shared):
    def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        network, texts = shared.value, column.to_pylist()
        found = np.full(len(texts), 0.5) if network is None else score(network, texts)
        return found, (found >= THRESHOLD).astype(np.int32)

    return run


def classify(docs: DataFrame, network: Network | None) -> DataFrame:
    """Adds `score` (the probability of label 1) and `predicted` to every row of `docs`.

    Null and empty texts are scored as one chunk of zero bytes.  Without a network (nothing to learn from) every score is
    0.5.  Each row is scored by its own text alone.  Extra columns of any name pass through; columns named like
    the added ones are replaced.  An empty table gives an empty result.
    """
    docs, back = shield(docs, ["text"], ["score", "predicted"])
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return extend(docs, _score(shared), ["text"], "score double, predicted int").select(*back, "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    network = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, network).select("doc_id", "held_out", "score", "predicted")
