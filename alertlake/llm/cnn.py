"""Quality classifier: a byte-level convolutional network in numpy.

Layers: byte embedding, learned filters of ``WIDTH`` bytes with ReLU, max-pooling over chunks of ``CHUNK`` bytes that
overlap by half and cover the whole text, a hidden layer per chunk, max- and mean-pooling over the chunks, and one
logistic unit. For scoring, embedding and filters are folded into tables of byte pairs, so a filter costs a few look-ups
per byte. Training is plain gradient descent (Adam) on a bounded sample of labelled rows.

Defined results: a null or empty text is scored as one chunk of padding. Repeated rows get equal scores, ids and other
columns are never read. An empty table gives an empty result; without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.frames import add_columns, bounded_sample, id_text, text_bytes

WIDTH, EMBED, FILTERS, HIDDEN = 8, 8, 24, 12
CHUNK, STEP = 256, 128
PAD = 0
# Labelled rows and bytes per row that training may see; scoring has no such limits.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 4_000
TRAIN_BYTES = 20_000_000
THRESHOLD = 0.7
# Bytes scored at a time, to keep the tables of activations in the processor's cache.
BLOCK = 1 << 16


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    filter_bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # 2 * HIDDEN
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return list(vars(self).values())


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)

    embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
    zeros = [np.zeros(n, np.float32) for n in (FILTERS, HIDDEN, 1)]
    return Network(embed, draw(WIDTH * EMBED, FILTERS), zeros[0], draw(FILTERS, HIDDEN), zeros[1] + 0.1, draw(2 * HIDDEN), zeros[2])


def padded(text: bytes) -> np.ndarray:
    """Bytes padded so that chunks of ``CHUNK`` positions at every ``STEP`` cover all of them, with ``WIDTH - 1`` to spare."""
    chunks = max(1, -(-(len(text) - CHUNK) // STEP) + 1)
    size = (chunks - 1) * STEP + CHUNK + WIDTH - 1
    return np.frombuffer(text.ljust(size, bytes([PAD])), np.uint8, size)


def chunks_of(text: np.ndarray) -> int:
    return (len(text) - CHUNK - WIDTH + 1) // STEP + 1


def fit(texts: list[bytes], target: np.ndarray, epochs: int | None = None, rate: float = 0.004, batch_bytes: int = 40_000) -> Network:
    """Train on a bounded list of texts, for as many rounds as make up ``TRAIN_BYTES``. Classes weigh the same."""
    net = new_network()
    if not len(texts):
        net.out[:] = 0
        return net
    data = [padded(text) for text in texts]
    epochs = epochs or int(np.clip(TRAIN_BYTES // sum(map(len, data)), 4, 40))
    share = min(max(float(np.mean(target)), 1e-3), 1 - 1e-3)
    weight = np.where(target > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    rng = np.random.default_rng(11)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parts()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        start = 0
        while start < len(order):
            stop, size = start, 0
            while stop < len(order) and (size == 0 or size + len(data[order[stop]]) <= batch_bytes):
                size += len(data[order[stop]])
                stop += 1
            chosen, start = order[start:stop], stop
            gradients = gradient(net, [data[i] for i in chosen], target[chosen].astype(np.float32), weight[chosen])
            step += 1
            now = rate * (1 - epoch / (epochs + 1))
            for part, slope, (first, second) in zip(net.parts(), gradients, moments, strict=True):
                first += 0.1 * (slope - first)
                second += 0.002 * (slope * slope - second)
                part -= now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.998**step)) + 1e-7)
    return net


def gradient(net: Network, data: list[np.ndarray], target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Slopes of the weighted logistic loss. Only the winning position of each pool takes part in the way back."""
    counts = np.array([chunks_of(text) for text in data])
    owner = np.repeat(np.arange(len(data)), counts)
    windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(text, CHUNK + WIDTH - 1)[::STEP] for text in data])
    pooled, place = np.empty((len(windows), FILTERS), np.float32), np.empty((len(windows), FILTERS), np.int64)
    for k, window in enumerate(windows):
        rows = np.lib.stride_tricks.sliding_window_view(net.embed[window].ravel(), WIDTH * EMBED)[::EMBED]
        active = rows @ net.filters
        place[k] = active.argmax(axis=0)
        pooled[k] = np.take_along_axis(active, place[k][None], 0)[0]
    raw = pooled + net.filter_bias
    units = np.maximum(raw, 0)
    inner = units @ net.hidden + net.hidden_bias
    active = np.maximum(inner, 0)
    bounds = np.concatenate([[0], counts.cumsum()[:-1]])
    top = np.maximum.reduceat(active, bounds)
    mean = np.add.reduceat(active, bounds) / counts[:, None]
    both = np.hstack([top, mean])
    p = 1 / (1 + np.exp(-np.clip(both @ net.out + net.out_bias[0], -30, 30)))
    error = ((p - target) * weight / len(data)).astype(np.float32)
    d_both = error[:, None] * net.out
    # The first chunk that reaches the maximum takes its slope.
    hit = active == top[owner]
    seen = np.cumsum(hit, axis=0)
    before = np.vstack([np.zeros((1, HIDDEN), seen.dtype), seen])[bounds]
    first = hit & (seen - before[owner] == 1)
    d_active = first * d_both[owner, :HIDDEN] + (d_both[:, HIDDEN:] / counts[:, None])[owner]
    d_inner = np.where(inner > 0, d_active, 0).astype(np.float32)
    d_raw = np.where(raw > 0, d_inner @ net.hidden.T, 0)
    d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    reach = np.arange(WIDTH)
    for f in range(FILTERS):
        some = np.flatnonzero(d_raw[:, f])
        used = windows[some[:, None], place[some, f][:, None] + reach]
        d_filters[:, f] = d_raw[some, f] @ net.embed[used].reshape(len(some), -1)
        spread = d_raw[some, f][:, None, None] * net.filters[:, f].reshape(WIDTH, EMBED)
        np.add.at(d_embed, used.ravel(), spread.reshape(-1, EMBED))
    return [d_embed, d_filters, d_raw.sum(0), units.T @ d_inner, d_inner.sum(0), both.T @ error, error.sum(keepdims=True)]


class Scorer:
    """The network with embedding and filters folded into one table per byte pair of the filter."""

    def __init__(self, net: Network):
        self.net = net
        single = np.einsum("be,wef->wbf", net.embed, net.filters.reshape(WIDTH, EMBED, FILTERS))
        pairs = single[0::2, :, None, :] + single[1::2, None, :, :]
        self.tables = np.ascontiguousarray(pairs.reshape(WIDTH // 2, 65536, FILTERS), np.float32)

    def pooled(self, text: np.ndarray) -> np.ndarray:
        """Maxima of the filters over half chunks, block by block; a chunk is two neighbouring halves."""
        halves = (len(text) - WIDTH + 1) // STEP
        out = np.empty((halves, FILTERS), np.float32)
        per_block = BLOCK // STEP
        for start in range(0, halves, per_block):
            stop = min(start + per_block, halves)
            part = text[start * STEP : stop * STEP + WIDTH - 1].astype(np.uint16)
            pair = part[:-1] * np.uint16(256) + part[1:]
            size = (stop - start) * STEP
            total = self.tables[0].take(pair[:size], axis=0)
            for k in range(1, WIDTH // 2):
                total += self.tables[k].take(pair[2 * k : 2 * k + size], axis=0)
            out[start:stop] = total.reshape(-1, STEP, FILTERS).max(axis=1)
        return np.maximum(out[:-1], out[1:])

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Texts are laid end to end: each begins at a multiple of ``STEP``, its chunks see nothing of the next."""
        if not texts:
            return np.zeros(0)
        net, scores = self.net, []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (size == 0 or size + len(texts[stop]) < 16 * BLOCK):
                size += len(texts[stop])
                stop += 1
            data = [padded(text) for text in texts[start:stop]]
            start = stop
            # Every text ends with a gap of STEP bytes of padding, in which its last filters end.
            laid = np.concatenate([np.pad(text, (0, STEP - WIDTH + 1)) for text in data] + [np.zeros(WIDTH - 1, np.uint8)])
            counts = np.array([chunks_of(text) for text in data])
            first = np.concatenate([[0], np.cumsum(counts + 2)[:-1]])
            pooled = self.pooled(laid)
            rows = np.repeat(first - np.concatenate([[0], counts.cumsum()[:-1]]), counts) + np.arange(counts.sum())
            units = np.maximum(pooled[rows] + net.filter_bias, 0)
            active = np.maximum(units @ net.hidden + net.hidden_bias, 0)
            bounds = np.concatenate([[0], counts.cumsum()[:-1]])
            both = np.hstack([np.maximum.reduceat(active, bounds), np.add.reduceat(active, bounds) / counts[:, None]])
            scores.append(1 / (1 + np.exp(-np.clip(both @ net.out + net.out_bias[0], -30, 30))))
        return np.concatenate(scores).astype(float)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` labelled texts of at most ``most_bytes``, half of them of each class where there are enough."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality")).where("_quality IN (0, 1)")
    marked = marked.groupBy("_id").agg(F.max("_quality").alias("_quality"))
    halves = [bounded_sample(marked.where(F.col("_quality") == kind), rows // 2, "_id") for kind in (0, 1)]
    joined = id_text(docs, "doc_id", "text").where(F.octet_length("text") <= most_bytes).join(halves[0].union(halves[1]), F.col("doc_id") == F.col("_id"))
    # A repeated id counts once, so that the bound holds.
    sample = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_quality").alias("_quality")).toPandas().sort_values("doc_id")
    return [text.encode() for text in sample["text"]], sample["_quality"].to_numpy(dtype=float)


def with_short_lines(texts: list[bytes], target: np.ndarray, every: int = 2) -> tuple[list[bytes], np.ndarray]:
    """Add one line of every second good text as a good text: few texts are short, and a part of a good one is good."""
    rng = np.random.default_rng(5)
    good = [text.split(b"\n") for text, mark in zip(texts, target, strict=True) if mark > 0][::every]
    short = [lines[rng.integers(len(lines))][:160] for lines in good]
    return texts + short, np.concatenate([target, np.ones(len(short))])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    return fit(*with_short_lines(*labelled_sample(docs, labels, rows)))


def classify(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents, ``score`` and ``predicted``."""

    def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        score = scorer(net).score(text_bytes(batch, text_col))
        return {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return add_columns(docs, [("score", "double"), ("predicted", "int")], columns)


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their own columns only."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scorer(net).score(text_bytes(batch, text_col)) >= threshold))

    return docs.mapInArrow(passing, docs.schema)


_SCORERS: dict[bytes, Scorer] = {}


def scorer(net: Network) -> Scorer:
    """Fold the tables once per worker process and network."""
    key = net.out.tobytes() + net.filter_bias.tobytes()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(net)
    return _SCORERS[key]
