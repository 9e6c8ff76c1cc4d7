"""Byte-level convolutional quality classifier in numpy.

A filter of width 8 holds a learned weight per byte value and place. All filters slide over the
whole document; their responses are max-pooled over overlapping chunks of 256 bytes (step 128), the
chunk values are pooled over the document (largest, mean, smallest), and a logistic layer combines
them into one probability. Filters and layer are fitted together by back-propagation on a bounded
sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import slices
from .sampling import fold, labelled_sample

WIDTH, FILTERS, BLOCK = 8, 16, 128
#: Documents of either class that the fit reads, and the bytes that they hold at most; texts are whole.
SAMPLE, SAMPLE_BYTES = 750, 8 << 20
EPOCHS, BATCH, RATE, DECAY = 8, 50, 0.02, 1e-4
THRESHOLD = 0.3
FOLDS, HELD_FOLD = 5, 0
TILE = 128 * 128


def _responses(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Filter responses at every byte of x that has WIDTH bytes from it on."""
    n = len(x) - WIDTH + 1
    acc = np.take(table[0], x[:n], axis=0)
    part = np.empty_like(acc)
    for j in range(1, WIDTH):
        np.take(table[j], x[j : j + n], axis=0, out=part)
        acc += part
    return acc


def document_features(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Largest, mean and smallest chunk value of every filter, for each document."""
    sizes = np.diff(offsets)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks + 1)])  # a block of zeros parts documents
    x = np.zeros(int(first[-1]) * BLOCK + WIDTH, np.uint8)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = int(first[i]) * BLOCK
        x[at : at + b - a] = data[a:b]
    peak = np.empty((int(first[-1]), FILTERS), np.float32)
    for at in range(0, int(first[-1]) * BLOCK, TILE):
        r = _responses(x[at : min(at + TILE, int(first[-1]) * BLOCK) + WIDTH - 1], table)
        peak[at // BLOCK : at // BLOCK + len(r) // BLOCK] = r.reshape(-1, BLOCK, FILTERS).max(axis=1)
    pair = np.maximum(peak, np.concatenate([peak[1:], peak[-1:]]))  # a chunk: two blocks, one shared with the next
    chunks = np.maximum(1, blocks - 1)
    lone = first[:-1][blocks == 1]
    pair[lone] = peak[lone]
    pair = np.tanh(pair)
    bounds = np.stack([first[:-1], first[:-1] + chunks], 1).ravel()
    bounds = np.minimum(bounds, len(pair) - 1)
    top = np.maximum.reduceat(pair, bounds)[::2]
    low = np.minimum.reduceat(pair, bounds)[::2]
    mean = np.add.reduceat(pair, bounds)[::2] / chunks[:, None].astype(np.float32)
    return np.concatenate([top, mean, low], axis=1)


def chunks_of(text: str) -> np.ndarray:
    """All overlapping chunks of a text, a row each, with the bytes that the last places of a filter read."""
    b = np.frombuffer(text.encode(), np.uint8)
    n = max(1, -(-len(b) // BLOCK) - 1)
    x = np.zeros((n + 1) * BLOCK + WIDTH - 1, np.uint8)
    x[: len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(x, 2 * BLOCK + WIDTH - 1)[::BLOCK][:n]


def fit(rows: list[tuple[int, str]], prior: dict[int, int], seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Filters, weights and bias; rows: label and whole text, the same number of either class or nearly."""
    rng = np.random.Generator(np.random.PCG64(seed))
    xs = [chunks_of(t) for _, t in rows]
    y = np.array([k for k, _ in rows], np.float32)
    params = [rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS if len(rows) >= 20 and 0 < y.sum() < len(y) else 0):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            x = np.concatenate([xs[i] for i in pick])
            counts = np.array([len(xs[i]) for i in pick])
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            table, w, b = params
            best = np.full((len(x), FILTERS), -np.inf, np.float32)
            arg = np.zeros((len(x), FILTERS), np.int64)
            for c in range(0, len(x), 64):  # small enough for the cache
                part = x[c : c + 64]
                r = np.take(table[0], part[:, : 2 * BLOCK], axis=0)
                for j in range(1, WIDTH):
                    r += np.take(table[j], part[:, j : j + 2 * BLOCK], axis=0)
                arg[c : c + 64] = r.argmax(axis=1)
                best[c : c + 64] = np.take_along_axis(r, arg[c : c + 64][:, None], axis=1)[:, 0]
            t = np.tanh(best)
            top, low = np.maximum.reduceat(t, first), np.minimum.reduceat(t, first)
            g = np.concatenate([top, np.add.reduceat(t, first) / counts[:, None], low], axis=1)
            p = 1 / (1 + np.exp(-np.clip(g @ w + b[0], -30, 30)))
            dz = ((p - y[pick]) / len(pick)).astype(np.float32)
            dg = dz[:, None] * w
            doc = np.repeat(np.arange(len(pick)), counts)
            dt = dg[doc, FILTERS : 2 * FILTERS] / counts[doc][:, None]
            dt += dg[doc, :FILTERS] * (t == top[doc]) + dg[doc, 2 * FILTERS :] * (t == low[doc])
            dr = dt * (1 - t * t)
            rows_at, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
            d_table = np.empty_like(table)
            for j in range(WIDTH):
                at = x[rows_at, arg + j].astype(np.int64) * FILTERS + cols
                d_table[j] = np.bincount(at.ravel(), weights=dr.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            grads = [d_table, (g.T @ dz).astype(np.float32) + DECAY * w, np.array([dz.sum()], np.float32)]
            step += 1
            for q, (param, grad) in enumerate(zip(params, grads)):
                m[q] = 0.9 * m[q] + 0.1 * grad
                v[q] = 0.99 * v[q] + 0.01 * grad * grad
                param -= RATE * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.99**step)) + 1e-6)
    shown = [max(1, int((y == k).sum())) for k in (0, 1)]
    shift = np.log(max(1, prior.get(1, 1)) / shown[1]) - np.log(max(1, prior.get(0, 1)) / shown[0])
    return params[0], params[1], float(params[2][0] + shift)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Scores read the text alone, all its chunks whatever its length. The fit reads at most per_class
    labelled documents of either class outside the held-out fold, whole, with SAMPLE_BYTES a class;
    without labels the untrained layer's score stands. Null and empty texts get the score of a document
    of zero bytes; repeated rows get equal scores. Other columns, whatever their names, are not read.
    """
    sample, prior = labelled_sample(docs, labels, label_col, FOLDS, HELD_FOLD, per_class, id_col, text_col, SAMPLE_BYTES)
    rows = [(r["label"], r["text"]) for r in sample.collect()]  # bounded: 2 * per_class rows, 2 * SAMPLE_BYTES
    table, w, b = fit(sorted(rows), prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                g = document_features(data, offsets, table)
                p = 1 / (1 + np.exp(-np.clip(g.astype(np.float64) @ w + b, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p)], names=["doc_id", "held_out", "score"])

    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD_FOLD).alias("held_out"), F.col(text_col).alias("text"))
        .mapInArrow(score, "doc_id long, held_out boolean, score double")
        .withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    )
