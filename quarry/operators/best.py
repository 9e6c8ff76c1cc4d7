"""The best k rows of every query within a task, in numpy: only these leave the task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Scores (rows times queries) that a task holds at once.
CELLS = 1 << 22
#: Rows in one matrix of scores at most.
ROWS = 8192
#: Rows of an Arrow batch that leaves a task.
OUT_ROWS = 1 << 16


def rows_at_once(n_queries: int) -> int:
    return max(1, min(ROWS, CELLS // max(n_queries, 1)))


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Best:
    """Rows by score rounded to 9 places, then by key; equal scores are never dropped before the keys decided."""

    def __init__(self, n_queries: int, k: int):
        self.n, self.k = n_queries, k
        self.bar = np.full(n_queries, -np.inf)
        self.parts: list[tuple] = []
        self.held, self.room = 0, max(2 * n_queries * k, CELLS // 4)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores[row, query], -inf for pairs that don't count; keys[row]."""
        if len(keys) > self.k and not np.isfinite(self.bar).all():
            least = np.partition(scores, len(keys) - self.k, axis=0)[len(keys) - self.k]
            self.bar = np.maximum(self.bar, np.where(np.isfinite(least), least, -np.inf) - 2e-9)
        rows, qs = np.nonzero((scores >= self.bar) & (scores > -np.inf))
        self.parts.append((qs, scores[rows, qs], keys[rows]))
        self.held += len(rows)
        if self.held > self.room:
            self._settle()

    def _settle(self) -> None:
        qs, scores, keys = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        place = np.unique(keys, return_inverse=True)[1] if keys.dtype == object else keys
        order = np.lexsort((place, -np.round(scores, 9), qs))
        qs = qs[order]
        nth = runs(np.bincount(qs, minlength=self.n))
        order, qs, nth = order[nth < self.k], qs[nth < self.k], nth[nth < self.k]
        scores, keys = scores[order], keys[order]
        last = nth == self.k - 1
        self.bar[qs[last]] = np.maximum(self.bar[qs[last]], np.round(scores[last], 9) - 2e-9)
        self.parts, self.held = [(qs, scores, keys)], len(qs)

    def batches(self, query_ids: pa.Array, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self._settle()
        qs, scores, keys = self.parts[0]
        for a in range(0, len(qs), OUT_ROWS):
            part = slice(a, a + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(qs[part])), pa.array(keys[part], key_type), pa.array(scores[part])], ["query_id", "doc_id", "score"])
