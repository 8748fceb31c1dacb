"""Whole-number vectors for the exact searches (operators 11 and 13): conversion, products without rounding, selection with ties.

A vector's components become floor(256 * x), x as a double. Vectors that are null, or that hold null or non-finite
components, and rows without an id take no part. Vectors of different lengths are compared on their common leading
components, as if the shorter one were padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256.0
#: Columns of a tile of scores.
TILE = 4096


def usable(vector: str) -> Column:
    """Whether a vector has only finite components."""
    x = F.col(vector).cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def usable_rows(rows: DataFrame, vector: str = "embedding", number: str = "vec_id") -> DataFrame:
    return rows.where(usable(vector)).where(F.col(number).isNotNull())


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, scaled matrix) for each length of vector in a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.floor(SCALE * values[starts[at][:, None] + np.arange(size)])


def packed(matrix: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where all fit, else as doubles."""
    return (matrix.astype("<i2") if np.abs(matrix).max(initial=0) < 1 << 15 else matrix.astype("<f8")).tobytes()


def unpacked(data: bytes | memoryview | np.ndarray, rows: int, size: int) -> np.ndarray:
    kind = "<i2" if len(data) == 2 * rows * size else "<f8"
    return np.frombuffer(data, kind, rows * size).reshape(rows, size)


def longest(matrix: np.ndarray) -> float:
    return float(np.sqrt(np.square(matrix, dtype=np.float64).sum(1).max(initial=0.0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``. No partial sum passes the product of the norms (Cauchy-Schwarz), so single
    or double precision is exact below its whole-number range; beyond both, Python's integers are used."""
    size = min(a.shape[1], b.shape[1])
    a, b = a[:, :size], b[:, :size]
    most = longest(a) * longest(b) * 1.0001
    if most < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).astype(object) @ whole(b).astype(object).T if size else np.zeros((len(a), len(b)))


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` highest scores above minus infinity, best first; of equal scores the first columns."""
    if scores.dtype == object:
        found = [sorted((c for c in range(len(line)) if line[c] > -np.inf), key=lambda c: (-line[c], c))[:k] for line in scores]
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.array([c for f in found for c in f], np.int64)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        row, column = np.nonzero(scores > -np.inf)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


class TopLists:
    """For each of ``n`` searches its ``k`` best (score, id) so far: higher scores first, of equal ones smaller ids. A score that no
    long holds raises."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), self.NONE)
        self.ids = np.zeros((n, k), np.int64)

    @property
    def last(self) -> np.ndarray:
        """The score that a new entry must reach; the least number while a list isn't full."""
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in some of ``scores`` (a line for each of ``rows``; minus infinity: none), whose columns ascend by ``ids``."""
        if not scores.size:
            return
        top = scores.max(1)
        near = np.flatnonzero((top > -np.inf) & (top >= self.last[rows]))
        if not len(near):
            return
        row, column = best(scores[near], self.scores.shape[1])
        new, number = np.full((len(near), self.scores.shape[1]), self.NONE), np.zeros((len(near), self.scores.shape[1]), np.int64)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        value = scores[near[row], column]
        new[row, place] = [int(x) for x in value] if value.dtype == object else value
        number[row, place] = ids[column]
        self.merge(rows[near], new, number)

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        all_scores, all_ids = np.concatenate([self.scores[rows], scores], 1), np.concatenate([self.ids[rows], ids], 1)
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[rows], self.ids[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(search, place from 0, id, score) of all entries."""
        row, place = np.nonzero(self.scores != self.NONE)
        return row, place, self.ids[row, place], self.scores[row, place]
