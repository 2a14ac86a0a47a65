"""The nearest vectors of one block to the points of another, by matrix product and a check in the order of `vectors.cosine`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are scored at once; what the product may differ from the score by; lengths whose products keep in range.
PAIRS, SLACK, LEAST, MOST = 1 << 20, 1e-9, 1e-100, 1e100


class Vectors:
    """A column of arrays: rows of one length as a matrix, with what is null in it."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.absent = column.is_null().to_numpy(zero_copy_only=False)
        values = column.flatten()
        self.gaps = values.is_null().to_numpy(zero_copy_only=False)
        self.values = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        self.start = np.cumsum(self.n) - self.n

    def lengths(self):
        return np.unique(self.n).tolist()

    def matrix(self, rows: np.ndarray, width: int):
        """The first `width` elements of the rows, their lengths, and which rows have a null there."""
        at = self.start[rows][:, None] + np.arange(width)
        m, total = self.values[at], np.zeros(len(rows))
        for i in range(width):  # in order, as a fold adds them
            total = total + m[:, i] * m[:, i]
        return m, np.sqrt(total), self.absent[rows] | self.gaps[at].any(axis=1)


def _exact(dot: np.ndarray, length: np.ndarray) -> np.ndarray:
    """vectors.cosine, bit for bit, of dots and products of lengths; a NaN is greater than all, as in Spark."""
    x = np.divide(dot, length, out=np.zeros_like(dot), where=length != 0)
    x = np.where(np.isnan(x), 1.0, np.clip(x, -1.0, 1.0))
    return np.where(np.isnan(length) | (length > 0), x, 0.0)


def nearest(points: pa.ChunkedArray, vectors: pa.ChunkedArray, ids: np.ndarray, seen: list[np.ndarray], k: int):
    """(point, vector, score): for each point its k vectors of highest (1 + cosine) / 2, ties by id, but those whose ids it has seen."""
    p, v = Vectors(points), Vectors(vectors)
    known, place = np.unique(ids, return_inverse=True)
    out = []
    step = max(1, PAIRS // max(1, len(ids)))
    for lo in range(0, len(p.n), step):
        own = np.arange(lo, min(lo + step, len(p.n)))
        fresh = np.ones((len(own), len(known)), bool)
        for r, i in enumerate(own):
            at = np.searchsorted(known, seen[i])
            at = at[at < len(known)]
            fresh[r, at[np.isin(known[at], seen[i])]] = False
        open_ = fresh[:, place]
        near, sure, parts = np.full(open_.shape, -np.inf), np.ones(open_.shape, bool), []
        for a in p.lengths():
            rows = np.flatnonzero(p.n[own] == a)
            for b in v.lengths():
                cols = np.flatnonzero(v.n == b)
                if not len(rows) or not len(cols):
                    continue
                (x, xn, xbad), (y, yn, ybad) = p.matrix(own[rows], min(a, b)), v.matrix(cols, min(a, b))
                odd = lambda n: ~((n == 0) | ((n > LEAST) & (n < MOST)))
                plain = lambda m, n, bad: np.where((bad | odd(n) | (n == 0))[:, None], 0.0, m / np.where((n == 0) | odd(n), 1.0, n)[:, None])
                near[np.ix_(rows, cols)] = plain(x, xn, xbad) @ plain(y, yn, ybad).T
                sure[np.ix_(rows, cols)] = ~((odd(xn) & ~xbad)[:, None] | (odd(yn) & ~ybad)[None, :])
                parts.append((rows, cols, x, xn, xbad, y, yn, ybad))
        rank = np.where(open_ & sure, near, -np.inf)
        bar = -np.partition(-rank, k - 1, axis=1)[:, k - 1] if rank.shape[1] > k else np.full(len(own), -np.inf)
        chosen = open_ & (~sure | (near >= bar[:, None] - SLACK))
        for rows, cols, x, xn, xbad, y, yn, ybad in parts:
            i, j = np.nonzero(chosen[np.ix_(rows, cols)])
            dot = np.zeros(len(i))
            for d in range(x.shape[1]):
                dot = dot + x[i, d] * y[j, d]
            score = np.where(xbad[i] | ybad[j], 0.0, _exact(dot, xn[i] * yn[j]))
            out.append((own[rows[i]], cols[j], (1 + score) / 2))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, score = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i)
    best = np.arange(len(i)) - first < k
    return i[best], j[best], score[best]
