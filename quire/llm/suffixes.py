"""Suffix arrays with their common prefixes, cut at a depth, by prefix doubling; the deep nodes of their tree.

``Suffixes`` sorts the suffixes that begin at given places of an array of symbols by their first ``depth`` symbols (each
has that many). Factors of 2, 4, 8, ... symbols are ranked from the ranks of their halves, so order and equality come
from the symbols themselves. ``deep_nodes`` are the internal nodes of the suffix tree at a depth or below it: stretches
of the suffix array whose neighbours share that many symbols.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WHITE, words


class Suffixes:
    """order: the places in the order of their first `depth` symbols; lcp: symbols that each shares with the one before."""

    def __init__(self, symbols: np.ndarray, bits: int, places: np.ndarray, depth: int):
        # Ranks of all factors of 1, 2, 4, ... symbols; what fits 32 bits is its own rank.
        self.ranks = [symbols.astype(np.uint64)]
        while (length := 1 << len(self.ranks)) <= depth:
            last = self.ranks[-1]
            half, size = length // 2, bits * length // 2
            pair = (last[: max(0, len(last) - half)] << np.uint64(min(size, 32))) | last[half:]
            self.ranks.append(pair if size <= 16 else np.unique(pair, return_inverse=True)[1].astype(np.uint64))
        self.depth = depth
        top, reach = self.ranks[-1], 1 << len(self.ranks) - 1
        key = (top[places] << np.uint64(32)) | top[places + depth - reach]  # the two factors cover all of the depth
        at = np.argsort(key, kind="stable")
        self.order = at
        self.lcp = np.zeros(len(at), np.int64)
        if len(at):
            self.lcp[1:] = self.common(places[at[:-1]], places[at[1:]])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b share, up to the depth."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            ranks, length = self.ranks[k], 1 << k
            open_ = np.flatnonzero(n + length <= self.depth)
            same = open_[ranks[a[open_] + n[open_]] == ranks[b[open_] + n[open_]]]
            n[same] += length
        return n


def deep_nodes(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last but one place in the suffix array, and the parent's depth, of each node with two leaves at least
    whose leaves share `depth` symbols, though no others share as many with them."""
    lead = np.flatnonzero(lcp < depth)
    end = np.append(lead[1:], len(lcp))
    around = np.append(lcp, 0)
    parent = np.maximum(around[lead], around[end]) if len(lead) else lead
    inner = end - lead > 1
    return lead[inner], end[inner], parent[inner]


def word_symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each word among the different words, in the order of their bytes, and the offsets of the rows' words."""
    s, e, at = words(buf, off)
    ends = np.zeros(len(s) + 1, np.int32)
    np.cumsum(e - s, out=ends[1:])
    plain = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(buf[~WHITE[buf]] if len(buf) else buf)])
    coded = plain.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], at
