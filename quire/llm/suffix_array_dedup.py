"""Suffix-array dedup of `size` UTF-8 bytes by prefix-free parsing.

Rolling-hash triggers cut each document into phrases. A trigger is a place whose rolling hash is the least in some
window of ``size`` bytes, so that no window is without one and equal windows have it at the same place; a phrase is all
that the windows of one trigger cover, so neighbouring phrases overlap and each window lies in one phrase. The *parse* is
the corpus as phrases, the *dictionary* holds each different phrase once.

The parse's suffixes are sorted by trigger, phrase, and place in the corpus: its suffix array as far as one phrase, beyond
which no window reaches. What it has several times is an interval of it, and all windows of that phrase repeat. The
dictionary's suffixes that start a window are sorted by their first ``size`` bytes (Suffixes: order and common prefixes
from the bytes). Both combine to the order of the corpus' suffixes: a stretch of the dictionary's array with ``size``
bytes in common stands for all places that the parse has for its phrases, in corpus order, and repeats if they are
several. Every occurrence goes, the first included.

It is done in parts: phrases of one trigger are a dictionary of their own, as no window occurs under two. A trigger that
begins only one phrase needs no text. Under a trigger of very many phrases single windows are the phrases.

Null texts are empty. Rows alike in doc_id and text are one document (not a repeat of each other), different texts of
one doc_id are parts of it. Matches never cross rows. Removal may cut a character: kept text is bytes. Phrases are told
apart by two 64-bit hashes (trigger and text), as is usual for such dictionaries; windows by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_id, flat, keyed, table
from .repeats import Windows, by_document, phrase_windows, removed
from .suffixes import Suffixes

KEPT = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
KEPT_DDL = "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def windows(size: int = 200) -> Windows:
    return Windows("byte", size, gram=max(1, size * 3 // 25), first=False, chunk=2 << 20)


def combined(w: Windows, doc, pos, n, text):
    """Phrase and place of each window of a dictionary's part in the order of their bytes and then of the corpus, and
    whether an equal one is anywhere else."""
    buf, off = flat(text)
    row, j, at = phrase_windows(off[:-1], n)
    corpus = np.lexsort((pos[row] + j, doc[row]))
    suffixes = Suffixes(buf, 8, at[corpus], w.size)
    row, j = row[corpus][suffixes.order], j[corpus][suffixes.order]
    goes = np.zeros(len(row), bool)
    if len(row):
        lead = np.flatnonzero(suffixes.lcp < w.size)
        stretch = np.diff(np.append(lead, len(row)))
        # A row that came twice is the same document: several places make a repeat, not several rows.
        first = np.repeat(lead, stretch)
        other = (doc[row] != doc[row[first]]) | (pos[row] + j != pos[row[first]] + j[first])
        goes = np.repeat(np.logical_or.reduceat(other, lead), stretch)
    return row, j, goes


def suffix_array_dedup(docs: DataFrame, size: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) for each row: its bytes less every repeat of `size` bytes."""
    w = windows(size)
    own = keyed(docs)

    def finish(doc, text, lo, hi):
        keep, at = [], 0
        for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
            keep.append(text[at:x])
            at = y
        kept = b"".join([*keep, text[at:]])
        return doc, len(text), len(text) - len(kept), len(lo), kept, hashlib.sha256(kept).hexdigest()

    return by_document(own, removed(own, w, combined), w, finish, KEPT, KEPT_DDL).select(as_id(), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents")).drop("kept")
