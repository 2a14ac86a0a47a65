"""Substring dedup over words: suffixes partitioned by variable-length prefixes, suffix trees of their groups.

Suffixes that start windows of ``size`` words count. Of the suffixes that share an anchor (quire.llm.repeats: the least
hash of a few words in the window) one stands for the run: that which starts at the anchor, dealt out by its prefix, the
words that were hashed. Where more than ``hot`` runs share a prefix, their suffixes are dealt out one by one by longer
prefixes of their own: half, three quarters, or all of ``size`` words, until no more than ``crowd`` share one. Runs
equal to the word are one path in any tree and meet before; their first in corpus order goes on.

A group's suffixes, cut at ``size`` words, make a suffix tree, held as suffix array and common prefixes (Suffixes), its
words told apart by their bytes (words of over 64 bytes by a 128-bit digest). Its deep internal nodes, those of ``size``
words, are the repeats: their leaves are the places of one word sequence, and all but the first in corpus order lose
their words. Neighbouring leaves' places run together to maximal repeats.

Null or empty texts have no words. Rows alike in doc_id and text are one document, different texts of one doc_id are
parts of it in hash order, rows without doc_id come before all others in hash order. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, flat, keyed, met, signed, table
from .repeats import Windows, by_document, phrase_windows, removed
from .suffixes import Suffixes, deep_nodes, word_symbols

KEPT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("th", pa.int64())])
KEPT_DDL = "doc long, n_words long, n_removed long, kept string, kept_sha256 string, th long"


def windows(size: int = 20) -> Windows:
    return Windows("word", size, gram=max(1, size * 3 // 10), first=True)


def subtrees(w: Windows, doc, pos, n, text):
    """Phrase and place of each window in the groups' suffix trees, and whether an equal one comes earlier in the corpus."""
    rank, offsets = word_symbols(*flat(text))
    row, j, at = phrase_windows(offsets[:-1], n)
    place, which = pos[row] + j, doc[row]
    # Leaves of one node come in corpus order.
    corpus = np.lexsort((place, which))
    tree = Suffixes(rank, 32, at[corpus], w.size)
    leaf = corpus[tree.order]
    first, end, _ = deep_nodes(tree.lcp, w.size)
    node = np.repeat(np.arange(len(first)), end - first)
    leaves = leaf[np.repeat(first, end - first) + np.arange(len(node)) - np.repeat(np.cumsum(end - first) - (end - first), end - first)]
    lead = leaf[first][node]
    goes = np.zeros(len(row), bool)
    goes[leaves] = (which[lead] != which[leaves]) | (place[lead] != place[leaves])
    return row, j, goes


def deduped(docs: DataFrame, size: int = 20) -> DataFrame:
    """KEPT for each row; th is text_key() of its text as it was."""
    w = windows(size)
    own = keyed(docs)

    def finish(doc, text, lo, hi):
        parts = text.split()  # bytes.split() cuts at the six ASCII white space bytes
        keep, at = [], 0
        for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
            keep += parts[at:x]
            at = y
        keep += parts[at:]
        kept = b" ".join(keep)
        return doc, len(parts), len(parts) - len(keep), kept.decode(), hashlib.sha256(kept).hexdigest(), int(signed(np.array([xxhash.xxh64_intdigest(text, 42)], np.uint64))[0])

    return by_document(own, removed(own, w, subtrees), w, finish, KEPT, KEPT_DDL)


def substring_dedup(docs: DataFrame, size: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) for each row: its text less every word in a repeat seen earlier."""
    return deduped(docs, size).select(as_id(), "n_words", "n_removed", "kept", "kept_sha256")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their repeats removed; a document of which no word is left goes, one that lost none keeps its text as it was."""
    done = deduped(docs).where("n_removed > 0").groupBy("doc", "th").agg(F.first("kept").alias("__kept"))
    out = met(docs, done, "left")
    out = out.withColumn("text", F.coalesce("__kept", "text")).where("__kept IS NULL OR __kept <> ''")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
