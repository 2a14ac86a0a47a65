"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a chunk ends where enough of its high bits are zero. Chunking is normalised: none
ends before ``LEAST`` bytes, up to ``NORMAL`` bytes more zero bits are asked for than after, and ``MOST`` ends any chunk.
As the hash sees the last 32 bytes alone, chunks after an insertion fall as before it. A fingerprint is the set of a
text's chunk digests, each with its length: hex of ten bytes a chunk (digest, length), in order of digest. The likeness
of a fingerprint to another is the share, by length, of its chunks that the other has (containment); an empty text is
like an empty one only.

The query needs each document's successor by doc_id. Documents go to ranges of ids (bounds from quantiles of the ids, four
for each partition) and the first document of a range also to the range before, so no window over the whole table is
needed. A null doc_id comes first; rows of one doc_id follow each other by a hash of their text. Null texts are empty. A
single row is its own successor. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, as_id, chunks, doc_key, mix, spread, squeeze, table, unsqueeze
from .repeats import BYTE

LEAST, NORMAL, MOST = 32, 96, 512
#: High bits that must be zero before and after NORMAL bytes.
HARD, EASY = np.uint32(0xFF000000), np.uint32(0xFC000000)
GEAR = (mix(BYTE) >> np.uint64(32)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at each byte: the sum of GEAR[b] << age, by doubling the span."""
    h = GEAR[buf]
    for span in (1, 2, 4, 8, 16):
        h[span:] += h[:-span] << np.uint32(span)  # numpy buffers the overlapping right side
    return h


def cuts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all rows, and how many each row has."""
    h = gear(buf)
    easy = np.flatnonzero((h & EASY) == 0)
    hard = easy[(h[easy] & HARD) == 0].tolist()
    easy = easy.tolist()
    ends, counts, x, y = [], [], 0, 0
    for start, stop in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        before = len(ends)
        while start < stop:
            x = bisect_left(hard, start + LEAST - 1, x)
            if x < len(hard) and hard[x] < start + NORMAL - 1:
                end = hard[x] + 1
            else:
                y = bisect_left(easy, start + NORMAL - 1, y)
                end = min(easy[y] + 1 if y < len(easy) else stop, start + MOST)
            start = min(end, stop)
            ends.append(start)
        counts.append(len(ends) - before)
    return np.array(ends, np.int64), np.array(counts, np.int64)


class Prints:
    """Fingerprints of many texts."""

    def __init__(self, texts: list[bytes]):
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        buf = np.frombuffer(b"".join(texts), np.uint8)
        ends, counts = cuts(buf, off) if len(buf) else (np.zeros(0, np.int64), np.zeros(len(texts), np.int64))
        row = np.repeat(np.arange(len(texts)), counts)
        starts = ends.copy()
        starts[1:] = ends[:-1]
        first = np.cumsum(counts) - counts
        starts[first[counts > 0]] = off[:-1][counts > 0]
        size = ends - starts
        digest = (Rolling(BYTE[buf]).of(starts, ends) if len(buf) else np.zeros(0, np.uint64)) ^ mix(size.astype(np.uint64))
        order = np.lexsort((digest, row))
        row, digest, size = row[order], digest[order], size[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
        self.row, self.digest, self.size = row[new], digest[new], size[new]
        self.at = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.weight = np.diff(np.concatenate(([0], np.cumsum(self.size)))[self.at])

    def hex(self) -> list[str]:
        raw = np.zeros(len(self.digest), np.dtype([("d", ">u8"), ("n", ">u2")]))
        raw["d"], raw["n"] = self.digest, self.size
        text = raw.tobytes().hex()
        return [text[20 * a : 20 * b] for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Containment of text a[i] in text b[i]."""

        def tagged(which):
            n = self.at[which + 1] - self.at[which]
            place = np.repeat(self.at[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return np.repeat(np.arange(len(which)), n), place

        (pa_, xa), (pb, xb) = tagged(a), tagged(b)
        pair, place = np.concatenate((pa_, pb)), np.concatenate((xa, xb))
        order = np.lexsort((self.digest[place], pair))
        pair, place = pair[order], place[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (self.digest[place[1:]] == self.digest[place[:-1]])) if len(pair) else np.zeros(0, np.int64)
        shared = np.bincount(pair[same], self.size[place[same]], len(a))
        weight = self.weight[a]
        return np.where(weight > 0, shared / np.maximum(weight, 1), (self.weight[b] == 0).astype(float))


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with the column fingerprint."""

    def run(batches):
        for b in chunks(batches, "__text"):
            own = Prints([t or b"" for t in b.column("__text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own.hex(), pa.string())], [*b.schema.names[:-1], "fingerprint"])

    out = docs.drop("fingerprint")
    return out.withColumn("__text", F.col("text").cast("string").cast("binary")).mapInArrow(run, T.StructType(list(out.schema)).add("fingerprint", "string"))


def successors(docs: DataFrame) -> DataFrame:
    """(bucket, tail, doc, th, text): documents by range of ids, sorted within partitions; tail rows belong to the next range."""
    parts = spread(docs.sparkSession)
    n = 4 * parts  # several ranges a task, so that tasks are alike
    own = docs.select(doc_key().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = np.array(sorted({int(q) for q in own.approxQuantile("doc", [k / n for k in range(1, n)], 0.2 / n)} if n > 1 else set()), np.int64)

    def lowest(batches):
        for b in batches:
            doc = b.column("doc").to_numpy()
            bucket = np.searchsorted(bounds, doc, "right")
            for k in np.unique(bucket).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([doc[bucket == k].min()], pa.int64())], ["bucket", "doc"])

    least = own.select("doc").mapInArrow(lowest, "bucket int, doc long").groupBy("bucket").agg(F.min("doc").alias("doc"))
    least = sorted((r.bucket, r.doc) for r in least.collect())  # a row for each range
    before = {doc: least[k - 1][0] for k, (_, doc) in enumerate(least)}
    firsts = np.array([doc for _, doc in least], np.int64)

    def deal(batches):
        for b in chunks(batches):
            doc = b.column("doc").to_numpy()
            blob = pa.array(squeeze(b.column("text").cast(pa.binary()).to_pylist()), pa.binary())
            again = np.flatnonzero(np.isin(doc, firsts))
            bucket = np.concatenate((np.searchsorted(bounds, doc, "right"), [before[x] for x in doc[again].tolist()])).astype(np.int32)
            tail = np.repeat([0, 1], [len(doc), len(again)]).astype(np.int32)
            take = pa.array(np.concatenate((np.arange(len(doc)), again)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(tail), b.column("doc").take(take), b.column("th").take(take), blob.take(take)], ["bucket", "tail", "doc", "th", "text"])

    dealt = own.select("doc", F.xxhash64("text").alias("th"), "text").mapInArrow(deal, "bucket int, tail int, doc long, th long, text binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "doc", "th")


OUT = pa.schema([("doc", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT_DDL = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame) -> DataFrame:
    """The contract's row for each row of docs."""

    def run(batches):
        last = None
        for b in chunks(batches, most=1 << 20):
            rows = list(zip(*(b.column(c).to_pylist() for c in ("bucket", "tail", "doc")), unsqueeze(b.column("text").to_pylist()), strict=True))
            if last is not None:
                rows.insert(0, last)
            if not rows:
                continue
            last = rows[-1]
            own = [k for k in range(len(rows) - 1) if not rows[k][1]]
            if own:
                yield judged(rows, np.array(own))

    def judged(rows, own):
        texts = [r[3] for r in rows]
        plain = [t.decode() for t in texts]
        edited = [(plain[k][: len(plain[k]) - len(plain[k]) // 2] + plain[k + 1][: len(plain[k]) // 2]).encode() for k in own.tolist()]
        prints = Prints(texts + edited)
        shown = prints.hex()
        changed = len(texts) + np.arange(len(own))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in own.tolist()], pa.int64()),
                pa.array([len(plain[k]) for k in own.tolist()], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                pa.array([shown[k] for k in own.tolist()], pa.string()),
                pa.array(shown[len(texts) :], pa.string()),
                pa.array(prints.likeness(own, changed)),
                pa.array(prints.likeness(own, own + 1)),
            ],
            schema=OUT,
        )

    return successors(docs).mapInArrow(run, OUT_DDL).select(as_id(), *OUT.names[1:])


def op3_cdc_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
