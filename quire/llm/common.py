"""What the operators share: reading tables, written intermediate tables, rows as documents, text kernels.

A *document key* is ``(doc, part)``: ``doc`` is the integer doc_id and ``part`` numbers the different texts found under
one doc_id in the order of their hashes (0 where ids are unique). A row without doc_id has a doc below ``NO_ID`` from its
text's hash, so that any number of such rows spread; doc_ids are above that. Rows that agree in both id and text are one
document; every row of the input still gets its own row in a result.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch, written

#: Documents below it have no doc_id.
NO_ID = -(2**62)
#: Bytes of text that a Python worker works on at once.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(text_key(), 2) + F.lit(-(2**63)))


def text_key() -> Column:
    """Hash of a row's text, as keyed() has it: with doc_key() it tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def met(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined with keys (doc, th, other columns) by doc key and text; the columns __doc and __th stay."""
    own = docs.withColumns({"__doc": doc_key(), "__th": text_key()})
    return own.join(keys.withColumnsRenamed({"doc": "__doc", "th": "__th"}), ["__doc", "__th"], how)


def as_id(col: str = "doc") -> Column:
    return F.when(F.col(col) >= NO_ID, F.col(col)).alias("doc_id")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, part, copies, text): a row for each document, with how many rows have it; other columns are left out, a null
    text is empty."""
    own = docs.select(doc_key().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    twice = own.groupBy("doc").count().where("count > 1").select("doc")
    if twice.limit(1).count() == 0:
        return own.select("doc", F.lit(0).alias("part"), F.lit(1).alias("copies"), "text")
    alone = own.join(twice, "doc", "left_anti").select("doc", F.lit(0).alias("part"), F.lit(1).alias("copies"), "text")
    shared = own.join(twice, "doc", "left_semi").groupBy("doc", F.xxhash64("text").alias("th"))
    shared = written(shared.agg(F.first("text").alias("text"), F.count("*").cast("int").alias("copies")))
    # Texts of one id are numbered within ranges of their hashes, so that no task has all of an id.
    ranges = shared.groupBy("doc", F.shiftright("th", 54).alias("range")).count()
    before = ranges.withColumn("before", F.sum("count").over(Window.partitionBy("doc").orderBy("range")) - F.col("count")).drop("count")
    number = F.row_number().over(Window.partitionBy("doc", "range").orderBy("th")) - 1
    parts = shared.select("doc", "th", F.shiftright("th", 54).alias("range")).withColumn("number", number).join(before, ["doc", "range"])
    parts = parts.select("doc", "th", (F.col("number") + F.col("before")).cast("int").alias("part"))
    return alone.unionByName(shared.join(parts, ["doc", "th"]).select("doc", "part", "copies", "text"))


def squeeze(texts: list[bytes]) -> list[bytes]:
    c = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False)
    return [c.compress(t) for t in texts]


def unsqueeze(blobs: list[bytes]) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(b) for b in blobs]


def chunks(batches, text: str = "text", most: int = CHUNK_BYTES):
    """Record batches cut so that each holds about `most` bytes of text, or a single longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def lean(run):
    """run for mapInArrow, whose worker gives its free memory back at the end: workers outlive their tasks."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def gathered(batches, schema: pa.Schema) -> pa.Table:
    """All rows of a partition."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else schema.empty_table()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in one array, and the offsets of its rows; nulls are empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


# The six ASCII white space bytes of [\x20\x09-\x0D].
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in buf, and the offsets of each row's words among them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start, stop = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    stop[:-1] &= ~ink[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range buf[s:e], taken eight bytes at a time over all ranges at once."""
    pad = np.zeros(len(buf) + 8, np.uint8)
    pad[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), "<u8", pad, strides=(1,))
    size = e - s
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo, at = np.flatnonzero(size > 0), 0
    while len(todo):
        left = np.minimum(size[todo] - at, 8).astype(np.uint64)
        lane = lanes[s[todo] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8)))
        h[todo] = mix(h[todo] ^ mix(lane + np.uint64(0x2545F4914F6CDD1D)))
        at += 8
        todo = todo[size[todo] > at]
    return h


BASE = 0x9E6C63D0676A9A99
UNBASE = pow(BASE, -1, 2**64)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n at least; the longest made so far is kept."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for x in (BASE, UNBASE):
            p = np.full(1 << max(16, int(n).bit_length()), x, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


class Rolling:
    """Hashes of arbitrary ranges of a symbol array, in constant time each (polynomial in BASE modulo 2^64)."""

    def __init__(self, sym: np.ndarray):
        self.pow, self.unpow = powers(len(sym) + 1)
        self.sums = np.zeros(len(sym) + 1, np.uint64)
        np.cumsum(sym * self.pow[: len(sym)], dtype=np.uint64, out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.unpow[lo])

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.unpow[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` neighbours, by doubling."""
    if len(v) < width:
        return v[:0]
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[: len(v) - have], v[have:])
        have *= 2
    rest = width - have
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
