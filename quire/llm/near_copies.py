"""All near copies at a similarity of 0.8 of five-word shingles: SimHash's trie join proposes, prefixes of rare shingles make it whole.

A text's shingles are its different runs of five lower-cased words (all of it, if it has fewer); two texts are alike if
``SIMILARITY`` of all shingles of both are shingles of both. Texts with the same shingles are one class, named by its first
text. No link between classes is left out:

1. Put the shingles in any one order. Two classes that are alike share one of the first ``n - ceil(0.8 n) + 1`` of the n
   shingles of each (the prefix), as the rest alone is too few. So all links are among the classes that meet at a shingle of
   their prefixes. The order used has shingles that are in the prefixes of more than ``FEW`` classes last, the most common
   ones at the very end, so that passages which many texts have make no large groups. It changes what is compared, never
   what is found.
2. Likely links first: SimHashes within two bits (quire.llm.simhash), and each group's members with its first. Each is
   checked by its shingles; components are taken over those that are alike.
3. Then, in each group that is not one component by now, all pairs of different components. A pair is let go only where its
   links are ruled out: by the numbers of shingles, or as parities of the shingles' hashes in 4 n bits or more differ in more
   places than shingles of alike texts can (each shingle that only one of them has changes one bit). What is left is checked.
   Where that is many pairs, a forest of them goes first and then all that it leaves between different components. Groups of
   more than ``LARGE`` are dealt out, each two blocks of them to a task.

Shingles, and sets of them, are told apart by 64-bit hashes. Texts without words are alike. Rows alike in doc_id and text are
one document, a row without doc_id comes before all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, chunks, doc_key, flat, gathered, lean, met, mix, signed, spread, text_key, word_hash, words, written
from .simhash import LOWER, components, forest, links

WIDTH, BITS = 5, 2
#: Classes with a shingle in their prefixes above which it is common; classes of a group that are met in one task.
FEW, LARGE = 64, 2000
#: Common shingles at most; passing pairs for each class of a group above which a forest goes first.
COMMON, MANY = 1 << 17, 4
SIMILARITY = 0.8
#: Buckets of shingles for each task; bytes of parities that are met at once.
BUCKETS, PIECE = 4, 4 << 20
U = np.uint64
SALT, OTHER, PARITY = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_FOLD = np.frombuffer(LOWER, np.uint8)


def shingles(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's different shingles, in their order, and the offsets of the rows among them."""
    buf = _FOLD[buf]
    s, e, at = words(buf, off)
    roll = Rolling(word_hash(buf, s, e))
    n = np.diff(at)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), many)
    lo = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + at[row]
    h = roll.of(lo, np.minimum(lo + width, at[row + 1]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def simhash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row's shingles."""
    prints = np.zeros(len(at) - 1, U)
    own = np.flatnonzero(np.diff(at))
    if len(own):
        bits = np.unpackbits(mix(h ^ SALT).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[own], axis=0, dtype=np.int32)
        prints[own] = np.packbits(2 * ones > np.diff(at)[own][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return prints


def packed(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary value for each row: its numbers of h."""
    offsets = (at * h.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(h))])


def unpacked(column: pa.Array, kind="<u8") -> tuple[np.ndarray, np.ndarray]:
    buf, off = flat(column)
    size = np.dtype(kind).itemsize
    return np.frombuffer(buf.tobytes(), kind), off // size


MET = [("g", "<u8"), ("v", "<i8"), ("n", "<i8")]


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(doc_key().alias("doc"), text_key().alias("th"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def whole(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's shingles, which names their class."""
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(h ^ OTHER), dtype=U)))
    return signed(mix(sums[at[1:]] - sums[at[:-1]] + mix(np.diff(at).astype(U))))


def classes(docs: DataFrame) -> DataFrame:
    """(v, n, fp, doc, th): each class with its number of shingles, their SimHash, and its first text."""

    def run(batches):
        for b in chunks(batches, most=1 << 20):
            h, at = shingles(*flat(b.column("text")))
            cols = whole(h, at), np.diff(at).astype(np.int64), signed(simhash(h, at))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), b.column("doc"), b.column("th")], ["v", "n", "fp", "doc", "th"])

    own = texts(docs).mapInArrow(lean(run), "v long, n long, fp long, doc long, th long")
    return own.groupBy("v", "n", "fp").agg(F.min(F.struct("doc", "th")).alias("x")).select("v", "n", "fp", "x.doc", "x.th")


def needed(n, least: float = SIMILARITY):
    """Shingles that a text must share to be alike, of its n."""
    return np.ceil(least * n - 1e-6).astype(np.int64)


def prefixes(h: np.ndarray, at: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each row's prefix, and their rows; `common` has the common shingles, the most common last."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    if len(common):
        order = np.argsort(common)
        found = np.minimum(np.searchsorted(common, h, sorter=order), len(common) - 1)
        h = h[np.lexsort((h, np.where(common[order[found]] == h, order[found] + 1, 0), row))]
    took = np.arange(len(h)) - at[row] < (n - needed(n) + 1)[row]
    return h[took], row[took]


def dealt(docs: DataFrame, common: np.ndarray, names: bool) -> DataFrame:
    """(bucket, rows): the prefixes' shingles by buckets, packed as (g) or (g, v, n)."""
    many = BUCKETS * spread(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(common)
    kind = MET[: 3 if names else 1]

    def run(batches):
        parts, seen = [], set()  # copies within a partition do not travel
        for b in chunks(batches, most=1 << 20):
            h, at = shingles(*flat(b.column("text")))
            v, n = whole(h, at), np.diff(at).astype(np.int64)
            new = np.array([not (x in seen or seen.add(x)) for x in v.tolist()], bool)
            h, row = prefixes(h, at, sent.value)
            h, row = h[new[row]], row[new[row]]
            part = np.empty(len(h), kind)
            part["g"] = h
            if names:
                part["v"], part["n"] = v[row], n[row]
            parts.append(part)
        if parts:
            own = np.concatenate(parts)
            bucket = (mix(own["g"]) % U(many)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(many + 1))
            used = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), packed(own[order], at).take(pa.array(used))], ["bucket", "rows"])

    return texts(docs).mapInArrow(lean(run), "bucket int, rows binary").repartition(spread(docs.sparkSession), "bucket")


def read(batches, kind) -> np.ndarray:
    found = [np.frombuffer(flat(b.column("rows"))[0].tobytes(), kind) for b in batches]
    return np.concatenate(found) if found else np.zeros(0, kind)


def common_shingles(docs: DataFrame, own: DataFrame, few: int) -> np.ndarray:
    """Shingles in the prefixes of more than `few` classes, the most common last. More is asked for where they would be over
    COMMON."""
    few = max(few, (own.select(F.sum(F.floor(F.col("n") * (1 - SIMILARITY)) + 2)).first()[0] or 0) // COMMON)

    def run(batches):
        g, n = np.unique(read(batches, MET[:1])["g"], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(g[n > few])), pa.array(n[n > few])], ["g", "n"])

    found = dealt(docs, np.zeros(0, U), False).mapInArrow(lean(run), "g long, n long").toArrow()
    g, n = found.column("g").to_numpy().view(U), found.column("n").to_numpy()
    return g[np.lexsort((g, n))]


def met_at(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(g, v, n): the groups of two and more classes that meet at a shingle; groups with the same members are one."""

    def run(batches):
        own = read(batches, MET)
        own = own[np.lexsort((own["v"], own["g"]))]
        if len(own):
            own = own[np.append(True, (own["g"][1:] != own["g"][:-1]) | (own["v"][1:] != own["v"][:-1]))]
            lead = np.flatnonzero(np.append(True, own["g"][1:] != own["g"][:-1]))
            size = np.diff(np.append(lead, len(own)))
            own, size = own[np.repeat(size > 1, size)], size[size > 1]
        if not len(own):
            return
        key = mix(np.add.reduceat(mix(own["v"].view(U) ^ OTHER), np.cumsum(size) - size) ^ mix(size.astype(U)))
        chosen = np.zeros(len(key), bool)
        chosen[np.unique(key, return_index=True)[1]] = True
        took = np.repeat(chosen, size)
        cols = [signed(np.repeat(key, size)[took]), *(np.ascontiguousarray(own[c][took]) for c in ("v", "n"))]
        yield from pa.Table.from_arrays([pa.array(c) for c in cols], ["g", "v", "n"]).to_batches(max_chunksize=20000)

    return dealt(docs, common, True).mapInArrow(lean(run), "g long, v long, n long").distinct()


def likely(own: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): classes whose SimHashes are within BITS bits, and members with the first of their group."""
    lead = groups.groupBy("g").agg(F.min(F.struct("v", "n")).alias("x"))
    fits = F.least("n", "x.n") >= F.lit(SIMILARITY - 1e-9) * F.greatest("n", "x.n")
    stars = groups.join(lead, "g").where(fits).select(F.col("x.v").alias("a"), F.col("v").alias("b"))
    prints = written(own.groupBy("fp").agg(F.min("v").alias("lead")))
    same = own.join(prints, "fp").select(F.col("lead").alias("a"), F.col("v").alias("b"))
    close = links(prints, BITS).select(F.col("a.lead").alias("a"), F.col("b.lead").alias("b"))
    return stars.union(same).union(close).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard(h: np.ndarray, x: np.ndarray, k: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of the rows of two lists of sets (numbers, offsets); 1 if neither has any."""
    own, other = np.repeat(np.arange(len(x) - 1), np.diff(x)), np.repeat(np.arange(len(y) - 1), np.diff(y))
    row, all_ = np.concatenate((own, other)), np.concatenate((h, k))
    order = np.lexsort((all_, row))
    row, all_ = row[order], all_[order]
    twice = np.flatnonzero((row[1:] == row[:-1]) & (all_[1:] == all_[:-1])) if len(row) else row
    both = np.bincount(row[twice], minlength=len(x) - 1)
    either = np.diff(x) + np.diff(y) - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard similarity of the shingles of texts a[i] and b[i]; 1 if neither has any."""
    return jaccard(*shingles(*flat(a)), *shingles(*flat(b)))


def alike(held: DataFrame, edges: DataFrame) -> DataFrame:
    """Those edges (a, b; written) whose classes are alike, by the texts of held (v, text)."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    own = written(held.join(ends, "v", "left_semi"))
    side = lambda x: own.select(F.col("v").alias(x), F.col("text").alias(f"{x}t"))
    pairs = edges.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "at", "bt")

    def run(batches):
        for batch in batches:
            for b in chunks([batch], "at"):
                for c in chunks([b], "bt"):
                    ok = pa.array(similarity(c.column("at"), c.column("bt")) >= SIMILARITY)
                    yield pa.RecordBatch.from_arrays([c.column("a"), c.column("b")], ["a", "b"]).filter(ok)

    return written(pairs.mapInArrow(lean(run), "a long, b long"))


def parities(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row a power of two of bits, 4 n at least, each the parity of the number of shingles that fall on it."""
    n = np.diff(at)
    size = (1 << np.ceil(np.log2(np.maximum(4 * n, 64))).astype(np.int64)) // 64
    off = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    row = np.repeat(np.arange(len(n)), n)
    place = (mix(h ^ PARITY) & (U(64) * size.astype(U) - U(1))[row]).astype(np.int64) + 64 * off[row]
    bits = (np.bincount(place, minlength=64 * off[-1]) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8"), off


def differing(bits: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in which the parities of rows a[i] and b[i] differ, the longer ones folded to the shorter."""
    size = np.diff(off)
    out = np.zeros(len(a), np.int64)
    small, big = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    kinds = np.stack((size[small], size[big]), 1)
    for x, y in np.unique(kinds, axis=0).tolist():
        here = np.flatnonzero((kinds == (x, y)).all(axis=1))
        step = max(1, PIECE // (8 * y))
        for k in range(0, len(here), step):
            i = here[k : k + step]
            long = bits[off[big[i]][:, None] + np.arange(y)].reshape(len(i), y // x, x)
            out[i] = np.bitwise_count(np.bitwise_xor.reduce(long, axis=1) ^ bits[off[small[i]][:, None] + np.arange(x)]).sum(axis=1, dtype=np.int64)
    return out


MEMBERS = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("v", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("bits", pa.binary())])


def possible(n: np.ndarray, c: np.ndarray, side: np.ndarray, bits: np.ndarray, off: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places a < b of members of different components, and of sides 1 and 2 if there are sides, that may be alike."""
    found = []
    order = np.argsort(n, kind="stable")
    own = n[order]
    last = np.searchsorted(own, own / least + 1e-6, "right")  # larger ones are too large
    many = last - np.arange(len(n)) - 1
    ends = np.cumsum(many)
    lead = 0
    while lead < len(n):
        to = max(lead + 1, int(np.searchsorted(ends, (ends[lead - 1] if lead else 0) + (1 << 18), "right")))
        x = np.repeat(np.arange(lead, to), many[lead:to])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many[lead:to]) - many[lead:to], many[lead:to])
        a, b = order[x], order[y]
        ok = (c[a] != c[b]) & ((side[a] == 0) | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        near = differing(bits, off, a, b) <= (1 - least) / (1 + least) * (n[a] + n[b]) + 1e-6
        found.append((np.minimum(a, b)[near], np.maximum(a, b)[near]))
        lead = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def open_links(held: DataFrame, groups: DataFrame, first: DataFrame, large: int, all_: bool) -> DataFrame:
    """(a, b, more): pairs of groups between different components (first: a, b) that may be alike; of many a forest unless
    `all_`, and more says so."""
    own = groups.join(first.select(F.col("a").alias("v"), F.col("b").alias("c")), "v", "left")
    own = written(own.withColumn("c", F.coalesce("c", "v")))
    mixed = own.groupBy("g").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("size")).where("x <> y").select("g", F.ceil(F.col("size") / large).alias("k"))
    own = own.join(mixed, "g")

    def sketch(batches):
        for b in chunks(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("v"), packed(*parities(*shingles(*flat(b.column("text")))))], ["v", "bits"])

    bits = held.join(own.select("v").distinct(), "v", "left_semi").mapInArrow(lean(sketch), "v long, bits binary")
    block, other = F.pmod(F.xxhash64("v"), F.col("k")), F.col("other")
    own = own.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    side = F.when(F.col("block") == other, 0).when(F.col("block") < other, 1).otherwise(2)
    own = own.select(F.xxhash64("g", F.least("block", other), F.greatest("block", other)).alias("key"), side.cast("int").alias("side"), "v", "n", "c")

    def run(batches):
        t = gathered(batches, MEMBERS)
        if not t.num_rows:
            return
        t = t.take(pa.array(np.lexsort([t.column(x).to_numpy() for x in ("v", "key")]))).combine_chunks()
        key, side, v, n, c = (t.column(x).to_numpy() for x in ("key", "side", "v", "n", "c"))
        bits = pa.concat_arrays(t.column("bits").chunks)
        edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            a, b = possible(n[lo:hi], c[lo:hi], side[lo:hi], *unpacked(bits.slice(lo, hi - lo)))
            more = not all_ and len(a) > MANY * (hi - lo)
            if more:
                root = np.unique(c[lo:hi], return_index=True)[1][np.unique(c[lo:hi], return_inverse=True)[1]]
                took = forest(root, a, b, a)[0]
                a, b = a[took], b[took]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(v[lo + a]), pa.array(v[lo + b]), pa.array(np.full(len(a), more))], ["a", "b", "more"])

    pairs = own.join(bits, "v").select(*MEMBERS.names).repartition(spread(held.sparkSession), "key").mapInArrow(lean(run), "a long, b long, more boolean")
    return pairs.groupBy("a", "b").agg(F.max("more").alias("more"))


def firsts(docs: DataFrame) -> DataFrame:
    """(doc, th): the first text of each group of near copies, that of the smallest doc_id (of its texts, that of the least
    hash)."""
    own = written(classes(docs))
    groups = written(met_at(docs, common_shingles(docs, own, FEW)))
    edges = written(likely(own, groups))
    asked = groups.select("v").union(edges.select(F.explode(F.array("a", "b")))).distinct()
    held = texts(docs).join(own.join(asked, "v", "left_semi").select("v", "doc", "th"), ["doc", "th"])
    held = written(held.dropDuplicates(["v"]).select("v", "text"))
    first = components(alike(held, edges))
    for all_ in (False, True):
        edges = written(open_links(held, groups, first, LARGE, all_))
        count, more = edges.agg(F.count("*"), F.max("more")).first()
        if count:
            first = components(first.unionByName(alike(held, edges)))
        if not more:
            break
    least = own.join(first.withColumnRenamed("a", "v"), "v", "left").groupBy(F.coalesce("b", "v").alias("c"))
    return least.agg(F.min(F.struct("doc", "th")).alias("x")).select("x.doc", "x.th")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the first, and one of its rows if several are alike in id and text."""
    return met(docs, firsts(docs), "left_semi").dropDuplicates(["__doc", "__th"]).select(*docs.columns)
