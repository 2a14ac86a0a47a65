"""SimHash near-duplicates: fingerprints, a distributed binary-trie self-join, and components.

Fingerprints that differ in at most ``bits`` of 64 agree in one of ``bits + 1`` blocks, so each goes to one group per
block. A block's group that is still large is cut again: its fingerprints differ in at most ``bits`` of the remaining
places, which are split the same way. Within a group a binary trie over the sorted fingerprints is joined with itself:
pairs of nodes are followed downwards together, differing branches add to the pair's distance, and a pair whose distance
passes the budget is dropped with all below it, as is one whose places are joined by then. What leaves the task is a
spanning forest of the pairs: no component is lost, and links are never as many as the pairs. Components over all groups
come from alternating large-star and small-star steps.

Equal fingerprints (exact copies and texts alike in all shingles) are one vertex, so a large group of copies costs one.
Null and empty texts have fingerprint zero and are linked like any other. A row without doc_id has a null component
unless linked, in which case null comes before all other ids. Repeated rows each get their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_id, chunks, doc_key, gathered, lean, signed, spread, table, written

# A-Z to a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = 32
#: Fingerprints that are met in parts, at most; pairs of trie nodes that are looked at together.
PARTED, PIECE = 2000, 1 << 14


def _hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each text's shingles, and how many there are of each."""
    found: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        parts = text.translate(LOWER).split()
        if not parts:
            continue
        plain = b" ".join(parts)
        if len(parts) <= width:
            found.append(digest(plain, 42))
            counts[k] = 1
            continue
        gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == SPACE)
        starts = [0, *(gaps[: len(parts) - width] + 1).tolist()]
        ends = [*gaps[width - 1 :].tolist(), len(plain)]
        found += [digest(plain[a:b], 42) for a, b in zip(starts, ends, strict=True)]
        counts[k] = len(starts)
    return np.array(found, np.uint64), counts


def _majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.uint64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lead = (np.cumsum(counts) - counts)[own]
    ones = np.add.reduceat(bits, lead, axis=0, dtype=np.int32)
    out[own] = np.packbits(2 * ones > counts[own][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, **more: Column) -> DataFrame:
    """(doc, fp): doc key and 64-bit fingerprint of each row; and more columns, of type long."""
    names = ["doc", *more]

    def run(batches):
        for b in chunks(batches):
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(signed(_majority(*_hashes(texts, width))))], [*names, "fp"])

    own = docs.select(doc_key().alias("doc"), *(c.alias(k) for k, c in more.items()), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(run), ", ".join(f"{c} long" for c in [*names, "fp"]))


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each place's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs at distances the places that join components, nearest first, and the components' least members then."""
    chosen = []
    place = np.arange(len(root))
    while True:
        open_ = np.flatnonzero(root[a] != root[b])
        if not len(open_):
            return (np.concatenate(chosen) if chosen else open_), root
        # Each component takes its nearest pair; as ties go by place, these pairs close no circle.
        component, pair = np.concatenate((root[a[open_]], root[b[open_]])), np.concatenate((open_, open_))
        order = np.lexsort((pair, far[pair], component))
        first = np.append(True, component[order][1:] != component[order][:-1])
        took = np.unique(pair[order][first])
        chosen.append(took)
        root = stars(len(root), np.concatenate((place, a[took])), np.concatenate((root, b[took])))


def trie_join(prints: np.ndarray, group: np.ndarray, budget: int, few: int = 0, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of prints (rows of lanes, sorted by group, then lane by lane) of one group that differ in at most
    `budget` bits: all of them in groups of up to `few`, in larger ones enough to join all that such pairs join.

    A pair of trie nodes is a pair of ranges with their distance so far. Pairs go down in pieces, the first piece first, so
    that ranges joined by then need no more steps.
    """
    root = np.arange(len(prints))
    edge = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(prints))
    several = np.diff(edge) > 1
    every = np.repeat(np.diff(edge) <= few, np.diff(edge))
    lo, hi = edge[:-1][several].astype(np.int32), edge[1:][several].astype(np.int32)
    # Two ranges of places, their distance so far, and the bit at which they part next.
    todo = [(lo, hi, lo, hi, np.zeros(len(lo), np.int16), 0)]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def join(a, b, far):
        nonlocal root
        took, root = forest(root, a, b, far)
        found.append((a[took], b[took]))

    while todo:
        alo, ahi, blo, bhi, far, bit = todo.pop()
        if len(alo) > piece:
            half = len(alo) // 2
            todo += [(*(x[cut] for x in (alo, ahi, blo, bhi, far)), bit) for cut in (slice(half, None), slice(half))]
            continue
        # Ranges within one component have no more to tell.
        change = np.concatenate((np.zeros(1, np.int32), np.cumsum(root[1:] != root[:-1], dtype=np.int32)))
        open_ = every[alo] | (root[alo] != root[blo]) | (change[ahi - 1] != change[alo]) | (change[bhi - 1] != change[blo])
        alo, ahi, blo, bhi, far = (x[open_] for x in (alo, ahi, blo, bhi, far))
        # Two leaves need no more steps: their distance is counted at once.
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[leaf], blo[leaf]
        bits = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)
        found.append((a[every[a] & (bits <= budget)], b[every[a] & (bits <= budget)]))
        near = ~every[a] & (bits <= budget)
        if near.any():
            join(a[near], b[near], bits[near])
        alo, ahi, blo, bhi, far = (x[~leaf] for x in (alo, ahi, blo, bhi, far))
        if not len(alo):
            continue
        if bit == 64 * prints.shape[1]:  # ranges of equal prints: all of a group of few, or enough to join them
            for x0, x1, y0, y1, f in zip(*(x.tolist() for x in (alo, ahi, blo, bhi, far)), strict=True):
                x, y = np.arange(x0, x1), np.arange(y0, y1)
                if not every[x0]:
                    x, y = (np.append(x[:-1], x0), np.append(x[1:], y0)) if x0 != y0 else (x[:-1], x[1:])
                    join(x, y, np.full(len(x), f))
                else:
                    x, y = np.repeat(x, len(y)), np.tile(y, len(x))
                    found.append((x[(x0 != y0) | (x < y)], y[(x0 != y0) | (x < y)]))
            continue
        # A range is sorted, so its places with the bit set are its last.
        lane = prints[:, bit // 64] >> np.uint64(63 - bit % 64)
        count = np.concatenate((np.zeros(1, np.int32), np.cumsum(lane & np.uint64(1), dtype=np.int32)))
        am, bm = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        itself = alo == blo
        kept = []
        for x0, x1, y0, y1, f, only in ((alo, am, blo, bm, far, None), (am, ahi, bm, bhi, far, None), (alo, am, bm, bhi, far + 1, None), (am, ahi, blo, bm, far + 1, ~itself)):
            ok = (x1 > x0) & (y1 > y0) & (f <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
            if only is not None:
                ok &= only
            kept.append((x0[ok], x1[ok], y0[ok], y1[ok], f[ok]))
        todo.append((*(np.concatenate(c) for c in zip(*kept, strict=True)), bit + 1))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (lo[:0], lo[:0])


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """Shift and size of `parts` blocks over the low `width` bits."""
    cuts = [width * k // parts for k in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _bits(shift: int, size: int):
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << size) - 1))


def links(vertices: DataFrame, bits: int, large: int = 1024) -> DataFrame:
    """(a, b): for each component of each group, a spanning forest of its members (fp, lead)."""
    blocks = _blocks(64, bits + 1)
    grouped = vertices.select("fp", "lead", F.explode(F.array(*[F.struct(F.lit(k).alias("no"), _bits(*x).alias("value")) for k, x in enumerate(blocks)])).alias("k")).select("fp", "lead", "k.*")
    crowded = grouped.groupBy("no", "value").count().where(f"count > {large}").select("no", "value", F.lit(True).alias("crowded"))
    grouped = grouped.join(crowded, ["no", "value"], "left")

    def again(no: int):
        """Keys of the second cut in block `no`: the places outside it in bits + 1 blocks."""
        out = []
        for other, (shift, size) in enumerate(blocks):
            if other != no:
                out += [(other, shift + s, z) for s, z in _blocks(size, bits + 1)]
        # Blocks of the second cut take one piece of every other block each.
        return [F.struct(F.lit(j + 1).alias("sub"), F.xxhash64(*[_bits(s, z) for k, (_, s, z) in enumerate(out) if k % (bits + 1) == j]).alias("piece")) for j in range(bits + 1)]

    second = F.lit(None)
    for no in range(len(blocks)):
        second = F.when(F.col("no") == no, F.array(*again(no))).otherwise(second)
    whole = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("piece")))
    keyed = grouped.withColumn("s", F.explode(F.when(F.col("crowded"), second).otherwise(whole)))
    keyed = keyed.select("fp", "lead", F.xxhash64("no", "value", "s.sub", "s.piece").alias("g"))

    def run(batches):
        t = gathered(batches, pa.schema([("fp", pa.int64()), ("lead", pa.int64()), ("g", pa.int64())]))
        fp, lead, g = (t.column(c).to_numpy() for c in ("fp", "lead", "g"))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, g))
        fp, lead, g = fp[order], lead[order], g[order]
        if not len(g):
            return
        a, b = trie_join(fp[:, None], g, bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lead[a], signed(fp[a]), lead[b], signed(fp[b]))], ["al", "af", "bl", "bf"])

    found = keyed.repartition(spread(vertices.sparkSession), "g").mapInArrow(lean(run), "al long, af long, bl long, bf long")
    return found.select(F.struct(F.col("al").alias("lead"), F.col("af").alias("fp")).alias("a"), F.struct(F.col("bl").alias("lead"), F.col("bf").alias("fp")).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each vertex that has an edge, but the least of its component, with that least one."""
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = written(edges.where("a <> b").select(high, low).distinct())
    mark = None
    while True:
        # Large star: every larger neighbour is linked to the least neighbour.
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: every smaller neighbour, and the vertex, is linked to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("x"), "m").where("x <> m")
        edges = written(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges
        mark = now


def simhash_near_dups(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    prints = written(fingerprints(docs, width))
    vertices = written(prints.groupBy("fp").agg(F.min("doc").alias("lead"), F.count("*").alias("n")))
    found = components(links(vertices, bits)).select("a.fp", F.col("b.lead").alias("component"))
    belongs = vertices.join(found, "fp", "left").select("fp", "n", F.coalesce("component", "lead").alias("component"))
    # A fingerprint that very many rows have is met in several parts. There are at most PARTED such fingerprints.
    most = max(1000, prints.count() // PARTED)
    parted = F.broadcast(vertices.where(F.col("n") > most).select("fp", F.ceil(F.col("n") / most).cast("int").alias("k")))
    rows = prints.join(parted, "fp", "left").select("doc", "fp", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("k")), F.lit(0)).cast("int").alias("part"))
    copies = belongs.select("fp", "component", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, F.ceil(F.col("n") / most) - 1).otherwise(0).cast("int"))).alias("part"))
    return rows.join(copies, ["fp", "part"]).select(as_id(), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), as_id("component").alias("component_id"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_near_dups(table(spark, sf_dir, "documents"))
