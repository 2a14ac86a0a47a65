"""Sharding by a k-d tree, in DataFrame functions alone.

Each document is a point of its metadata (id, size, source, language), every dimension scaled to 30 bits of its range; a
hash of id and text makes up the low half of a coordinate, so that points which are alike in a dimension (one source may
hold a third of all rows) still split evenly. A node is split along its widest dimension at the median of bytes, which
is found by histograms: ``BINS`` ranges of coordinates are summed for all nodes of a level at once, the range that holds
the median is cut again, until it holds one document or less than ``NEAR`` of a leaf. Splitting goes on until leaves
reach the target. The executors pick the range from the histogram; the driver gets a row for each node of a level, and
the nodes, which are at most twice as many as shards, come back as a table that is joined.

Slots are numbered within a shard over pieces of it dealt by hash: sizes of the pieces are summed first, so no task sorts
a whole shard. Null texts have size 1 and crc32 0; null ids lie at the low end of the ids' range and take no part in it;
null sources and languages are points like any other. Equal texts are points of their own and may go to different
shards, as a group of copies can be larger than a shard. Rows alike in all columns get slots of their own. Columns other
than doc_id, text, source and lang are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_id, doc_key, spread, table, written

BINS, NEAR = 4096, 0.0005
DIMENSIONS = ("id", "size", "source", "lang")
UNIT = (1 << 30) - 1
#: One more than the largest coordinate: differences of coordinates fit a long.
END = (UNIT + 1) << 32


def points(docs: DataFrame) -> DataFrame:
    """(doc, size, text_crc32, salt, node, c0..c3): what the tree is made of, without texts; all start at the root, node 1."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(
        doc_key().alias("doc"),
        F.col("doc_id").cast("double").alias("x0"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.lit("source"), F.col("source").cast("string")), F.lit(UNIT)).alias("source"),
        F.pmod(F.xxhash64(F.lit("lang"), F.col("lang").cast("string")), F.lit(UNIT)).alias("lang"),
    )
    own = written(own.withColumns({"x1": F.log(F.col("size").cast("double")), "salt": F.pmod(F.xxhash64("doc", "text_crc32"), F.lit(1 << 32))}))
    # Both bounds come from the very column that is scaled: another logarithm may differ in its last bit.
    r = own.agg(*[f(c).alias(f"{n}_{c}") for c in ("x0", "x1") for n, f in (("low", F.min), ("high", F.max))]).first()

    def scaled(c: str) -> Column:
        low, high = r[f"low_{c}"], r[f"high_{c}"]
        if low is None or high <= low:
            return F.lit(0).cast("long")
        part = F.floor((F.col(c) - F.lit(low)) / F.lit(high - low) * UNIT).cast("long")
        return F.coalesce(F.greatest(F.lit(0), F.least(part, F.lit(UNIT))), F.lit(0)).cast("long")

    dims = [scaled("x0"), scaled("x1"), F.col("source"), F.col("lang")]
    return own.select("doc", "size", "text_crc32", "salt", F.lit(1).cast("long").alias("node"), *[(x * F.lit(1 << 32) + F.col("salt")).alias(f"c{i}") for i, x in enumerate(dims)])


def as_table(like: DataFrame, rows: list[tuple], ddl: str) -> DataFrame:
    """rows of the driver, one for each node: a broadcast side whose size is that of the tree, not of the data."""
    names = [c.split()[0] for c in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return F.broadcast(like.sparkSession.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{ddl.replace(' ', ':')}>>".replace(",:", ", ")))))


def medians(level: DataFrame, nodes: dict[int, float], leaf: float) -> dict[int, int]:
    """Split coordinate of each node of (node, c, size): nodes gives the bytes wanted below it."""
    span = {k: (0, END) for k in nodes}
    below = {k: 0 for k in nodes}
    done: dict[int, int] = {}
    so_far = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while len(done) < len(nodes):
        live = [k for k in nodes if k not in done]
        step = {k: max(1, -(-(span[k][1] - span[k][0]) // BINS)) for k in live}
        asked = as_table(level, [(k, *span[k], step[k], float(nodes[k] - below[k])) for k in live], "node long, lo long, hi long, step long, want double")
        bins = level.join(asked, "node").where("c >= lo AND c < hi").groupBy("node", "want", F.expr("(c - lo) DIV step").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        bins = bins.withColumn("before", F.coalesce(F.sum("bytes").over(so_far), F.lit(0)))
        # The bin that reaches what is wanted, or else the last.
        reach = F.when(F.col("before") + F.col("bytes") >= F.col("want"), F.struct("bin", "before", "bytes", "n"))
        found = bins.groupBy("node").agg(F.coalesce(F.min(reach), F.max(F.struct("bin", "before", "bytes", "n"))).alias("at")).collect()  # a row for each node
        at = {r.node: r["at"] for r in found}
        for k in live:
            if k not in at:
                done[k] = span[k][0]
                continue
            low, before, size, want = span[k][0] + at[k].bin * step[k], at[k].before, at[k].bytes, nodes[k] - below[k]
            if step[k] == 1 or at[k].n == 1 or size <= NEAR * leaf:
                done[k] = low + step[k] if abs(before + size - want) < abs(before - want) else low
            else:
                span[k], below[k] = (low, min(low + step[k], span[k][1])), below[k] + before
    return done


def tree(pts: DataFrame, leaves: int) -> DataFrame:
    """pts with shard, the leaf of each row; leaves are numbered from left to right."""
    places = [f"c{i}" for i in range(len(DIMENSIONS))]
    placed = pts
    share = {1: (0, leaves)}  # node: its first leaf and how many it has
    total = pts.agg(F.sum("size")).first()[0] or 0
    along = lambda: F.array(*places)[F.col("dim")]
    while any(n > 1 for _, n in share.values()):
        inner = {k: v for k, v in share.items() if v[1] > 1}
        level = placed.join(as_table(pts, [(k,) for k in inner], "node long"), "node")
        widths = [(F.max(c) - F.min(c)).alias(f"w{i}") for i, c in enumerate(places)]
        wide = {r.node: r for r in level.groupBy("node").agg(F.sum("size").alias("bytes"), *widths).collect()}  # a row for each node
        dim = {k: max(range(len(DIMENSIONS)), key=lambda i: (wide[k][f"w{i}"], -i)) if k in wide else 0 for k in inner}
        wanted = {k: wide[k].bytes * (n // 2) / n if k in wide else 0 for k, (_, n) in inner.items()}
        dims = as_table(pts, list(dim.items()), "node long, dim int")
        splits = medians(placed.join(dims, "node").select("node", along().alias("c"), "size"), wanted, total / leaves)
        cuts = as_table(pts, [(k, dim[k], splits[k]) for k in inner], "node long, dim int, split long")
        child = F.when(F.col("split").isNull(), F.col("node")).otherwise(2 * F.col("node") + (along() >= F.col("split")).cast("long"))
        placed = written(placed.join(cuts, "node", "left").withColumn("node", child).select(*pts.columns))
        for k, (first, n) in inner.items():
            del share[k]
            share |= {2 * k: (first, n // 2), 2 * k + 1: (first + n // 2, n - n // 2)}
    return placed.join(as_table(pts, [(k, first) for k, (first, _) in share.items()], "node long, shard int"), "node").drop("node")


def slots(placed: DataFrame) -> DataFrame:
    """placed with slot, gapless from 0 in each shard."""
    pieces = max(64, spread(placed.sparkSession))
    placed = written(placed.withColumn("piece", F.pmod("salt", F.lit(pieces)).cast("int")))
    sizes = placed.groupBy("shard", "piece").count()
    first = sizes.withColumn("first", F.sum("count").over(Window.partitionBy("shard").orderBy("piece")) - F.col("count")).drop("count")
    own = Window.partitionBy("shard", "piece").orderBy("doc", "text_crc32", "size")
    numbered = placed.withColumn("n", F.row_number().over(own).cast("long") - 1)
    return numbered.join(F.broadcast(first), ["shard", "piece"]).withColumn("slot", F.col("n") + F.col("first"))  # a row for each piece


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot); shards, or as many as bring each to target_bytes."""
    pts = written(points(docs))
    if shards is None:
        total = pts.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    placed = tree(pts, shards).select("doc", "size", "text_crc32", "salt", "shard")
    return slots(placed).select(as_id(), "size", "text_crc32", "shard", "slot")


def op10_kd_shards(spark, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
