"""Joins: bridges, rank-keeping hydration, intervals, as-of lookups, tolerances, overlaps and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def bridged(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """JON-01."""
    return left.join(bridge, left_key).join(right, right_key)


def union_scores(lexical: DataFrame, semantic: DataFrame, key: str = "doc_id") -> DataFrame:
    """JON-04, SET-03: all ids of both sides, 0 where a side has none."""
    both = lexical.join(semantic, key, "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lexical_score", "semantic_score")})


def hydrated(ids: DataFrame, column: str, rows: DataFrame, key: str) -> DataFrame:
    """JON-05: rows of an array of ids, in its order."""
    return ids.select(F.posexplode(column).alias("rank", key)).join(rows, key).orderBy("rank")


#: Coordinates of a bin: a range is looked up in the bins it covers, so that a join has an equal key.
BIN = 64


def intervals(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, lo: str, hi: str, order: list[str], how: str = "left", width: int = BIN) -> DataFrame:
    """JON-08, JON-10: for each point the first range (by `order`) of its keys that holds it, lo <= at <= hi.

    Ranges are dealt to the bins that they cover and points to theirs, so that no task meets all pairs of a key.
    """
    dealt = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    tagged = points.withColumn("_point", F.monotonically_increasing_id()).withColumn("_bin", F.floor(F.col(at) / width))
    hit = tagged.join(dealt, [*keys, "_bin"]).where(F.col(at).between(F.col(lo), F.col(hi)))
    best = hit.withColumn("_n", F.row_number().over(Window.partitionBy("_point").orderBy(*order))).where("_n = 1")
    extra = [c for c in ranges.columns if c not in keys]
    if how == "inner":
        return best.select(*points.columns, *extra)
    return tagged.join(best.select("_point", *extra), "_point", "left").select(*points.columns, *extra)


def page_at(offsets: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """JON-09: the page whose start is the last at or before each offset; the first page before that.

    Both sides go through one window by document and place, so that neither is joined with all of the other.
    """
    p = pages.select(key, F.col("start").alias("_at"), F.lit(0).alias("_side"), F.col("page").alias("_page"), F.lit(None).cast("long").alias("_id"))
    o = offsets.withColumn("_id", F.monotonically_increasing_id())
    q = o.select(key, F.col("offset").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(pages.schema["page"].dataType).alias("_page"), "_id")
    w = Window.partitionBy(key).orderBy("_at", "_side", "_page")
    every = Window.partitionBy(key).orderBy("_at", "_side", "_page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = p.unionByName(q).withColumn("page", F.coalesce(F.last("_page", ignorenulls=True).over(w), F.first("_page", ignorenulls=True).over(every)))
    return o.join(both.where("_side = 1").select("_id", "page"), "_id").drop("_id")


def segment_at(offsets: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """JON-10: the segment [start, end) that holds each offset, null in gaps."""
    s = segments.select(key, F.col("start").alias("_lo"), (F.col("end") - 1).alias("_hi"), "seg_id")
    return intervals(offsets, s, [key], "offset", "_lo", "_hi", ["_lo", "seg_id"], width=4096).drop("_lo", "_hi")


def adopted(verses: DataFrame, citations: DataFrame, reach: int = 60) -> DataFrame:
    """JON-11: each verse span with the key of the first citation that starts after its start and within reach of its end."""
    v = verses.select("page_id", F.col("start").alias("v_start"), F.col("end").alias("v_end"))
    c = citations.select("page_id", F.col("start").alias("c_start"), "key")
    near = v.join(c, "page_id", "left").withColumn("ok", (F.col("c_start") > F.col("v_start")) & (F.col("c_start") <= F.col("v_end") + reach))
    return near.groupBy("page_id", "v_start", "v_end").agg(F.min_by("key", F.when(F.col("ok"), F.col("c_start"))).alias("key"))


def tolerant_year(mentions: DataFrame, persons: DataFrame, within: int = 5) -> DataFrame:
    """JON-13, EXT-08: the one candidate of the blocking key whose death year is near; none if there are several."""
    m = mentions.select("mention_id", "blocking_key", "death_year")
    hit = m.join(persons.select("person_id", "blocking_key", F.col("death_year_hijri").alias("_y")), "blocking_key").where(F.abs(F.col("death_year") - F.col("_y")) <= within)
    one = hit.groupBy("mention_id").agg(F.count_distinct("person_id").alias("n"), F.min("person_id").alias("person_id")).where("n = 1")
    return mentions.join(one.select("mention_id", "person_id"), "mention_id", "left")


def near_places(left: DataFrame, right: DataFrame, within: float = 1.5) -> DataFrame:
    """JON-14: for each place the first (by id) other within `within` degrees both ways, through a grid of that size."""
    cell = lambda c: F.floor(F.col(c).cast("double") / within)
    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    l = left.withColumn("_x", cell("lat")).withColumn("_y", cell("lon"))
    r = right.select(F.col("ext_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.explode(F.transform(around, lambda d: cell("lat") + d)).alias("_x"), cell("lon").alias("_cy"))
    r = r.select("ext_id", "_lat", "_lon", "_x", F.explode(F.transform(around, lambda d: F.col("_cy") + d)).alias("_y"))
    hit = l.join(r, ["_x", "_y"]).where((F.abs(F.col("lat") - F.col("_lat")) <= within) & (F.abs(F.col("lon") - F.col("_lon")) <= within))
    return left.join(hit.groupBy("place_id").agg(F.min("ext_id").alias("ext_id")), "place_id", "left")


def shared_neighbours(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """JON-15: for each mention the candidate that shares most neighbours with it, if it strictly leads.

    edges(src, dst) both ways; candidates(mention_id, src, candidate).
    """
    mine = candidates.select("mention_id", "candidate", "src").join(edges.distinct(), "src").select("mention_id", "candidate", "dst")
    theirs = edges.select(F.col("src").alias("candidate"), "dst").distinct()
    return _leaders(mine.join(theirs, ["candidate", "dst"]).groupBy("mention_id", "candidate").count())


def shared_with_all(edges: DataFrame, mentions: Column) -> DataFrame:
    """JON-15 where every other src is a candidate of the srcs that are mentions.

    Ends meet once, at the neighbour that they share: no pair of a mention and a candidate is met with all its neighbours.
    """
    at = edges.select("src", "dst").repartition("dst").distinct()  # the join and both its sides keep this dealing
    pairs = at.where(mentions).withColumnRenamed("src", "mention_id").join(at.withColumnRenamed("src", "candidate"), "dst").where("candidate <> mention_id")
    return _leaders(pairs.groupBy("mention_id", "candidate").count())


def _leaders(counts: DataFrame) -> DataFrame:
    """Of each mention the candidate of the highest count, if no other has it."""
    tied = counts.groupBy("mention_id", "count").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate"))
    best = tied.groupBy("mention_id").agg(F.max(F.struct("count", "n", "candidate")).alias("x"))
    return best.where("x.n = 1").select("mention_id", "x.candidate", "x.count")


def tree(spark, nodes: DataFrame, root: Column, node: str = "chapter_id", parent: str = "parent_id") -> DataFrame:
    """JON-16: nodes below the roots with their depth and path, level by level, down to the level without rows.

    Each level is written, so the next one starts from it; a node on its own path is left out, so cycles end.
    """
    now = written(nodes.where(root).select(node, F.lit(0).alias("depth"), F.array(node).alias("path")))
    out = now
    while now.limit(1).count():
        below = nodes.join(now.select(F.col(node).alias(parent), "depth", "path"), parent).where(~F.array_contains("path", F.col(node)))
        now = written(below.select(node, (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(node)).alias("path")))
        out = out.unionByName(now)
    return out


def reanchored(relations: DataFrame, old: DataFrame, new: DataFrame, end: str) -> DataFrame:
    """JON-17: an endpoint of an old run as the mention of the new run with equal label and span, null where there is none."""
    span = ["doc_id", "label", "start", "end"]
    way = old.select(F.col("mention_id").alias(end), *span).join(new.select(F.col("mention_id").alias("_new"), *span), span).select(end, "_new")
    return relations.join(way, end, "left").withColumn(end, F.col("_new")).drop("_new")


def holding(rows: DataFrame, passages: DataFrame, text: str, passage: str, most: int = 13) -> DataFrame:
    """Rows whose text holds a passage, both with single spaces, met by runs of words that stand inside every passage.

    A passage's first and last word may be parts of longer words in a text, its inner ones are whole: the first run of
    them is its key, as long as the shortest passage allows, and texts give all their runs of that length. Passages
    without inner words meet all texts.
    """
    p = passages.withColumn("_w", F.split(passage, " ")).withColumn("_n", F.size("_w") - 2)
    run = min(most, p.where("_n > 0").agg(F.min("_n")).first()[0] or 0)
    inner = p.where("_n > 0").withColumn("_key", F.xxhash64(F.array_join(F.slice("_w", 2, max(run, 1)), " "))).drop("_w", "_n")
    out = None
    if run:
        words = F.split(text, " ")
        runs = F.when(F.size(words) >= run, F.transform(F.sequence(F.lit(0), F.size(words) - run), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, run), " "))))
        met = rows.withColumn("_key", F.explode(F.array_distinct(runs))).join(inner, "_key").drop("_key")
        out = met.where(F.contains(text, passage))
    short = p.where("_n <= 0").drop("_w", "_n")
    if short.limit(1).count():
        few = rows.join(short, F.contains(text, passage))
        out = few if out is None else out.unionByName(few)
    return out if out is not None else rows.join(short, F.contains(text, passage))


def containing(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """JON-18: pairs under equal keys (such as a page) of which one text holds the other."""
    return left.join(right, keys).where(F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a)))


def free_of(spans: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """JON-12: spans in order of priority; one that overlaps a span taken before is dropped. Order decides, so a group is one task."""

    def greedy(pdf):
        taken, keep = [], []
        for row in pdf.sort_values(["priority", "start", "end"]).itertuples():
            free = not any(s < row.end and row.start < e for s, e in taken)
            keep.append(row.Index) if free else None
            if free:
                taken.append((row.start, row.end))
        return pdf.loc[keep]

    return spans.groupBy(*keys).applyInPandas(greedy, schema)
