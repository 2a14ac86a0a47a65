"""Windows, orders, limits and set operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offset(blocks: DataFrame, keys: list[str], order: str, text: str, gap: int = 1) -> DataFrame:
    """WIN-01: where each block starts in its page, blocks being joined by `gap` characters."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("start", F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0).cast("long"))).withColumn("end", F.col("start") + F.length(text))


def occurrence(mentions: DataFrame, keys: list[str] = ("doc_id", "page", "surface"), order: str = "start") -> DataFrame:
    """WIN-02: the how-manieth of its surface on its page a mention is, from 1."""
    return mentions.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def segment_ends(points: DataFrame, length: str) -> DataFrame:
    """WIN-03: each segment ends where the next starts, the last at the text's length."""
    return points.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")), F.col(length)))


def sibling_order(segments: DataFrame, keys: list[str] = ("doc_id", "stream")) -> DataFrame:
    """WIN-04."""
    return segments.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1)


def chapter_tree(headings: DataFrame) -> DataFrame:
    """WIN-05: parent and last page of headings (doc_id, ord, level 1..3, page).

    The parent is the last heading of the level above (or of level 1); a chapter ends before the next heading under the
    same parent, if that is on a later page.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda n: F.last(F.when(F.col("level") == n, F.col("ord")), ignorenulls=True).over(w)
    out = headings.withColumns({"_h1": last(1), "_h2": last(2)})
    parent = F.when(F.col("level") == 2, F.col("_h1")).when(F.col("level") == 3, F.when(F.col("_h2") > F.coalesce("_h1", F.lit(-1)), F.col("_h2")).otherwise(F.col("_h1")))
    out = out.withColumn("parent", parent).drop("_h1", "_h2")
    nxt = F.lead("page").over(Window.partitionBy("doc_id", "parent").orderBy("ord"))
    return out.withColumn("page_end", F.when(nxt - 1 >= F.col("page"), nxt - 1).otherwise(F.when(nxt.isNotNull(), F.col("page"))))


def overlapping(intervals: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """WIN-06: intervals that begin before the one before them has ended."""
    return intervals.withColumn("_hi", F.lag(hi).over(Window.partitionBy(*keys).orderBy(lo, hi))).where(F.col("_hi") > F.col(lo)).drop("_hi")


def merged_points(points: Column, within: int = 5) -> Column:
    """WIN-07: sorted places less those within 5 of the last one kept."""
    empty = F.array().cast("array<int>")
    return F.aggregate(F.array_sort(points.cast("array<int>")), empty, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > within), F.concat(kept, F.array(x))).otherwise(kept))


def merged_seeds(seeds: Column, within: int = 5) -> Column:
    """WIN-07: struct<start, markup, title> points; of near ones the markup's wins, else the first."""
    pick = lambda kept, x: F.when((F.size(kept) == 0) | (x.start - F.get(kept, F.size(kept) - 1).start > within), F.concat(kept, F.array(x))).when(x.markup & ~F.get(kept, F.size(kept) - 1).markup, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))).otherwise(kept)
    return F.aggregate(F.array_sort(seeds), F.filter(seeds, lambda _: F.lit(False)), pick)


def first_writers(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN-08: of rows with equal keys the first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best_chunk(chunks: DataFrame) -> DataFrame:
    """WIN-09: of a page's chunks the most similar, the first of equals."""
    return first_writers(chunks, ["doc_id", "page"], [F.desc("similarity"), "chunk_index"])


def chain_edges(nodes: DataFrame) -> DataFrame:
    """WIN-10, EXT-16: neighbours of a chain; a node that switches begins the next group of transmitters."""
    w = Window.partitionBy("chain_id").orderBy("ord")
    out = nodes.withColumns({"next_node": F.lead("node").over(w), "tahwil_group": F.coalesce(F.sum(F.col("switches").cast("int")).over(w), F.lit(0))})
    return out.where("next_node IS NOT NULL").select("chain_id", "ord", "node", "next_node", "tahwil_group")


def longest_run(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """WIN-11: the longest stretch of neighbouring rows with the flag, by key."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = rows.withColumn("_f", flag).withColumn("_g", F.row_number().over(w) - F.sum(F.col("_f").cast("int")).over(w))
    return own.groupBy(*keys, "_g").agg(F.count_if("_f").alias("n")).groupBy(*keys).agg(F.max("n").alias("longest"))


def text_rows(words: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """WIN-12: rows of words (x, y0, y1) by height of their middles: one belongs to a row whose first middle is within half a median height."""

    def cluster(pdf):
        pdf = pdf.assign(_m=(pdf.y0 + pdf.y1) / 2).sort_values(["_m", "x"])
        near = 0.5 * float(np.median(pdf.y1 - pdf.y0))
        row, first, rows = -1, None, []
        for m in pdf._m:
            if first is None or m - first > near:
                row, first = row + 1, m
            rows.append(row)
        return pdf.drop(columns="_m").assign(row=rows).sort_values(["row", "x"])

    return words.groupBy(*keys).applyInPandas(cluster, schema)


def increasing(values: list) -> list[int]:
    """WIN-13: places of a longest strictly increasing subsequence, by patience sorting."""
    from bisect import bisect_left

    tails, at, before = [], [], []
    for k, v in enumerate(values):
        j = bisect_left(tails, v)
        before.append(at[j - 1] if j else None)
        tails[j : j + 1], at[j : j + 1] = [v], [k]
    out, k = [], at[-1] if at else None
    while k is not None:
        out.append(k)
        k = before[k]
    return out[::-1]


def increasing_rows(rows: DataFrame, keys: list[str], order: str, value: str, schema: str) -> DataFrame:
    """WIN-13: of each group the rows of a longest increasing subsequence of `value`."""
    return rows.groupBy(*keys).applyInPandas(lambda pdf: (s := pdf.sort_values(order)).iloc[increasing(s[value].tolist())], schema)


def recent(messages: DataFrame, keys: list[str], order: str, most: int = 20) -> DataFrame:
    """WIN-14: the last messages of each conversation."""
    return messages.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(f"_n <= {most}").drop("_n")


def rounded(c: Column, digits: int = 4) -> Column:
    """ORD-01: half up on the binary value."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def by_score(rows: DataFrame, score: str = "score", key: str = "doc_id", newest: str | None = None) -> DataFrame:
    """ORD-01: by rounded score, then newest, then id."""
    return rows.orderBy(rounded(F.col(score)).desc(), *([F.desc(newest)] if newest else []), key)


def by_page(rows: DataFrame, score: str = "score") -> DataFrame:
    """ORD-02."""
    return rows.orderBy(F.desc(score), "page")


def suggestions(sources: list[tuple[DataFrame, str]], query: str, most: int = 10) -> DataFrame:
    """ORD-03: matches of several sources, ten of each, repeats out, prefixes first, then shorter, then as they came."""
    parts = []
    for rank, (rows, column) in enumerate(sources):
        hit = rows.select(F.col(column).alias("value")).where(F.contains(F.lower("value"), F.lit(query.lower()))).distinct()
        parts.append(hit.orderBy("value").limit(most).withColumn("rank", F.lit(rank)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = every.groupBy("value").agg(F.min("rank").alias("rank"))
    return once.orderBy(F.lower("value").startswith(query.lower()).desc(), F.length("value"), "rank", "value").limit(most)


def whitelisted_order(rows: DataFrame, wanted: str | None, allowed: list[str], default: str, key: str) -> DataFrame:
    """ORD-04: by '-column' or 'column' if allowed, else by the default."""
    name = (wanted or "").lstrip("-")
    if name not in allowed:
        return rows.orderBy(default, key)
    return rows.orderBy(F.desc(name) if wanted.startswith("-") else F.asc(name), key)


def client_order(rows: DataFrame, how: str, title: str = "title") -> DataFrame:
    """ORD-05: newest, alphabetical (by the Unicode collation), shortest, relevance or page."""
    orders = {
        "newest": [F.desc("uploaded_at"), "doc_id"],
        "alphabetical": [F.collate(F.col(title), "UNICODE_CI"), "doc_id"],
        "shortest": ["page_count", "doc_id"],
        "relevance": [F.desc("score"), "doc_id"],
        "page": ["page", F.desc("score")],
    }
    return rows.orderBy(*orders[how])


def page_of(rows: DataFrame, order: list, page: int, size: int = 20) -> DataFrame:
    """LIM-01."""
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def page_links(total: int, page: int, size: int = 20) -> dict[str, int | None]:
    """LIM-01."""
    last = max(1, -(-total // size))
    return {"count": total, "next": page + 1 if page < last else None, "previous": page - 1 if page > 1 else None}


def page_slice(pages: DataFrame, first: int, count: int, most: int = 10) -> DataFrame:
    """LIM-02."""
    return pages.where(F.col("page").between(first, first + max(1, min(count, most)) - 1))


def top(rows: DataFrame, order: list, most: int, cap: int) -> DataFrame:
    """LIM-03: at least one and at most `cap` rows."""
    return rows.orderBy(*order).limit(max(1, min(most, cap)))


def batches(pages: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """LIM-06: runs of consecutive pages, cut to batches of `most`."""
    w = Window.partitionBy(*keys).orderBy("page")
    runs = pages.withColumn("_run", F.col("page") - F.row_number().over(w))
    cut = runs.withColumn("_cut", F.floor((F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("page")) - 1) / most))
    return cut.groupBy(*keys, "_run", "_cut").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).drop("_run", "_cut")


def quota(opens: DataFrame, docs_a_day: int = 50, pages_a_day: int = 5000) -> DataFrame:
    """LIM-05: distinct documents and pages of each user and day, and whether they are over; opening again is free."""
    once = opens.select("user_id", F.to_date("ts").alias("day"), "doc_id", "page").distinct()
    used = once.groupBy("user_id", "day").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("pages"))
    return used.withColumn("over", (F.col("docs") > docs_a_day) | (F.col("pages") > pages_a_day))


def admitted(opens: DataFrame, docs_a_day: int = 50) -> DataFrame:
    """LIM-05: opens within the quota: each document counts when first opened that day."""
    first = opens.groupBy("user_id", F.to_date("ts").alias("day"), "doc_id").agg(F.min("ts").alias("first_ts"))
    n = first.withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("first_ts", "doc_id")))
    return opens.withColumn("day", F.to_date("ts")).join(n.where(f"nth <= {docs_a_day}").select("user_id", "day", "doc_id"), ["user_id", "day", "doc_id"], "left_semi")


def all_of(hits: DataFrame, key: list[str], term: str, wanted: int) -> DataFrame:
    """SET-01: keys that have every one of `wanted` terms."""
    return hits.groupBy(*key).agg(F.countDistinct(term).alias("_n")).where(f"_n = {wanted}").drop("_n")


def none_of(rows: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """SET-02."""
    return rows.join(hits, key, "left_anti")


def ordered_union(parts: list[DataFrame], key: str) -> DataFrame:
    """SET-04: values of the parts, each (key, pos), in order of part and place, each once."""
    every = None
    for k, p in enumerate(parts):
        p = p.select(key, F.struct(F.lit(k).alias("part"), F.col("pos").alias("pos")).alias("at"))
        every = p if every is None else every.unionByName(p)
    return every.groupBy(key).agg(F.min("at").alias("at")).orderBy("at")


def merged_terms(a, b) -> Column:
    """SET-05."""
    return F.array_sort(F.array_union(a, b))


def values_of(rows: DataFrame, column: str) -> DataFrame:
    """SET-06."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct()
