"""Counts, facets, engagement, quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The weights of engagement.
WEIGHTS = {"open": 1.0, "time": 2.0, "pages": 0.02, "in_doc_search": 0.5, "assistant": 1.5, "bookmark": 3.0, "note": 3.0, "highlight": 2.0, "complete": 5.0}


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """AGG-01, AGG-25: rows of each value but null and blank, most first."""
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def distinct_docs(bridge: DataFrame, dimension: DataFrame, on: str, key: str, doc: str = "doc_id") -> DataFrame:
    """AGG-02, AGG-13: distinct documents of each value of a dimension, by value."""
    return bridge.join(dimension.where(F.col(key).isNotNull()), on).groupBy(key).agg(F.countDistinct(doc).alias("n")).orderBy(key)


def labelled_counts(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """AGG-03: counts with the label of each value."""
    return counts_by(rows, key).join(labels, key, "left").withColumn("label", F.coalesce("label", F.col(key).cast("string")))


def country_counts(bridge: DataFrame, authors: DataFrame, exact: bool = True) -> DataFrame:
    """AGG-04: distinct documents of each nationality; as written (full rebuild), or in any case (refresh of a key)."""
    key = F.col("nationality") if exact else F.lower("nationality")
    own = authors.where(F.coalesce("nationality", F.lit("")) != "").select("author_id", key.alias("country"))
    return bridge.join(own, "author_id").groupBy("country").agg(F.countDistinct("doc_id").alias("documents"))


def refreshed(counts: DataFrame, bridge: DataFrame, authors: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-05: counts with the changed keys (old and new) computed again; a key without documents goes."""
    fresh = country_counts(bridge, authors.where(F.lower("nationality").isin([k.lower() for k in keys])), exact=False)
    names = counts.sparkSession.createDataFrame([(k, k.lower()) for k in keys], "country string, low string")
    fresh = names.join(fresh.withColumnRenamed("country", "low"), "low").select("country", "documents")
    return counts.where(~F.col("country").isin(keys)).unionByName(fresh)


def score(minutes_ms: str = "total_read_ms") -> Column:
    """AGG-07."""
    w = WEIGHTS
    return (
        w["open"] * F.col("open_count")
        + w["time"] * F.log1p(F.greatest(F.col(minutes_ms), F.lit(0)) / 60000.0)
        + w["pages"] * F.col("pages_read")
        + w["in_doc_search"] * F.col("in_doc_search_count")
        + w["assistant"] * F.col("assistant_query_count")
        + w["bookmark"] * F.col("bookmark_count")
        + w["note"] * F.col("note_count")
        + w["highlight"] * F.col("highlight_count")
        + w["complete"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("percent_complete")))
    )


def floored(deltas: Column) -> Column:
    """AGG-06: a counter over deltas in order that never falls below 0."""
    return F.aggregate(deltas, F.lit(0).cast("long"), lambda a, x: F.greatest(F.lit(0).cast("long"), a + x))


def affinity(events: DataFrame) -> DataFrame:
    """AGG-06, AGG-07, STM-04: the fold of events (user_id, doc_id, event_type, ts, event_id, read_ms, pages_read, percent).

    Counters and durations are sums and maxima with partial aggregation. Only the bookmark counter needs order: it is
    max(0, ...) at each step, so s(n) = sum(n) - min(0, least sum so far), which two windows give without collecting.
    """
    own = events.where(F.col("doc_id").isNotNull())
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    marks = own.where(F.col("event_type").isin("bookmark_add", "bookmark_remove")).withColumn("_d", F.when(F.col("event_type") == "bookmark_add", 1).otherwise(-1).cast("long"))
    run = Window.partitionBy("user_id", "doc_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("_s", F.sum("_d").over(run)).groupBy("user_id", "doc_id").agg((F.sum("_d") - F.least(F.lit(0).cast("long"), F.min("_s"))).alias("bookmark_count"))
    folded = own.groupBy("user_id", "doc_id").agg(
        is_("document_open").alias("open_count"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "reading_session", F.greatest(F.coalesce("read_ms", F.lit(0)), F.lit(0)))), F.lit(0)).cast("long").alias("total_read_ms"),
        F.coalesce(F.max(F.when(F.col("event_type") == "reading_session", F.col("pages_read"))), F.lit(0)).alias("pages_read"),
        is_("in_doc_search").alias("in_doc_search_count"),
        is_("assistant_query").alias("assistant_query_count"),
        is_("note_add").alias("note_count"),
        is_("highlight_add").alias("highlight_count"),
        F.coalesce(F.max(F.when(F.col("event_type") == "reading_session", F.col("percent"))), F.lit(0.0)).alias("percent_complete"),
        F.min("ts").alias("first_engaged_at"),
        F.max("ts").alias("last_engaged_at"),
    )
    whole = folded.join(marks, ["user_id", "doc_id"], "left").withColumn("bookmark_count", F.coalesce("bookmark_count", F.lit(0).cast("long")))
    return whole.withColumn("engagement_score", score())


def rebuilt(sources: list[DataFrame]) -> DataFrame:
    """AGG-08: affinity rows of several durable sources merged: counters summed, extents and progress by max."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    sums = ["open_count", "total_read_ms", "in_doc_search_count", "assistant_query_count", "bookmark_count", "note_count", "highlight_count"]
    have = set(every.columns)
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) if c in have else F.lit(0).alias(c) for c in sums]
    aggs += [F.coalesce(F.max(c), F.lit(0)).alias(c) if c in have else F.lit(0).alias(c) for c in ("pages_read", "percent_complete")]
    return every.groupBy("user_id", "doc_id").agg(*aggs, F.min("ts").alias("first_engaged_at"), F.max("ts").alias("last_engaged_at")).withColumn("engagement_score", score())


def popular(affinities: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """AGG-09: the documents of highest total score that are not among the seen."""
    return affinities.join(seen.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.sum("engagement_score").alias("popularity")).orderBy(F.desc("popularity"), "doc_id").limit(most)


def facet_weights(affinities: DataFrame, bridge: DataFrame, key: str) -> DataFrame:
    """AGG-11: for each user and author (or category) the sum of score + 1 over the documents."""
    w = affinities.select("user_id", "doc_id", (F.greatest("engagement_score", F.lit(0.0)) + 1).alias("w"))
    return w.join(bridge, "doc_id").groupBy("user_id", key).agg(F.sum("w").alias("weight"))


def rollup(mentions: DataFrame, ayas: int = 21, cap: int = 200) -> DataFrame:
    """AGG-12: sorted sets of what active mentions of a document name; a verse range counts for `ayas` at most."""
    path = lambda p: F.get_json_object("normalized", p)
    kind = F.col("entity_type")
    sura, first = path("$.sura").cast("int"), path("$.aya_start").cast("int")
    verses = F.when((kind == "quran") & sura.isNotNull() & first.isNotNull(), F.transform(F.sequence(first, F.least(F.coalesce(path("$.aya_end").cast("int"), first), first + ayas - 1)), lambda a: F.concat_ws(":", sura, a)))
    one = lambda test, value: F.array_sort(F.collect_set(F.when(test, value)))
    return mentions.groupBy("doc_id").agg(
        one(kind == "person", F.coalesce(F.concat(F.lit("p:"), F.col("person_id")), F.col("normalized_text"))).alias("persons"),
        one(kind == "place", F.coalesce(F.concat(F.lit("pl:"), F.col("place_id")), F.col("normalized_text"))).alias("places"),
        one(kind == "quran", sura).alias("quran_suras"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(verses)))).alias("quran_ayas"),
        one(kind == "hadith_source", path("$.collection")).alias("hadith_collections"),
        F.slice(one(kind == "organization", F.col("normalized_text")), 1, cap).alias("organizations"),
        F.slice(one(kind == "work", F.coalesce(F.concat(F.lit("w:"), F.col("work_id")), F.col("normalized_text"))), 1, cap).alias("works"),
    )


def mention_docs(dimension: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """AGG-13: documents that mention each row of a dimension, 0 included."""
    n = mentions.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("doc_id").alias("docs"))
    return dimension.join(n, key, "left").withColumn("docs", F.coalesce("docs", F.lit(0).cast("long")))


def page_similarity(chunks: DataFrame) -> DataFrame:
    """AGG-14."""
    return chunks.groupBy("doc_id", "page").agg(F.max("similarity").alias("similarity"), F.max_by("chunk_index", F.struct("similarity", -F.col("chunk_index"))).alias("chunk_index"))


def with_page_total(fragments: DataFrame, value: str = "marks") -> DataFrame:
    """AGG-15."""
    return fragments.withColumn(f"page_{value}", F.sum(value).over(Window.partitionBy("doc_id", "page")))


def max_normalized(rows: DataFrame, column: str, into: str) -> DataFrame:
    """AGG-16: divided by the largest of all, which is found by its own aggregation; 0 where that is not positive."""
    top = rows.agg(F.max(column).alias("_top"))
    return rows.join(F.broadcast(top)).withColumn(into, F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(0.0)).drop("_top")


def significant_terms(tokens: DataFrame, foreground: DataFrame, most: int, least_docs: int = 2, background: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """AGG-17: terms over-represented in the foreground documents by JLH: (fg - bg) * fg / bg of document shares.

    tokens(doc_id, token) may repeat; document frequencies come from distinct pairs. Where an index has its vocabulary
    (token, docs) and its one row of documents (n) as `background`, only the foreground's words are counted.
    """
    chosen = foreground.select("doc_id").distinct()
    fg = tokens.join(chosen, "doc_id", "left_semi").select("doc_id", "token").distinct().groupBy("token").agg(F.count("*").alias("fg"))
    if background is None:
        bg = tokens.select("doc_id", "token").distinct().groupBy("token").agg(F.count("*").alias("bg"))
        every = tokens.agg(F.countDistinct("doc_id").alias("bg_docs"))
    else:
        bg, every = background[0].select("token", F.col("docs").alias("bg")), background[1].select(F.col("n").alias("bg_docs"))
    sizes = every.join(F.broadcast(chosen.agg(F.count("*").alias("fg_docs"))))
    share = fg.where(F.col("fg") >= least_docs).join(bg, "token").join(F.broadcast(sizes))
    f, b = F.col("fg") / F.col("fg_docs"), F.col("bg") / F.col("bg_docs")
    return share.withColumn("score", (f - b) * f / b).where("score > 0").orderBy(F.desc("score"), "token").limit(most).select("token", "fg", "bg", "score")


def picked_ranks(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """AGG-18: the values at index n*10//100, n//2 and n*90//100 of each key's sorted rows.

    Places come from counts of equal values with a running sum, so a group's rows are summed before they meet.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    run = Window.partitionBy(*keys).orderBy(value)
    upto = counts.withColumn("hi", F.sum("c").over(run)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    pick = lambda at: F.min(F.when(F.col("hi") > at, F.col(value)))
    return upto.groupBy(*keys).agg(pick(F.floor(F.col("n") / 10)).alias("p10"), pick(F.floor(F.col("n") / 2)).alias("p50"), pick(F.floor(F.col("n") * 9 / 10)).alias("p90"))


def coverage(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """AGG-18: share of each text that its segments cover."""
    own = segments.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return lengths.join(own, "doc_id", "left").withColumn("coverage", F.coalesce(F.col("covered"), F.lit(0)) / F.greatest(F.col("length"), F.lit(1)))


def extraction_figures(mentions: DataFrame) -> DataFrame:
    """AGG-19: mentions by label with those not found in the text and those whose span does not hold their surface."""
    return mentions.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("start").isNull()).alias("not_found"), F.count_if(F.col("start").isNotNull() & (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("surface"))).alias("broken"))


def cost(docs: DataFrame, chars: str, per_token: float = 3.5, window: int = 3000, output: float = 0.30) -> DataFrame:
    """AGG-20: windows, tokens in and out that an extraction of the documents takes."""
    n = F.col(chars)
    return docs.agg(F.sum(n).alias("chars"), F.sum(F.ceil(n / window)).alias("windows"), (F.sum(n) / per_token).alias("tokens_in"), (F.sum(n) / per_token * output).alias("tokens_out"))


def anchor_figures(mentions: DataFrame, least: float = 0.8) -> DataFrame:
    """AGG-21."""
    rate = F.count_if(F.col("start").isNotNull()) / F.count("*")
    return mentions.groupBy("doc_id").agg(F.count("*").alias("n"), rate.alias("anchor_rate"), F.when(rate < least, "LOW_ANCHOR_RATE").alias("flag"))


def regions(mentions: DataFrame) -> DataFrame:
    """AGG-22: regions of a document by kind: items in order and the highest confidence."""
    return mentions.groupBy("doc_id", "kind").agg(F.max("confidence").alias("confidence"), F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x.text).alias("items"))


def question_answers(rows: DataFrame) -> DataFrame:
    """AGG-23: each answer with the question pending there: the last question since the answer before."""
    w = Window.partitionBy("doc_id").orderBy("start")
    return rows.withColumn("question", F.when((F.col("kind") == "answer") & (F.lag("kind").over(w) == "question"), F.lag("text").over(w))).where("question IS NOT NULL").select("doc_id", "start", "question", F.col("text").alias("answer"))


def request_figures(requests: DataFrame) -> DataFrame:
    """AGG-24, SNK-05: counter and duration sum by method, route and status."""
    return requests.groupBy("method", "route", "status").agg(F.count("*").alias("requests"), F.sum("duration_ms").alias("duration_sum"), F.count("duration_ms").alias("duration_count"))
