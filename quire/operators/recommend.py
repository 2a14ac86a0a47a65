"""Recommendations for all users at once: personal, by facets, popular, newest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions import vectors as V
from ..sources.scratch import written
from .aggregates import facet_weights

SOURCES, BY_MEANING, BY_FACET = 25, 0.7, 0.3
#: Users, and documents, of a block.
BLOCK = 2048


def favourites(affinities: DataFrame) -> DataFrame:
    """The documents that a user engaged with most, with weight score + 1."""
    return V.top_weighted(affinities, ["user_id"], "engagement_score", "doc_id", SOURCES).withColumn("weight", F.greatest("engagement_score", F.lit(0.0)) + 1)


def centroids(affinities: DataFrame, vectors: DataFrame) -> DataFrame:
    """AGG-10."""
    return V.centroid(favourites(affinities).join(vectors, "doc_id"), ["user_id"], "embedding", "weight")


def nearest(points: DataFrame, vectors: DataFrame, seen: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """SEM-03 for many users: the k nearest unseen documents of each, best of each block of documents first.

    Users are a stated query set. Blocks of users meet blocks of documents, and each pair of blocks keeps k a user, so what
    is shuffled is users times blocks of documents times k at most; scores are those of V.cosine.
    """
    points = written(points.select("user_id", "centroid"))
    parts = lambda df: max(1, -(-df.count() // block))
    most, many = parts(vectors), parts(points)
    of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # As many as the block has documents at most.
    read = seen.select("user_id", "doc_id").join(vectors.select("doc_id"), "doc_id", "left_semi").groupBy("user_id", of("doc_id", most).alias("_b")).agg(F.collect_set("doc_id").alias("seen"))
    q = points.withColumn("_b", every(most)).join(read, ["user_id", "_b"], "left").withColumn("_u", of("user_id", many))
    b = vectors.select("doc_id", "embedding", of("doc_id", most).alias("_b")).withColumn("_u", every(many))

    def best(left, right):
        ids = right.column("doc_id").to_numpy()
        own = [np.asarray(x or (), np.int64) for x in left.column("seen").to_pylist()]
        i, j, score = blocks.nearest(left.column("centroid"), right.column("embedding"), ids, own, k)
        return pa.table([left.column("user_id").take(pa.array(i)), pa.array(ids[j]), pa.array(score)], ["user_id", "doc_id", "semantic"])

    local = q.groupBy("_u", "_b").cogroup(b.groupBy("_u", "_b")).applyInArrow(best, "user_id long, doc_id long, semantic double")
    order = Window.partitionBy("user_id").orderBy(F.desc("semantic"), "doc_id")
    return local.withColumn("_n", F.row_number().over(order)).where(f"_n <= {k}").drop("_n")


def facet_scores(affinities: DataFrame, candidates: DataFrame, doc_authors: DataFrame, doc_categories: DataFrame) -> DataFrame:
    """REC-03, AGG-11: raw / (raw + 3) over shared authors and categories, and the shared author of most weight."""
    top = favourites(affinities)
    a = facet_weights(top, doc_authors, "author_id")
    c = facet_weights(top, doc_categories, "category_id")
    by_author = candidates.join(doc_authors, "doc_id").join(a, ["user_id", "author_id"]).select("user_id", "doc_id", "author_id", "weight")
    by_category = candidates.join(doc_categories, "doc_id").join(c, ["user_id", "category_id"]).select("user_id", "doc_id", F.lit(None).cast("long").alias("author_id"), "weight")
    raw = by_author.unionByName(by_category).groupBy("user_id", "doc_id").agg(F.sum("weight").alias("raw"), F.max_by("author_id", F.when(F.col("author_id").isNotNull(), F.struct("weight", -F.col("author_id")))).alias("best_author"))
    return raw.select("user_id", "doc_id", (F.col("raw") / (F.col("raw") + 3)).alias("facet"), "best_author")


def personalized(affinities: DataFrame, vectors: DataFrame, doc_authors: DataFrame, doc_categories: DataFrame, limit: int) -> DataFrame:
    """REC-02."""
    near = written(nearest(centroids(affinities, vectors), vectors, affinities, min(limit * 4, 100)))
    scored = near.join(facet_scores(affinities, near.select("user_id", "doc_id"), doc_authors, doc_categories), ["user_id", "doc_id"], "left")
    top = F.max("semantic").over(Window.partitionBy("user_id"))  # at most 100 rows a user
    return scored.withColumn("score", BY_MEANING * F.col("semantic") / top + BY_FACET * F.coalesce("facet", F.lit(0.0))).withColumn("reason", F.when(F.col("best_author").isNotNull(), "more_by_author").otherwise("for_you")).select("user_id", "doc_id", "score", "reason", "best_author")


def wanted_ranks(users: DataFrame, seen: DataFrame, more: int) -> DataFrame:
    """(user_id, rank): of a list in order, a user who has seen n rows needs the first n + more at most."""
    n = seen.groupBy("user_id").agg(F.count("*").alias("n"))
    return users.join(n, "user_id", "left").select("user_id", F.explode(F.sequence(F.lit(1), (F.coalesce("n", F.lit(0)) + more).cast("int"))).alias("rank"))


def longest(ranks: DataFrame) -> int:
    return ranks.agg(F.max("rank")).first()[0] or 0


def by_facets(users: DataFrame, affinities: DataFrame, docs: DataFrame, doc_authors: DataFrame, doc_categories: DataFrame, limit: int) -> DataFrame:
    """REC-04: candidates that share a facet, the first 4 * limit by id, ranked by facet score.

    Only the heads of the facets' lists are read, as far as a user can need them: what meets is a row for each user, facet
    and rank, however many documents a facet has.
    """
    mine = affinities.join(users, "user_id", "left_semi")
    top = written(favourites(mine))
    ranks = written(wanted_ranks(top.select("user_id").distinct(), mine, 4 * limit))
    most = longest(ranks)

    def heads(bridge: DataFrame, key: str) -> DataFrame:
        """The first documents by id of each facet that users share, met rank by rank."""
        liked = top.join(bridge, "doc_id").select("user_id", key).distinct()
        order = Window.partitionBy(key).orderBy("doc_id")
        known = bridge.join(docs.select("doc_id"), "doc_id", "left_semi").select(key, "doc_id").distinct()
        first = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        return liked.join(ranks, "user_id").join(first, [key, "rank"]).select("user_id", "doc_id")

    every = heads(doc_authors, "author_id").unionByName(heads(doc_categories, "category_id")).distinct()
    fresh = every.join(mine.select("user_id", "doc_id"), ["user_id", "doc_id"], "left_anti")
    cut = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy("doc_id"))).where(f"_n <= {4 * limit}").drop("_n")
    scored = cut.join(facet_scores(mine, cut, doc_authors, doc_categories), ["user_id", "doc_id"], "left")
    return scored.select("user_id", "doc_id", F.coalesce("facet", F.lit(0.0)).alias("score"), F.when(F.col("best_author").isNotNull(), "more_by_author").otherwise("for_you").alias("reason"), "best_author")


def from_list(users: DataFrame, affinities: DataFrame, ranked: DataFrame, reason: str, limit: int) -> DataFrame:
    """REC-05: the best of a common list (doc_id, score) that a user has not seen.

    The list is cut to what the user who saw most can need before it is numbered, and users meet it rank by rank.
    """
    seen = affinities.join(users, "user_id", "left_semi").select("user_id", "doc_id")
    ranks = written(wanted_ranks(users, seen, limit))
    head = ranked.orderBy(F.desc("score"), "doc_id").limit(longest(ranks))
    numbered = head.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("l")).select(F.posexplode("l").alias("k", "x"))
    numbered = numbered.select((F.col("k") + 1).alias("rank"), F.col("x.doc_id").alias("doc_id"), (-F.col("x.s")).alias("score"))
    fresh = ranks.join(numbered, "rank").join(seen, ["user_id", "doc_id"], "left_anti")
    return fresh.select("user_id", "doc_id", "score", F.lit(reason).alias("reason"), F.lit(None).cast("long").alias("best_author"))


def recommend(users: DataFrame, affinities: DataFrame, docs: DataFrame, vectors: DataFrame, doc_authors: DataFrame, doc_categories: DataFrame, limit: int = 12) -> DataFrame:
    """REC-01, REC-05: of each user the first tier that has anything, its best `limit` (1 to 50).

    A tier is made only for users whom no tier before has served, and written, so none is made twice.
    """
    limit = max(1, min(limit, 50))
    affinities = written(affinities.select("user_id", "doc_id", "engagement_score"))  # every tier reads them
    left = written(users.select("user_id").distinct())
    liked = affinities.groupBy("doc_id").agg(F.sum("engagement_score").alias("score"))
    new = docs.select("doc_id", F.unix_timestamp("uploaded_at").cast("double").alias("score"))
    tiers = [
        lambda u: personalized(affinities.join(u, "user_id", "left_semi"), vectors, doc_authors, doc_categories, limit),
        lambda u: by_facets(u, affinities, docs, doc_authors, doc_categories, limit),
        lambda u: from_list(u, affinities, liked, "popular", limit),
        lambda u: from_list(u, affinities, new, "newest", limit),
    ]
    out = None
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "doc_id")
    for k, tier in enumerate(tiers):
        best = tier(left).withColumn("tier", F.lit(k)).withColumn("rank", F.row_number().over(order)).where(f"rank <= {limit}")
        best = written(best)
        out = best if out is None else out.unionByName(best)
        left = written(left.join(best.select("user_id").distinct(), "user_id", "left_anti"))
        if left.limit(1).count() == 0:
            break
    return out
