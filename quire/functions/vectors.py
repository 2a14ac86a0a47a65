"""Vectors as arrays: cosine, length, normalisation, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import _col


def dot(a, b) -> Column:
    """Over the shorter of the two."""
    n = F.least(F.size(_col(a)), F.size(_col(b)))
    pairs = F.zip_with(F.slice(_col(a), 1, n), F.slice(_col(b), 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """SEM-01: between -1 and 1; 0 for an empty or zero vector. Scale does not matter."""
    n = F.least(F.size(_col(a)), F.size(_col(b)))
    length = norm(F.slice(_col(a), 1, n)) * norm(F.slice(_col(b), 1, n))
    return F.when((n > 0) & (length > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / length))).otherwise(0.0)


def normalized(a) -> Column:
    """SEM-02: zero stays zero."""
    length = norm(a)
    return F.transform(_col(a), lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def centroid(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """AGG-10: weighted mean of each key's vectors, normalised; one sum for each key and dimension."""
    parts = rows.select(*keys, F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = parts.groupBy(*keys, "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))  # as many as dimensions
    return whole.select(*keys, normalized(F.transform("v", lambda s: s.x)).alias("centroid"))


def top_weighted(rows: DataFrame, keys: list[str], weight: str, tie: str, most: int = 25) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(weight), tie)
    return rows.withColumn("_n", F.row_number().over(order)).where(f"_n <= {most}").drop("_n")
