"""LNK-01: links from own entities to an outside authority, each needing a second sign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .joins import near_places


def linked_persons(persons: DataFrame, outside: DataFrame, years: int = 10) -> DataFrame:
    """The one outside person of the same folded name whose death year is within ten years."""
    o = outside.select("ext_id", normalize("label").alias("_k"), F.col("death_year").alias("_y"))
    hit = persons.withColumn("_k", normalize("display_name")).join(o, "_k").where(F.abs(F.col("death_year_hijri") - F.col("_y")) <= years)
    return hit.groupBy("person_id").agg(F.countDistinct("ext_id").alias("n"), F.min("ext_id").alias("ext_id")).where("n = 1").drop("n")


def linked_places(places: DataFrame, outside: DataFrame, within: float = 1.5) -> DataFrame:
    """An outside place of the same folded name near by."""
    o = outside.withColumn("_n", normalize("label"))
    named = places.withColumn("_n", normalize("name")).join(o.select("_n", "ext_id").distinct(), "_n").select("place_id", F.col("ext_id").alias("_e"))
    hit = near_places(places, outside.join(named.select(F.col("_e").alias("ext_id")).distinct(), "ext_id", "left_semi"), within)
    return hit.join(named, (hit.place_id == named.place_id) & (hit.ext_id == F.col("_e"))).select(hit.place_id, "ext_id")


def linked_unique(rows: DataFrame, outside: DataFrame, key: str, name: str) -> DataFrame:
    """The only outside entity of the same folded label."""
    one = outside.groupBy(normalize("label").alias("_k")).agg(F.countDistinct("ext_id").alias("n"), F.min("ext_id").alias("ext_id")).where("n = 1")
    return rows.withColumn("_k", normalize(name)).join(one, "_k").select(key, "ext_id")


def linked_works(works: DataFrame, outside: DataFrame) -> DataFrame:
    """JON-18: outside works whose title holds the own one or is held by it, with the same author; the least id of several."""
    o = outside.select("ext_id", "author", normalize("label").alias("_t"))
    w = works.select("work_id", "author", normalize("title").alias("_w"))
    hit = w.join(o, "author").where(F.contains("_t", "_w") | F.contains("_w", "_t"))
    return hit.groupBy("work_id").agg(F.min("ext_id").alias("ext_id"))
