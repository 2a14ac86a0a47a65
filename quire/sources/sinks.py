"""Sinks: index tables, knowledge JSON, Markdown and CSV exports, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_index(rows: DataFrame, path: str, append: bool = False) -> None:
    """SNK-01, SNK-02, SNK-06: index rows; columns may be added later (read with mergeSchema)."""
    rows.write.mode("append" if append else "overwrite").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_knowledge(rows: DataFrame, path: str) -> None:
    """SRC-15: knowledge rows as JSON lines; null fields are left out."""
    rows.write.mode("overwrite").json(path)


def notes_markdown(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """SNK-03: one Markdown text for each user and document: front matter, then a section for each note by page."""
    one = notes.join(docs.select("doc_id", "title"), "doc_id")
    section = F.concat(F.lit("## p. "), F.col("page").cast("string"), F.lit("\n\n"), F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit("> "), F.col("quote"), F.lit("\n\n"))).otherwise(""), F.col("body"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "note_id", section.alias("s")))), lambda x: x.s), "\n\n")
    whole = one.groupBy("user_id", "doc_id", "title").agg(F.count("*").alias("n"), body.alias("b"))
    return whole.select("user_id", "doc_id", F.concat(F.lit("---\ntitle: "), F.col("title"), F.lit("\nnotes: "), F.col("n").cast("string"), F.lit("\n---\n\n# "), F.col("title"), F.lit("\n\n"), F.col("b"), F.lit("\n")).alias("markdown"))


def csv_line(*columns: str):
    """SNK-04: an RFC 4180 line."""
    def one(c):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.concat_ws(",", *[one(c) for c in columns])


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK-04."""
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def counters(requests: DataFrame) -> DataFrame:
    """SNK-05: counter lines in the text format that scrapers read."""
    return requests.select("name", F.map_entries("labels").alias("l"), "value").groupBy("name", "l").agg(F.sum("value").alias("value")).select(F.concat(F.col("name"), F.lit("{"), F.array_join(F.transform(F.array_sort("l"), lambda e: F.concat(e.key, F.lit('="'), e.value, F.lit('"'))), ","), F.lit("} "), F.col("value").cast("string")).alias("line"))
