"""The search index on disk: postings in buckets of words, with the statistics and the vocabulary beside them.

A row is a word of a field of a document, with how often and where it stands there and how long the field is, so that a
score needs nothing but the rows of its own words. Rows lie in folders by a checksum of the word: a query names its words,
so only their folders are read. Within files rows are in the order of words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ANALYSES = {"raw": T.tokens, "exact": T.exact_tokens, "stem": T.stemmed_tokens}
#: Folders of words; and tasks that write one, as a single word may fill a folder.
BUCKETS, PIECES = 64, 4


@dataclass(frozen=True)
class Postings:
    """rows (bucket, token, field, doc_id, tf, places, dl), stats (field, n, avgdl; field * for documents) and vocabulary (token, docs) of one analysis."""

    rows: DataFrame
    stats: DataFrame
    vocabulary: DataFrame
    buckets: int = BUCKETS

    def of(self, words: list[str]) -> DataFrame:
        """The rows of some words, from their buckets alone."""
        buckets = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        return self.rows.where(F.col("bucket").isin(buckets) & F.col("token").isin(sorted(set(words))))

    def among(self, words: DataFrame) -> DataFrame:
        """The rows of the words of a table (token, more columns), which prunes the buckets as it is met."""
        return self.rows.join(words.withColumn("bucket", bucket(self.buckets)), ["bucket", "token"])

    def background(self) -> tuple[DataFrame, DataFrame]:
        """The vocabulary, and one row with the number of documents."""
        return self.vocabulary, self.stats.where("field = '*'")


def bucket(buckets: int):
    return F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(buckets)).cast("int")


def rows_of(docs: DataFrame, fields: list[str], analysis: str, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """A row for each word of each field of each document. Words are sorted and met inside their document, so nothing is
    shuffled; keys are taken to be unique, as a search has a row for each of them."""

    def of(f):
        value = F.array_join(F.col(f), " ") if docs.schema[f].dataType.typeName() == "array" else F.col(f)
        every = F.transform(ANALYSES[analysis](value), lambda w, i: F.struct(w.alias("token"), i.alias("pos")))
        return docs.select(F.col(key).alias("doc_id"), F.lit(f).alias("field"), F.sort_array(every).alias("t"))

    token = lambda k: F.get("t", k)["token"]
    leads = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda k: (k == 0) | (token(k) != token(k - 1)))
    words = reduce(DataFrame.unionByName, [of(f) for f in fields]).where(F.size("t") > 0).withColumn("leads", leads)
    until = lambda j: F.coalesce(F.get("leads", j + 1), F.size("t"))
    runs = F.transform("leads", lambda k, j: F.struct(token(k).alias("token"), F.transform(F.slice("t", k + 1, until(j) - k), lambda x: x.pos).alias("places")))
    one = words.select("doc_id", "field", F.size("t").cast("long").alias("dl"), F.explode(runs).alias("r")).select("doc_id", "field", "dl", "r.token", "r.places")
    return one.select(bucket(buckets).alias("bucket"), "token", "field", "doc_id", F.size("places").cast("long").alias("tf"), "places", "dl")


def around(rows: DataFrame, several: bool = True, buckets: int = BUCKETS) -> Postings:
    """Postings of rows, with the statistics worked out from them; a field of a document counts by the row of its first word."""
    first = rows.where(F.get("places", F.lit(0)) == 0).select("field", "doc_id", "dl")
    stats = first.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    stats = stats.unionByName(first.agg(F.lit("*").alias("field"), F.countDistinct("doc_id").alias("n"), F.lit(None).cast("double").alias("avgdl")))
    return Postings(rows, stats, rows.groupBy("token").agg((F.countDistinct("doc_id") if several else F.count("*")).alias("docs")), buckets)


def unwritten(docs: DataFrame, fields: list[str], key: str = "doc_id") -> dict[str, Postings]:
    """The postings of a small table, analysed anew whenever they are read."""
    return {a: around(rows_of(docs, fields, a, key), len(fields) > 1) for a in ANALYSES}


def write(docs: DataFrame, fields: list[str], path: str, key: str = "doc_id", analyses: tuple[str, ...] = tuple(ANALYSES), buckets: int = BUCKETS) -> None:
    """SNK-01, SNK-06: the index of docs' fields under a folder."""
    spark = docs.sparkSession
    for a in analyses:
        rows = rows_of(docs, fields, a, key, buckets)
        piece = F.pmod(F.xxhash64("doc_id"), F.lit(PIECES))
        rows.repartition("bucket", piece).sortWithinPartitions("bucket", "token", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{a}/rows")
        made = around(spark.read.parquet(f"{path}/{a}/rows"), len(fields) > 1)
        made.stats.write.mode("overwrite").parquet(f"{path}/{a}/stats")
        made.vocabulary.write.mode("overwrite").parquet(f"{path}/{a}/vocabulary")


ROWS = "token string, field string, doc_id long, tf long, places array<int>, dl long, bucket int"


def read(spark: SparkSession, path: str, analyses: tuple[str, ...] = tuple(ANALYSES), buckets: int = BUCKETS) -> dict[str, Postings]:
    table = lambda a, name, ddl: spark.read.schema(ddl).parquet(f"{path}/{a}/{name}")
    return {a: Postings(table(a, "rows", ROWS), table(a, "stats", "field string, n long, avgdl double"), table(a, "vocabulary", "token string, docs long"), buckets) for a in analyses}
