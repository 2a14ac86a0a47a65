"""Small lookups: regnal periods, regions, match kinds, stand-ins for outside services."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_kind, normalize, tokens
from ..functions.vectors import normalized

#: Rows of a lookup table that go to every task.
BOUND = 20_000


def bounded(table: DataFrame, most: int = BOUND) -> DataFrame:
    """The table for a broadcast, after a check of its size."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"a lookup table has more than {most} rows")
    return F.broadcast(table)


def regnal_years(phrases: DataFrame, periods: DataFrame) -> DataFrame:
    """DAT-06: phrases (phrase_id, phrase) with the years of the first period (by ord) whose folded name they hold."""
    p = bounded(periods.select("ord", normalize("ruler").alias("_r"), "year_from", "year_to"))
    hit = phrases.withColumn("_p", normalize("phrase")).join(p, F.contains(F.col("_p"), F.col("_r")))
    first = hit.groupBy("phrase_id").agg(F.min_by(F.struct("year_from", "year_to"), "ord").alias("y")).select("phrase_id", "y.year_from", "y.year_to")
    return phrases.join(first, "phrase_id", "left")


def regions(rows: DataFrame, query: str, name: str = "name", most: int = 10) -> DataFrame:
    """STR-28: rows named like the query: the very name first, then those that hold it, shorter first."""
    folded = normalize(name)
    q = normalize(F.lit(query))
    return rows.withColumn("_rank", F.when(folded == q, 0).when(F.contains(folded, q), 1)).where("_rank IS NOT NULL").orderBy("_rank", F.length(name), name).limit(most).drop("_rank")


def kind_counts(matches: DataFrame) -> DataFrame:
    """STR-21: matches of each kind."""
    return matches.groupBy(match_kind("match_kind", "lexical_score", "semantic_score").alias("kind")).agg(F.count("*").alias("n"))


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """JON-03: rows without a partner."""
    return rows.join(seen.select(*keys), keys, "left_anti")


def hashed_vectors(docs: DataFrame, size: int = 64, text: str = "text", cap: int = 8000) -> DataFrame:
    """SEM-05, a stand-in for an embedding service: signed counts of hashed words of the first 8000 characters, length one."""
    words = docs.select("doc_id", F.explode(tokens(F.substring(text, 1, cap))).alias("w"))
    h = F.xxhash64("w")
    parts = words.groupBy("doc_id", F.pmod(h, F.lit(size)).cast("int").alias("i")).agg(F.sum(F.when(h.bitwiseAND(F.lit(1 << 40)) != 0, 1).otherwise(-1)).cast("double").alias("x"))
    whole = parts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))  # as many as `size`
    full = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return whole.select("doc_id", normalized(full).alias("embedding"))


class Engines:
    """SRC-10: recognition engines by name, with what each is asked for; their answers come as JSON (SRC-04, SRC-09, SRC-11)."""

    def __init__(self):
        self.known: dict[str, dict] = {}

    def register(self, name: str, url: str, formats: tuple[str, ...], words: bool = False) -> None:
        self.known[name] = {"name": name, "url": url, "formats": formats, "words": words}

    def listing(self, healthy: set[str]) -> list[dict]:
        return [e | {"available": e["name"] in healthy} for e in sorted(self.known.values(), key=lambda e: e["name"])]


def recognised_words(answers: DataFrame) -> DataFrame:
    """SRC-11: words (page_id, block, seq, text, x0, y0, x1, y1, conf) of a recogniser's JSON, in reading order."""
    schema = "struct<regions:array<struct<id:string,lines:array<struct<bbox:array<double>,words:array<struct<text:string,bbox:array<double>,conf:double>>>>>>>"
    r = answers.select("page_id", F.explode(F.from_json("answer", schema).regions).alias("r")).select("page_id", F.col("r.id").alias("block"), F.posexplode("r.lines").alias("line", "l"))
    w = r.select("page_id", "block", "line", F.posexplode("l.words").alias("k", "w")).where(F.trim("w.text") != "")
    seq = F.row_number().over(Window.partitionBy("page_id", "block").orderBy("line", "k")) - 1
    box = [F.get("w.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return w.select("page_id", "block", seq.alias("seq"), F.trim("w.text").alias("text"), *box, F.col("w.conf").alias("conf"))


def extracted_text(answers: DataFrame) -> DataFrame:
    """SRC-04: text and metadata of an extraction service's JSON answer (content, metadata)."""
    a = F.from_json("answer", "struct<content:string,metadata:map<string,string>>")
    return answers.select("doc_id", F.trim(a.content).alias("content"), a.metadata.alias("metadata")).where("content <> ''")
