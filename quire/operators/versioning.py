"""Versioned tables as snapshots: each function makes the next snapshot of a table from the last and what is new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import first_writers


def replaced(old: DataFrame, new: DataFrame, docs: DataFrame, name: str, version: str, at: Column) -> DataFrame:
    """DML-01: rows of the documents that an extractor ran over: those of the same version and unverified go, unverified
    ones of other versions are superseded, verified ones stay and are orphaned where the text changed.

    docs(doc_id, content_hash); old rows have extractor, version, human_verified, content_hash, superseded_at, orphaned.
    """
    mine = (F.col("extractor") == name) & F.col("_now").isNotNull()
    rows = old.join(docs.select("doc_id", F.col("content_hash").alias("_now")), "doc_id", "left")
    rows = rows.where(F.coalesce(~(mine & (F.col("version") == version) & ~F.col("human_verified")), F.lit(True)))
    rows = rows.withColumn("superseded_at", F.when(mine & ~F.col("human_verified") & F.col("superseded_at").isNull(), at).otherwise(F.col("superseded_at")))
    rows = rows.withColumn("orphaned", F.coalesce(F.col("orphaned") | (mine & F.col("human_verified") & (F.col("content_hash") != F.col("_now"))), F.col("orphaned"))).drop("_now")
    return rows.unionByName(new, allowMissingColumns=True)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """DML-02, SRC-12: new values where there are any, old rows that have no new one stay."""
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    return o.join(n, on, "full_outer").select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns])


def created(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """DML-02: get or create: rows with new keys are added, existing ones stay as they are."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"), allowMissingColumns=True)


def appended(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DML-03: appended once for each client key; the first to come wins."""
    return old.unionByName(first_writers(new, keys, order).join(old, keys, "left_anti"))


def unchanged_out(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """DML-04."""
    return rows.join(ledger, keys, "left_anti")


def verified_kept(old: DataFrame, new: DataFrame, span: list[str]) -> DataFrame:
    """DML-05: new rows, but on equal spans a human's row instead."""
    verified = old.where("human_verified")
    return verified.unionByName(new.join(verified, span, "left_anti"), allowMissingColumns=True)


def purged(rows: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    """DML-06, DAT-09, STM-06."""
    return rows.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def reviewed(rows: DataFrame, decisions: DataFrame, key: str = "mention_id") -> DataFrame:
    """DML-07: approve, reject or reopen; the last decision counts, and approval or rejection verifies."""
    last = decisions.groupBy(key).agg(F.max_by("action", "decided_at").alias("_a"))
    status = F.create_map(*[F.lit(x) for x in ("approve", "approved", "reject", "rejected", "reopen", "pending")])
    out = rows.join(last, key, "left")
    return out.withColumns({"review_status": F.coalesce(F.try_element_at(status, F.col("_a")), F.col("review_status")), "human_verified": F.when(F.col("_a").isin("approve", "reject"), True).when(F.col("_a") == "reopen", False).otherwise(F.col("human_verified"))}).drop("_a")


def merged_entities(mentions: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """LNK-02: mentions of a merged entity point to the one that stays."""
    return mentions.join(merges.select(F.col("loser").alias(key), "winner"), key, "left").withColumn(key, F.coalesce("winner", key)).drop("winner")


def merged_aliases(entities: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """LNK-02: the one that stays takes the names of those merged into it."""
    named = entities.join(merges.select(F.col("loser").alias(key), "winner"), key, "left").withColumn("_to", F.coalesce("winner", key))
    names = named.groupBy("_to").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>"))))))).alias("_all"))
    kept = entities.join(merges.select(F.col("loser").alias(key)), key, "left_anti")
    return kept.join(names, F.col(key) == F.col("_to")).withColumn("aliases", F.array_except("_all", F.array("display_name"))).drop("_to", "_all")
