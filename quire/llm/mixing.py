"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic. The token weights of the cells are raked: scaled in turn so
that the sums by source, by language and by topic meet their targets, until no scale differs from 1 by more than ``NEAR``,
at most ``ROUNDS`` times over. Default targets temper the shares that the marginals have (share to the power ``TEMPER``,
made to sum to one). A cell's documents are then sampled with one probability, the cell's ratio of raked to own tokens
times a constant, at most 1; the constant is chosen so that the tokens expected are ``KEEP`` of all. Which documents go
is decided by a hash of their id, and of their text if they have no id, so it does not depend on how rows are dealt out.

Cells, marginals and scales are tables, written each round; the driver sees only how far a round moved and the constant,
which it brackets with ``STEPS`` trials at a time. The topic of a document is the form of its text (``topic``), unless a
column is given. Nulls are cells of their own. Null and empty texts have no tokens; a cell without tokens has ratio 1.
Repeated rows are decided alike. A table without tokens keeps its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, as_id, doc_key, met, table, text_key, written

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, NEAR, TEMPER, KEEP, STEPS = 30, 1e-5, 0.7, 0.85, 64
#: Fixed value: a word of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column, tokens: Column) -> Column:
    """The form of a text: table, markup, note (under 100 words), article (under 1000) or treatise."""
    return (
        F.when(tokens == 0, "empty")
        .when(F.length(text) - F.length(F.translate(text, "|", "")) > tokens / 4, "table")
        .when(F.length(text) - F.length(F.translate(text, "<>{}", "")) > tokens / 4, "markup")
        .when(tokens < 100, "note")
        .when(tokens < 1000, "article")
        .otherwise("treatise")
    )


def goals(cells: DataFrame, d: str, targets: dict[str, float] | None) -> DataFrame:
    """(k, goal): the share of all tokens that each value of dimension d shall have; they sum to one."""
    own = cells.groupBy(F.col(d).alias("k")).agg(F.sum("tokens").cast("double").alias("tokens"))
    if targets is not None:
        wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "x string, goal double")
        own = own.join(wanted, F.col("k").eqNullSafe(F.col("x")), "left").select("k", F.coalesce("goal", F.lit(0.0)).alias("goal"))
    else:
        own = own.select("k", F.pow("tokens", F.lit(TEMPER)).alias("goal"))
    whole = own.agg(F.sum("goal")).first()[0] or 1.0
    return own.withColumn("goal", F.col("goal") / F.lit(whole))


def raked(cells: DataFrame, targets: dict[str, dict] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight, the ratio of raked to own tokens."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goal = {d: written(goals(cells, d, (targets or {}).get(d))) for d in DIMENSIONS}
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds if total else 0):
        moved = F.lit(0.0)
        for d in DIMENSIONS:
            sums = now.groupBy(F.col(d).alias("x")).agg(F.sum("w").alias("have"))
            scale = sums.join(goal[d], F.col("x").eqNullSafe(F.col("k"))).select("x", F.when(F.col("have") > 0, F.col("goal") * F.lit(total) / F.col("have")).otherwise(1.0).alias(f"scale_{d}"))
            now = now.join(scale, F.col(d).eqNullSafe(F.col("x"))).drop("x").withColumn("w", F.col("w") * F.col(f"scale_{d}"))
            moved = F.greatest(moved, F.abs(F.col(f"scale_{d}") - 1))
        now = written(now.withColumn("moved", F.when(F.col("w") > 0, moved).otherwise(0.0)))
        step = now.agg(F.max("moved")).first()[0] or 0
        now = now.select(*cells.columns, "w")
        if step <= NEAR:
            break
    return now.select(*cells.columns, F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("weight"))


def constant(found: DataFrame, keep: float = KEEP) -> float:
    """k such that min(1, k * weight) of the tokens of cells (tokens, weight) are `keep` of all, or all that can be."""
    total, reach, least = found.agg(F.sum("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("tokens"))), F.min(F.when((F.col("tokens") > 0) & (F.col("weight") > 0), F.col("weight")))).first()
    if not total or not least:
        return 1.0
    if keep * total >= reach:
        return 1 / least
    low, high = 0.0, 1 / least  # every cell that has a weight is whole there
    while high - low > 1e-12 * high:
        trials = [low + (high - low) * i / STEPS for i in range(1, STEPS)]
        # Trials are rows: as columns, each round's literals would be new code for the driver to compile and keep.
        tried = found.sparkSession.range(1, STEPS, 1, 1).select(F.col("id").alias("trial"), (F.lit(low) + F.lit(high - low) * F.col("id") / F.lit(STEPS)).alias("k"))
        own = found.select("tokens", "weight").crossJoin(F.broadcast(tried)).groupBy("trial").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("k") * F.col("weight"))).alias("held"))
        sums = [x for _, x in sorted(own.collect())]
        short = sum(x < keep * total for x in sums)
        low, high = (trials[short - 1] if short else low), (trials[short] if short < len(trials) else high)
        if low == high:
            break
    return high


def mixed(docs: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP, topics: str | None = None, seed: int = 17) -> DataFrame:
    """(doc, th, source, lang, topic, n_tokens, weight, probability, selected) for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(doc_key().alias("doc"), text_key().alias("th"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), text.alias("text"), *([F.col(topics).cast("string").alias("topic")] if topics else []))
    if not topics:
        own = own.withColumn("topic", topic(F.col("text"), F.col("n_tokens")))
    own = written(own.drop("text"))
    found = written(raked(written(own.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))), targets))
    p = F.least(F.lit(1.0), F.lit(constant(found, keep)) * F.col("weight")) if found.agg(F.sum("tokens")).first()[0] else F.lit(1.0)
    found = found.select(*[F.col(d).alias(f"{d}_") for d in DIMENSIONS], "weight", p.alias("probability"))
    meet = F.lit(True)
    for d in DIMENSIONS:
        meet = meet & F.col(d).eqNullSafe(F.col(f"{d}_"))
    draw = F.when(F.col("doc") < NO_ID, F.xxhash64(F.lit(seed), F.col("doc"), F.col("th"))).otherwise(F.xxhash64(F.lit(seed), F.col("doc")))
    u = F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))
    out = own.join(found, meet)
    return out.withColumn("selected", u < F.col("probability")).select("doc", "th", *DIMENSIONS, "n_tokens", "weight", "probability", "selected")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, selected) for each row of docs."""
    return mixed(docs, **how).select(as_id(), *DIMENSIONS, "n_tokens", "weight", "probability", "selected")


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents. Rows alike in doc_id and text go together if one of them is not sampled."""
    return met(docs, mixed(docs).where("NOT selected").select("doc", "th").distinct(), "left_anti").select(*docs.columns)
