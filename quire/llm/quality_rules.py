"""Quality rules: plain limits, then robust multivariate outliers by the minimum covariance determinant.

Every document gets statistics of its text. Those that pass the plain limits are vectors of five transformed statistics
(``FEATURES``), which a minimum-covariance-determinant estimate describes for each language and source: from medians and
median absolute deviations as a start, concentration steps take mean and covariance of the ``SHARE`` nearest vectors,
``STEPS`` times, each step being two aggregations with partial sums on the executors. A document goes when the square of
its Mahalanobis distance passes ``CUTOFF``. Variances have the floors in ``FLOORS``, so that statistics which are the
same in nearly every document (no symbols, no repeated lines) do not turn a small departure into an outlier.

Groups of fewer than ``LEAST`` passing documents are judged by the estimate of all passing documents of their language,
and failing that (fewer than ``LEAST`` there, too) by that of all passing documents.
Null texts are empty and fail the limits; null languages and sources are groups of their own. Only doc_id, text, lang
and source are read. Repeated rows count as often as they come and each get their row. Without any passing document
there is nothing to estimate, and none is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Rolling, as_id, chunks, doc_key, flat, lean, met, mix, table, text_key, word_hash, words, written

#: Fixed values of the rules: symbols, least words, most per cent of words in repeated three-word windows.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50

#: Least standard deviation of each feature: log words, characters a word, log symbols per 1000 words, and the square
#: roots of the shares of repeated lines (four lines added, as one repeat says little in a short text) and of words in
#: repeated windows.
FEATURES = ("f0", "f1", "f2", "f3", "f4")
FLOORS = (0.5, 0.3, 0.8, 0.15, 0.15)
SHARE, STEPS, LEAST = 0.75, 4, 60
#: The 0.999999 quantile of chi square with five degrees of freedom, and that of SHARE; the latter sets MCD's scale.
CUTOFF, HALF = 35.89, 6.626
#: P(chi square with seven degrees <= HALF): the nearest SHARE have so much less variance than all.
SHRUNK = 0.531 / SHARE

STATS = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("lang", pa.string()), ("source", pa.string())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])
STATS_DDL = "doc long, th long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _sums(marks: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[off])


def _later(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash came before in its row, and whether it comes more than once there."""
    key = h ^ mix(row.astype(np.uint64) + np.uint64(0x51ED27))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = ~new
    if len(key):
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        twice[order] = np.repeat(size > 1, size)
    return later, twice


def text_stats(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of each row."""
    s, e, at = words(buf, off)
    n_words = np.diff(at)
    covered = np.zeros(len(buf) + 1, np.int32)
    np.add.at(covered, s, 1)
    np.add.at(covered, e, -1)
    inside = np.cumsum(covered[:-1]) > 0
    word_chars = _sums(inside & ((buf & 0xC0) != 0x80), off)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n_symbols = _sums(symbol[buf], off)

    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate((breaks + 1, off[:-1])))
    starts = starts[starts < len(buf)]
    stop = np.append(starts[1:], len(buf))  # a line's own break at its end tells no lines apart that differ otherwise
    stop = stop - (buf[stop - 1] == 10)
    ink = np.searchsorted(s, stop) > np.searchsorted(s, starts)
    starts, stop = starts[ink], stop[ink]
    row = np.searchsorted(off, starts, "right") - 1
    line = word_hash(buf, starts, stop)
    n_lines = np.bincount(row, minlength=len(off) - 1)
    n_dup = np.bincount(row[_later(row, line)[0]], minlength=len(off) - 1)

    h = word_hash(buf, s, e)
    gram = Rolling(h).all(3)
    of = np.repeat(np.arange(len(off) - 1), n_words)
    own = np.flatnonzero(of[: len(gram)] == of[2:][: len(gram)]) if len(gram) else np.zeros(0, np.int64)
    twice = own[_later(of[own], gram[own])[1]]
    mark = np.zeros(len(h) + 3, bool)
    for k in range(3):
        mark[twice + k] = True
    return [n_words, word_chars, n_symbols, n_lines, n_dup, _sums(mark[: len(h)], at)]


def statistics(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in chunks(batches, most=CHUNK_BYTES // 2):
            buf, off = flat(b.column("text"))
            cols = text_stats(buf, off)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("th"), b.column("lang"), b.column("source"), *(pa.array(c.astype(np.int64)) for c in cols)], STATS.names)

    own = docs.select(doc_key().alias("doc"), text_key().alias("th"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    words_or_1 = F.greatest(F.col("n_words"), F.lit(1))
    features = [
        F.log1p(F.col("n_words").cast("double")),
        F.col("word_chars") / words_or_1,
        F.log1p(1000.0 * F.col("n_symbols") / words_or_1),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4)),
        F.sqrt(F.col("n_repeat_words") / words_or_1),
    ]
    return own.mapInArrow(lean(run), STATS_DDL).select("*", failed.alias("base_failed"), *(f.alias(c) for f, c in zip(features, FEATURES, strict=True)))


def grouped(stats: DataFrame) -> DataFrame:
    """stats with g, the group whose estimate judges a document, and feeds, the groups whose estimates it is part of."""
    counts = written(stats.where("NOT base_failed").groupBy("lang", "source").count())
    langs = written(counts.groupBy("lang").agg(F.sum("count").alias("in_lang"), F.min("count").alias("least")))
    rare = (langs.agg(F.min("in_lang")).first()[0] or 0) < LEAST  # some language is judged by all documents
    way = counts.join(langs.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")))
    own, in_lang = F.to_json(F.struct("source", "lang"), {"ignoreNullFields": "false"}), F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    large, spoken = F.col("count") >= LEAST, F.col("in_lang") >= LEAST
    g = F.when(large, own).when(spoken, in_lang).otherwise("")
    feeds = F.array_compact(F.array(F.when(large, own), F.when(spoken & (F.col("least") < LEAST), in_lang), F.lit("" if rare else None).cast("string")))
    way = way.select(F.col("lang").alias("l"), F.col("source").alias("s"), g.alias("g"), feeds.alias("feeds"))
    return stats.join(way, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")


def _distance(names: str = "m", matrix: str = "p") -> Column:
    """Square of the Mahalanobis distance from the columns m (mean) and p (inverse covariance, row by row)."""
    k = len(FEATURES)
    d = [F.col(f) - F.col(names)[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(k):
        for j in range(i, k):
            total = total + d[i] * d[j] * F.col(matrix)[i * k + j] * (1.0 if i == j else 2.0)
    return total


def _inverted(moments: DataFrame, scale: float) -> DataFrame:
    """(g, m, p) from (g, n, s, q): counts, sums, and sums of products; floors are added to the variances."""
    k = len(FEATURES)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n = np.maximum(b.column("n").to_numpy().astype(float), 1)
            s = np.array(b.column("s").to_pylist(), float) / n[:, None]
            q = np.array(b.column("q").to_pylist(), float).reshape(-1, k, k) / n[:, None, None]
            cov = (q - s[:, :, None] * s[:, None, :]) * scale + np.diag(np.square(FLOORS))
            p = np.linalg.inv((cov + cov.transpose(0, 2, 1)) / 2)
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(list(s)), pa.array(list(p.reshape(-1, k * k)))], ["g", "m", "p"])

    return moments.mapInArrow(run, "g string, m array<double>, p array<double>")


def estimates(vectors: DataFrame) -> DataFrame:
    """(g, m, p): centre and inverse covariance of each group of the vectors (g, FEATURES)."""
    k = len(FEATURES)
    mid = vectors.groupBy("g").agg(F.array(*[F.percentile_approx(f, 0.5) for f in FEATURES]).alias("m"))
    off = vectors.join(written(mid), "g").select("g", "m", *[F.abs(F.col(f) - F.col("m")[i]).alias(f) for i, f in enumerate(FEATURES)])
    spread_ = [F.pow(1.4826 * F.percentile_approx(f, 0.5), 2) + FLOORS[i] ** 2 for i, f in enumerate(FEATURES)]
    first = off.groupBy("g").agg(F.first("m").alias("m"), *[x.alias(f"v{i}") for i, x in enumerate(spread_)])
    now = written(first.select("g", "m", F.array(*[(1 / F.col(f"v{i}")) if i == j else F.lit(0.0) for i in range(k) for j in range(k)]).alias("p")))
    for _ in range(STEPS):
        near = vectors.join(now, "g").select("g", *FEATURES, _distance().alias("d2"))
        limit = written(near.groupBy("g").agg(F.percentile_approx("d2", SHARE, F.lit(10000)).alias("limit")))
        held = near.join(limit, "g").where("d2 <= limit")
        sums = [F.sum(f) for f in FEATURES]
        products = [F.sum(F.col(FEATURES[min(i, j)]) * F.col(FEATURES[max(i, j)])) for i in range(k) for j in range(k)]
        moments = held.groupBy("g").agg(F.count("*").alias("n"), F.array(*sums).alias("s"), F.array(*products).alias("q"))
        now = written(_inverted(moments, 1 / SHRUNK))
    return now


def judged(docs: DataFrame) -> DataFrame:
    """(doc, th), the statistics, kept and distance2 for each row of docs."""
    stats = written(grouped(written(statistics(docs))))
    found = estimates(stats.where("NOT base_failed").select(F.explode("feeds").alias("g"), *FEATURES))
    # Documents of a group that has no estimate failed the limits, as no passing document shares their group.
    out = stats.join(found, "g", "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= CUTOFF)
    return out.withColumn("kept", kept)


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2) for each row of docs."""
    return judged(docs).select(as_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep; rows alike in doc_id and text go together if one of them is rejected."""
    return met(docs, judged(docs).where("NOT kept").select("doc", "th").distinct(), "left_anti").select(*docs.columns)
