"""Search within documents: words of pages with all their analyses, matches of terms, fragments, gates and blends.

A page's words are rows with the text before them, so a match is told by its own analysis and marked where it stands; a
page is cut to stretches of ``STRETCH`` characters, and each stretch with a match is a fragment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.spec import Term
from .retrieval import LENIENT, LENIENT_TOP, LEXICAL, SEMANTIC, STRICT, analysis_of, best_pages, chunk_scores, edits, fragment_scores, semantic_only

#: Characters of a fragment, and the most fragments of a page.
STRETCH, FRAGMENTS = 150, 50
#: What stands before a word, and a word with the marks that folding takes out.
PIECE = r"([^\p{L}\p{N}]*)([\p{L}\p{N}" + T.SKIPPED[1:-1] + "]+)"
PAGE = ["doc_id", "page"]


def page_words(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, before, word, raw, exact, stem, at): the words of pages; at is the character where one starts."""
    before, word = (F.regexp_extract_all("content", F.lit(PIECE), F.lit(g)) for g in (1, 2))
    rows = pages.select(*PAGE, F.posexplode(F.arrays_zip(before.alias("before"), word.alias("word"))).alias("pos", "w")).select(*PAGE, "pos", "w.before", "w.word")
    exact = T.normalize("word")
    stop = F.array(*[F.lit(w) for w in T.STOPWORDS])
    rows = rows.withColumns({"raw": F.lower("word"), "exact": exact, "stem": F.when(~F.array_contains(stop, exact), T.stem(exact))})
    ahead = Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("at", F.sum(F.length("before") + F.length("word")).over(ahead) - F.length("word"))


def words_of(spark, term: Term) -> list[str]:
    """A term's words, analysed as those of pages are."""
    one = spark.range(1).select(F.lit(0).alias("doc_id"), F.lit(0).alias("page"), F.lit(term.text).alias("content"))
    token = F.col(analysis_of(term))
    return [r.t for r in page_words(one).where(token.isNotNull()).orderBy("pos").select(token.alias("t")).collect()]


def _hit(term: Term, words: list[str], flag: str) -> tuple[Column, Column, Column]:
    """Of a term: whether a word is part of a match (the column `flag`), whether a page (grouped) has all of it, and its matches there."""
    token = F.col(analysis_of(term))
    if not words:
        return F.lit(False), F.lit(False), F.lit(0).cast("long")
    if term.match == "phrase":
        order = Window.partitionBy(*PAGE).orderBy("pos")
        whole = reduce(lambda a, b: a & b, [F.coalesce(F.lead(token, j).over(order) == w, F.lit(False)) if j else token == w for j, w in enumerate(words)])
        return whole, F.max(flag), F.count_if(flag)
    if term.match == "fuzzy":
        each = [F.coalesce(F.levenshtein(token, F.lit(w), edits(term.fuzziness, w)) >= 0, F.lit(False)) for w in dict.fromkeys(words)]
    else:
        each = [F.coalesce(token == w, F.lit(False)) for w in dict.fromkeys(words)]
    return reduce(lambda a, b: a | b, each), reduce(lambda a, b: a & b, [F.max(e) for e in each]), F.count_if(flag)


def term_words(pages: DataFrame, terms: tuple[Term, ...]) -> tuple[DataFrame, DataFrame]:
    """Words of pages with _m, the terms that mark them, and hits (doc_id, page, i, matches) of each term on each page."""
    words = page_words(pages)
    hits, marks = [], []
    for i, t in enumerate(terms):
        own = words_of(pages.sparkSession, t)
        flag, every, count = _hit(t, own, f"_f{i}")
        words = words.withColumn(f"_f{i}", flag)
        if t.match == "phrase" and len(own) > 1:  # all words of a match are marked, not only its first
            reach = Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(-(len(own) - 1), 0)
            words = words.withColumn(f"_m{i}", F.max(f"_f{i}").over(reach))
        else:
            words = words.withColumn(f"_m{i}", F.col(f"_f{i}"))
        hits.append(F.when(every, F.struct(F.lit(i).alias("i"), count.alias("matches"))))
        marks.append(F.when(F.col(f"_m{i}"), F.lit(i)))
    # Pages meet once for all terms.
    found = words.groupBy(*PAGE).agg(F.array_compact(F.array(*hits)).alias("h")).select(*PAGE, F.explode("h").alias("h")).select(*PAGE, "h.i", "h.matches")
    return words.withColumn("_m", F.array_compact(F.array(*marks))).drop(*[f"_{x}{i}" for x in "fm" for i in range(len(terms))]), found


def term_fragments(pages: DataFrame, terms: tuple[Term, ...], stretches: bool = False) -> DataFrame:
    """LEX-09: (doc_id, page, nth, snippet, marks, terms): fragments of pages with what the terms match marked, however they
    match; a term marks nothing on a page that it doesn't match whole. Terms of must_not mark nothing. With `stretches` the
    number of the stretch comes too."""
    words, hits = term_words(pages, terms)
    positive = F.array(*[F.lit(i) for i, t in enumerate(terms) if t.op != "must_not"]).cast("array<int>")
    on_page = hits.groupBy(*PAGE).agg(F.collect_set("i").alias("_p"))
    own = words.join(on_page, PAGE).withColumn("_m", F.array_intersect(F.array_intersect("_m", "_p"), positive)).withColumn("_s", F.floor(F.col("at") / STRETCH))
    # Words next to each other under the same terms are in one pair of marks.
    order = Window.partitionBy(*PAGE, "_s").orderBy("pos")
    marked, before, after = F.size("_m") > 0, F.lag("_m").over(order), F.lead("_m").over(order)
    own = own.withColumns({"_open": marked & ~before.eqNullSafe(F.col("_m")), "_close": marked & ~after.eqNullSafe(F.col("_m"))})
    piece = F.concat("before", F.when(F.col("_open"), "<mark>").otherwise(""), "word", F.when(F.col("_close"), "</mark>").otherwise(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("x")))), lambda p: p.x), "")
    made = own.groupBy(*PAGE, "_s").agg(F.trim(text).alias("snippet"), F.count_if("_open").alias("marks"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_m")))).alias("terms"))
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("_s")) - 1
    return made.where("marks > 0").withColumn("nth", nth).where(f"nth < {FRAGMENTS}").select(*PAGE, "nth", "snippet", "marks", "terms", *([F.col("_s").alias("stretch")] if stretches else []))


def fragments(pages: DataFrame, query: str, around: int = 75, most: int = FRAGMENTS) -> DataFrame:
    """LEX-09 for a literal query: (doc_id, page, nth, snippet, marks): windows of 75 characters before and after a match, all
    matches in it marked; a window begins after the one before. One pass of a pattern finds them."""
    window = "(?isu).{0," + str(around) + "}?\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E.{0," + str(around) + "}"
    one = pages.select(*PAGE, F.posexplode(F.slice(F.regexp_extract_all("content", F.lit(window), F.lit(0)), 1, most)).alias("nth", "cut"))
    return one.select(*PAGE, "nth", T.highlight("cut", query).alias("snippet")).withColumn("marks", T.mark_count("snippet"))


def in_document(pages: DataFrame, chunks: DataFrame | None, query: str, vector=None, mode: str = "mix", bar: float | None = None, top_k: int | None = None) -> DataFrame:
    """HYB-03: matches in documents: exact (the literal text), similar (stems or fuzzy words), semantic, mix or all."""
    strict, lenient = (STRICT, LENIENT) if bar is None else (bar, bar)
    best = chunk_scores(chunks, vector) if chunks is not None and vector is not None else None
    only = lambda rows: rows.select(*PAGE, F.lit(None).cast("double").alias("lexical_score"), F.col("similarity").alias("semantic_score"), F.col("similarity").alias("score"), F.lit("semantic").alias("match_kind"))
    empty = pages.select(*PAGE, *[F.lit(None).cast("double").alias(c) for c in ("lexical_score", "semantic_score", "score")], F.lit("").alias("match_kind")).where("false")

    def ranked(rows):
        rows = rows.orderBy(F.desc("score"), *PAGE)
        return rows.limit(top_k) if top_k else rows

    if mode == "semantic":
        return ranked(only(best_pages(best, strict))) if best is not None else empty
    found = None
    if mode in ("exact", "mix", "all"):
        found = fragments(pages, query).withColumn("match_kind", F.lit("exact" if mode in ("exact", "all") else "lexical"))
    if mode in ("similar", "mix", "all"):
        near = term_fragments(pages, (Term(query, "stem", op="should"), Term(query, "fuzzy", op="should")))
        near = near.select(*PAGE, "nth", "snippet", F.col("marks").cast("int").alias("marks"), F.lit("lexical").alias("match_kind"))
        # Pages that have the literal text keep its fragments.
        found = near if found is None else found.unionByName(near.join(found.select(*PAGE), PAGE, "left_anti"))
    lex = fragment_scores(found).groupBy(*PAGE, "match_kind").agg(F.max("lexical_score").alias("lexical_score"))
    if mode in ("exact", "similar") or best is None:
        return ranked(lex.select(*PAGE, "lexical_score", F.lit(None).cast("double").alias("semantic_score"), F.col("lexical_score").alias("score"), "match_kind"))
    page_best = best.groupBy(*PAGE).agg(F.max("similarity").alias("similarity"))
    both = lex.join(page_best, PAGE, "left").withColumn("semantic_score", F.coalesce("similarity", F.lit(0.0)))
    both = both.select(*PAGE, "lexical_score", "semantic_score", (LEXICAL * F.col("lexical_score") + SEMANTIC * F.col("semantic_score")).alias("score"), "match_kind")
    hit_docs = lex.select("doc_id").distinct()
    merged = semantic_only(page_best.join(hit_docs, "doc_id", "left_semi"), lex, strict)
    rest = only(best_pages(best.join(hit_docs, "doc_id", "left_anti"), lenient)).withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "page"))).where(f"_n <= {top_k or LENIENT_TOP}").drop("_n")
    return ranked(both.unionByName(merged).unionByName(rest))


def page_gates(hits: DataFrame, terms: tuple[Term, ...], pages: DataFrame) -> DataFrame:
    """HYB-04, SET-01, SET-02: pages with all musts and no must_not, of hits (doc_id, page, i); shoulds gate lexical pages only."""
    musts, nots = [i for i, t in enumerate(terms) if t.op == "must"], [i for i, t in enumerate(terms) if t.op == "must_not"]
    if not musts:
        out = pages.select(*PAGE).distinct()
        return out.join(hits.where(F.col("i").isin(nots)), PAGE, "left_anti") if nots else out
    no = F.count_if(F.col("i").isin(nots)) if nots else F.lit(0)
    met = hits.groupBy(*PAGE).agg(F.size(F.collect_set(F.when(F.col("i").isin(musts), F.col("i")))).alias("n"), no.alias("no"))
    return met.where(f"n = {len(musts)} AND no = 0").select(*PAGE)


def in_document_terms(pages: DataFrame, terms: tuple[Term, ...], chunks: DataFrame | None = None, vector=None, bar: float = STRICT, strict_should: bool = False) -> DataFrame:
    """HYB-04: several terms at once, each by its own kind of match and diacritics. strict_should makes shoulds gate semantic pages as well."""
    hits = term_words(pages, terms)[1]
    gates = page_gates(hits, terms, pages)
    on_page = hits.where(F.col("i").isin([i for i, t in enumerate(terms) if t.op != "must_not"])).groupBy(*PAGE).agg(F.array_sort(F.collect_set("i")).alias("term_hits"))
    lex = fragment_scores(term_fragments(pages, terms)).groupBy(*PAGE).agg(F.max("lexical_score").alias("lexical_score"))
    lex = lex.join(on_page, PAGE).join(gates, PAGE, "left_semi").select(*PAGE, "lexical_score", "term_hits")
    if chunks is None or vector is None:
        return lex.withColumns({"semantic_score": F.lit(None).cast("double"), "score": F.col("lexical_score")})
    best = chunk_scores(chunks, vector).groupBy(*PAGE).agg(F.max("similarity").alias("similarity")).join(gates, PAGE, "left_semi")
    if strict_should and any(t.op == "should" for t in terms):
        best = best.join(lex, PAGE, "left_semi")
    both = lex.join(best, PAGE, "left").select(*PAGE, "lexical_score", "term_hits", F.coalesce("similarity", F.lit(0.0)).alias("semantic_score"))
    both = both.withColumn("score", LEXICAL * F.col("lexical_score") + SEMANTIC * F.col("semantic_score"))
    more = semantic_only(best, lex, bar).drop("match_kind").withColumn("term_hits", F.array().cast("array<int>"))
    return both.unionByName(more)
