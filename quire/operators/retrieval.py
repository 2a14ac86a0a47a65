"""Ranked retrieval: index rows, lexical and vector matching, blends, and search within a document.

An index has the postings of each analysis, which quire.sources.index writes by buckets of words, so a search reads the
postings of its words alone. Scope and gates apply before scores are ranked or cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..plans.spec import Query, Term, checked
from ..sources.index import ANALYSES, Postings
from .aggregates import max_normalized
from .joins import intervals, union_scores
from .windows import first_writers, none_of

# BM25's parameters, the boosts of the fields, the blend, and the bars of in-document search.
K1, B = 1.2, 0.75
BOOSTS = {"title": 2.0, "authors": 1.5, "categories": 1.5, "description": 1.2, "alternate_names": 1.3, "content": 1.0}
LEXICAL, SEMANTIC = 0.60, 0.40
STRICT, LENIENT, LENIENT_TOP, PAGE_MARKS = 0.5, 0.3, 20, 0.25


def index_rows(docs: DataFrame, doc_authors: DataFrame, authors: DataFrame, doc_categories: DataFrame, categories: DataFrame, vector_size: int, rollups: DataFrame | None = None) -> DataFrame:
    """IDX-01, SRC-01: one wide row for each document."""
    a = doc_authors.join(authors, "author_id").groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("alternate_names", F.array().cast("array<string>"))))))), " ").alias("authors"),
        F.array_sort(F.collect_set(F.nullif(F.col("nationality"), F.lit("")))).alias("countries"),
        F.array_sort(F.collect_set("death_century")).alias("centuries"),
    )
    c = doc_categories.join(categories, "category_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("categories"))
    usable = (F.size("semantic_vector") == vector_size) & F.exists("semantic_vector", lambda x: x != 0)
    out = docs.withColumn("semantic_vector", F.when(usable, F.col("semantic_vector"))).join(a, "doc_id", "left").join(c, "doc_id", "left")
    return out.join(rollups, "doc_id", "left") if rollups is not None else out


def bm25(index: Postings, query: list[str], keep: DataFrame | None = None, need_all: bool = False) -> DataFrame:
    """LEX-01, LEX-04, LEX-05: (doc_id, field, score) with each token counted once; need_all asks for every token in a field.

    Document frequencies and mean lengths are over the whole index, the scope `keep` cuts scored documents only. The
    postings of the query's words are all that is read.
    """
    wanted = sorted(set(query))
    tf = index.of(wanted).select("doc_id", "field", "token", "tf", "dl")
    df = tf.groupBy("field", "token").agg(F.count("*").alias("df"))
    if keep is not None:
        tf = tf.join(keep.select("doc_id"), "doc_id", "left_semi")
    # df and stats have a row for each query token and field.
    rows = tf.join(F.broadcast(df), ["field", "token"]).join(F.broadcast(index.stats), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = rows.groupBy("doc_id", "field").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    return (out.where(f"matched = {len(wanted)}") if need_all else out).drop("matched")


def bm25_scan(docs: DataFrame, query: list[str], column: str = "content", analysis: str = "raw", keep: Column | None = None, need_all: bool = False) -> DataFrame:
    """LEX-04 without an index: (doc_id, score) of one field by two passes over the texts, with nothing shuffled but one row
    of statistics. Words are counted inside each document, so no row is made for a word."""
    wanted = sorted(set(query))
    t = docs.select("doc_id", (F.lit(True) if keep is None else keep).alias("_keep"), ANALYSES[analysis](column).alias("_t"))
    t = t.select("doc_id", "_keep", F.size("_t").alias("_dl"), *[F.size(F.filter("_t", _equals(w))).alias(f"_f{i}") for i, w in enumerate(wanted)])
    n = F.count_if(F.col("_dl") > 0)
    stats = t.agg(n.alias("_n"), (F.sum("_dl") / n).alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(wanted))])
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(wanted)):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_n") - d + 0.5) / (d + 0.5))
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))).otherwise(0.0)
        every = every & (f > 0)
    # The test is on the score, which needs the statistics: on the counts it would be pushed down and count words twice.
    out = t.where(F.coalesce(F.col("_keep"), F.lit(False))).join(F.broadcast(stats))
    return out.select("doc_id", (F.when(every, score) if need_all else score).alias("score")).where("score > 0")


def _equals(word: str):
    return lambda t: t == word


def best_fields(scores: DataFrame, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """LEX-01: the best boosted field of each document."""
    boost = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in boosts.items() for x in p]), F.col("field")), F.lit(1.0))
    return scores.groupBy("doc_id").agg(F.max(F.col("score") * boost).alias("score"))


def edits(fuzziness, word: str) -> int:
    """LEX-06: AUTO allows 0, 1 or 2 edits for up to 2, up to 5, or more letters."""
    return (0 if len(word) < 3 else 1 if len(word) <= 5 else 2) if fuzziness == "AUTO" else int(fuzziness)


def fuzzy_vocabulary(index: Postings, word: str, fuzziness="AUTO") -> DataFrame:
    """LEX-06, STR-18: words of the index within the edits of a query word; lengths are compared before distances."""
    k = edits(fuzziness, word)
    near = index.vocabulary.where(F.abs(F.length("token") - len(word)) <= k).select("token")
    return near.withColumn("distance", F.levenshtein(F.col("token"), F.lit(word), k)).where("distance >= 0")


def phrase(index: Postings, query: list[str]) -> DataFrame:
    """LEX-07: (doc_id, field, pos) where the words stand in order next to each other.

    Each word's place less its own offset is where the phrase would start: the phrase is there if all offsets agree.
    """
    words = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(i).alias("i")) for i, w in enumerate(query)])
    q = index.rows.sparkSession.range(1).select(F.explode(words).alias("q")).select("q.token", "q.i")
    hits = index.of(query).join(F.broadcast(q), "token").select("doc_id", "field", "i", F.explode("places").alias("at"))
    starts = hits.select("doc_id", "field", (F.col("at") - F.col("i")).alias("pos"), "i")
    return starts.groupBy("doc_id", "field", "pos").agg(F.countDistinct("i").alias("n")).where(f"n = {len(query)}").drop("n")


def analysis_of(term: Term) -> str:
    """LEX-02: stemmed, as typed, or folded."""
    return "stem" if term.match == "stem" else "raw" if term.diacritics == "sensitive" else "exact"


def analyzed(spark, term: Term) -> list[str]:
    """A term's words, by the analysis of its postings."""
    return spark.range(1).select(ANALYSES[analysis_of(term)](F.lit(term.text)).alias("t")).first().t


def term_matches(index: dict[str, Postings], term: Term) -> DataFrame:
    """LEX-02, STR-19: (doc_id, field, score) of one term."""
    posts = index[analysis_of(term)]
    words = analyzed(posts.rows.sparkSession, term)
    if not words:
        return posts.rows.select("doc_id", "field", F.lit(0.0).alias("score")).where("false")
    if term.match == "phrase":
        found = phrase(posts, words).select("doc_id", "field").distinct()
        return bm25(posts, words, found.where("field <> 'categories'").select("doc_id").distinct()).join(found, ["doc_id", "field"], "left_semi")
    if term.match == "fuzzy":
        parts = []
        for i, w in enumerate(dict.fromkeys(words)):
            near = fuzzy_vocabulary(posts, w, term.fuzziness).withColumn("weight", 1 - F.col("distance") / F.greatest(F.lit(len(w)), F.length("token")))
            parts.append(posts.among(near).groupBy("doc_id", "field").agg(F.max("weight").alias("score")).withColumn("i", F.lit(i)))
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy("doc_id", "field").agg(F.sum("score").alias("score"), F.countDistinct("i").alias("n")).where(f"n = {len(parts)}").drop("n")
    return bm25(posts, words, need_all=True)


def boolean(index: dict[str, Postings], terms: tuple[Term, ...], keep: DataFrame | None = None) -> DataFrame:
    """LEX-03, LEX-08: (doc_id, lexical_score, term_hits): all musts, one should if there are any, no must_not, within `keep`."""
    parts = [best_fields(term_matches(index, t)).withColumns({"i": F.lit(i), "op": F.lit(t.op)}) for i, t in enumerate(terms)]
    every = reduce(DataFrame.unionByName, parts)
    if keep is not None:
        every = every.join(keep.select("doc_id"), "doc_id", "left_semi")
    count = lambda op: sum(t.op == op for t in terms)
    has = lambda op: F.count_if(F.col("op") == op)
    positive = F.col("op") != "must_not"
    out = every.groupBy("doc_id").agg(F.sum(F.when(positive, F.col("score"))).alias("lexical_score"), F.array_sort(F.collect_set(F.when(positive, F.col("i")))).alias("term_hits"), has("must").alias("m"), has("should").alias("s"), has("must_not").alias("x"))
    ok = (F.col("m") == count("must")) & (F.col("x") == 0)
    return out.where(ok & (F.col("s") > 0) if count("should") else ok).drop("m", "s", "x")


def gated(index: dict[str, Postings], terms: tuple[Term, ...], keep: DataFrame) -> DataFrame:
    """SEM-04: documents of the scope that meet musts and must_nots, whatever the shoulds."""
    for t in terms:
        if t.op != "should":
            keep = keep.join(term_matches(index, t).select("doc_id").distinct(), "doc_id", "left_semi" if t.op == "must" else "left_anti")
    return keep


def knn(vectors: DataFrame, query, k: int, keep: DataFrame | None = None, key: str = "doc_id", column: str = "embedding") -> DataFrame:
    """SEM-03: the k documents nearest by cosine within the scope; scores are (1 + cosine) / 2, ties by id."""
    rows = vectors if keep is None else vectors.join(keep.select(key), key, "left_semi")
    score = (1 + V.cosine(column, V.literal(query))) / 2
    return rows.select(key, score.alias("semantic_score")).orderBy(F.desc("semantic_score"), key).limit(k)


def chunk_scores(chunks: DataFrame, query, column: str = "embedding") -> DataFrame:
    """SEM-06: similarity of each chunk, never below 0."""
    return chunks.withColumn("similarity", F.greatest(F.lit(0.0), V.cosine(column, V.literal(query))))


def best_pages(scored: DataFrame, bar: float = STRICT, most: int | None = None) -> DataFrame:
    """SEM-07: of each page its best chunk, if it passes the bar, the most similar first."""
    out = first_writers(scored, ["doc_id", "page"], [F.desc("similarity"), "chunk_index"]).where(F.col("similarity") >= bar).orderBy(F.desc("similarity"), "doc_id", "page")
    return out.limit(most) if most else out


def blended(lexical: DataFrame, semantic: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """HYB-01, JON-04, AGG-16: both scores divided by their largest, 0.60 and 0.40 of them; lexical alone without the other."""
    lex = max_normalized(lexical, "lexical_score", "lexical_score_n").select(key, F.col("lexical_score_n").alias("lexical_score"))
    if semantic is None:
        return lex.withColumns({"semantic_score": F.lit(None).cast("double"), "score": F.col("lexical_score")})
    sem = max_normalized(semantic, "semantic_score", "n").select(key, F.col("n").alias("semantic_score"))
    return union_scores(lex, sem, key).withColumn("score", LEXICAL * F.col("lexical_score") + SEMANTIC * F.col("semantic_score"))


def search(index: dict[str, Postings], docs: DataFrame, vectors: DataFrame | None, query: Query) -> tuple[DataFrame, str | None]:
    """HYB-02: ranked documents of `docs` (which has the filters applied) and why the mode was degraded, if it was."""
    query = checked(query)
    keep = docs.select("doc_id")
    if query.scope == "selected":
        keep = keep.where(F.col("doc_id").isin(list(query.ids)))
    can = vectors is not None and query.vector is not None
    degraded = None if query.mode == "exact" or can else "no_vector"
    k = min(max(query.size, 1) * max(query.page, 1), 100)
    near = knn(vectors, query.vector, k, gated(index, query.terms, keep)) if can and query.mode != "exact" else None
    if query.mode == "semantic" and near is not None:
        sem = max_normalized(near, "semantic_score", "n").select("doc_id", F.lit(None).cast("double").alias("lexical_score"), F.col("n").alias("semantic_score"), F.col("n").alias("score"))
        return sem.orderBy(F.desc("score"), "doc_id"), degraded
    lexical = boolean(index, query.terms, keep)
    return blended(lexical.select("doc_id", "lexical_score"), near).orderBy(F.desc("score"), "doc_id"), degraded


def page_of_results(ranked: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """LIM-01 over search results, at most 200 of them."""
    return ranked.orderBy(F.desc("score"), "doc_id").limit(200).offset((max(page, 1) - 1) * size).limit(size)


def list_search(index: Postings, docs: DataFrame, words: list[str], fallback: str | None = None) -> DataFrame:
    """HYB-12: the ten best by the fields, or a substring match where the index cannot answer."""
    if fallback is not None:
        return docs.where(F.contains(F.lower("content"), F.lit(fallback.lower()))).orderBy("doc_id")
    return best_fields(bm25(index, words, docs)).orderBy(F.desc("score"), "doc_id").limit(10)


def expansion(index: Postings, lexical: DataFrame, semantic: DataFrame, most: int = 10) -> DataFrame:
    """HYB-08: words that stand out in what a fuzzy and a vector search found (200 by score)."""
    from .aggregates import significant_terms

    ranked = lexical.select("doc_id", F.col("lexical_score").alias("s")).unionByName(semantic.select("doc_id", F.col("semantic_score").alias("s")))
    fg = ranked.groupBy("doc_id").agg(F.max("s").alias("s")).orderBy(F.desc("s"), "doc_id").limit(200)
    return significant_terms(index.rows.select("doc_id", "token"), fg, most, background=index.background())


def assisted(guesses: DataFrame, known: DataFrame, free: str) -> DataFrame:
    """HYB-09: facet guesses (facet, value) that are known, and the free text with those that are not appended, one row."""
    hit = guesses.withColumn("low", F.lower("value")).join(known.select("facet", F.lower("value").alias("low"), F.col("value").alias("resolved")), ["facet", "low"], "left")
    own = F.array_sort(F.collect_list(F.when(F.col("resolved").isNotNull(), F.concat_ws("=", "facet", "resolved"))))
    rest = F.array_sort(F.collect_list(F.when(F.col("resolved").isNull(), F.col("value"))))
    return hit.agg(own.alias("facets"), F.trim(F.concat_ws(" ", F.lit(free), F.array_join(rest, " "))).alias("text"))


def first_snippet(columns: list[str], plain: bool = False) -> Column:
    """LEX-10: the first non-empty highlight by priority of its field."""
    out = F.coalesce(*[F.when(F.size(c) > 0, F.get(c, F.lit(0))) for c in columns])
    return T.strip_marks(out) if plain else out


def attributed(frags: DataFrame, pages: DataFrame) -> DataFrame:
    """LEX-11: the page of each fragment (doc_id, frag_id, snippet): the page that holds it whole, else one that holds its
    longest piece between page breaks, else its longest line; null where none does."""
    plain = T.squeeze_space(T.strip_marks("snippet"))
    longest = lambda a: F.element_at(F.array_sort(F.transform(a, lambda x: F.struct(F.length(T.squeeze_space(x)).alias("n"), T.squeeze_space(x).alias("t")))), -1).t
    bare = T.strip_marks("snippet")
    tries = F.array(F.struct(F.lit(0).alias("rank"), plain.alias("t")), F.struct(F.lit(1).alias("rank"), longest(F.split(bare, r"\f|\n{3,}")).alias("t")), F.struct(F.lit(2).alias("rank"), longest(F.split(bare, "\n")).alias("t")))
    asked = frags.select("doc_id", "frag_id", F.explode(tries).alias("q")).select("doc_id", "frag_id", "q.rank", "q.t").where("t <> ''")
    hit = asked.join(pages.select("doc_id", "page", T.squeeze_space("content").alias("_c")), "doc_id").where(F.contains("_c", "t"))
    best = hit.groupBy("doc_id", "frag_id").agg(F.min(F.struct("rank", "page")).alias("m")).select("doc_id", "frag_id", F.col("m.page").alias("page"))
    return frags.join(best, ["doc_id", "frag_id"], "left")


def absorbed(frags: DataFrame, schema: str) -> DataFrame:
    """LEX-12: fragments (doc_id, page, seq, plain, marks, terms) of a page that hold each other become one: the richer stays
    in the earlier one's place with the terms of both. Order decides, so a page is one task."""

    def fold(pdf):
        kept = []
        for row in pdf.sort_values("seq").to_dict("records"):
            for k, other in enumerate(kept):
                if row["plain"] in other["plain"] or other["plain"] in row["plain"]:
                    terms = sorted({*other["terms"], *row["terms"]})
                    best = row if row["marks"] > other["marks"] else other
                    kept[k] = {**best, "seq": other["seq"], "terms": terms}
                    break
            else:
                kept.append({**row, "terms": sorted(row["terms"])})
        import pandas as pd

        return pd.DataFrame(kept, columns=pdf.columns)

    return frags.groupBy("doc_id", "page").applyInPandas(fold, schema)


def fragment_scores(frags: DataFrame) -> DataFrame:
    """LEX-13: marks + 0.25 * marks of the page, and that divided by the document's largest."""
    page, doc = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id")
    out = frags.withColumn("lex_raw", F.col("marks") + PAGE_MARKS * F.sum("marks").over(page))
    return out.withColumn("lexical_score", F.col("lex_raw") / F.max("lex_raw").over(doc))


def legacy_matches(index: dict[str, Postings], text: str, phrase_only: bool, ignore_diacritics: bool) -> DataFrame:
    """LEX-14: documents by the older query: a phrase; or stemmed words or fuzzy folded ones; or, as typed, fuzzy words."""
    side = "ignore" if ignore_diacritics else "sensitive"
    if phrase_only:
        return term_matches(index, Term(text, "phrase", diacritics=side)).select("doc_id").distinct()
    fuzzy = term_matches(index, Term(text, "fuzzy", diacritics=side)).select("doc_id")
    return (fuzzy.unionByName(term_matches(index, Term(text, "stem")).select("doc_id")) if ignore_diacritics else fuzzy).distinct()


def semantic_only(best: DataFrame, seen: DataFrame, bar: float = STRICT) -> DataFrame:
    """HYB-05: pages above the bar that no lexical match has."""
    return none_of(best.where(F.col("similarity") >= bar), seen.select("doc_id", "page").distinct(), ["doc_id", "page"]).select("doc_id", "page", F.lit(0.0).alias("lexical_score"), F.col("similarity").alias("semantic_score"), (SEMANTIC * F.col("similarity")).alias("score"), F.lit("semantic").alias("match_kind"))


def context_pages(ranked: DataFrame, pages: DataFrame, most: int = 10, budget: int = 60000) -> DataFrame:
    """HYB-06: distinct pages of the best matches in order, as long as their texts fit the budget."""
    best = ranked.orderBy(F.desc("score"), "doc_id", "page").limit(most)
    once = best.groupBy("doc_id", "page").agg(F.max("score").alias("score")).join(pages, ["doc_id", "page"])
    run = Window.orderBy(F.desc("score"), "doc_id", "page").rowsBetween(Window.unboundedPreceding, 0)  # at most ten rows
    return once.withColumn("used", F.sum(F.length("content")).over(run)).where(F.col("used") <= budget)


def neighbours(pages: DataFrame, doc: int, page: int) -> DataFrame:
    """HYB-07."""
    return pages.where((F.col("doc_id") == doc) & F.col("page").between(page - 1, page + 1)).orderBy("page")


def printed(citations: DataFrame, volumes: DataFrame) -> DataFrame:
    """STR-30, JON-08: citations (doc_id, page) with the volume and printed page that their page has, if any."""
    hit = intervals(citations, volumes, ["doc_id"], "page", "from_page", "to_page", ["from_page"])
    return hit.withColumn("printed_page", F.when(F.col("printed_start").isNotNull(), F.col("printed_start") + F.col("page") - F.col("from_page"))).drop("from_page", "to_page", "printed_start")
