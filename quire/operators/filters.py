"""Scopes, facet filters, worklists and projections. Filters come before any ranking or limit."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed_pages

RIGHTS = ("public_domain", "licensed", "restricted", "unknown")


def scope_mine(docs: DataFrame, user: int | None, owner: str = "uploaded_by") -> DataFrame:
    """FIL-01: a user's own rows; without a user there are none."""
    return docs.where(F.lit(False) if user is None else F.col(owner) == user)


def ids_of(tokens: Iterable[str]) -> list[int]:
    """FIL-03: numbers among request tokens; the rest is dropped."""
    return [int(t) for t in tokens if t.strip().isdigit()]


def by_ids(docs: DataFrame, tokens: Iterable[str], key: str = "doc_id") -> DataFrame:
    """FIL-03: without a single number the filter does not apply."""
    ids = ids_of(tokens)
    return docs.where(F.col(key).isin(ids)) if ids else docs


def by_dimension(docs: DataFrame, bridge: DataFrame, dimension: DataFrame, condition: Column, doc: str = "doc_id", key: str = "author_id") -> DataFrame:
    """FIL-04, FIL-06, FIL-07, JON-02: documents with a bridged row of the dimension that meets the condition; each once."""
    return docs.join(bridge.join(dimension.where(condition).select(key), key, "left_semi"), doc, "left_semi")


def by_authors(docs: DataFrame, bridge: DataFrame, authors: DataFrame, values: list[str]) -> DataFrame:
    """FIL-02: by name where a name matches, else by id; values that match nothing leave nothing."""
    if not values:
        return docs
    named = authors.where(F.col("name").isin(values))
    numbered = authors.where(F.col("author_id").isin(ids_of(values))).join(named.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")
    return docs.join(bridge.join(named.select("author_id").unionByName(numbered.select("author_id")), "author_id", "left_semi"), "doc_id", "left_semi")


def by_values(docs: DataFrame, column: str, values: list[str], allowed: Iterable[str] | None = None) -> DataFrame:
    """FIL-05, FIL-09, FIL-10: exact membership; values outside `allowed` are dropped, and no value means no filter."""
    values = [v for v in values if v and (allowed is None or v in set(allowed))]
    return docs.where(F.col(column).isin(values)) if values else docs


def any_case(column: str, values: list[str]) -> Column:
    """FIL-06."""
    return F.lower(column).isin([v.lower() for v in values])


def centuries(tokens: Iterable[str], least: int = 1, most: int = 20) -> list[int]:
    """FIL-07, FIL-10: centuries among tokens, those outside dropped."""
    return [n for n in ids_of(tokens) if least <= n <= most]


def by_dates(docs: DataFrame, column: str, since: str | None, until: str | None) -> DataFrame:
    """FIL-08: days inclusive on both sides; a malformed bound does not apply."""
    def bound(text, test):
        day = F.to_date(F.lit(text)) if text is None else F.try_to_date(F.lit(text))
        return F.coalesce(test(F.to_date(column), day), day.isNull()) if text is not None else F.lit(True)
    return docs.where(bound(since, lambda a, b: a >= b) & bound(until, lambda a, b: a <= b))


def by_meta(docs: DataFrame, meta: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """FIL-10, JON-06: by facets of the 1:1 metadata."""
    for column, values in wanted.items():
        meta = by_values(meta, column, values) if values and isinstance(values[0], str) else meta.where(F.col(column).isin(values)) if values else meta
    return docs.join(meta, "doc_id", "left_semi") if any(wanted.values()) else docs


def active(mentions: DataFrame) -> DataFrame:
    """FIL-16: neither superseded nor rejected."""
    return mentions.where(F.col("superseded_at").isNull() & (F.col("review_status") != "rejected"))


def by_mentions(docs: DataFrame, mentions: DataFrame, persons: list[int] = (), places: list[int] = (), quran: list[str] = (), collections: list[str] = ()) -> DataFrame:
    """FIL-11, JSN-02: each given facet must be met by some active mention; suras and sura:aya among one facet are alternatives."""
    live = active(mentions)
    path = lambda p: F.get_json_object("normalized", p)
    if persons:
        docs = docs.join(live.where(F.col("person_id").isin(list(persons))), "doc_id", "left_semi")
    if places:
        docs = docs.join(live.where(F.col("place_id").isin(list(places))), "doc_id", "left_semi")
    if quran:
        test = F.lit(False)
        for token in quran:
            sura, _, aya = token.partition(":")
            if sura.isdigit() and (not aya or aya.isdigit()):
                one = path("$.sura").cast("int") == int(sura)
                if aya:
                    first = path("$.aya_start").cast("int")
                    one = one & (first <= int(aya)) & (F.coalesce(path("$.aya_end").cast("int"), first) >= int(aya))
                test = test | one
        docs = docs.join(live.where((F.col("entity_type") == "quran") & test), "doc_id", "left_semi")
    if collections:
        docs = docs.join(live.where((F.col("entity_type") == "hadith_source") & path("$.collection").isin(list(collections))), "doc_id", "left_semi")
    return docs


class Facets:
    """FIL-12: registered facet names, each with the column (scalar or array) of the index that it tests."""

    def __init__(self):
        self.known: dict[str, Callable[[list], Column]] = {}

    def register(self, name: str, column: str, array: bool = False, kind: str = "string") -> None:
        def test(values):
            wanted = [F.lit(v).cast(kind) for v in values]
            return F.arrays_overlap(F.col(column), F.array(*wanted)) if array else F.col(column).isin([v for v in values])
        self.known[name] = test

    def clauses(self, wanted: dict[str, list]) -> Column:
        """The conjunction; unknown names raise, blank values are dropped."""
        unknown = sorted(set(wanted) - set(self.known))
        if unknown:
            raise ValueError(f"unknown facets: {', '.join(unknown)}")
        out = F.lit(True)
        for name, values in wanted.items():
            values = [v for v in values if str(v).strip()]
            if values:
                out = out & self.known[name](values)
        return out


def contains_any(query: str, *columns: str) -> Column:
    """FIL-14: substring in any case in one of the columns."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return out


def typeahead(rows: DataFrame, names: DataFrame, key: str, query: str, folded: str, counts: DataFrame, most: int = 20) -> DataFrame:
    """FIL-15: rows whose own name holds the query or of whose normalised names one begins with it; most documents first."""
    hit = rows.where(contains_any(query, "name")).select(key).unionByName(names.where(F.col("normalized").startswith(folded)).select(key)).distinct()
    ranked = rows.join(hit, key, "left_semi").join(counts, key, "left").withColumn("docs", F.coalesce("docs", F.lit(0).cast("long")))
    return ranked.orderBy(F.desc("docs"), "name", key).limit(most)


def of_user(rows: DataFrame, user: int, doc: int | None = None) -> DataFrame:
    """FIL-17."""
    return rows.where((F.col("user_id") == user) & (F.lit(True) if doc is None else F.col("doc_id") == doc))


def worklist(docs: DataFrame, most: int, status: str = "failed") -> DataFrame:
    """FIL-18: oldest first."""
    return docs.where(F.col("status") == status).orderBy("uploaded_at", "doc_id").limit(most)


def stale_vectors(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """FIL-19: without a vector of the right size."""
    return rows.where(F.coalesce(F.size(vector), F.lit(-1)) != size)


def of_country(docs: DataFrame, bridge: DataFrame, authors: DataFrame, country: str) -> DataFrame:
    """FIL-20: each document once, by its first matching author's name."""
    named = bridge.join(authors.where(F.lower("nationality") == country.lower()), "author_id").groupBy("doc_id").agg(F.min("name").alias("author"))
    return docs.join(named, "doc_id").orderBy("author", "doc_id")


def changed(rows: DataFrame, column: str, fresh: Column) -> DataFrame:
    """FIL-21: rows whose derived value differs, nulls told apart, with the new one."""
    return rows.withColumn("fresh", fresh).where(~F.col(column).eqNullSafe(F.col("fresh")))


def unparseable(rows: DataFrame, source: str, fresh: Column) -> DataFrame:
    """FIL-21: how many sources say something that does not parse."""
    return rows.agg(F.count_if((F.coalesce(F.trim(F.col(source)), F.lit("")) != "") & fresh.isNull()).alias("unparseable"))


def list_row(docs: DataFrame) -> DataFrame:
    """PRJ-01: without content and vectors."""
    return docs.drop("content", "text", "semantic_vector", "embedding")


def scores_for_mode(rows: DataFrame, mode: str) -> DataFrame:
    """PRJ-02: scores that a mode does not compute are null."""
    null = F.lit(None).cast("double")
    return rows.withColumns({"lexical_score": null if mode == "semantic" else F.col("lexical_score"), "semantic_score": null if mode == "exact" else F.col("semantic_score")})


def status_row(docs: DataFrame) -> DataFrame:
    """PRJ-03."""
    return docs.select("doc_id", (F.col("status") == "succeeded").alias("processed"), F.length("content").alias("content_length"), F.coalesce(F.size("semantic_vector"), F.lit(0)).alias("vector_size"))


def author_detail(bridge: DataFrame, most: int = 50) -> DataFrame:
    """PRJ-04: number of documents of each author, and the first of them by id (a bounded heap each, not a sorted group)."""
    return bridge.groupBy("author_id").agg(F.countDistinct("doc_id").alias("total"), F.slice(F.array_sort(F.collect_set("doc_id")), 1, most).alias("first_docs"))


def continue_rows(progress: DataFrame, docs: DataFrame, user: int, most: int = 8) -> DataFrame:
    """PRJ-05, LIM-04: where a user reads, latest first, with the number of pages."""
    latest = progress.where(F.col("user_id") == user).orderBy(F.desc("updated_at"), "doc_id").limit(max(1, min(most, 50)))
    return latest.join(docs.select("doc_id", F.size(fixed_pages("content")).alias("total_pages")), "doc_id").orderBy(F.desc("updated_at"), "doc_id")
