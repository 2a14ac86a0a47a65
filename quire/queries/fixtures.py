"""Queries over literal rows whose results are known; their SQL is those results as VALUES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import values as val
from ..functions import vectors as V
from ..operators import aggregates as agg
from ..operators import extraction as ext
from ..operators import filters as fil
from ..operators import geometry as geo
from ..operators import joins as jon
from ..operators import kb, linking, lookups
from ..operators import retrieval as ret
from ..operators import versioning as dml
from ..operators import windows as win
from ..operators import within
from ..plans.spec import Term
from ..sources import readers, sinks
from ..sources.index import unwritten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SQL_TYPES = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in v.split("\n"))
    return repr(v)


def known(schema: str, *rows: tuple):
    """The registered function's rows and their types; both sides are cast to the same."""
    names = [c.split(" ") for c in schema.split(", ")]
    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    cast = ", ".join(f'{n}::{SQL_TYPES[t]} AS {n}' for n, t in names)
    sql = f"SELECT {cast} FROM (VALUES {values}) AS t({', '.join(n for n, _ in names)})"

    def put(f):
        def run(spark, sf_dir):
            return f(spark).select(*[F.col(n).cast(t).alias(n) for n, t in names])

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = sql
        return f

    return put


def rows(spark, schema, *values):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def joined(c):
    """An array as text, so that it compares plainly."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# Dates.
DEATHS = [
    ("728 هـ", 728), ("728هـ", 728), ("728 ه", 728), ("728 هجرية", 728), ("728 AH", 728), ("728 A.H.", 728), ("728", 728), ("1447", 1447),
    ("٧٢٨هـ", 728), ("۷۲۸", 728), ("ت 728", 728), ("نحو 730 هـ", 730), ("توفي سنة 728", 728), ("حوالي 600", 600), ("728-730", 728), ("728/729 هـ", 728),
    ("728 هـ / 1328 م", 728), ("1328 م - 728 هـ", 728), ("1328 م", 728), ("1328 CE", 728), ("1328 AD", 728), ("1970", 1390), ("1500", 1500),
    ("د.ت", None), ("ت غ م", None), ("مجهول", None), ("القرن الخامس", None), ("5th century", None), ("0", None), ("5000 هـ", None),
]


@known("raw string, year int", *DEATHS)
def death_years(spark):
    return rows(spark, "raw string", *[r for r, _ in DEATHS]).select("raw", D.death_year("raw").alias("year"))


@known("year int, century int", (700, 7), (701, 8), (728, 8), (100, 1), (1, 1), (0, None))
def hijri_centuries(spark):
    return rows(spark, "year int", 700, 701, 728, 100, 1, 0).select("year", D.hijri_century("year").alias("century"))


@known("raw string, year int, century int", ("728 هـ", 728, 8), ("د.ت", None, None))
def death_fields(spark):
    return rows(spark, "raw string", "728 هـ", "د.ت").select("raw", D.death_fields("raw").alias("f")).select("raw", "f.year", "f.century")


@known("phrase string, year int", ("ثمان وعشرين وسبعمائه", 728), ("خمس عشره", 15), ("كذا", None))
def spelled_numbers(spark):
    return rows(spark, "phrase string", "ثمان وعشرين وسبعمائه", "خمس عشره", "كذا").select("phrase", D.spelled_number("phrase").alias("year"))


@known("marker string, year int, calendar string, confidence double", ("ه", 728, "hijri", 0.9), (None, 450, "hijri", 0.6), ("م", 1925, "gregorian", 0.9), (None, 1925, "gregorian", 0.6))
def calendars(spark):
    return rows(spark, "marker string, year int", ("ه", 728), (None, 450), ("م", 1925), (None, 1925)).select("marker", "year", D.calendar("marker", "year").alias("c")).select("marker", "year", "c.*")


@known("kind string, year int, hijri int, gregorian int", ("hijri", 728, 728, 1328), ("gregorian", 1328, 728, 1328), ("coptic", 1000, None, None))
def converted_years(spark):
    return rows(spark, "kind string, year int", ("hijri", 728), ("gregorian", 1328), ("coptic", 1000)).select("kind", "year", D.converted("kind", "year").alias("c")).select("kind", "year", "c.*")


@known("day string, left_seconds int", ("20240105", 3600), ("20240106", 86400))
def day_buckets(spark):
    t = rows(spark, "t string", "2024-01-05 23:00:00", "2024-01-06 00:00:00").select(F.to_timestamp_ntz("t").alias("t"))
    return t.select(D.day_bucket("t").alias("day"), D.seconds_to_midnight("t").alias("left_seconds"))


# Text.
NORMAL = [("الإِسْلامُ", "الاسلام"), ("مِشْكاةٌ", "مشكاه"), ("مُوسَى", "موسي"), ("العـــلم", "العلم"), ("سنة ٧٢٨ هـ", "سنه 728 ه"), ("۱۲۳", "123")]


@known("raw string, folded string", *NORMAL)
def text_normalized(spark):
    return rows(spark, "raw string", *[r for r, _ in NORMAL]).select("raw", T.normalize("raw").alias("folded"))


@known("shadow string, places string, start int, finish int", ("موسي", "0,2,3,5", 2, 6))
def shadow_maps(spark):
    s = rows(spark, "raw string", "مُوسَى").select(T.shadow_map("raw").alias("s"))
    o = T.to_original(F.col("s.map"), F.lit(1), F.lit(4))
    return s.select("s.shadow", joined(F.col("s.map")).alias("places"), o.start.alias("start"), o.end.alias("finish"))


@known("shadow string, places string", ("a b", "0,1,4"))
def collapsed_shadows(spark):
    return rows(spark, "raw string", "a  \nb").select(T.collapsed_shadow("raw").alias("s")).select("s.shadow", joined(F.col("s.map")).alias("places"))


@known("n int, place int", (1, 0), (2, 1), (3, 2), (4, None))
def nth_places(spark):
    return rows(spark, "n int", 1, 2, 3, 4).select("n", T.find_nth(F.lit("aaaa"), F.lit("aa"), F.col("n")).alias("place"))


@known("surface string, n int, start int, finish int", ("ab", 2, 3, 5), ("ab", 9, 0, 2), ("AB", 1, 0, 2), ("zz", 1, None, None))
def located_surfaces(spark):
    q = rows(spark, "surface string, n int", ("ab", 2), ("ab", 9), ("AB", 1), ("zz", 1)).withColumn("focus", F.lit("ab ab"))
    return q.select("surface", "n", T.locate_in_focus("focus", "surface", F.col("n")).alias("s")).select("surface", "n", "s.start", F.col("s.end").alias("finish"))


@known("raw string, plain string", ("**bold** and [text](http://x) ![i](y)", "bold and text "), ("`code` <b>x</b> _em_", "code x em"))
def markdown_cleaned(spark):
    return rows(spark, "raw string", "**bold** and [text](http://x) ![i](y)", "`code` <b>x</b> _em_").select("raw", T.markdown_clean("raw").alias("plain"))


@known("raw string, mark_key string, direction string", ("Abc, دِ!", "abcد", "ltr"), ("سلام", "سلام", "rtl"), ("12", "12", None))
def match_keys(spark):
    return rows(spark, "raw string", "Abc, دِ!", "سلام", "12").select("raw", T.match_key("raw").alias("mark_key"), T.direction("raw").alias("direction"))


NAMES = [
    ("ابو حامد الغزالي", "ابو حامد", None, None, None, "الغزالي", "ابو حامد"),
    ("ابن تيميه", None, "ابن تيميه", None, None, None, "ابن تيميه"),
    ("محمد بن احمد الذهبي", None, None, "محمد", "بن احمد", "الذهبي", "محمد"),
]


@known("name string, kunya string, shuhra string, ism string, nasab string, nisba string, block string", *NAMES)
def name_parts(spark):
    return rows(spark, "name string", *[n[0] for n in NAMES]).select("name", T.name_parts("name").alias("p"), T.blocking_key("name").alias("block")).select("name", "p.*", "block")


@known("raw string, bare string, cased string", ("أبا بكر محمد", "محمد", "ابو بكر محمد"))
def kunya_names(spark):
    return rows(spark, "raw string", "أبا بكر محمد").select("raw", T.name_without_kunya("raw").alias("bare"), T.kunya_case("raw").alias("cased"))


@known("n int, pages string", (0, "1,3,12"),)
def citation_extract(spark):
    return rows(spark, "t string", '<cite page="3">x</cite> see [p](#p-12) and [q](#p-1) <cite page="12">').select(F.lit(0).alias("n"), joined(T.cited_pages("t")).alias("pages"))


@known("raw string, slug string, title string", ("Hello, World!", "hello-world", "Hello, World!"))
def slugs_and_titles(spark):
    return rows(spark, "raw string", "Hello, World!").select("raw", T.slug("raw").alias("slug"), T.title_of("raw").alias("title"))


@known("raw string, cut string", ("One. Two. Three", "One. Two."), ("short", "short"))
def sentence_cuts(spark):
    return rows(spark, "raw string", "One. Two. Three", "short").select("raw", T.cut_at_sentence("raw", 12).alias("cut"))


@known("marked string, cut string", ("a <mark>Fox</mark> ran", "… a Fox ra…"))
def highlights(spark):
    return rows(spark, "t string", "a Fox ran").select(T.highlight("t", "fox").alias("marked"), T.snippet(F.concat(F.lit("b "), F.col("t")), "fox", 6).alias("cut"))


@known("digits string, back string, kind string, age string", ("١٢", "12", "PDF", "2 h ago"))
def locale_labels(spark):
    return rows(spark, "n int", 12).select(T.locale_digits("n").alias("digits"), T.locale_digits(T.locale_digits("n"), False).alias("back"), T.file_type(F.lit("a.pdf")).alias("kind"), T.relative_age(F.lit(7300)).alias("age"))


@known("raw string, pages string", ("1-3, 2,25", "1,2,3,25"), ("x,5-4", ""))
def page_lists(spark):
    return rows(spark, "raw string", "1-3, 2,25", "x,5-4").select("raw", joined(T.page_list("raw")).alias("pages"))


@known("raw string, found string", ("a, b,,a", "a,b"))
def csv_parameters(spark):
    return rows(spark, "raw string", "a, b,,a").select("raw", joined(T.csv_values(F.lit(" "), "raw")).alias("found"))


@known("n int, page int, content string", (0, 1, "a"), (0, 3, "b"), (1, 1, "x"), (1, 2, "y"), (2, 1, ""))
def page_splits(spark):
    t = rows(spark, "n int, t string", (0, "a\f \fb"), (1, "x\n\n\n\ny"), (2, ""))
    return t.select("n", F.explode(T.fixed_pages("t")).alias("p")).select("n", "p.*")


@known("page int, content string", (1, "one"), (2, "two"))
def markdown_page_splits(spark):
    return rows(spark, "t string", "{0}------\none\n{1}------\n\n{2}------\ntwo").select(F.explode(T.markdown_pages("t")).alias("p")).select("p.*")


@known("n int, plain string", (0, "A\nb c\nd & e"))
def html_blocks(spark):
    return rows(spark, "t string", "<h1>A</h1><p>b <b>c</b></p><td>d</td> &amp; e").select(F.lit(0).alias("n"), T.html_text("t").alias("plain"))


@known("n int, plain string", (0, "a\nb c"))
def markdown_sources(spark):
    return rows(spark, "t string", "﻿a\r\nb\fc").select(F.lit(0).alias("n"), T.markdown_source("t").alias("plain"))


@known("tags string, pinned int", ("a,b", 1))
def reader_validation(spark):
    t = spark.range(1).select(F.array(F.lit("a "), F.lit(""), F.lit("b")).alias("tags"), F.from_json(F.lit('[{"page":1,"text":"x","label":"l"},{"page":0,"text":"y","label":"l"}]'), "array<struct<page:int,text:string,label:string>>").alias("p"))
    return t.select(joined(T.tags_valid("tags")).alias("tags"), F.size(T.pinned_valid("p")).alias("pinned"))


@known("word string, stem string", ("المسلمون", "مسلم"), ("كتاب", "كتاب"), ("والكتب", "كتب"))
def light_stems(spark):
    return rows(spark, "word string", "المسلمون", "كتاب", "والكتب").select("word", T.stem(F.col("word")).alias("stem"))


# Numbers, arrays, JSON.


@known("a double, b double, c double", (0.0, 0.5, 1.0))
def clamps(spark):
    return spark.range(1).select(val.clamp01(F.lit(-2)).alias("a"), val.squash(F.lit(3.0)).alias("b"), val.clamp01(F.lit(7)).alias("c"))


@known("box string, spans string", ("0.0,1.0,5.0,6.0", "0.0-3.0,3.0-4.0"))
def boxes(spark):
    t = spark.range(1).select(F.expr("array(array(0D,2D,3D,4D), array(1D,1D,5D,6D))").alias("b"))
    spans = val.proportional_split(F.lit(0.0), F.lit(4.0), F.array(F.lit(3), F.lit(1)))
    return t.select(joined(val.box_union("b")).alias("box"), joined(F.transform(spans, lambda s: F.concat_ws("-", s.x0.cast("string"), s.x1.cast("string")))).alias("spans"))


@known("expanded string, capped string", ("1,2,3,7", "a,b"))
def array_sets(spark):
    t = spark.range(1).select(F.from_json(F.lit('[{"lo":1,"hi":3},{"lo":7,"hi":null},{"lo":3,"hi":2}]'), "array<struct<lo:int,hi:int>>").alias("r"))
    return t.select(joined(val.expand_ranges("r")).alias("expanded"), joined(val.capped_set(F.array(F.lit("c"), F.lit("b"), F.lit("a"), F.lit("b")), 2)).alias("capped"))


@known("raw string, body string", ('```json\n{"a": 1}\n```', '{"a": 1}'), ("none", None))
def lenient_json(spark):
    return rows(spark, "raw string", '```json\n{"a": 1}\n```', "none").select("raw", val.lenient_object("raw").alias("body"))


@known("name string, year int, sure double", ("x", 7, None))
def whitelisted_json(spark):
    return rows(spark, "j string", '{"name":"x","year":"7","sure":"no","other":1}').select(val.whitelisted("j", {"name": "string", "year": "int", "sure": "double"}).alias("w")).select("w.*")


@known("kind string, hijri_year int, hijri_year_to int, anchor string", ("hijri", 728, 728, None), ("hijri_range", 700, 710, None), ("relative", None, None, "after"))
def flat_times(spark):
    t = rows(spark, "j string", '{"kind":"hijri","year":728}', '{"kind":"hijri_range","year":700,"year_to":710}', '{"kind":"relative","anchor_text":"after"}')
    t = t.select(F.from_json("j", "struct<kind:string,year:int,month:int,day:int,year_to:int,approximate:boolean,anchor_text:string>").alias("t"))
    return t.select(val.flat_time("t").alias("f")).select(F.col("f.time_kind").alias("kind"), "f.hijri_year", "f.hijri_year_to", F.col("f.anchor_text").alias("anchor"))


@known("ref string", ("quran:2:1-3",), ("bukhari:52",), ("quran:3:5",))
def flat_refs(spark):
    t = rows(spark, "j string", '{"ref_kind":"quran","sura":2,"aya_start":1,"aya_end":3}', '{"ref_kind":"hadith","collection":"bukhari","number":52}', '{"ref_kind":"quran","sura":3,"aya_start":5}')
    return t.select(val.flat_ref(F.from_json("j", "struct<ref_kind:string,sura:int,aya_start:int,aya_end:int,collection:string,number:int>")).alias("ref"))


@known("rank string, level int", ("thiqa", 3), ("kadhdhab", 12), ("x", None))
def appraisal_levels(spark):
    return rows(spark, "rank string", "thiqa", "kadhdhab", "x").select("rank", kb.rank_level().alias("level"))


@known("n int, cosine double", (0, 1.0), (1, 0.6), (2, 0.0), (3, 0.0))
def cosine_cases(spark):
    t = rows(spark, "n int, a array<double>, b array<double>", (0, [1.0, 2.0], [2.0, 4.0]), (1, [1.0, 0.0, 0.0], [0.6, 0.8, 0.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [], [1.0]))
    return t.select("n", (F.floor(V.cosine("a", "b") * 1e6 + 0.5) / 1e6).alias("cosine"))


# Extraction.
PAGES = [
    (1, "كما في (سورة آل عمران: ١٠٢-١٠٤) من الآيات."), (2, "ذكر البقرة والنمل في كلامه عن الحيوان."), (3, "الحديث رواه البخاري (رقم ٥٢) في كتاب الإيمان."),
    (4, "أخرجه البخاري ومسلم في صحيحيهما."), (5, "أخرجه ابن ماجة في سننه."), (6, "وكان ذلك سنة ٧٢٨ هـ في دمشق."), (7, "ولد سنة ٤٥٠ ونشأ في بغداد."),
    (8, "صدرت الطبعة عام ١٩٢٥ م في القاهرة."), (9, "توفي رحمه الله سنة ثمان وعشرين وسبعمائة بدمشق."), (10, "في الفترة ٧١٢-٧٢٨ هـ تنقل بين الشام ومصر."),
]


def pages(spark):
    return rows(spark, "doc_id long, content string", *PAGES).withColumn("page", F.lit(1))


@known("doc_id long, key string, review boolean, held boolean", (1, "quran:3:102-104", False, True), (3, "bukhari:52", False, True), (4, "bukhari", False, True), (4, "muslim", False, True), (5, "ibnmajah", False, True), (6, "hijri:728", False, True), (7, "hijri:450", True, True), (8, "greg:1925", False, True), (9, "hijri:728", False, True), (10, "hijri:712-728", False, True))
def extracted_references(spark):
    m = ext.mentions(pages(spark), ["quran", "takhrij", "dates"]).join(pages(spark), ["doc_id", "page"])
    held = F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("surface")
    return m.select("doc_id", F.col("normalized_text").alias("key"), F.col("needs_review").alias("review"), held.alias("held"))


@known("key string, kind string", ("quran:2:255", "verse"), ("quran:2:255", "citation"), ("quran:unknown", "verse"))
def extracted_verses(spark):
    t = rows(spark, "doc_id long, page int, content string", (1, 1, "قال ﴿آية﴾ [البقرة: 255]"), (2, 1, "قال ﴿آية﴾ فقط"))
    return ext.mentions(t, ["quran"]).select(F.col("normalized_text").alias("key"), F.get_json_object("normalized", "$.kind").alias("kind"))


@known("key string, anchor string, confidence double", ("محمد", "death_marker", 0.85), ("ابن تيميه", "gazetteer", 0.9))
def extracted_persons(spark):
    t = rows(spark, "doc_id long, page int, content string", (1, 1, "محمد بن أحمد الذهبي (ت 748 هـ) و ابن تيمية"))
    people = rows(spark, "person_id long, display_name string, aliases array<string>", (7, "ابن تيمية", ["تقي"]))
    return ext.mentions(t, ["persons"], person_rows=people).select(F.col("normalized_text").alias("key"), F.get_json_object("normalized", "$.anchor").alias("anchor"), "confidence")


@known("key string, place long, review boolean", ("دمشق", 1, False), ("الدمشقي", 1, True))
def extracted_places(spark):
    t = rows(spark, "doc_id long, page int, content string", (1, 1, "في دمشق قال الدمشقي"))
    names = rows(spark, "place_id long, normalized string, kind string", (1, "دمشق", "name"), (1, "الدمشقي", "nisba"))
    return ext.mentions(t, ["places"], place_rows=names).select(F.col("normalized_text").alias("key"), F.get_json_object("normalized", "$.place_id").cast("long").alias("place"), F.col("needs_review").alias("review"))


@known("doc_id long, item int, page int, start int, finish int", (1, 0, 1, 0, 3), (1, 1, 1, 8, 11), (1, 2, 2, 0, 4), (1, 3, None, None, None))
def anchored_claims(spark):
    p = rows(spark, "doc_id long, page int, content string", (1, 1, "abc def abc"), (1, 2, "next page"))
    c = rows(spark, "doc_id long, item int, page int, surface string, nth int", (1, 0, 1, "abc", None), (1, 1, 1, "abc", None), (1, 2, 1, "«next»", None), (1, 3, 1, "gone", None))
    return ext.anchored(c, p).withColumnRenamed("end", "finish")


@known("item int, dropped string, confidence double", (0, None, 0.8), (1, "unknown_kind", 0.5), (2, None, 1.0))
def gated_claims(spark):
    c = rows(spark, "window_id long, item int, claim string, kind string, confidence double, evidence_found boolean", (1, 0, "mention", "person", 1.0, False), (1, 1, "mention", "alien", 0.5, True), (1, 2, "mention", "place", 3.0, True))
    return ext.gated_claims(c, {"mention": ["person", "place"]})


@known("src string, predicate string, dst string", ("b", "taught", "a"), ("c", "parent_of", "d"), ("w", "commentary_on", "v"))
def mapped_relations(spark):
    c = rows(spark, "type string, subtype string, subject string, object string", ("narrated_from", None, "a", "b"), ("kinship", "son", "d", "c"), ("work_derived", "sharh", "w", "v"), ("kinship", "cousin", "x", "y"))
    return ext.mapped_relations(c)


@known("node string, next_node string, tahwil_group long", ("a", "b", 0), ("b", "c", 1))
def isnad_chain(spark):
    t = rows(spark, "chain_id long, ord int, node string, switches boolean", (1, 0, "a", False), (1, 1, "b", True), (1, 2, "c", False))
    return win.chain_edges(t)


@known("quote_id long, person_mention long", (1, 10), (2, None))
def attributed_quotes(spark):
    q = rows(spark, "quote_id long, window_id long, speaker string", (1, 1, "مالك"), (2, 1, "احمد"))
    p = rows(spark, "window_id long, mention_id long, normalized string", (1, 11, "مالك"), (1, 10, "مالك"))
    return ext.attributed_quotes(q, p)


@known("doc_id long, page int", (1, 1), (1, 2), (1, 3), (1, 5), (1, 10), (1, 12), (1, 15), (1, 20))
def sampled_pages(spark):
    p = spark.range(1, 21).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page"), F.lit("x").alias("content"))
    ch = rows(spark, "doc_id long, page int", (1, 12), (1, 2), (1, 19))
    return ext.sampled_pages(p, ch)


@known("genre string, confidence double, others string", ("fiqh", 1.0, "hadith"))
def classified_answers(spark):
    a = rows(spark, "doc_id long, answer string", (1, '{"genre":"fiqh","madhhab":"zz","confidence":7,"secondary_genres":["fiqh","hadith","x"]}'))
    return ext.classified(a, {"genre": ["fiqh", "hadith"], "madhhab": ["hanafi"], "register": []}).select("genre", "confidence", joined(F.col("secondary_genres")).alias("others"))


@known("doc_id long, genre_hint string, era_hint int, playbook string", (1, "fiqh", 3, "law"), (2, None, None, "general"))
def rule_hints(spark):
    t = rows(spark, "doc_id long, title string, author_centuries array<int>", (1, "المغني في الفقه", [5, 3]), (2, "x", None))
    h = ext.rule_hints(t, {"fiqh": "الفقه", "tarikh": "تاريخ"})
    return h.withColumn("playbook", ext.playbook("genre_hint"))


@known("mention_id long, person_id long", (1, 5), (2, None), (3, None))
def tolerant_years(spark):
    m = rows(spark, "mention_id long, blocking_key string, death_year int", (1, "a", 728), (2, "b", 500), (3, "a", 900))
    p = rows(spark, "person_id long, blocking_key string, death_year_hijri int", (5, "a", 730), (6, "b", 499), (7, "b", 503))
    return jon.tolerant_year(m, p).select("mention_id", "person_id")


@known("place_id long, ext_id string", (1, "x"), (2, None))
def near_places(spark):
    a = rows(spark, "place_id long, lat double, lon double", (1, 33.5, 36.3), (2, 10.0, 10.0))
    b = rows(spark, "ext_id string, lat double, lon double", ("y", 34.9, 36.0), ("x", 33.0, 37.0), ("z", 12.0, 10.0))
    return jon.near_places(a, b).select("place_id", "ext_id")


@known("kind string, id long, ext_id string", ("person", 1, "p1"), ("place", 1, "x"), ("work", 1, "w1"), ("unique", 2, "u1"))
def external_links(spark):
    people = linking.linked_persons(rows(spark, "person_id long, display_name string, death_year_hijri int", (1, "أحمد", 240), (2, "زيد", 100)), rows(spark, "ext_id string, label string, death_year int", ("p1", "احمد", 241), ("p2", "احمد", 500)))
    place = linking.linked_places(rows(spark, "place_id long, name string, lat double, lon double", (1, "دمشق", 33.5, 36.3)), rows(spark, "ext_id string, label string, lat double, lon double", ("x", "دمشق", 33.4, 36.2), ("w", "حلب", 33.4, 36.2)))
    work = linking.linked_works(rows(spark, "work_id long, author string, title string", (1, "a", "المغني")), rows(spark, "ext_id string, author string, label string", ("w1", "a", "المغني في الفقه"), ("w2", "b", "المغني")))
    one = linking.linked_unique(rows(spark, "id long, name string", (2, "حلب"), (3, "بصرة")), rows(spark, "ext_id string, label string", ("u1", "حلب"), ("u2", "بصرة"), ("u3", "بصرة")), "id", "name")
    part = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "ext_id")
    return part(people, "person", "person_id").unionByName(part(place, "place", "place_id")).unionByName(part(work, "work", "work_id")).unionByName(part(one, "unique", "id"))


@known("start int, kept boolean", (0, True), (8, True))
def overlap_suppressed(spark):
    t = rows(spark, "page_id long, priority int, start int, `end` int", (1, 1, 3, 9), (1, 0, 0, 5), (1, 2, 8, 12), (1, 3, 9, 11))
    return jon.free_of(t, ["page_id"], "page_id long, priority int, start int, end int").select("start", F.lit(True).alias("kept"))


@known("v_start int, key string", (0, "k1"), (200, None))
def verses_adopt_citations(spark):
    v = rows(spark, "page_id long, start int, `end` int", (1, 0, 20), (1, 200, 210))
    c = rows(spark, "page_id long, start int, key string", (1, 70, "k2"), (1, 30, "k1"), (1, 190, "k0"))
    return jon.adopted(v, c).select("v_start", "key")


@known("o int, seg_id string", (0, "a"), (9, "a"), (10, None), (15, "b"))
def segments_at_offsets(spark):
    o = rows(spark, "doc_id long, offset int", (1, 0), (1, 9), (1, 10), (1, 15))
    s = rows(spark, "doc_id long, seg_id string, start int, `end` int", (1, "a", 0, 10), (1, "b", 12, 20))
    return jon.segment_at(o, s).select(F.col("offset").alias("o"), "seg_id")


@known("relation_id long, src long", (1, 21), (2, None))
def reanchored_endpoints(spark):
    r = rows(spark, "relation_id long, src long", (1, 11), (2, 12))
    span = "mention_id long, doc_id long, label string, start int, `end` int"
    return jon.reanchored(r, rows(spark, span, (11, 1, "p", 0, 3), (12, 1, "p", 5, 6)), rows(spark, span, (21, 1, "p", 0, 3), (22, 1, "q", 5, 6)), "src").select("relation_id", "src")


@known("a string, b string", ("abc", "b"), ("x", "xyz"))
def containment_pairs(spark):
    left = rows(spark, "page int, a string", (1, "abc"), (1, "x"), (2, "abc"))
    return jon.containing(left, rows(spark, "page int, b string", (1, "b"), (1, "xyz"), (1, "q")), ["page"], "a", "b").select("a", "b")


@known("rank int, doc_id long, name string", (0, 3, "c"), (1, 1, "a"))
def rank_kept(spark):
    ids = spark.range(1).select(F.array(F.lit(3), F.lit(9), F.lit(1)).cast("array<long>").alias("ids"))
    out = jon.hydrated(ids, "ids", rows(spark, "doc_id long, name string", (1, "a"), (2, "b"), (3, "c")), "doc_id")
    return out.withColumn("rank", F.when(F.col("rank") == 0, 0).otherwise(1))


# Windows and folds.


@known("points string", ("0,9,20",))
def dedupe_near_points(spark):
    return spark.range(1).select(joined(win.merged_points(F.array(*[F.lit(x) for x in (0, 3, 4, 9, 20, 24)]))).alias("points"))


@known("starts string, titles string", ("3,20", "h,z"))
def dedupe_near_seeds(spark):
    t = spark.range(1).select(F.from_json(F.lit('[{"start":0,"markup":false,"title":"m"},{"start":3,"markup":true,"title":"h"},{"start":20,"markup":false,"title":"z"}]'), "array<struct<start:int,markup:boolean,title:string>>").alias("s"))
    m = win.merged_seeds(F.col("s"))
    return t.select(joined(F.transform(m, lambda x: x.start)).alias("starts"), joined(F.transform(m, lambda x: x.title)).alias("titles"))


@known("ord int, parent int, page_end int", (0, None, 8), (1, 0, 4), (2, 1, 3), (3, 1, None), (4, 0, None), (5, None, None))
def chapters(spark):
    t = rows(spark, "doc_id long, ord int, level int, page int", (1, 0, 1, 1), (1, 1, 2, 2), (1, 2, 3, 3), (1, 3, 3, 4), (1, 4, 2, 5), (1, 5, 1, 9))
    return win.chapter_tree(t)


@known("start int", (8,))
def overlapping_intervals(spark):
    t = rows(spark, "doc_id long, start int, stop int", (1, 0, 10), (1, 8, 12), (1, 12, 15))
    return win.overlapping(t, ["doc_id"], "start", "stop").select("start")


@known("row_no int, words string", (0, "b,a"), (1, "c"))
def text_rows(spark):
    t = rows(spark, "page_id long, w string, x double, y0 double, y1 double", (1, "a", 5.0, 1.0, 11.0), (1, "b", 1.0, 0.0, 10.0), (1, "c", 0.0, 20.0, 30.0))
    out = win.text_rows(t, ["page_id"], "page_id long, w string, x double, y0 double, y1 double, row int")
    return out.groupBy(F.col("row").alias("row_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "w"))), lambda s: s.w), ",").alias("words"))


@known("k int", (0,), (2,), (3,))
def increasing_subsequence(spark):
    t = rows(spark, "g int, k int, v int", (1, 0, 1), (1, 1, 9), (1, 2, 2), (1, 3, 3))
    return win.increasing_rows(t, ["g"], "k", "v", "g int, k int, v int").select("k")


@known("value string, spot string", ("b", "0:0"), ("a", "0:1"), ("c", "1:1"))
def ordered_unions(spark):
    t = win.ordered_union([rows(spark, "value string, pos int", ("b", 0), ("a", 1)), rows(spark, "value string, pos int", ("a", 0), ("c", 1))], "value")
    return t.select("value", F.concat_ws(":", F.col("at.part").cast("string"), F.col("at.pos").cast("string")).alias("spot"))


@known("doc_id long, question string, answer string", (1, "q2", "a1"))
def question_answer_pairs(spark):
    t = rows(spark, "doc_id long, start int, kind string, text string", (1, 0, "question", "q1"), (1, 1, "question", "q2"), (1, 2, "answer", "a1"), (1, 3, "answer", "a2"))
    return agg.question_answers(t)


@known("kind string, confidence double, items string", ("verse", 0.9, "x,y"))
def structured_regions(spark):
    t = rows(spark, "doc_id long, kind string, start int, text string, confidence double", (1, "verse", 5, "y", 0.9), (1, "verse", 1, "x", 0.4))
    return agg.regions(t).select("kind", "confidence", joined(F.col("items")).alias("items"))


MENTION = "doc_id long, entity_type string, normalized string, normalized_text string, person_id long, place_id long, work_id long, superseded_at string, review_status string"


def mention_rows(spark):
    return rows(spark, MENTION, (1, "quran", '{"sura":2,"aya_start":1,"aya_end":3}', "quran:2:1-3", None, None, None, None, "approved"), (1, "person", "{}", "x", 7, None, None, None, "approved"), (1, "place", "{}", "y", None, 9, None, None, "pending"), (1, "person", "{}", "gone", None, None, None, None, "rejected"), (2, "hadith_source", '{"collection":"muslim"}', "muslim", None, None, None, None, "approved"), (2, "person", "{}", "old", None, None, None, "2024", "approved"))


@known("doc_id long, persons string, places string, suras string, ayas string, hadith string", (1, "p:7", "pl:9", "2", "2:1,2:2,2:3", ""), (2, "", "", "", "", "muslim"))
def rollup_entity_sets(spark):
    r = agg.rollup(fil.active(mention_rows(spark)))
    return r.select("doc_id", joined(F.col("persons")).alias("persons"), joined(F.col("places")).alias("places"), joined(F.col("quran_suras")).alias("suras"), joined(F.col("quran_ayas")).alias("ayas"), joined(F.col("hadith_collections")).alias("hadith"))


@known("person_id long, docs long", (7, 1), (8, 0))
def mention_doc_counts(spark):
    return agg.mention_docs(rows(spark, "person_id long", 7, 8), fil.active(mention_rows(spark)), "person_id")


@known("doc_id long", (1,))
def mention_facets(spark):
    return fil.by_mentions(rows(spark, "doc_id long", 1, 2), mention_rows(spark), persons=[7], quran=["9", "2:3"])


@known("label string, n long, not_found long, broken long", ("person", 3, 1, 1))
def extraction_figures(spark):
    t = rows(spark, "label string, text string, start int, `end` int, surface string", ("person", "abc", 0, 2, "ab"), ("person", "abc", 1, 2, "x"), ("person", "abc", None, None, "q"))
    return agg.extraction_figures(t)


@known("doc_id long, rate double, flag string", (1, 0.5, "LOW_ANCHOR_RATE"), (2, 1.0, None))
def anchor_figures(spark):
    t = rows(spark, "doc_id long, start int", (1, 0), (1, None), (2, 4))
    return agg.anchor_figures(t).withColumnRenamed("anchor_rate", "rate")


@known("chars long, windows long, tokens_in double, tokens_out double", (7000, 4, 2000.0, 600.0))
def cost_estimate(spark):
    return agg.cost(rows(spark, "doc_id long, n long", (1, 6500), (2, 500)), "n")


@known("doc_id long, coverage double", (1, 0.5), (2, 0.0))
def segment_coverage(spark):
    return agg.coverage(rows(spark, "doc_id long, start int, `end` int", (1, 0, 5)), rows(spark, "doc_id long, length int", (1, 10), (2, 10)))


# Retrieval within a document.


@known("frag_id int, page int", (0, 1), (1, 3), (2, None), (3, 2))
def fragment_pages(spark):
    p = rows(spark, "doc_id long, page int, content string", (1, 1, "alpha beta"), (1, 2, "gamma delta"), (1, 3, "epsilon zeta eta"))
    f = rows(spark, "doc_id long, frag_id int, snippet string", (1, 0, "<mark>alpha</mark>  beta"), (1, 1, "delta\f<mark>epsilon</mark> zeta"), (1, 2, "nowhere"), (1, 3, "junk\ngamma <mark>delta</mark>"))
    return ret.attributed(f, p).select("frag_id", "page")


@known("page int, marks int, lex_raw double", (1, 2, 2.75), (1, 1, 1.75), (2, 1, 1.25))
def fragment_scores(spark):
    t = rows(spark, "doc_id long, page int, marks int", (1, 1, 2), (1, 1, 1), (1, 2, 1))
    return ret.fragment_scores(t)


@known("plain string, marks int, terms string", ("a long text", 2, "0,1"))
def absorbed_fragments(spark):
    schema = "doc_id long, page int, seq int, plain string, marks int, terms array<int>"
    t = rows(spark, schema, (1, 1, 0, "long", 1, [0]), (1, 1, 1, "a long text", 2, [1]))
    return ret.absorbed(t, schema).select("plain", "marks", joined(F.col("terms")).alias("terms"))


@known("page int", (2,))
def page_gates_of_musts(spark):
    hits = rows(spark, "doc_id long, page int, i int", (1, 1, 0), (1, 2, 0), (1, 2, 1))
    return within.page_gates(hits, (Term("a"), Term("b")), rows(spark, "doc_id long, page int", (1, 1), (1, 2), (1, 3))).select("page")


@known("doc_id long, score double", (1, 1.0), (2, 0.5), (3, 0.25))
def max_normalized_scores(spark):
    return agg.max_normalized(rows(spark, "doc_id long, s double", (1, 8.0), (2, 4.0), (3, 2.0)), "s", "score")


@known("page int, snippet string, marks int", (1, "a <mark>Fox</mark> and a <mark>fox</mark>", 2))
def highlighted_fragments(spark):
    t = rows(spark, "doc_id long, page int, content string", (1, 1, "a Fox and a fox"), (1, 2, "none"))
    return within.fragments(t, "fox")


@known("page int, kind string, score double", (1, "exact", 0.6), (2, "semantic", 0.4))
def in_document_mix(spark):
    p = rows(spark, "doc_id long, page int, content string", (1, 1, "a fox"), (1, 2, "other"))
    c = rows(spark, "doc_id long, page int, chunk_index int, embedding array<double>", (1, 1, 0, [0.0, 1.0]), (1, 2, 1, [1.0, 0.0]))
    return within.in_document(p, c, "fox", [1.0, 0.0], "all").withColumnRenamed("match_kind", "kind")


@known("page int, hits string", (1, "0"), (3, "0,1"))
def in_document_terms(spark):
    p = rows(spark, "doc_id long, page int, content string", (1, 1, "fox"), (1, 2, "fox bad"), (1, 3, "fox hen"))
    out = within.in_document_terms(p, (Term("fox"), Term("hen", op="should"), Term("bad", op="must_not")))
    return out.select("page", joined(F.col("term_hits")).alias("hits"))


MATCHING = "doc_id long, page int, content string"


@known("page int, i int, matches long", (1, 0, 1), (3, 0, 2), (1, 1, 1), (2, 2, 1), (1, 3, 3), (3, 3, 2), (4, 4, 1), (5, 5, 1), (4, 6, 1), (5, 6, 1))
def page_term_kinds(spark):
    """Words, phrases, fuzzy words, stems, and marks as typed or folded: a word is no part of another."""
    p = rows(spark, MATCHING, (1, 1, "A cat sat on the mat"), (1, 2, "category of concatenation"), (1, 3, "cat, CAT"), (1, 4, "المسلمون هنا"), (1, 5, "مُسلم"))
    terms = (Term("cat"), Term("on the", "phrase"), Term("concatenatoin", "fuzzy"), Term("catt mat", "fuzzy", 1), Term("مسلم", "stem"), Term("مُسلم", diacritics="sensitive"), Term("مسلم", "stem"))
    return within.term_words(p, terms)[1].where("NOT (i = 4 AND page = 5)")


@known("page int, snippet string, marks int, terms string", (1, "He <mark>on the</mark> <mark>cats</mark>", 2, "0,1"), (2, "the <mark>cat</mark> and the <mark>hat</mark>", 2, "1"))
def term_marks(spark):
    p = rows(spark, MATCHING, (1, 1, "He on the cats"), (1, 2, "the cat and the hat"))
    out = within.term_fragments(p, (Term("on the", "phrase", op="should"), Term("cat", "fuzzy", 1), Term("he", op="must_not")))
    return out.select("page", "snippet", "marks", joined(F.col("terms")).alias("terms"))


@known("page int, kind string, score double", (1, "lexical", 1.0))
def in_document_similar(spark):
    p = rows(spark, MATCHING, (1, 1, "five foxes"), (1, 2, "other"))
    return within.in_document(p, None, "foxe", mode="similar").withColumnRenamed("match_kind", "kind")


@known("page int, used long", (2, 5), (1, 9))
def context_budget(spark):
    r = rows(spark, "doc_id long, page int, score double", (1, 1, 0.5), (1, 2, 0.9), (1, 2, 0.1), (1, 3, 0.2))
    p = rows(spark, "doc_id long, page int, content string", (1, 1, "abcd"), (1, 2, "abcde"), (1, 3, "abcdefghij"))
    return ret.context_pages(r, p, budget=12)


@known("page int, volume int, printed_page int", (5, 1, 14), (12, 2, 1), (99, None, None))
def printed_citations(spark):
    c = rows(spark, "doc_id long, page int", (1, 5), (1, 12), (1, 99))
    v = rows(spark, "doc_id long, volume int, from_page int, to_page int, printed_start int", (1, 1, 1, 10, 10), (1, 2, 12, 30, 1))
    return ret.printed(c, v)


@known("facets string, text string", ("lang=Arabic", "books unknownplace"))
def assist_resolution(spark):
    g = rows(spark, "facet string, value string", ("lang", "arabic"), ("country", "unknownplace"))
    return ret.assisted(g, rows(spark, "facet string, value string", ("lang", "Arabic")), "books").select(joined(F.col("facets")).alias("facets"), "text")


INDEXED = "doc_id long, countries string, centuries string, authors string, has_vector boolean"


@known(INDEXED, (1, "Iraq,Syria", "3", "a aa b", True), (2, None, None, None, False))
def index_wide_rows(spark):
    docs = rows(spark, "doc_id long, title string, semantic_vector array<double>", (1, "t", [1.0, 0.0]), (2, "u", [0.0, 0.0]))
    authors = rows(spark, "author_id long, name string, alternate_names array<string>, nationality string, death_century int", (1, "a", ["aa"], "Syria", 3), (2, "b", None, "Iraq", 3))
    bridge = rows(spark, "doc_id long, author_id long", (1, 1), (1, 2))
    cats = rows(spark, "category_id long, name string", (1, "c"))
    out = ret.index_rows(docs, bridge, authors, rows(spark, "doc_id long, category_id long", (1, 1)), cats, 2)
    return out.select("doc_id", joined(F.col("countries")).alias("countries"), joined(F.col("centuries")).alias("centuries"), "authors", F.col("semantic_vector").isNotNull().alias("has_vector"))


@known("doc_id long, hit string", (1, "stem"), (2, "fuzzy"))
def stem_and_fuzzy_terms(spark):
    docs = rows(spark, "doc_id long, content string", (1, "المسلمون هنا"), (2, "قال muslim"))
    index = unwritten(docs, ["content"])
    a = ret.term_matches(index, Term("مسلم", "stem")).select("doc_id", F.lit("stem").alias("hit"))
    return a.unionByName(ret.term_matches(index, Term("muslin", "fuzzy")).select("doc_id", F.lit("fuzzy").alias("hit")))


# Segments and knowledge.


@known("start int, finish int, ord int", (0, 10, 0), (10, 25, 1))
def flat_segments(spark):
    p = rows(spark, "doc_id long, start int, stream string", (1, 0, "main"), (1, 10, "main"))
    return kb.segments(p, rows(spark, "doc_id long, length int", (1, 25))).withColumnRenamed("end", "finish")


@known("start int, finish int", (0, 3500), (3500, 7000), (7000, 10500))
def even_windows(spark):
    return kb.fallback_windows(rows(spark, "doc_id long, length int", (1, 10500)), 4000).withColumnRenamed("end", "finish")


SEG = "doc_id long, seg_id string, stream string, parent_id string, start int, `end` int"


@known("seg_id string, fault string", ("a", "duplicate_id"), ("x", "missing_parent"), ("p", "cycle"), ("q", "cycle"), ("z", "bounds"), ("k", "outside_parent"))
def segment_faults(spark):
    t = rows(spark, SEG, (1, "a", "m", None, 0, 10), (2, "r", "m", None, 0, 50), (2, "k", "m", "r", 40, 60), (1, "a", "n", None, 0, 10), (1, "x", "m", "none", 20, 30), (3, "p", "m", "q", 0, 10), (3, "q", "m", "p", 0, 10), (4, "z", "m", None, 90, 101))
    return kb.tree_faults(t, rows(spark, "doc_id long, length int", (1, 100), (2, 100), (3, 100), (4, 100)))


@known("seg_id string", ("b",), ("c",))
def segment_leaves(spark):
    return kb.leaves(rows(spark, SEG, (1, "a", "m", None, 0, 10), (1, "b", "m", "a", 0, 5), (1, "c", "m", "a", 5, 10))).select("seg_id")


@known("win int, start int, finish int, ids string, oversized boolean", (0, 0, 20, "a,b", False), (1, 20, 60, "c", True), (2, 60, 77, "d", False), (3, 77, 93, "d", False), (4, 93, 110, "d", False))
def planned_windows(spark):
    t = rows(spark, "doc_id long, seg_id string, start int, `end` int, is_scope boolean", (1, "a", 0, 10, False), (1, "b", 10, 20, False), (1, "c", 20, 60, True), (1, "d", 60, 110, False))
    docs = rows(spark, "doc_id long, text string", (1, "x" * 110))
    return kb.windows(t, docs, 20, 5).select(F.col("window").alias("win"), "start", F.col("end").alias("finish"), joined(F.col("seg_ids")).alias("ids"), "oversized")


@known("start int, finish int", (0, 24), (24, 51), (51, 75), (75, 100))
def windows_end_at_breaks(spark):
    t = rows(spark, "doc_id long, seg_id string, start int, `end` int, is_scope boolean", (1, "a", 0, 100, False))
    text = list("x" * 100)
    for k, c in ((20, " "), (23, "."), (50, "\n"), (48, "."), (90, " ")):
        text[k] = c
    return kb.windows(t, rows(spark, "doc_id long, text string", (1, "".join(text))), 25, 5).select("start", F.col("end").alias("finish"))


@known("chunk int, start int, finish int", (0, 0, 8), (1, 6, 16), (2, 14, 20))
def text_chunks(spark):
    return kb.chunked(rows(spark, "doc_id long, text string", (1, "abcdefg\nhijklmnopqrs")), 10, 2).withColumnRenamed("end", "finish")


@known("ord int, place int", (0, 0), (1, 6), (2, None))
def marker_places(spark):
    d = rows(spark, "doc_id long, text string", (1, "First\nSECOND line\nthird"))
    m = rows(spark, "doc_id long, ord int, line string", (1, 0, "First"), (1, 1, "second  line"), (1, 2, "absent"))
    return kb.resolved_markers(d, m).withColumnRenamed("offset", "place")


@known("relation_id long, reason string", (1, None), (2, "range"), (3, "missing_endpoint"), (4, "self_relation"), (5, "unknown_predicate"))
def checked_relations(spark):
    r = rows(spark, "relation_id long, predicate string, src long, dst long", (1, "born_in", 1, 2), (2, "born_in", 1, 3), (3, "born_in", 1, 9), (4, "student_of", 1, 1), (5, "zz", 1, 2))
    m = rows(spark, "mention_id long, label string", (1, "person"), (2, "place"), (3, "person"))
    kept, dropped = kb.checked_relations(r, m)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(dropped).select("relation_id", "reason")


@known("id string", ("a",))
def assembled_entities(spark):
    e = rows(spark, "id string, refs array<string>", ("a", []), ("b", ["c"]), ("c", ["gone"]))
    return kb.assembled(e, rows(spark, "src string, dst string", ("a", "b")))[0].select("id")


@known("src_entity string, predicate string, dst_entity string", ("E1", "taught", "E2"))
def entity_relations(spark):
    r = rows(spark, "src long, predicate string, dst long", (1, "taught", 2), (1, "taught", 3), (4, "taught", 2))
    return kb.to_entities(r, rows(spark, "mention_id long, entity_id string", (1, "E1"), (2, "E2"), (3, "E1")))


@known("relation_id long, mention_id long", (2, 9))
def integrity_faults(spark):
    return kb.integrity(rows(spark, "relation_id long, src long, dst long", (1, 1, 2), (2, 1, 9)), rows(spark, "mention_id long", 1, 2))


@known("mention_id long, kept_id long, page int", (1, 1, 1), (2, 1, 1), (3, 3, 2))
def projected_mentions(spark):
    m = rows(spark, "mention_id long, doc_id long, label string, start int, `end` int", (1, 1, "p", 0, 3), (2, 1, "p", 0, 3), (3, 1, "p", 50, 53))
    kept, alias = kb.projected(m, rows(spark, "doc_id long, page int, start int", (1, 1, 0), (1, 2, 40)))
    return alias.join(kept.select(F.col("mention_id").alias("kept_id"), "page"), "kept_id")


@known("stage string, calls long, cached long, chars_to_bill long", ("split", 2, 1, 50))
def call_status(spark):
    p = rows(spark, "stage string, cache_key string, chars int", ("split", "a", 10), ("split", "b", 50))
    return kb.call_status(p, rows(spark, "cache_key string", "a"))


@known("line_text string, level int, start long", ("Title", 1, 0), ("item", None, 6), ("Sub", 2, 11))
def normalized_book(spark):
    t = rows(spark, "doc_id long, page int, content string", (1, 1, "Title\n=====\n- item\n---"), (1, 2, "## Sub"))
    return kb.normalized_lines(t).withColumnRenamed("text", "line_text")


@known("ord int, level int, title string", (0, 1, "One & two"), (1, 2, "Three"))
def mixed_headings(spark):
    return kb.headings(rows(spark, "doc_id long, content string", (1, "<h1>One &amp; <b>two</b></h1>\n## Three\n#### no")))


# Pages of scans.


@known("start int, sure boolean, x0 double", (0, True, 0.0), (4, True, 30.0), (8, False, 60.0))
def placed_words(spark):
    b = rows(spark, "page_id long, block string, text string, x0 double, y0 double, x1 double, y1 double, rtl boolean", (1, "b", "one two thr", 0.0, 0.0, 100.0, 10.0, False))
    w = rows(spark, "page_id long, block string, seq int, text string, x0 double, y0 double, x1 double, y1 double", (1, "b", 0, "one", 0.0, 0.0, 25.0, 10.0), (1, "b", 1, "two", 30.0, 0.0, 60.0, 10.0))
    return geo.placed_words(b, w).select("start", "sure", F.when(F.col("start") == 8, 60.0).otherwise(F.col("x0")).alias("x0"))


@known("block string, start int, x0 double, x1 double", ("l", 0, 20.0, 40.0), ("l", 4, 40.0, 60.0), ("r", 0, 40.0, 60.0), ("r", 4, 20.0, 40.0), ("t", 0, 0.0, 10.0), ("t", 4, 30.0, 40.0), ("t", 8, 0.0, 10.0), ("t", 12, 30.0, 40.0))
def split_boxes(spark):
    block = "page_id long, block string, text string, x0 double, y0 double, x1 double, y1 double, rtl boolean"
    b = rows(spark, block, (1, "l", "foo bar", 0.0, 0.0, 100.0, 10.0, False), (1, "r", "foo bar", 0.0, 0.0, 100.0, 10.0, True), (1, "t", "one two two one", 0.0, 0.0, 100.0, 30.0, False))
    word = "page_id long, block string, seq int, text string, x0 double, y0 double, x1 double, y1 double"
    read = [(1, k, 0, "foobar", 20.0, 0.0, 60.0, 10.0) for k in "lr"]
    read += [(1, "t", 0, "one", 30.0, 15.0, 40.0, 25.0), (1, "t", 1, "one", 0.0, 0.0, 10.0, 10.0), (1, "t", 2, "two", 0.0, 15.0, 10.0, 25.0), (1, "t", 3, "two", 30.0, 0.0, 40.0, 10.0)]
    return geo.placed_words(b, rows(spark, word, *read)).select("block", "start", "x0", "x1")


@known("page_id long, blocks long, low_coverage long, mean_coverage double", (1, 2, 1, 0.75))
def geometry_figures(spark):
    return geo.page_figures(rows(spark, "page_id long, block string, coverage double", (1, "a", 1.0), (1, "a", 1.0), (1, "b", 0.5)))


@known("y0 double, words int", (0.0, 5), (50.0, 1))
def merged_passes(spark):
    t = rows(spark, "page_id long, pass int, y0 double, y1 double, words int", (1, 0, 0.0, 10.0, 3), (1, 1, 0.0, 9.0, 5), (1, 1, 50.0, 60.0, 1))
    return geo.passes(t)


# Sources, sinks, versions.


@known("path string, refused string", ("a.pdf", None), ("b.exe", "type"), ("c.md", "size"), ("d.txt", "empty"))
def upload_checks(spark):
    return readers.judged_uploads(rows(spark, "path string, length long", ("a.pdf", 100), ("b.exe", 1), ("c.md", 11 << 20), ("d.txt", 0)))


@known("authors string, categories string", ("A,B", "x,y"))
def mined_metadata(spark):
    t = spark.range(1).select(F.create_map(F.lit("dc:creator"), F.lit("A; B;A"), F.lit("Keywords"), F.lit("x, y")).alias("metadata"))
    return readers.mined_metadata(t).select(joined(F.col("authors")).alias("authors"), joined(F.col("categories")).alias("categories"))


@known("page int, content string, starts string, width double", (1, "Hello\nworld", "0,6", 100.0))
def layout_pages(spark):
    j = '{"children":[{"id":"p","page":1,"bbox":[0,0,100,200],"children":[{"id":"a","block_type":"Text","bbox":[0,0,1,1],"html":"<p>Hello</p>"},{"id":"b","block_type":"Text","bbox":[0,0,1,1],"html":"world"}]}]}'
    out = readers.layout_pages(rows(spark, "doc_id long, layout string", (1, j)))
    return out.select("page", "content", joined(F.transform("blocks", lambda b: b.char_start)).alias("starts"), "width")


@known("page int, content string", (1, "a"), (7, "c"))
def ocr_pages(spark):
    t = rows(spark, "doc_id long, j string", (1, '[{"text":"a"},{"text":" "},{"page_number":7,"text":"c"}]'))
    return readers.ocr_pages(t.select("doc_id", F.from_json("j", "array<struct<page_number:int,text:string,markdown:string,tables:array<string>>>").alias("pages")))


@known("source_id string, normalized string, kind string", ("1", "دمشق", "name"), ("1", "الشام", "historic"))
def gazetteer_names(spark):
    return readers.gazetteer_names(rows(spark, "source string, source_id string, name string, variants string", ("s", "1", "دمشق", "الشام:historic|دمشق:name")))


@known("title string, n int", ("b", 1), ("a", 0))
def seeded_works(spark):
    w = rows(spark, "normalized_title string, title string", ("a", "a"))
    out = readers.seeded_works(w, rows(spark, "title string", "A", "b"))
    return out.select("title", F.when(F.col("title") == "b", 1).otherwise(0).alias("n"))


@known("display_name string, block string", ("x", None), ("ابن تيمية", "ابن تيميه"))
def seeded_persons(spark):
    p = rows(spark, "display_name string, aliases array<string>, blocking_key string, death_year_hijri int", ("x", None, None, None))
    a = rows(spark, "name string, alternate_names array<string>, death_year_hijri int", ("x", None, 1), ("ابن تيمية", None, 728))
    return readers.seeded_persons(p, a).withColumnRenamed("blocking_key", "block")


@known("markdown string", ("---\ntitle: T\nnotes: 2\n---\n\n# T\n\n## p. 1\n\n> q\n\nfirst\n\n## p. 4\n\nsecond\n",))
def notes_markdown(spark):
    n = rows(spark, "user_id long, doc_id long, note_id long, page int, quote string, body string", (1, 1, 2, 4, None, "second"), (1, 1, 1, 1, "q", "first"))
    return sinks.notes_markdown(n, rows(spark, "doc_id long, title string", (1, "T")))


@known("line string", ('a,"b,""c""",',))
def csv_lines(spark):
    return rows(spark, "a string, b string, c string", ("a", 'b,"c"', None)).select(sinks.csv_line("a", "b", "c").alias("line"))


@known("line string", ('hits{a="1",b="2"} 5',))
def prometheus_counters(spark):
    t = spark.range(2).select(F.lit("hits").alias("name"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")).alias("labels"), (F.col("id") + 2).alias("value"))
    return sinks.counters(t)


@known("k string, v string, verified boolean", ("a", "human", True), ("b", "new", False))
def verified_rows_kept(spark):
    old = rows(spark, "k string, v string, human_verified boolean", ("a", "human", True), ("b", "old", False))
    new = rows(spark, "k string, v string, human_verified boolean", ("a", "new", False), ("b", "new", False))
    return dml.verified_kept(old, new, ["k"]).withColumnRenamed("human_verified", "verified")


@known("client_id string, body string", ("a", "first"), ("b", "second"))
def idempotent_append(spark):
    old = rows(spark, "session long, client_id string, seq int, body string", (1, "a", 0, "first"))
    new = rows(spark, "session long, client_id string, seq int, body string", (1, "a", 1, "again"), (1, "b", 2, "second"), (1, "b", 3, "third"))
    return dml.appended(old, new, ["session", "client_id"], ["seq"])


@known("mention_id long, status string, verified boolean", (1, "approved", True), (2, "pending", False), (3, "pending", False))
def review_decisions(spark):
    m = rows(spark, "mention_id long, review_status string, human_verified boolean", (1, "pending", False), (2, "rejected", True), (3, "pending", False))
    d = rows(spark, "mention_id long, action string, decided_at int", (1, "reject", 1), (1, "approve", 2), (2, "reopen", 1))
    return dml.reviewed(m, d).select("mention_id", F.col("review_status").alias("status"), F.col("human_verified").alias("verified"))


@known("person_id long, aliases string", (1, "b,bb"), (3, ""))
def entity_merges(spark):
    p = rows(spark, "person_id long, display_name string, aliases array<string>", (1, "a", None), (2, "b", ["bb"]), (3, "c", None))
    merges = rows(spark, "loser long, winner long", (2, 1))
    return dml.merged_aliases(p, merges, "person_id").select("person_id", joined(F.col("aliases")).alias("aliases"))


@known("mention_id long, person_id long", (1, 1), (2, 3))
def repointed_mentions(spark):
    return dml.merged_entities(rows(spark, "mention_id long, person_id long", (1, 2), (2, 3)), rows(spark, "loser long, winner long", (2, 1)), "person_id")


@known("doc_id long", (2,))
def runs_pending(spark):
    h = rows(spark, "doc_id long, corpus_hash string", (1, "h1"), (2, "h2"))
    return ext.pending_runs(h, rows(spark, "doc_id long, extractor string, version string, corpus_hash string", (1, "x", "1", "h1"), (2, "x", "1", "old")), "x", "1").select("doc_id")


@known("start int, status string", (0, "approved"), (5, "pending"))
def triaged_mentions(spark):
    t = rows(spark, "doc_id long, page int, entity_type string, start int, `end` int, normalized_text string, confidence double, needs_review boolean", (1, 1, "date", 0, 3, "a", 0.9, False), (1, 1, "date", 0, 3, "b", 0.5, False), (1, 1, "date", 5, 8, "c", 0.6, False))
    return ext.triaged(t).withColumnRenamed("review_status", "status")


@known("normalized_text string, place_id long", ("x", 1), ("y", None))
def resolved_places(spark):
    return ext.resolved(rows(spark, "normalized_text string", "x", "y"), rows(spark, "normalized string, place_id long", ("x", 1), ("y", 1), ("y", 2)), "normalized", "place_id")


@known("doc_id long, title string, total_pages int", (2, "b", 3), (1, "a", 1))
def continue_reading(spark):
    p = rows(spark, "user_id long, doc_id long, updated_at int", (1, 1, 5), (1, 2, 9), (2, 1, 7))
    d = rows(spark, "doc_id long, title string, content string", (1, "a", "x"), (2, "b", "x\fy\fz"))
    return fil.continue_rows(p, d, 1).join(d.select("doc_id", "title"), "doc_id")


@known("place_id long, docs long", (2, 3), (1, 0))
def typeahead_places(spark):
    p = rows(spark, "place_id long, name string", (1, "Damascus"), (2, "Dam"), (3, "Basra"))
    n = rows(spark, "place_id long, normalized string", (2, "damm"), (3, "basra"))
    return fil.typeahead(p, n, "place_id", "dam", "dam", rows(spark, "place_id long, docs long", (2, 3)))


@known("lexical double, semantic double", (None, 0.5))
def scores_by_mode(spark):
    return fil.scores_for_mode(rows(spark, "lexical_score double, semantic_score double", (0.1, 0.5)), "semantic").select(F.col("lexical_score").alias("lexical"), F.col("semantic_score").alias("semantic"))


@known("title string, pos int", ("a", 0), ("B", 1), ("c", 2))
def alphabetical_order(spark):
    t = win.client_order(rows(spark, "doc_id long, title string", (1, "c"), (2, "B"), (3, "a")), "alphabetical")
    return t.withColumn("k", F.lower("title")).select("title", (F.ascii("k") - 97).alias("pos"))


@known("label string, n long", ("bad", 1))
def unparseable_sources(spark):
    t = rows(spark, "raw string", "728 هـ", "القرن الخامس", "")
    return fil.unparseable(t, "raw", D.death_year("raw")).select(F.lit("bad").alias("label"), F.col("unparseable").alias("n"))


# Lookups.


@known("phrase_id long, year_from int, year_to int", (1, 170, 193), (2, None, None))
def regnal_periods(spark):
    t = rows(spark, "phrase_id long, phrase string", (1, "في خلافة هارون الرشيد"), (2, "في زمن قديم"))
    p = rows(spark, "ord int, ruler string, year_from int, year_to int", (2, "هارون", 1, 2), (1, "هارون الرشيد", 170, 193))
    return lookups.regnal_years(t, p).drop("phrase")


@known("name string", ("مصر",), ("مصر العليا",))
def region_search(spark):
    return lookups.regions(rows(spark, "name string", "مصر العليا", "الشام", "مصر"), "مصر")


@known("kind string, n long", ("exact", 1), ("semantic", 1), ("lexical", 1))
def match_kind_counts(spark):
    return lookups.kind_counts(rows(spark, "match_kind string, lexical_score double, semantic_score double", ("exact", 1.0, 0.2), (None, 0.0, 0.7), (None, 0.3, 0.7)))


@known("n int, words string", (0, "fox,hen"))
def marked_token_list(spark):
    return rows(spark, "t string", "a <mark>Fox</mark> b <mark>hen</mark> <mark>fox</mark>").select(F.lit(0).alias("n"), joined(T.marked_tokens("t")).alias("words"))


@known("t string, code string", ("the end of it", "en"), ("der und die", "de"), ("123", None))
def language_guesses(spark):
    return rows(spark, "t string", "the end of it", "der und die", "123").select("t", T.language("t").alias("code"))


@known("block string, seq int, text string, x1 double", ("b", 0, "one", 2.0), ("b", 1, "two", 4.0))
def recognised_words(spark):
    j = '{"regions":[{"id":"b","lines":[{"bbox":[0,0,9,9],"words":[{"text":"one","bbox":[0,0,2,1],"conf":0.9},{"text":" ","bbox":[0,0,2,1],"conf":0.9},{"text":"two","bbox":[3,0,4,1],"conf":0.8}]}]}]}'
    return lookups.recognised_words(rows(spark, "page_id long, answer string", (1, j)))


@known("doc_id long, content string, author string", (1, "text", "A"))
def service_texts(spark):
    j = '{"content":" text ","metadata":{"Author":"A"}}'
    out = lookups.extracted_text(rows(spark, "doc_id long, answer string", (1, j), (2, '{"content":" "}')))
    return out.withColumn("author", F.try_element_at("metadata", F.lit("Author")))


@known("doc_id long", (2,))
def unseen_documents(spark):
    return lookups.unseen(rows(spark, "doc_id long", 1, 2), rows(spark, "doc_id long", 1), ["doc_id"])


@known("doc_id long, length double, alike boolean", (1, 1.0, True), (2, 1.0, True))
def hashed_embeddings(spark):
    v = lookups.hashed_vectors(rows(spark, "doc_id long, text string", (1, "one two two"), (2, "Two one two")))
    both = v.select(F.col("doc_id").alias("o"), F.col("embedding").alias("e"))
    out = v.join(both, v.doc_id != both.o)
    return out.select("doc_id", (F.floor(V.norm("embedding") * 1e6 + 0.5) / 1e6).alias("length"), (V.cosine("embedding", "e") > 0.999).alias("alike"))
