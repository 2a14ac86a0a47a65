"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded for matching, and the two rows of Arabic digits with their ASCII digits.
FOLD_FROM, FOLD_TO = "أإآٱىة", "اااايه"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
#: Vocalisation, annotation signs, tatweel, dagger alef, and zero-width marks.
SKIPPED = "[\\u064B-\\u065F\\u06D6-\\u06ED\\u0640\\u0670\\uFEFF\\u200B-\\u200F]"
WORD = r"[\p{L}\p{N}]+"

#: What light Arabic stemming takes off, as publicly described for Lucene's light stemmer.
PREFIXES = ["وال", "بال", "كال", "فال", "لل", "ال", "و"]
SUFFIXES = ["ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي"]
#: A short list of Arabic function words.
STOPWORDS = ["من", "في", "على", "الى", "عن", "ان", "هذا", "هذه", "ذلك", "التي", "الذي", "ما", "لا", "او", "ثم", "كان", "قد", "هو", "هي", "و"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java(pattern: str) -> Column:
    return F.lit(pattern)


def normalize(c) -> Column:
    """STR-03: without marks, letters and digits folded, lower case."""
    kept = F.regexp_replace(_col(c), java(SKIPPED), F.lit(""))
    return F.lower(F.translate(kept, FOLD_FROM + DIGITS_FROM, FOLD_TO + DIGITS_TO))


def tokens(c) -> Column:
    """TOK-01: lower-case words."""
    return F.regexp_extract_all(F.lower(_col(c)), java(WORD), F.lit(0))


def exact_tokens(c) -> Column:
    """TOK-02: words of the folded text."""
    return F.regexp_extract_all(normalize(c), java(WORD), F.lit(0))


def stem(word: Column) -> Column:
    """Light stem: a prefix that leaves two letters goes (three after a lone conjunction), then suffixes in turn while two stay. A word without an Arabic letter has nothing to lose."""
    long = "|".join(PREFIXES[:-1])
    cut = F.regexp_replace(word, f"^(?:(?:{long})(?=.{{2}})|{PREFIXES[-1]}(?=.{{3}}))", "")
    for s in SUFFIXES:
        cut = F.regexp_replace(cut, f"(?<=.{{2}}){s}$", "")
    return F.when(word.rlike(r"\p{InArabic}"), cut).otherwise(word)


def stemmed_tokens(c) -> Column:
    """TOK-03: folded words less stopwords, stemmed."""
    return F.transform(F.filter(exact_tokens(c), lambda w: ~w.isin(STOPWORDS)), stem)


def shadow_map(c) -> Column:
    """STR-04: struct of the folded text and, for each of its characters, the place (from 0) of its original."""
    chars = F.transform(F.split(_col(c), ""), lambda x, i: F.struct(normalize(x).alias("c"), i.alias("i")))
    kept = F.filter(chars, lambda x: x.c != "")
    # A character that folds to several has an entry for each.
    spread = F.flatten(F.transform(kept, lambda x: F.transform(F.filter(F.split(x.c, ""), lambda y: y != ""), lambda y: F.struct(y.alias("c"), x.i.alias("i")))))
    return F.struct(F.array_join(F.transform(spread, lambda x: x.c), "").alias("shadow"), F.transform(spread, lambda x: x.i).alias("map"))


def to_original(index_map: Column, start: Column, end: Column) -> Column:
    """STR-05: span [start, end) of the shadow as a span of the original."""
    return F.struct(F.get(index_map, start).alias("start"), (F.get(index_map, end - 1) + 1).alias("end"))


def collapsed_shadow(c) -> Column:
    """STR-06: STR-04 with runs of white space as one space that keeps the run's first place."""
    s = shadow_map(c)
    text, places = s["shadow"], s["map"]
    chars = F.transform(F.split(text, ""), lambda x, i: F.struct(F.when(x.rlike(r"^\s$"), F.lit(" ")).otherwise(x).alias("c"), i.alias("k")))
    chars = F.filter(chars, lambda x: x.c != "")
    kept = F.filter(chars, lambda x: ~((x.c == " ") & (x.k > 0) & F.substring(text, x.k, F.lit(1)).rlike(r"^\s$")))
    return F.struct(F.array_join(F.transform(kept, lambda x: x.c), "").alias("shadow"), F.transform(kept, lambda x: F.get(places, x.k)).alias("map"))


def find_nth(hay, needle, n) -> Column:
    """STR-07: place (from 0) of the nth (from 1) occurrence, overlaps counted; null if there are fewer."""
    hay, needle, n = _col(hay), _col(needle), n if isinstance(n, Column) else F.lit(n)
    last = F.length(hay) - F.length(needle)
    places = F.when((last >= 0) & (F.length(needle) > 0), F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(hay, i + 1, F.length(needle)) == needle))
    return F.get(places, n - 1)


def locate_in_focus(focus, surface, n) -> Column:
    """STR-08: span of a surface in a text: nth exact, first exact, nth folded, first folded; null if none."""
    focus, surface = _col(focus), _col(surface)
    whole = collapsed_shadow(focus)
    folded = F.trim(collapsed_shadow(surface)["shadow"])
    exact = F.coalesce(find_nth(focus, surface, n), find_nth(focus, surface, 1))
    shadow = F.coalesce(find_nth(whole["shadow"], folded, n), find_nth(whole["shadow"], folded, 1))
    return F.when(exact.isNotNull(), F.struct(exact.alias("start"), (exact + F.length(surface)).alias("end"))).when(shadow.isNotNull(), to_original(whole["map"], shadow, shadow + F.length(folded)))


def squeeze_space(c) -> Column:
    """STR-11: white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def strip_marks(c) -> Column:
    """STR-11: highlight marks out."""
    return F.regexp_replace(_col(c), "</?mark>", "")


def mark_count(c) -> Column:
    """STR-11: pairs of highlight marks."""
    return F.floor(F.regexp_count(_col(c), F.lit("</?mark>")) / 2).cast("int")


def markdown_clean(c) -> Column:
    """STR-12: images out, links and emphasis to their text, code ticks, HTML tags and NBSP out."""
    c = _col(c)
    for pattern, into in [
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"<[^>\n]+>", ""),
        (r"`+", ""),
        (r"\*\*\*|___", ""),
        (r"\*\*|__", ""),
        (r"(?<![\p{L}\p{N}])[*_]([^*_\n]+)[*_](?![\p{L}\p{N}])", "$1"),
        ("\\u00A0", " "),
    ]:
        c = F.regexp_replace(c, pattern, into)
    return c


def match_key(c) -> Column:
    """STR-15: folded, without punctuation, symbols, separators and control characters."""
    return F.regexp_replace(normalize(c), r"[\p{P}\p{S}\p{Z}\p{C}]", "")


def direction(c) -> Column:
    """STR-16: rtl, ltr or null by which letters are more; ties are rtl."""
    right = F.regexp_count(_col(c), F.lit(r"[֐-ࣿיִ-﷿ﹰ-ﻼ]"))
    left = F.regexp_count(_col(c), F.lit(r"[A-Za-zÀ-ɏ]"))
    return F.when(right + left == 0, F.lit(None).cast("string")).when(right >= left, "rtl").otherwise("ltr")


def name_without_kunya(c) -> Column:
    """STR-09: a folded name less a leading kunya, if a word is left."""
    name = squeeze_space(normalize(c))
    cut = F.regexp_replace(name, r"^(ابو|ابا|ابي|ام) \S+ ", "")
    return F.when(F.length(cut) > 0, cut).otherwise(name)


def kunya_case(c) -> Column:
    """STR-09: the three cases of abu as one."""
    return F.regexp_replace(squeeze_space(normalize(c)), r"(?<![\p{L}\p{N}])(ابا|ابي)(?![\p{L}\p{N}])", "ابو")


def name_parts(c) -> Column:
    """STR-10: kunya, shuhra, ism, nasab and nisba of a folded name by the places of its words."""
    words = F.filter(F.split(F.trim(_col(c)), r"\s+"), lambda w: w != "")
    size = F.size(words)
    at = lambda i: F.get(words, i)
    kunya = at(F.lit(0)).isin("ابو", "ابي", "ام") & (size > 1)
    skip = F.when(kunya, 2).otherwise(0)
    left = size - skip
    shuhra = at(skip).isin("ابن", "بن") & (left > 1)
    long_al = lambda w: w.startswith("ال") & (F.length(w) > 4)
    lone = ~shuhra & (left == 1) & long_al(at(skip))
    ism = ~shuhra & ~lone & (left > 0)
    after = skip + F.when(shuhra, 2).when(lone | ism, 1).otherwise(0)
    rest = F.slice(words, after + 1, F.greatest(size - after, F.lit(0)))
    chain = F.regexp_extract(F.array_join(rest, " "), r"^((?:(?:بن|ابن) \S+ ?)+)", 1)
    nasab = F.nullif(F.trim(chain), F.lit(""))
    rest = F.filter(F.split(F.substring(F.array_join(rest, " "), F.length(chain) + 1, F.lit(100000)), " "), lambda w: w != "")
    last = F.get(rest, F.size(rest) - 1)
    return F.struct(
        F.when(kunya, F.concat_ws(" ", at(F.lit(0)), at(F.lit(1)))).alias("kunya"),
        F.when(shuhra, F.concat_ws(" ", at(skip), at(skip + 1))).alias("shuhra"),
        F.when(ism, at(skip)).alias("ism"),
        nasab.alias("nasab"),
        F.when(lone, at(skip)).when(long_al(last), last).alias("nisba"),
    )


def blocking_key(c) -> Column:
    """STR-10: the part of a name that candidates are grouped by."""
    p = name_parts(c)
    return F.coalesce(p["shuhra"], p["kunya"], p["ism"], _col(c))


def slug(c, most: int = 60) -> Column:
    """STR-23: letters and digits joined by hyphens."""
    return F.substring(F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", "-"), F.lit("-")), 1, most)


def title_of(c, most: int = 60) -> Column:
    """STR-23: the first `most` characters of a message, with an ellipsis if there are more."""
    one = squeeze_space(c)
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most)), F.lit("…"))).otherwise(one)


def cited_pages(c) -> Column:
    """STR-22: pages cited as <cite page="n"> and as [..](#p-n), distinct, in order of number."""
    tags = F.regexp_extract_all(_col(c), F.lit(r"<cite\s+page=[\"']?(\d+)"), F.lit(1))
    links = F.regexp_extract_all(_col(c), F.lit(r"\]\(#p-(\d+)\)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.concat(tags, links), lambda x: x.cast("int"))))


def cut_at_sentence(c, most: int = 30000) -> Column:
    """STR-24: at most `most` characters, cut after the last sentence end in the later half, else plainly."""
    head = F.substring(_col(c), 1, most)
    stop = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?؟\n])", 1))
    return F.when(F.length(_col(c)) <= most, _col(c)).when(stop > most // 2, F.substring(head, F.lit(1), stop)).otherwise(head)


def highlight(c, query: str) -> Column:
    """STR-26: literal matches, in any case, between marks."""
    return F.regexp_replace(_col(c), "(?iu)\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E", "<mark>$0</mark>") if query else _col(c)


def snippet(c, query: str, most: int = 160) -> Column:
    """STR-26: half of `most` characters on both sides of the first match, with ellipses, else the beginning."""
    c = _col(c)
    at = F.locate(query.lower(), F.lower(c)) - 1
    lo = F.greatest(at - most // 2, F.lit(0))
    hi = F.least(at + len(query) + most // 2, F.length(c))
    hit = F.concat(F.when(lo > 0, "…").otherwise(""), F.substring(c, lo + 1, hi - lo), F.when(hi < F.length(c), "…").otherwise(""))
    return F.when(at >= 0, hit).when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def locale_digits(c, arabic: bool = True) -> Column:
    """STR-27: ASCII digits as Arabic ones, or back."""
    return F.translate(_col(c).cast("string"), DIGITS_TO[:10], DIGITS_FROM[:10]) if arabic else F.translate(_col(c), DIGITS_FROM, DIGITS_TO)


def file_type(c) -> Column:
    """STR-27: label of a file name's extension."""
    ext = F.lower(F.regexp_extract(_col(c), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "", "FILE").when(ext.isin("doc", "docx"), "WORD").when(ext.isin("md", "markdown"), "MARKDOWN").otherwise(F.upper(ext))


def relative_age(seconds: Column) -> Column:
    """STR-27: age as a phrase."""
    day = F.floor(seconds / 86400)
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min ago"))).when(day < 1, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h ago"))).otherwise(F.concat(day.cast("string"), F.lit(" d ago")))


def page_list(c) -> Column:
    """STR-29: '1-20,25' as sorted distinct numbers; what is no number or range is dropped."""
    parts = F.filter(F.transform(F.split(_col(c), ","), lambda x: F.trim(x)), lambda p: p.rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$"))
    ends = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("a"), F.regexp_extract(p, r"(\d+)$", 1).cast("int").alias("b")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(ends, lambda e: e.a <= e.b), lambda e: F.sequence(e.a, e.b)))))


def csv_values(*columns) -> Column:
    """FIL-13: values of the first column that is not blank, trimmed, without blanks and repeats, in order."""
    first = F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in columns])
    return F.array_distinct(F.filter(F.transform(F.split(first, ","), lambda x: F.trim(x)), lambda x: x != ""))


def fixed_pages(c, size: int = 2000) -> Column:
    """STR-01: pages as struct<page, content>: by form feeds, else by blank lines, else by `size` characters; blank ones are left out but counted."""
    c = F.coalesce(_col(c), F.lit(""))
    count = F.greatest(F.ceil(F.length(c) / size).cast("int"), F.lit(1))
    by_size = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))
    parts = F.when(c.contains("\f"), F.split(c, "\f")).when(c.rlike(r"\n{3,}"), F.split(c, r"\n{3,}")).otherwise(by_size)
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    pages = F.filter(F.transform(parts, lambda p, i: F.struct((i + 1).alias("page"), strip(p).alias("content"))), lambda p: p.content != "")
    return F.when(F.size(pages) > 0, pages).otherwise(F.array(F.struct(F.lit(1).alias("page"), F.lit("").alias("content"))))


def markdown_pages(c) -> Column:
    """STR-02: pages between {n} separator lines, numbered after blank ones are dropped; null without separators."""
    mark = r"(?m)^\{\d+\}-{3,}[ \t]*$"
    parts = F.filter(F.transform(F.split(_col(c), mark), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.when(_col(c).rlike(mark), F.transform(parts, lambda p, i: F.struct((i + 1).alias("page"), p.alias("content"))))


def page_hash(c) -> Column:
    """HSH-01: SHA-256 of a page."""
    return F.sha2(F.coalesce(_col(c), F.lit("")).cast("binary"), 256)


def corpus_hash(hashes: Column) -> Column:
    """HSH-01: SHA-256 of sorted hashes, one a line."""
    return F.sha2(F.array_join(F.array_sort(hashes), "\n").cast("binary"), 256)


def dedupe_key(*parts) -> Column:
    """HSH-01: SHA-256 of parts joined by a unit separator; a null part is empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def html_text(c) -> Column:
    """SRC-08: text of an HTML block: line ends for block tags, spaces for cells, entities read, blank lines dropped."""
    c = _col(c)
    for pattern, into in [
        (r"(?is)<(script|style)\b.*?</\1\s*>", ""),
        (r"(?s)<!--.*?-->", ""),
        (r"(?i)<br\s*/?>|</(p|li|tr|h[1-6]|div)\s*>", "\n"),
        (r"(?i)</(td|th)\s*>", " "),
        (r"<[^>]*>", ""),
        ("&nbsp;|\\u00A0", " "),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;|&apos;", "'"),
        ("&amp;", "&"),
        (r"[ \t\r]+", " "),
        (r" ?\n[ \n]*", "\n"),
    ]:
        c = F.regexp_replace(c, pattern, into)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def markdown_source(c) -> Column:
    """SRC-06: no byte order mark, LF line ends, form feeds as spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(c), "^\\uFEFF", ""), "\r\n?", "\n"), "\f", " ")


def tags_valid(c, most: int = 16, length: int = 32) -> Column:
    """STR-31: tags trimmed, blanks and repeats out; null where there are too many or one is too long."""
    tags = F.array_distinct(F.filter(F.transform(_col(c), lambda x: F.trim(x)), lambda t: t != ""))
    return F.when((F.size(tags) <= most) & F.forall(tags, lambda t: F.length(t) <= length), tags)


def pinned_valid(c, most: int = 10, text: int = 2000, label: int = 120) -> Column:
    """STR-31: pinned passages struct<page, text, label> with page above 0 and a text, cut to length; at most `most`."""
    good = F.filter(_col(c), lambda p: (p.page > 0) & (F.trim(p.text) != ""))
    return F.slice(F.transform(good, lambda p: F.struct(p.page.alias("page"), F.substring(p.text, 1, text).alias("text"), F.substring(p.label, 1, label).alias("label"))), 1, most)


def marked_tokens(c, most: int = 24) -> Column:
    """STR-20: the first `most` different words between highlight marks, folded, in order."""
    marked = F.regexp_extract_all(_col(c), F.lit("(?s)<mark>(.*?)</mark>"), F.lit(1))
    return F.slice(F.array_distinct(F.flatten(F.transform(marked, lambda m: exact_tokens(m)))), 1, most)


#: Kinds of match from the strongest to the weakest.
KINDS = ["exact", "lexical", "semantic"]


def match_kind(kind, lexical, semantic) -> Column:
    """STR-21: the stated kind if it is known, else lexical or semantic by the score that there is."""
    return F.when(_col(kind).isin(KINDS), _col(kind)).when(F.coalesce(_col(lexical), F.lit(0.0)) > 0, "lexical").when(F.coalesce(_col(semantic), F.lit(0.0)) > 0, "semantic").otherwise("lexical")


#: A few function words of each language, for a guess at a text's language.
PROFILES = {
    "ar": ["في", "من", "على", "الى", "عن"],
    "de": ["der", "die", "und", "das", "nicht", "von", "zu"],
    "en": ["the", "of", "and", "to", "that", "is", "with"],
    "es": ["el", "los", "las", "y", "una", "por", "con"],
    "fr": ["le", "les", "des", "et", "une", "est", "dans"],
}


def _member(values: list[str]):
    return lambda w: w.isin(values)


def language(c) -> Column:
    """STR-25, a stand-in for a detector: the language with most of its function words in the text, null without any."""
    words = tokens(c)
    hits = [F.struct(F.size(F.filter(words, _member(p))).alias("n"), F.lit(code).alias("code")) for code, p in PROFILES.items()]
    best = F.array_max(F.array(*hits))
    return F.when(best.n > 0, best.code)
