"""Segments, windows and knowledge rows: planning, mapping, checks and projections."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import pairwise
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extraction import shadow
from .joins import page_at
from .windows import first_writers, segment_ends, sibling_order


def text_chunks(text: str, size: int = 150_000, overlap: int = 2_000) -> list[tuple[int, int]]:
    """KB-01: spans of at most `size` characters that end after a line break where there is one, each beginning `overlap` before."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            cut = text.rfind("\n", start + overlap, end)
            end = cut + 1 if cut > start + overlap else end
        out.append((start, end))
        start = end if end == len(text) else max(end - overlap, start + 1)
    return out


def chunked(docs: DataFrame, size: int = 150_000, overlap: int = 2_000) -> DataFrame:
    """KB-01: (doc_id, chunk, start, end, text)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(d, k, a, b, t[a:b]) for d, t in zip(pdf.doc_id, pdf.text, strict=True) if t for k, (a, b) in enumerate(text_chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, start int, end int, text string")


def marker_offsets(text: str, lines: list[str]) -> list[int | None]:
    """KB-02: line starts of verbatim marker lines, strictly increasing: exact ahead, folded ahead, exact anywhere."""
    low, places = shadow(re.sub(r"\s", " ", text))
    out: list[int | None] = []
    cursor, last = 0, -1
    for line in lines:
        needle = " ".join((line or "").split())
        at = text.find(needle, cursor) if len(needle) >= 3 else -1
        if at < 0 and len(needle) >= 3:
            from bisect import bisect_left

            k = low.find(shadow(needle)[0], bisect_left(places, cursor))
            at = places[k] if k >= 0 else text.find(needle)
        start = text.rfind("\n", 0, at) + 1 if at >= 0 else -1
        if at < 0 or start <= last:
            out.append(None)
            continue
        out.append(start)
        last, cursor = start, at + len(needle)
    return out


def resolved_markers(docs: DataFrame, markers: DataFrame) -> DataFrame:
    """KB-02: markers (doc_id, ord, line) with their offsets; order runs through a document, so one is one task."""

    def run(key, mine, texts):
        mine = mine.sort_values("ord")
        found = marker_offsets(texts.text.iloc[0] if len(texts) else "", mine.line.tolist())
        import pandas as pd

        return pd.DataFrame({"doc_id": key[0], "ord": mine.ord.tolist(), "offset": pd.array(found, "Int32")})

    return markers.groupBy("doc_id").cogroup(docs.select("doc_id", "text").groupBy("doc_id")).applyInPandas(run, "doc_id long, ord int, offset int")


def segments(points: DataFrame, lengths: DataFrame) -> DataFrame:
    """KB-03, WIN-03, WIN-04: flat segments between merged points (doc_id, start, stream, segment_type)."""
    return sibling_order(segment_ends(points.join(lengths, "doc_id"), "length").drop("length"))


def fallback_windows(lengths: DataFrame, size: int = 3000) -> DataFrame:
    """KB-03: even spans for documents without points."""
    n = F.ceil(F.col("length") / size).cast("int")
    return lengths.where("length > 0").withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).select("doc_id", F.floor(F.col("length") * F.col("k") / n).cast("int").alias("start"), F.floor(F.col("length") * (F.col("k") + 1) / n).cast("int").alias("end"))


def tree_faults(rows: DataFrame, lengths: DataFrame, levels: int = 32) -> DataFrame:
    """KB-04: (doc_id, seg_id, fault): repeated ids, spans out of bounds, missing parents, children outside their parent,
    overlapping siblings, and cycles (found by pointer doubling, so long chains take few rounds)."""
    own = rows.join(lengths, "doc_id", "left")
    fault = lambda df, name: df.select("doc_id", "seg_id", F.lit(name).alias("fault"))
    twice = rows.groupBy("doc_id", "seg_id").count().where("count > 1")
    bounds = own.where((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("length")))
    parents = rows.select("doc_id", F.col("seg_id").alias("parent_id"), F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    child = rows.where("parent_id IS NOT NULL")
    orphans = child.join(parents, ["doc_id", "parent_id"], "left_anti")
    outside = child.join(parents, ["doc_id", "parent_id"]).where("start < _lo OR end > _hi")
    w = Window.partitionBy("doc_id", "stream", "parent_id").orderBy("start", "end")
    over = rows.withColumn("_e", F.lag("end").over(w)).where("_e > start")
    up = child.select("doc_id", "seg_id", F.col("parent_id").alias("up"))
    for _ in range(max(1, levels.bit_length())):
        up = up.join(up.select("doc_id", F.col("seg_id").alias("up"), F.col("up").alias("_next")), ["doc_id", "up"]).select("doc_id", "seg_id", F.col("_next").alias("up"))
    # After that many doublings only members of (or paths into) a cycle still have an ancestor.
    out = fault(twice, "duplicate_id")
    for df, name in ((bounds, "bounds"), (orphans, "missing_parent"), (outside, "outside_parent"), (over, "overlap"), (up, "cycle")):
        out = out.unionByName(fault(df, name))
    return out.distinct()


def leaves(rows: DataFrame) -> DataFrame:
    """KB-05: segments that are no parent, in reading order."""
    return rows.join(rows.select("doc_id", F.col("parent_id").alias("seg_id")).where("seg_id IS NOT NULL").distinct(), ["doc_id", "seg_id"], "left_anti").orderBy("doc_id", "start", "seg_id")


class Leaf(NamedTuple):
    seg_id: str
    start: int
    end: int
    scope: bool = False


#: Where a window may end, the best first: a blank line, a line, a sentence, white space.
BREAK = re.compile(r"((?<=\n)\n)|(\n)|([.۔؟!])|(\s)")


def break_ends(text: str) -> list[list[int]]:
    """Ends of all breaks of a text by kind, each in order."""
    ends: list[list[int]] = [[] for _ in range(BREAK.groups)]
    for m in BREAK.finditer(text):
        ends[m.lastindex - 1].append(m.end())
    return ends


def even_cuts(leaf: Leaf, most: int, ends: list[list[int]]) -> list[int]:
    """Places that part a long leaf about evenly: near each even place the nearest break of the best kind within a quarter of a part."""
    parts = -(-(leaf.end - leaf.start) // most)
    width = (leaf.end - leaf.start) / parts
    cuts = set()
    for place in (leaf.start + round(k * width) for k in range(1, parts)):
        around = (nearest(kind, place, width / 4) for kind in ends)
        cuts.add(next((x for x in around if x is not None), place))
    return sorted(x for x in cuts if leaf.start < x < leaf.end)


def nearest(places: list[int], wanted: int, reach: float) -> int | None:
    """The member of a sorted list nearest to what is wanted, if within reach."""
    k = bisect_left(places, wanted)
    return min((x for x in places[max(0, k - 1) : k + 1] if abs(x - wanted) <= reach), key=lambda x: abs(x - wanted), default=None)


def planned(leaves: list[Leaf], length: int, most: int = 3000, overlap: int = 250, text: str | None = None) -> list[tuple]:
    """KB-06: (context_start, context_end, start, end, ids, oversized): leaves packed up to `most`; a coreference scope is never
    parted but marked when too long; other long leaves are parted about evenly."""
    packs: list[list[Leaf]] = []
    for leaf in leaves:
        # A pack that holds a long leaf is full by itself.
        if packs and leaf.end - packs[-1][0].start <= most:
            packs[-1].append(leaf)
        else:
            packs.append([leaf])
    ends = break_ends(text or "")
    rows = []
    for pack in packs:
        low, high = pack[0].start, pack[-1].end
        long = high - low > most
        cuts = even_cuts(pack[0], most, ends) if long and not pack[0].scope else []
        for x, y in pairwise([low, *cuts, high]):
            rows.append((max(0, x - overlap), min(length, y + overlap), x, y, [leaf.seg_id for leaf in pack], long and pack[0].scope))
    return rows


WINDOWS = "doc_id long, window int, context_start int, context_end int, start int, end int, seg_ids array<string>, oversized boolean"


def windows(leaf_rows: DataFrame, docs: DataFrame, most: int = 3000, overlap: int = 250) -> DataFrame:
    """KB-06 for documents; packing is greedy, so a document is one task."""

    def run(key, rows, texts):
        import pandas as pd

        text = texts.text.iloc[0] if len(texts) else ""
        leaves = [Leaf(r.seg_id, int(r.start), int(r.end), bool(r.is_scope)) for r in rows.sort_values(["start", "seg_id"]).itertuples()]
        return pd.DataFrame([(key[0], k, *w) for k, w in enumerate(planned(leaves, len(text), most, overlap, text))], columns=["doc_id", "window", "context_start", "context_end", "start", "end", "seg_ids", "oversized"])

    return leaf_rows.groupBy("doc_id").cogroup(docs.select("doc_id", "text").groupBy("doc_id")).applyInPandas(run, WINDOWS)


# For each relation the kinds of its subject and object.
DOMAINS = [
    ("narrated_from", "person", "person"), ("student_of", "person", "person"), ("son_of", "person", "person"), ("sibling_of", "person", "person"),
    ("appointed", "person", "person"), ("dismissed", "person", "person"), ("debated", "person", "person"),
    ("refuted", "person work", "person work sect religion"), ("authored", "person", "work"), ("transmitted_work", "person", "work"),
    ("commentary_on", "work", "work"), ("abridgment_of", "work", "work"), ("gloss_on", "work", "work"), ("supplement_to", "work", "work"),
    ("born_in", "person", "place"), ("died_in", "person", "place"), ("resided_in", "person", "place"), ("traveled_to", "person", "place"),
    ("buried_in", "person", "place"), ("nisba_of", "person", "place"), ("member_of_tribe", "person", "tribe"), ("follows_madhhab", "person", "sect"),
    ("member_of_sect", "person", "sect"), ("follows_religion", "person", "religion"), ("converted_to", "person", "religion"), ("sect_of", "sect", "religion"),
    ("held_office", "person", "office"), ("founded", "person", "organization"), ("affiliated_with", "person", "organization"),
    ("taught_at", "person", "organization"), ("studied_at", "person", "organization"), ("published_by", "work", "organization"),
    ("located_in", "organization", "place"), ("part_of", "place organization", "place organization"), ("participated_in", "person", "event"),
    ("occurred_in", "event", "place"),
]
# Ranks of appraisal from the best to the worst; the first six praise.
RANKS = ["awthaq_al_nas", "thiqa_thiqa", "thiqa", "saduq", "saduq_sayyi_al_hifz", "maqbul", "layyin", "daif", "munkar_al_hadith", "matruk", "muttaham_bil_kadhib", "kadhdhab"]
PRAISE = 6


def rank_level(rank: str = "rank"):
    """MAP-01."""
    return F.nullif(F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col(rank)).cast("int"), F.lit(0))


def appraisal_faults(rows: DataFrame) -> DataFrame:
    """Appraisals whose polarity is not that of their rank."""
    level = rank_level()
    return rows.where(level.isNotNull() & ((F.col("polarity") == "tadil") != (level <= PRAISE)))


def checked_relations(relations: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KB-07: relations whose ends exist and are of the right kinds, and the others with the reason."""
    rules = relations.sparkSession.createDataFrame(DOMAINS, "predicate string, _dom string, _ran string")
    kind = lambda end, into: mentions.select(F.col("mention_id").alias(end), F.col("label").alias(into))
    rows = relations.join(kind("src", "_s"), "src", "left").join(kind("dst", "_d"), "dst", "left").join(F.broadcast(rules), "predicate", "left")
    reason = (
        F.when(F.col("_dom").isNull(), "unknown_predicate")
        .when(F.col("_s").isNull() | F.col("_d").isNull(), "missing_endpoint")
        .when(F.col("src") == F.col("dst"), "self_relation")
        .when(~F.array_contains(F.split("_dom", " "), F.col("_s")), "domain")
        .when(~F.array_contains(F.split("_ran", " "), F.col("_d")), "range")
    )
    judged = rows.withColumn("reason", reason).drop("_s", "_d", "_dom", "_ran")
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def assembled(entities: DataFrame, relations: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """KB-08: entities (id, refs) and relations without references to what is not there, dropping until nothing changes or
    `rounds` are over."""
    now = entities
    for _ in range(rounds):
        bad = now.select("id", F.explode("refs").alias("ref")).join(now.select(F.col("id").alias("ref")), "ref", "left_anti").select("id").distinct()
        if bad.isEmpty():
            break
        now = now.join(bad, "id", "left_anti")
    ok = now.select("id")
    kept = relations.join(ok.withColumnRenamed("id", "src"), "src", "left_semi").join(ok.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return now, kept


def to_entities(relations: DataFrame, members: DataFrame) -> DataFrame:
    """KB-09: mention relations between entities; those without an entity or with the same at both ends go."""
    m = lambda end, into: members.select(F.col("mention_id").alias(end), F.col("entity_id").alias(into))
    return relations.join(m("src", "src_entity"), "src").join(m("dst", "dst_entity"), "dst").where("src_entity <> dst_entity").select("src_entity", "predicate", "dst_entity").distinct()


def integrity(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """KB-10: relation ends that no mention has."""
    ids = mentions.select("mention_id")
    ends = relations.select("relation_id", F.explode(F.array("src", "dst")).alias("mention_id"))
    return ends.where("mention_id IS NOT NULL").join(ids, "mention_id", "left_anti").select("relation_id", "mention_id").distinct()


def projected(mentions: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KB-11: mentions once for each (doc, label, span) with page and key, and the way from every mention to the one kept."""
    span = ["doc_id", "label", "start", "end"]
    kept = first_writers(mentions.where("start IS NOT NULL"), span, ["mention_id"])
    at = page_at(kept.withColumn("offset", F.col("start")), pages).drop("offset")
    key = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in span]).cast("binary"), 256)
    alias = mentions.select("mention_id", *span).join(kept.select(F.col("mention_id").alias("kept_id"), *span), span).select("mention_id", "kept_id")
    return at.withColumn("dedupe_key", key), alias


def call_status(plan_: DataFrame, cache: DataFrame) -> DataFrame:
    """KB-12: planned calls by stage: how many are cached and how many are to be paid for, with their characters."""
    rows = plan_.join(cache.select("cache_key", F.lit(True).alias("_hit")), "cache_key", "left")
    return rows.groupBy("stage").agg(F.count("*").alias("calls"), F.count_if(F.col("_hit")).alias("cached"), F.sum(F.when(F.col("_hit").isNull(), F.col("chars")).otherwise(0)).alias("chars_to_bill"))


# Markdown books to text with headings.


def normalized_lines(pages: DataFrame) -> DataFrame:
    """STR-13: lines of pages cleaned, with heading levels and running offsets: rules skipped, underlined headings given to the
    line above, list and quote marks taken off."""
    from ..functions.text import markdown_clean, squeeze_space

    lines = pages.select("doc_id", "page", F.posexplode(F.split("content", "\n")).alias("line", "raw"))
    lines = lines.where(~F.col("raw").rlike(r"^\s*([-*_])(\s*\1){2,}\s*$"))
    under = F.col("raw").rlike(r"^\s*=+\s*$")
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    lines = lines.withColumn("_next", F.lead(under).over(w)).where(~under)
    body = F.regexp_replace(F.regexp_replace("raw", r"^\s*(>\s*)+", ""), r"^\s*([-*+]|\d+[.)])\s+", "")
    level = F.length(F.regexp_extract("raw", r"^(#{1,6})\s", 1))
    text = squeeze_space(markdown_clean(F.when(level > 0, F.regexp_replace("raw", r"^#+\s+", "")).otherwise(body)))
    out = lines.select("doc_id", "page", "line", text.alias("text"), F.when(level > 0, level).when(F.col("_next"), 1).alias("level")).where("text <> ''")
    before = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0).cast("long")))


HEADINGS = "doc_id long, ord int, level int, title string, offset int"


def headings(docs: DataFrame) -> DataFrame:
    """STR-14: <h1..3> and # .. ### headings of documents (doc_id, content) in order of place."""

    def run(batches):
        import html

        import pandas as pd

        tag = re.compile(r"<h([1-3])[^>]*>(.*?)</h\1>|^(#{1,3})\s+(.+)$", re.I | re.S | re.M)
        for pdf in batches:
            rows = []
            for d, text in zip(pdf.doc_id, pdf.content, strict=True):
                for k, m in enumerate(tag.finditer(text or "")):
                    title = html.unescape(re.sub(r"<[^>]+>", "", m[2] if m[1] else m[4].split("\n")[0])).strip()
                    rows.append((d, k, int(m[1]) if m[1] else len(m[3]), " ".join(title.split()), m.start()))
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "level", "title", "offset"])

    return docs.select("doc_id", "content").mapInPandas(run, HEADINGS)
