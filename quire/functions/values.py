"""Numbers, arrays, maps and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def clamp01(c) -> Column:
    """MTH-01."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(c).cast("double")))


def squash(c, half: float = 3.0) -> Column:
    """MTH-01: x / (x + 3)."""
    return _col(c) / (_col(c) + F.lit(half))


def box_union(boxes) -> Column:
    """MTH-02: the box [x0, y0, x1, y1] around all boxes."""
    edge = lambda i: F.transform(_col(boxes), lambda b: F.get(b, F.lit(i)))
    return F.when(F.size(_col(boxes)) > 0, F.array(F.array_min(edge(0)), F.array_min(edge(1)), F.array_max(edge(2)), F.array_max(edge(3))))


def proportional_split(x0, x1, lengths) -> Column:
    """MTH-02: spans of [x0, x1] in proportion to the lengths (least 1 each)."""
    parts = F.transform(_col(lengths), lambda n: F.greatest(n.cast("double"), F.lit(1.0)))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    upto = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0.0), lambda a, x: a + x)
    wide = _col(x1) - _col(x0)
    return F.transform(parts, lambda n, i: F.struct((_col(x0) + wide * upto(i) / total).alias("x0"), (_col(x0) + wide * upto(i + 1) / total).alias("x1")))


def median(c) -> Column:
    """MTH-02: aggregate."""
    return F.percentile(_col(c), 0.5)


def expand_ranges(ranges, most: int = 21) -> Column:
    """ARR-01: struct<lo, hi> ranges as sorted distinct numbers, at most `most` a range."""
    one = lambda r: F.sequence(r.lo, F.least(F.coalesce(r.hi, r.lo), r.lo + most - 1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(_col(ranges), lambda r: F.coalesce(r.hi, r.lo) >= r.lo), one))))


def capped_set(values, most: int = 200) -> Column:
    """ARR-01: sorted distinct values, the first `most`."""
    return F.slice(F.array_sort(F.array_distinct(_col(values))), 1, most)


def label(c, names: dict[str, str]) -> Column:
    """MAP-01: the label of an enum value, the value itself where there is none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), _col(c)), _col(c))


def sanitized(json, string: int = 2000, key: int = 64, total: int = 8192) -> Column:
    """JSN-01: event metadata with keys and strings cut; where it is still large, its short scalars alone; {} for no object."""
    raw = F.coalesce(F.from_json(_col(json), "map<string,string>"), F.create_map().cast("map<string,string>"))
    small = F.map_from_entries(F.transform(F.map_entries(raw), lambda e: F.struct(F.substring(e.key, 1, key).alias("key"), F.substring(e.value, 1, string).alias("value"))))
    least = F.map_filter(small, lambda k, v: (F.length(v) <= 200) & ~v.rlike(r"^[\[{]"))
    return F.when(F.octet_length(F.to_json(small)) <= total, F.to_json(small)).otherwise(F.to_json(least))


def path_equals(json, path: str, value) -> Column:
    """JSN-02: whether the value at a JSON path equals a value, by text."""
    return F.get_json_object(_col(json), path) == F.lit(str(value))


def lenient_object(c) -> Column:
    """JSN-03: the outermost object of an answer, without fences; null where none parses."""
    body = F.regexp_extract(_col(c), r"(?s)(\{.*\})", 1)
    return F.when(F.from_json(body, "map<string,string>").isNotNull() & (body != ""), body)


def whitelisted(json, kinds: dict[str, str]) -> Column:
    """JSN-04: the known keys of an object as a struct of the given types; what does not convert is null."""
    m = F.from_json(_col(json), "map<string,string>")
    def cast(name, kind):
        return F.try_element_at(m, F.lit(name)).try_cast(kind).alias(name)
    return F.struct(*[cast(n, k) for n, k in kinds.items()])


def flat_time(c) -> Column:
    """JSN-05: struct<kind, year, month, day, year_to, approximate, anchor_text> as the columns that each kind fills."""
    t = _col(c)
    dated = t.kind.isin("hijri", "hijri_range")
    return F.struct(
        t.kind.alias("time_kind"),
        F.when(dated, t.year).alias("hijri_year"),
        F.when(t.kind == "hijri", t.month).alias("hijri_month"),
        F.when(t.kind == "hijri", t.day).alias("hijri_day"),
        F.when(t.kind == "hijri_range", t.year_to).when(t.kind == "hijri", t.year).alias("hijri_year_to"),
        F.when(dated, F.coalesce(t.approximate, F.lit(False))).alias("approximate"),
        F.when(t.kind == "relative", t.anchor_text).alias("anchor_text"),
    )


def flat_ref(c) -> Column:
    """JSN-05: struct<ref_kind, sura, aya_start, aya_end, collection, number> as its grouping key."""
    r = _col(c)
    aya = F.when(F.coalesce(r.aya_end, r.aya_start) != r.aya_start, F.concat_ws("-", r.aya_start, r.aya_end)).otherwise(r.aya_start.cast("string"))
    quran = F.concat_ws(":", F.lit("quran"), r.sura.cast("string"), aya)
    return F.when(r.ref_kind == "quran", quran).when(r.ref_kind == "hadith", F.concat_ws(":", r.collection, r.number.cast("string")))
