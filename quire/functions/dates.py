"""Hijri dates, calendars and time buckets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGITS_FROM, DIGITS_TO, _col

MAX_PLAUSIBLE, GREGORIAN_CUTOFF, MAX_YEAR = 1600, 1500, 2200
#: Strings that say that a date is unknown, without separators.
UNKNOWN = ["دت", "تغم", "مجهول", "غيرمعروف", "nd", "unknown", ""]
#: Words before a year that say nothing about it.
NOISE = "نحو|حوالي|حوالى|تقريبا|تقريبًا|بعد|قبل|سنة|توفي|توفى|المتوفى|circa|ca\\.|c\\.|~"
#: Era marks after a year.
HIJRI_MARK = r"(?:هـ|ﻫ|ه(?![\p{L}\p{N}_])|هجري(?:ة)?|A\.?\s?H\.?(?![A-Za-z])|H(?![A-Za-z]))"
GREGORIAN_MARK = r"(?:م(?![\p{L}\p{N}_])|ميلادي(?:ة)?|C\.?E\.?(?![A-Za-z])|A\.?D\.?(?![A-Za-z]))"

#: Spelled-out numbers after folding, whose sum is a year.
NUMBER_WORDS = {
    "واحد": 1, "واحده": 1, "احدي": 1, "اثنين": 2, "اثنتين": 2, "ثلاث": 3, "ثلاثه": 3, "اربع": 4, "اربعه": 4,
    "خمس": 5, "خمسه": 5, "ست": 6, "سته": 6, "سبع": 7, "سبعه": 7, "ثمان": 8, "ثمانيه": 8, "ثماني": 8, "تسع": 9,
    "تسعه": 9, "عشر": 10, "عشره": 10, "عشرين": 20, "ثلاثين": 30, "اربعين": 40, "خمسين": 50, "ستين": 60,
    "سبعين": 70, "ثمانين": 80, "تسعين": 90, "مائه": 100, "مئه": 100, "مايه": 100, "مائتين": 200, "مئتين": 200,
    "ثلاثمائه": 300, "ثلثمائه": 300, "اربعمائه": 400, "خمسمائه": 500, "ستمائه": 600, "سبعمائه": 700,
    "ثمانمائه": 800, "ثمانيمائه": 800, "تسعمائه": 900, "الف": 1000,
}


def gregorian_to_hijri(year) -> Column:
    """DAT-02: rounded half to even."""
    return F.bround((_col(year) - 622) * 33 / 32).cast("int")


def hijri_to_gregorian(year) -> Column:
    """DAT-05."""
    return F.bround(_col(year) * 32 / 33 + 622).cast("int")


def hijri_century(year) -> Column:
    """DAT-03: null below 1."""
    year = _col(year)
    return F.when(year >= 1, F.floor((year + 99) / 100).cast("int"))


def death_year(c) -> Column:
    """DAT-01: the hijri year of a free-text death date, or null."""
    one = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    text = one(F.replace(F.translate(_col(c), DIGITS_FROM, DIGITS_TO), F.lit("ـ"), F.lit("")))
    compact = F.lower(F.regexp_replace(text, r"[\s.?،,؛;:_\-–—/\\()\[\]]+", ""))
    plain = F.regexp_replace(text, NOISE, " ")
    plain = F.regexp_replace(plain, r"(?:^|\s)ت\s*(?=\d)", " ")
    plain = one(F.regexp_replace(plain, r"(\d{1,4})\s*[-–—/\\]\s*\d{1,4}", "$1"))
    number = lambda pattern: F.nullif(F.regexp_extract(plain, pattern, 1), F.lit("")).cast("int")
    hijri, gregorian, bare = number(r"(\d{1,4})\s*" + HIJRI_MARK), number(r"(\d{1,4})\s*" + GREGORIAN_MARK), number(r"(\d{1,4})")
    year = F.coalesce(hijri, gregorian_to_hijri(gregorian), F.when(bare > GREGORIAN_CUTOFF, gregorian_to_hijri(bare)).otherwise(bare))
    return F.when(~compact.isin(UNKNOWN) & ~text.rlike("(?i)قرن|century") & year.between(1, MAX_PLAUSIBLE), year)


def death_fields(c) -> Column:
    """DAT-04: struct<year, century>."""
    year = death_year(c)
    return F.struct(year.alias("year"), hijri_century(year).alias("century"))


def spelled_number(c) -> Column:
    """DAT-07: the sum of spelled-out numbers, null where a word is unknown or the sum is not in 1..2200."""
    # The conjunction splits words, as the words themselves hold no such letter but at their start.
    parts = F.filter(F.split(_col(c), r"\s+|و"), lambda w: w != "")
    lookup = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    values = F.transform(parts, lambda w: F.try_element_at(lookup, w))
    total = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    return F.when((F.size(parts) > 0) & total.between(1, MAX_YEAR), total)


def calendar(marker, year) -> Column:
    """DAT-08: struct<calendar, confidence>: sure where marked; a bare year up to 1500 is hijri."""
    marker, year = _col(marker), _col(year)
    kind = F.when(marker.isin("ه", "هجريه"), "hijri").when(marker.isin("م", "ميلاديه"), "gregorian").when(year <= GREGORIAN_CUTOFF, "hijri").otherwise("gregorian")
    return F.struct(kind.alias("calendar"), F.when(marker.isin("ه", "هجريه", "م", "ميلاديه"), 0.9).otherwise(0.6).alias("confidence"))


def converted(kind, year) -> Column:
    """DAT-05: struct<hijri, gregorian>; years of other calendars stay raw, with neither."""
    kind, year = _col(kind), _col(year)
    return F.struct(
        F.when(kind == "hijri", year).when(kind == "gregorian", gregorian_to_hijri(year)).alias("hijri"),
        F.when(kind == "gregorian", year).when(kind == "hijri", hijri_to_gregorian(year)).alias("gregorian"),
    )


def kept_since(ts, days: int = 180, now: Column | None = None) -> Column:
    """DAT-09: whether a row is young enough to stay."""
    now = F.current_timestamp() if now is None else now
    return _col(ts) >= now - F.make_dt_interval(F.lit(days))


def day_bucket(ts) -> Column:
    """DAT-10: the UTC day as yyyymmdd."""
    return F.date_format(_col(ts), "yyyyMMdd")


def seconds_to_midnight(ts) -> Column:
    """DAT-10."""
    return (86400 - (F.hour(_col(ts)) * 3600 + F.minute(_col(ts)) * 60 + F.second(_col(ts)))).cast("int")
