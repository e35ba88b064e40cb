"""Cleaning of numbers, dates and times in text cells, as Column expressions.

Each function gives null where the cell is not of its kind; callers coalesce
with the cell. The odd cases are part of the semantics: signs are lost, a k
anywhere multiplies by a thousand, cells with a colon are no numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = "january february march april may june july august september october november december".split()
_NAMES = "|".join([*MONTHS, *[m[:3] for m in MONTHS]])


def number(c: Column) -> Column:
    v = F.trim(c)
    digits = F.regexp_replace(F.regexp_extract(v, r"^[^\d]*([\d,]+\.?\d*)", 1), ",", "")
    plain = F.when(digits.rlike(r"^(\d+\.?\d*|\.\d+)$"), digits).try_cast("double")
    unit = F.lower(F.regexp_extract(v, "(?i)(billion|million|thousand|k)", 1))
    scale = F.when(unit == "billion", 1e9).when(unit == "million", 1e6).when(unit.isin("thousand", "k"), 1e3).otherwise(1.0)
    return F.when(~v.contains(":"), plain * scale / F.when(v.contains("%"), 100.0).otherwise(1.0))


def _month(name: Column) -> Column:
    short = F.substring(F.lower(name), 1, 3)
    index = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS):
        index = F.when(short == m[:3], F.lit(i + 1)).otherwise(index)
    return F.lpad(index.cast("string"), 2, "0")


def date(c: Column) -> Column:
    v = F.trim(c)
    a, b, d = rf"(?i)^({_NAMES})\s+(\d{{1,2}}),?\s*(\d{{4}})", rf"(?i)^(\d{{1,2}})\s+({_NAMES})\s+(\d{{4}})", rf"(?i)^({_NAMES})\s+(\d{{1,2}})"
    part = lambda p, i: F.regexp_extract(v, p, i)
    two = lambda x: F.lpad(x, 2, "0")
    return (
        F.when(v.rlike(a), F.concat_ws("-", part(a, 3), _month(part(a, 1)), two(part(a, 2))))
        .when(v.rlike(b), F.concat_ws("-", part(b, 3), _month(part(b, 2)), two(part(b, 1))))
        .when(v.rlike(d), F.concat_ws("-", F.lit("XXXX"), _month(part(d, 1)), two(part(d, 2))))
    )


def seconds(c: Column) -> Column:
    v = F.trim(c)
    three, two, spelled = r"^(\d{1,2}):(\d{2}):(\d{2})$", r"^(\d{1,2}):(\d{2})$", r"^(\d+)h\s+(\d+)'\s+(\d+)"
    n = lambda p, i: F.regexp_extract(v, p, i).try_cast("double")
    hms = lambda p: n(p, 1) * 3600 + n(p, 2) * 60 + n(p, 3)
    return F.when(v.rlike(three), hms(three)).when(v.rlike(two), n(two, 1) * 60 + n(two, 2)).when(v.rlike(spelled), hms(spelled))


def cell_kind(c: Column) -> Column:
    """date, time or numeric when cleaning would change the cell, in that order; else null."""
    return F.when(date(c).isNotNull() & (date(c) != c), "date").when(seconds(c).isNotNull(), "time").when(number(c).isNotNull(), "numeric")


def column_kind(kinds: Column, total: Column) -> Column:
    """The kind of more than half of the first ten cells, from the array of their kinds."""
    share = lambda k: F.size(F.filter(kinds, lambda x: x == k)) > total * 0.5
    return F.when(total == 0, "unknown").when(share("date"), "date").when(share("time"), "time").when(share("numeric"), "numeric").otherwise("mixed")


def to_numeric(c: Column) -> Column:
    """A double, or null for what is no plain number (d and f suffixes are none)."""
    return F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(c)).try_cast("double")


def to_datetime(c: Column, layout: str = "yyyy-MM-dd") -> Column:
    """A timestamp without zone, or null for another layout."""
    return F.try_to_timestamp(c, F.lit(layout)).cast("timestamp_ntz")
