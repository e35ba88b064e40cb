"""Values in canonical form before answers are compared. The profiles differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILES = ("rows", "sets", "table", "graph")


def datetime_string(c: Column) -> Column:
    """Midnight goes, a T between date and time becomes a blank where the seconds end in .0, which goes too."""
    d = r"^(\d{4}-\d{2}-\d{2})"
    c = F.regexp_replace(c, d + r"(?:T|\s+)00:00:00(?:\.0)?$", "$1")
    return F.regexp_replace(c, d + r"(?:T|\s+)(\d{2}:\d{2}:\d{2})\.0$", "$1 $2")


def _number(v: Column, whole_below: float | None) -> Column:
    n = F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v).try_cast("double")
    whole = n == F.floor(n)
    if whole_below:
        whole = whole & (F.abs(n) < whole_below)
    return F.when(whole & (F.abs(n) < 9e18), F.floor(n).cast("bigint").cast("string")).otherwise(F.bround(n, 10).cast("string"))


def value(c: Column, profile: str) -> Column:
    """A canonical string. rows: null is '', whole numbers below 1e15; sets: null stays, dates are normalised; table: small letters, signs of numbers go; graph: small letters."""
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}; there are {PROFILES}")
    v = F.trim(c.cast("string"))
    if profile == "rows":
        return F.coalesce(_number(v, 1e15), v, F.lit(""))
    if profile == "sets":
        v = datetime_string(v)
        return F.coalesce(_number(v, None), v)
    v = F.lower(v)
    plain = F.regexp_replace(v, "[,$%]", "") if profile == "table" else v
    return F.coalesce(_number(plain, None), v, F.lit(""))


def answer(c: Column) -> Column:
    """A result cell as text: no midnight, no .0 after times or whole numbers."""
    v = F.regexp_replace(c, "T00:00:00$", "")
    v = F.regexp_replace(v, r"(\d{2}:\d{2}:\d{2})\.0$", "$1")
    return F.regexp_replace(v, r"^(-?\d+)\.0+$", "$1")


def numeric_string(c: Column) -> Column:
    """A number without needless zeros: whole ones as such, others with six significant digits; other text as it is."""
    v = F.trim(c)
    n = F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v).try_cast("double")
    whole = (n == F.floor(n)) & (F.abs(n) < 1e38)
    shown = F.format_string("%.6g", n)
    short = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when((n == 0) & v.startswith("-"), "-0").when(whole, n.cast("decimal(38,0)").cast("string")).when(n.isNotNull() & ~whole, short).otherwise(c)


def table_cell(c: Column) -> Column:
    """Text of a whole number below 1e38 in its shortest form (11.0 is 11); other text as it is."""
    v = F.trim(c)
    n = F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v).try_cast("double")
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e38), n.cast("decimal(38,0)").cast("string")).otherwise(c)
