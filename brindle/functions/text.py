"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surface(c: Column) -> Column:
    """Small letters and digits, everything else one blank, no blanks at the ends. ß counts as ss, as case folding has it."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))


def identifier(c: Column) -> Column:
    """A name that can stand unquoted: / and . become _, other odd runs one _, a box_ before a digit or nothing."""
    bare = F.regexp_replace(F.replace(F.trim(c), F.lit("/"), F.lit(".")), r"^\.+|\.+$", "")
    name = F.replace(F.regexp_replace(bare, "[^A-Za-z0-9_.]+", "_"), F.lit("."), F.lit("_"))
    return F.when(name.rlike("^([0-9]|$)"), F.concat(F.lit("box_"), name)).otherwise(name)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 3) + 1


def json_object(c: Column) -> Column:
    """The JSON in a fenced block, else from the first { to the } that closes it; null without any. Braces count inside strings too."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    parts = F.regexp_extract_all(F.regexp_extract(c, r"(?s)(\{.*)", 1), F.lit(r"[{}][^{}]*"), F.lit(0))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part.startswith("{"), 1).otherwise(-1)
        return F.struct((acc["at"] + 1).alias("at"), depth.alias("depth"), F.when((acc["end"] == 0) & (depth == 0), acc["at"] + 1).otherwise(acc["end"]).alias("end"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))
    closed = F.transform(F.array(F.aggregate(parts, start, step, lambda acc: acc["end"])), lambda k: F.when(k > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(k - 1, F.lit(0))), ""), F.lit("}"))))
    return F.when(F.get_json_object(F.nullif(fenced, F.lit("")), "$").isNotNull(), fenced).otherwise(F.get(closed, F.lit(0)))


def answer_items(c: Column) -> Column:
    """A free-form answer as a list of strings: a JSON list, or what commas part."""
    listed = F.from_json(c, "array<string>")
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(c).startswith("["), F.coalesce(listed, parts)).otherwise(parts)



def pattern_labels(c: Column) -> Column:
    """The query patterns that a text shows, sorted; basic when there is none."""
    up = F.upper(c)
    has = lambda *words: [up.contains(w) for w in words]
    any_of = lambda *cs: F.greatest(*cs, F.lit(False))
    case, iif, inline = c.rlike(r"(?i)CASE\s+WHEN"), up.contains("IIF"), c.rlike(r"(?i)if\s+.+?\s+else\s+")
    counted = any_of(*has("SUM", "COUNT"))
    inline_counted = any_of(F.lower(c).contains("sum("), F.lower(c).contains("count"), F.lower(c).contains("len("))
    joins = F.regexp_count(c, F.lit(r"\.merge\(")) + F.regexp_count(up, F.lit(r"\bJOIN\b"))
    sorted_, grouped, head = any_of(up.contains("ORDER BY"), c.contains(".sort_values(")), any_of(up.contains("GROUP BY"), c.contains(".groupby(")), c.contains(".head(")
    rules = {
        "conditional_agg": (case & counted) | (inline & inline_counted),
        "value_mapping": (case & ~counted) | iif | (inline & ~inline_counted),
        "count_distinct": (up.contains("COUNT") & up.contains("DISTINCT")) | c.contains(".nunique()"),
        "like_pattern": any_of(up.contains("LIKE"), c.contains(".startswith("), c.contains(".str.contains(")),
        "between": up.contains("BETWEEN"),
        "subquery": c.rlike(r"(?i)\bIN\s*\("),
        "percentage": c.rlike(r"(?i)(?:SUM|COUNT)\s*\(.*\)\s*\*?\s*100") | F.lower(c).contains("percentage"),
        "group_order_limit": (up.contains("GROUP BY") & up.contains("ORDER BY") & up.contains("LIMIT")) | (sorted_ & head & grouped),
        "having": up.contains("HAVING"),
        "union": up.contains("UNION"),
        "string_date": any_of(c.rlike(r"(?i)STRFTIME|JULIANDAY|SUBSTR"), c.contains(".dt."), c.contains("pd.to_datetime")),
        "multi_join": joins >= 3,
        "join": (joins >= 1) & (joins < 3),
        "order_limit": sorted_ & head & ~grouped,
        "null_check": any_of(up.contains("IS NULL"), up.contains("IS NOT NULL"), c.contains(".notna()"), c.contains(".isna()")),
        "simple_agg": any_of(c.contains(".mean()"), up.contains("AVG")),
    }
    found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    return F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit("basic")))


def names_to_ids(c: Column, ids: dict[str, str]) -> Column:
    """Names of one question in a text become their ids, longer names first."""
    for name in sorted(ids, key=len, reverse=True):
        c = F.replace(c, F.lit(name), F.lit(ids[name]))
    return c
