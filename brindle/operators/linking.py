"""Values of a question against the cells of a database, and links between sources."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brindle.functions.text import surface

#: Search values come from one question; more of them are joined without a broadcast.
MOST_VALUES = 10_000


def _small(values: DataFrame) -> DataFrame:
    return F.broadcast(values) if values.limit(MOST_VALUES + 1).count() <= MOST_VALUES else values


def ratio_bound(a: Column, b: Column) -> Column:
    """No less than the edit similarity of a and b: twice the shorter length over both."""
    n, m = F.length(a), F.length(b)
    return 2 * F.least(n, m) / F.greatest(n + m, F.lit(1))


@F.pandas_udf(DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def resolve_exact(values: DataFrame, cells: DataFrame) -> DataFrame:
    """For each search value its first exact cell (small letters, trimmed), by table, column and cell."""
    v = _small(values.where(~F.trim("value").rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")).select("value", F.lower(F.trim("value")).alias("_k")))
    hit = cells.where(F.lower("column_name") != "id").join(v, F.lower(F.trim("cell")) == F.col("_k"))
    w = Window.partitionBy("value").orderBy("table_name", "column_name", "cell")
    return hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("value", "table_name", "column_name", F.trim("cell").alias("matched_value"), F.lit(1.0).alias("score"))


def resolve_fuzzy(values: DataFrame, cells: DataFrame, threshold: float = 0.75, best: int = 5) -> DataFrame:
    """The best cells for each search value by edit similarity of at least threshold: a bound on lengths first, then the exact ratio in batches."""
    v = _small(values.where(~F.trim("value").rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")).select("value", F.lower(F.trim("value")).alias("_k"), F.length(F.trim("value")).alias("_m")))
    c = cells.where(F.lower("column_name") != "id").where(F.trim("cell") != "").withColumn("_c", F.lower(F.trim("cell")))
    # Lengths that can reach the threshold join as equal numbers, so no pair of a hopeless length is made.
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    v = v.withColumn("_l", F.explode(F.sequence(F.ceil(F.col("_m") * low).cast("int"), F.floor(F.col("_m") * high).cast("int"))))
    pairs = c.withColumn("_l", F.length("_c")).join(v, "_l")
    scored = pairs.withColumn("score", F.when(F.col("_k") == F.col("_c"), 1.0).otherwise(_ratio("_k", "_c"))).where(F.col("score") >= threshold)
    w = Window.partitionBy("value").orderBy(F.desc("score"), "table_name", "column_name", "cell")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).select("value", "rank", "table_name", "column_name", F.trim("cell").alias("matched_value"), F.round("score", 4).alias("score"))


def _best(df: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("value").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def correct_substring(values: DataFrame, column: DataFrame) -> DataFrame:
    """value, corrected and similarity: the cell (db_value) that holds the value with the largest share of it."""
    c = column.join(_small(values.where(F.length("value") >= 3)), F.expr("contains(db_value, value)"))
    c = c.withColumn("similarity", F.length("value") / F.length("db_value"))
    return _best(c, F.desc("similarity"), F.desc("db_value")).select("value", F.col("db_value").alias("corrected"), F.round("similarity", 3).alias("similarity"))


def correct_casefold(values: DataFrame, column: DataFrame) -> DataFrame:
    c = column.join(_small(values), F.lower("db_value") == F.lower("value"))
    return _best(c, F.col("db_value")).select("value", F.col("db_value").alias("corrected"))


def correct_tokens(values: DataFrame, column: DataFrame, least: float = 0.6) -> DataFrame:
    """The cell that shares most tokens: candidates come by equal tokens, so cells without any are never met."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    v = values.select("value", tokens("value").alias("_v")).where(F.size("_v") >= 2).select("value", "_v", F.explode("_v").alias("_t"))
    c = column.select("db_value", tokens("db_value").alias("_c")).select("db_value", "_c", F.explode("_c").alias("_t"))
    hit = c.join(_small(v), "_t").groupBy("value", "db_value").agg((F.count(F.lit(1)) / F.max(F.greatest(F.size("_v"), F.size("_c")))).alias("score"))
    return _best(hit.where(F.col("score") >= least), F.desc("score"), F.col("db_value")).select("value", F.col("db_value").alias("corrected"), F.round("score", 4).alias("score"))


def correct_by_hint(values: DataFrame, hints: DataFrame, least: float = 0.6) -> DataFrame:
    """The first hint (hint, by its place) whose edit similarity to the value reaches least."""
    h = hints.crossJoin(_small(values.select("value"))).where(ratio_bound(F.col("value"), F.col("hint")) >= least).withColumn("score", _ratio("value", "hint"))
    return _best(h.where(F.col("score") >= least), F.col("place"), F.col("hint")).select("value", F.col("hint").alias("corrected"), F.round("score", 3).alias("similarity"))


def correct_close(values: DataFrame, column: DataFrame, least: float = 0.7, most: int = 20) -> DataFrame:
    """The best of difflib's most closest cells, whose similarity counts with 0.02 for each character of a common start and against 0.01 for each of different length."""
    c = column.where("db_value IS NOT NULL").join(_small(values.select("value")), ratio_bound(F.col("value"), F.col("db_value")) >= least)
    close = c.withColumn("_near", _ratio("db_value", "value")).where(F.col("_near") >= least)  # difflib asks cell first, and its ratio depends on the order
    close = close.withColumn("_n", F.row_number().over(Window.partitionBy("value").orderBy(F.desc("_near"), F.desc("db_value")))).where(F.col("_n") <= most).drop("_n")
    at = F.sequence(F.lit(1), F.greatest(F.least(F.length("value"), F.length("db_value")), F.lit(1)))
    same = F.transform(at, lambda i: F.substring("value", i, F.lit(1)) == F.substring("db_value", i, F.lit(1)))
    prefix = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))
    scored = close.withColumn("_own", _ratio("value", "db_value")).withColumn("_s", F.col("_own") + 0.02 * prefix - 0.01 * F.abs(F.length("value") - F.length("db_value")))
    return _best(scored, F.desc("_s"), F.desc("db_value")).select("value", F.col("db_value").alias("corrected"), F.round("_own", 3).alias("similarity"))


def correct(values: DataFrame, column: DataFrame, hints: DataFrame) -> DataFrame:
    """value, corrected, method and similarity by the first way that has a correction: substring, hint, closest cell, same but for case, common tokens."""
    ways = {
        "substring_containment": correct_substring(values, column), "execution_state_hint": correct_by_hint(values, hints), "fuzzy_match": correct_close(values, column),
        "case_insensitive_match": correct_casefold(values, column).withColumn("similarity", F.lit(1.0)), "token_overlap": correct_tokens(values, column).withColumnRenamed("score", "similarity"),
    }
    found = [df.select("value", "corrected", F.lit(m).alias("method"), "similarity", F.lit(i).alias("_way")) for i, (m, df) in enumerate(ways.items())]
    return _best(reduce(DataFrame.unionByName, found), F.col("_way")).drop("_way")


def coexisting(candidates: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
    """id, a value for each column and their total similarity: of the candidates (id, value, similarity) by column, those that stand in one row together.

    The highest total wins, then the least values; an id without such a row goes. Rows meet candidates by equal values only.
    """
    columns, out = list(candidates), rows.select(*candidates)
    for i, (column, found) in enumerate(candidates.items()):
        own = _small(found.select(F.col("id").alias(f"_id{i}"), F.col("value").alias(f"_v{i}"), F.col("similarity").alias(f"_s{i}")))
        same = F.col(column) == F.col(f"_v{i}")
        out = out.join(own, same & (F.col("_id0") == F.col(f"_id{i}")) if i else same).drop(f"_v{i}", *([f"_id{i}"] if i else []))
    total = reduce(lambda a, b: a + b, [F.col(f"_s{i}") for i in range(len(columns))])
    each = out.groupBy(F.col("_id0").alias("id"), *columns).agg(F.max(total).alias("similarity"))
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), *columns)
    return each.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", *columns, F.round("similarity", 4).alias("similarity"))


def contains_instead(values: DataFrame, column: DataFrame) -> DataFrame:
    """Values of which at least half of the parts of three or more characters stand in some cell."""
    parts = F.filter(F.split("value", r"[\s\-_:]"), lambda x: F.length(x) >= 3)
    v = _small(values.select("value", parts.alias("_p")).where(F.size("_p") > 0).select("value", F.size("_p").alias("_n"), F.explode("_p").alias("_t")))
    hit = column.join(v, F.expr("contains(lower(db_value), lower(_t))")).groupBy("value", "_n", "db_value").agg(F.count(F.lit(1)).alias("_k"))
    return hit.groupBy("value", "_n").agg(F.max("_k").alias("n_matched")).where(F.col("n_matched") >= F.col("_n") * 0.5).select("value", "n_matched", F.col("_n").cast("bigint").alias("n_parts"))


def link_exact(cells: DataFrame) -> DataFrame:
    """Column pairs of different sources with common surface forms, and how many: cells have source_id, table_name, column_name and cell."""
    s = cells.select("source_id", "table_name", "column_name", surface(F.col("cell")).alias("form")).where((F.length("form") >= 3) & F.col("form").rlike("[a-z]")).distinct()
    a, b = s.alias("a"), s.alias("b")
    joined = a.join(b, F.expr("a.form = b.form AND a.source_id < b.source_id"))
    name = lambda x: F.concat_ws(".", f"{x}.table_name", f"{x}.column_name")
    return joined.groupBy(name("a").alias("left_column"), name("b").alias("right_column")).agg(F.count(F.lit(1)).alias("n_common"), F.min("a.form").alias("example"))


def link_fuzzy(left: DataFrame, right: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Pairs of forms (form) whose edit similarity reaches threshold. So similar strings of n characters share a block of at least so many that the three-character pieces of the one, taken side by side, include one of the other's: candidates come by equal pieces and like lengths."""
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    a = left.select(F.col("form").alias("left_form")).distinct().withColumn("_p", F.explode(pieces(F.col("left_form"))))
    b = right.select(F.col("form").alias("right_form")).distinct().withColumn("_p", F.explode(pieces(F.col("right_form"))))
    pairs = a.join(b, "_p").where(ratio_bound(F.col("left_form"), F.col("right_form")) >= threshold).select("left_form", "right_form").distinct()
    return pairs.withColumn("score", _ratio("left_form", "right_form")).where(F.col("score") >= threshold).select("left_form", "right_form", F.round("score", 4).alias("score"))


def unused(values: DataFrame, code: str) -> DataFrame:
    """Values of two or more characters that a text of code does not hold."""
    v = F.trim("value")
    return values.where((F.length(v) >= 2) & ~F.contains(F.lit(code), v)).select("value")


def files_of_boxes(files: DataFrame, boxes: DataFrame) -> DataFrame:
    """file and box: files with rows whose name's last dotted part is a box."""
    last = files.where("n_rows > 0").select("file", F.substring_index("file", ".", -1).alias("box"))
    return last.join(boxes.select("box").distinct(), "box").select("file", "box")
