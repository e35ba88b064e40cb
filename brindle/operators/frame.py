"""Dataframe verbs with the semantics of in-memory data frames where they differ from SQL's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal(c: Column, v) -> Column:
    return c == v


def unequal(c: Column, v) -> Column:
    """Keeps rows whose value is null."""
    return ~c.eqNullSafe(F.lit(v))


def contains(c: Column, s: str, case: bool = True, regex: bool = False) -> Column:
    """False for null."""
    if regex:
        return F.coalesce(c.rlike(s if case else f"(?i){s}"), F.lit(False))
    return F.coalesce((c if case else F.lower(c)).contains(s if case else s.lower()), F.lit(False))


def startswith(c: Column, s: str) -> Column:
    return F.coalesce(c.startswith(s), F.lit(False))


LIST_ROWS = 1024


def paired(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str]) -> DataFrame:
    """Inner join, null keys matching, for keys that are frequent on both sides; no column name is on both.

    Rows of right are put in lists of at most LIST_ROWS of one key. Each row of
    left is repeated once for each list of its key, these are dealt out to all
    cores, and each meets one list: pairs are made where they leave, so a task
    holds lists, not pairs, and work is even however rows lie in files or keys.
    Dealt by range, a task has few lists, which keeps files of pairs small.
    All columns must be of types that can be ordered.
    """
    spark, keys = left.sparkSession, [f"_k{i}" for i in range(len(right_on))]
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = [F.col(b).alias(k) for b, k in zip(right_on, keys, strict=True)]
    met = reduce(lambda p, q: p & q, [F.col(a).eqNullSafe(F.col(k)) for a, k in zip(left_on, keys, strict=True)])
    place = F.row_number().over(Window.partitionBy(*right_on).orderBy(*right.columns)) - 1
    lists = right.withColumn("_list", F.floor(place / LIST_ROWS)).groupBy(*named, "_list").agg(F.collect_list(F.struct(*right.columns)).alias("_rows"))
    sizes = right.groupBy(*named).agg(F.floor((F.count(F.lit(1)) - 1) / LIST_ROWS).alias("_last"))
    blocks = left.join(sizes, met).select(*left.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("_at"))
    dealt = blocks.repartitionByRange(tasks, *left_on, "_at", *left.columns)
    return dealt.join(lists, met & (F.col("_at") == F.col("_list"))).select(*left.columns, F.inline("_rows"))


def merge(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], suffixes: tuple[str, str] = ("_x", "_y"), many: bool = False) -> DataFrame:
    """Inner join in which null keys match; columns that both sides have get suffixes, equal key names stay one column. Keys of unlike kinds are refused.

    many is for keys that are frequent on both sides; see paired().
    """
    text = lambda df, c: dict(df.dtypes)[c] == "string"
    for a, b in zip(left_on, right_on, strict=True):
        if text(left, a) != text(right, b):
            raise ValueError(f"keys {a} and {b} are of unlike types; cast one of them")
    shared = {a for a, b in zip(left_on, right_on, strict=True) if a == b}
    both = set(left.columns) & set(right.columns) - shared
    x = left.select(*[F.col(c).alias(f"{c}{suffixes[0]}" if c in both else c) for c in left.columns])
    y = right.select(*[F.col(c).alias(f"{c}{suffixes[1]}" if c in both else f"_r_{c}" if c in shared else c) for c in right.columns])
    name = lambda c, s: f"{c}{s}" if c in both else c
    ons = [(name(a, suffixes[0]), f"_r_{b}" if a == b else name(b, suffixes[1])) for a, b in zip(left_on, right_on, strict=True)]
    both_rows = paired(x, y, *map(list, zip(*ons, strict=True))) if many else x.join(y, reduce(lambda p, q: p & q, [x[a].eqNullSafe(y[b]) for a, b in ons]), "inner")
    return both_rows.drop(*[f"_r_{c}" for c in shared])


def group(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """groupBy without the groups of a null key."""
    return df.dropna(subset=keys).groupBy(*keys).agg(*[c.alias(k) for k, c in aggregates.items()])


def total(c: Column) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def ordered(df: DataFrame, *by: tuple[str, bool]) -> DataFrame:
    """Sorted by (column, ascending), nulls last either way."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in by])


def largest(df: DataFrame, n: int, column: str, position: list[str], smallest: bool = False) -> DataFrame:
    """The n rows of largest (or smallest) column; of ties the first by position."""
    c = F.col(column)
    return df.where(c.isNotNull()).orderBy(c.asc() if smallest else c.desc(), *position).limit(n)


def first_of(df: DataFrame, keys: list[str], position: list[Column]) -> DataFrame:
    """drop_duplicates(keys, keep first by position)."""
    w = Window.partitionBy(*keys).orderBy(*position)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_null_columns(df: DataFrame) -> DataFrame:
    """Without columns that are null in every row, unless all are."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    kept = [c for c in df.columns if counts[c]]
    return df.select(*kept) if kept else df


def row_at(df: DataFrame, i: int, position: list[str]) -> DataFrame:
    """The row at place i (from 0) by position."""
    return df.orderBy(*position).offset(i).limit(1)


def largest_of(df: DataFrame, n: int, keys: list[str], position: list[Column], place: str) -> DataFrame:
    """The first n rows of each group by position, numbered in place; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*position)
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n)


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], prefix: str, cell: Column) -> DataFrame:
    """Each row of left with the last row of right of equal keys that is not after it.

    cell, a function of at that never falls while at grows, parts a key's
    rows: within a cell both sides are one sorted run, and each cell gets the
    last row of the cells before. So no pairs are made, and a hot key is as
    many tasks as it has cells. right has one row for each key and time. Null
    keys or times match nothing.
    """
    taken = F.struct(F.col(at), *values)
    kind = right.select(taken.alias("v")).schema["v"].dataType
    known = F.lit(True)
    for k in [*keys, at]:
        known = known & F.col(k).isNotNull()
    rows = left.select(*keys, at, cell.alias("_cell"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(kind).alias("_r"), F.lit(1).alias("_side"))
    found = right.where(known).select(*keys, at, cell.alias("_cell"), F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), taken.alias("_r"), F.lit(0).alias("_side"))
    both = rows.unionByName(found)
    inside = Window.partitionBy(*keys, "_cell").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*keys, "_cell").agg(F.max(F.when(F.col("_side") == 0, F.col(at))).alias("_last"), F.max_by("_r", F.when(F.col("_side") == 0, F.col(at))).alias("_r"))
    carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_kc"), F.last(F.when(F.col("_last").isNotNull(), F.col("_r")), ignorenulls=True).over(before).alias("_before"))
    own = both.withColumn("_v", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    on = F.col("_cell") == F.col("_kc")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    last = F.coalesce("_v", "_before")
    return own.join(carried.where("_before IS NOT NULL"), on, "left").select("_l.*", *[last[c].alias(f"{prefix}{c}") for c in [at, *values]])


def within(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of points and ranges with low <= value < high.

    Both sides meet in cells of width, so the join is one of equal keys: each
    point is in one cell, a range in all that it touches. width is about that of a usual range.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("bigint")
    r = ranges.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    p = points.withColumn("_cell", cell(value))
    return p.join(r, "_cell").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_cell")
