"""Column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import clean


def cells(df: DataFrame, table: str) -> DataFrame:
    """table_name, column_name and cell (text) of every cell, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("cell")) for c in df.columns])
    return df.select(F.lit(table).alias("table_name"), F.inline(pairs))


def distinct_cells(frames: dict[str, DataFrame]) -> DataFrame:
    """Distinct non-null cells of all columns of all frames."""
    return reduce(DataFrame.unionByName, [cells(df, t) for t, df in frames.items()]).where("cell IS NOT NULL").distinct()


def profile(df: DataFrame) -> DataFrame:
    """For each column its rows, non-null and distinct values, share of nulls and flag, from one aggregation."""
    each = [
        F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count(F.col(c)).alias("n_values"), F.count_distinct(F.col(c)).alias("n_distinct"),
            F.coalesce(F.bround(1 - F.count(F.col(c)) / F.count(F.lit(1)), 4), F.lit(0.0)).alias("null_ratio"),
        ).alias(c)
        for c in df.columns
    ]
    rows = df.agg(*each).select(F.inline(F.array(*[F.col(f"`{c}`") for c in df.columns])))
    return rows.withColumn("flag", F.when(F.col("null_ratio") > 0.5, "HIGH-NULL").otherwise(""))


# The shapes that name a pattern.
SHAPES = {"date": r"^\d{4}-\d{2}-\d{2}", "time": r"^\d{2}:\d{2}", "freebase_id": r"^(m|g)\.\w+"}


def pattern(c: Column) -> Column:
    """An aggregate: the shape of more than half of the values, or null."""
    out = F.lit(None).cast("string")
    for name, shape in reversed(SHAPES.items()):
        out = F.when(F.count_if(c.rlike(shape)) > F.count(c) * 0.5, name).otherwise(out)
    return out


# The flag of a pattern.
FLAGS = {"date": "DATE", "time": "TIME", "freebase_id": "ID"}


def flagged(df: DataFrame) -> DataFrame:
    """column_name and flags (DATE, TIME or ID by the shape of most values; HIGH-NULL where more than half are null), from one aggregation."""
    each = []
    for c in df.columns:
        shape, empty = pattern(F.col(c).cast("string")), F.count(F.col(c)) < F.count(F.lit(1)) * 0.5
        named = [F.when(shape == p, flag) for p, flag in FLAGS.items()]
        each.append(F.struct(F.lit(c).alias("column_name"), F.concat_ws(" ", *named, F.when(empty, "HIGH-NULL")).alias("flags")).alias(c))
    return df.agg(*each).select(F.inline(F.array(*[F.col(f"`{c}`") for c in df.columns])))


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """column_name, cell, n and place of the k most frequent values of each column, of equally frequent ones the least first."""
    from pyspark.sql import Window

    counts = cells(df, "").where("cell IS NOT NULL").groupBy("column_name", "cell").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "cell")
    return counts.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def described(df: DataFrame, table: str, samples: int = 3) -> str:
    """A line for each column: its type, flags and most frequent values. Only these come to the driver."""
    flags = dict(map(tuple, flagged(df).collect()))
    common: dict[str, list[str]] = {}
    for row in sorted(top_values(df, samples).collect(), key=lambda r: r.place):
        common.setdefault(row.column_name, []).append(row.cell)
    lines = [f"  - {c} ({t}){' ' + flags[c] if flags[c] else ''} | {', '.join(common.get(c, []))}" for c, t in df.dtypes]
    return "\n".join([f"Table: {table}", *lines])


def warnings(risks: list[dict[str, str]], most: int = 5) -> str:
    """The first risks (risk_type, severity, message, wrong_description) as text, with how many more there are; empty without any."""
    out = []
    for risk in risks[:most]:
        out.append(f"[{risk.get('severity', 'warning')}] {risk.get('risk_type', 'risk').replace('_', ' ')}: {risk.get('message', '')}".rstrip(": "))
        out += [f"  avoid: {risk['wrong_description']}"] if risk.get("wrong_description") else []
    return "\n".join(out + ([f"and {len(risks) - most} more"] if len(risks) > most else []))


def cvt_columns(df: DataFrame, known: DataFrame, sample: int = 50) -> DataFrame:
    """column_name, n, n_ids and n_unknown over the first sample distinct values by order, and is_cvt: most values are ids, and most ids name no known entity."""
    pairs = cells(df, "").where("cell IS NOT NULL").select("column_name", "cell").distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("column_name").orderBy("cell")
    head = pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sample)
    ids = known.select(F.col(known.columns[0]).cast("string").alias("_id")).distinct()
    is_id = F.col("cell").rlike(r"^(m|g)\.\w+")
    joined = head.join(ids, F.col("cell") == F.col("_id"), "left")
    per = joined.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_id).alias("n_ids"), F.count_if(is_id & F.col("_id").isNull()).alias("n_unknown"))
    return per.withColumn("is_cvt", (F.col("n_ids") > F.col("n") * 0.5) & (F.col("n_unknown") > F.col("n") * 0.5))


def cleaned(df: DataFrame, position: list[str], columns: list[str]) -> DataFrame:
    """df with the text columns named cleaned by the kind of their first ten non-null cells.

    Dates and numbers of such columns are rewritten, times stay; a mixed
    column's numbers are rewritten one by one. What a cleaner can't read stays.
    All columns' first cells, each from a sort with a limit, come in one job.
    """
    found = []
    for name in columns:
        first = df.where(F.col(name).isNotNull()).orderBy(*position).limit(10)
        found.append(first.agg(F.lit(name).alias("name"), F.collect_list(clean.cell_kind(F.col(name))).alias("kinds"), F.count(F.lit(1)).alias("total")))
    if not found:
        return df
    kinds = {r.name: r.kind for r in reduce(DataFrame.unionByName, found).select("name", clean.column_kind(F.col("kinds"), F.col("total")).alias("kind")).collect()}
    out = {}
    for name, kind in kinds.items():
        c = F.col(name)
        new = {"date": clean.date(c), "numeric": clean.number(c).cast("string"), "mixed": clean.number(c).cast("string")}.get(kind)
        out[name] = c if new is None else F.coalesce(new, c)
    return df.withColumns(out)
