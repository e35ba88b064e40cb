"""Scoring of answers, and votes over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.normalize import value


def score(pred: DataFrame, gold: DataFrame, example: str = "example_id", item: str = "item") -> DataFrame:
    """em and f1 for each example from sets of items; without any on both sides both are 1 (the example does not show)."""
    p = pred.select(example, item).distinct().withColumn("_p", F.lit(1))
    g = gold.select(example, item).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [example, item], "full").groupBy(example)
    counts = both.agg(F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return counts.select(example, "tp", "fp", "fn", F.when((F.col("fp") == 0) & (F.col("fn") == 0), 1.0).otherwise(0.0).alias("em"), F.round(f1, 4).alias("f1"))


def tuple_item(columns: list[Column]) -> Column:
    """A row as one canonical string: order counts."""
    return F.to_json(F.array(*[value(c, "rows") for c in columns]))


def row_set_item(columns: list[Column]) -> Column:
    """A row as the set of its values: neither order nor repetition counts."""
    return F.to_json(F.array_sort(F.array_distinct(F.array(*[F.coalesce(value(c, "sets"), F.lit("\x00null")) for c in columns]))))


def hit_at_1(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """hit_1 for each example: whether its first item (by pos) is a gold one."""
    w = Window.partitionBy("example_id").orderBy("pos")
    first = ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("example_id", value(F.col("item"), "graph").alias("item"))
    g = gold.select("example_id", value(F.col("item"), "graph").alias("item")).distinct().withColumn("_g", F.lit(1))
    return first.join(g, ["example_id", "item"], "left").select("example_id", F.when(F.col("_g").isNotNull(), 1).otherwise(0).alias("hit_1"))


def answer_hash(answer: Column) -> Column:
    """md5 of an answer's rows, in sorted order."""
    return F.md5(F.to_json(F.array_sort(answer)))


def vote(votes: DataFrame) -> DataFrame:
    """The winning vote of each example: votes have example_id, vote_id and hash (null: failed). Most votes win, then the lesser hash; the least vote_id stands for it."""
    per = votes.groupBy("example_id", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("vote_id").alias("vote_id"))
    w = Window.partitionBy("example_id").orderBy(F.col("hash").isNull(), F.desc("n"), "hash")
    every = Window.partitionBy("example_id")
    counted = per.withColumn("total_votes", F.sum("n").over(every)).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return counted.select("example_id", "vote_id", F.when(F.col("hash").isNull(), 0).otherwise(F.col("n")).cast("bigint").alias("vote_count"), "total_votes")


def vote_shares(votes: DataFrame) -> DataFrame:
    """The share, in percent of all votes, of each answer and of failures."""
    per = votes.groupBy("example_id", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("vote_id").alias("_v"))
    every = Window.partitionBy("example_id")
    label = F.when(F.col("hash").isNull(), F.lit("failed")).otherwise(F.concat(F.lit("vote_"), F.col("_v").cast("string")))
    return per.select("example_id", label.alias("label"), F.round(F.col("n") * 100.0 / F.sum("n").over(every), 4).alias("percentage"))


def casefold_item(columns: list[Column]) -> Column:
    """A row as one string of trimmed small letters: order counts."""
    return F.to_json(F.array(*[F.replace(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("None")))), F.lit("ß"), F.lit("ss")) for c in columns]))


def distinct_rows(rows: DataFrame, pos: str) -> DataFrame:
    """Rows that are not all null, each once, with its first pos."""
    columns = [c for c in rows.columns if c != pos]
    return rows.dropna(how="all", subset=columns).groupBy(*columns).agg(F.min(pos).alias(pos))


def restored_ids(df: DataFrame, column: str, names: DataFrame, most_names: int = 100_000) -> DataFrame:
    """column as ids: what follows the last ###, else an id as it is, else the id of a name (names has name and id), else the text. Rows left empty after ### go."""
    bare = F.trim(F.regexp_replace(F.col(column), r"[\[\]'\"]", ""))
    known = names.groupBy(F.col("name").alias("_name")).agg(F.max("id").alias("_id"))
    if known.limit(most_names + 1).count() <= most_names:
        known = F.broadcast(known)
    joined = df.withColumn("_bare", bare).join(known, F.col("_bare") == F.col("_name"), "left")
    marked, is_id = F.col("_bare").contains("###"), F.col("_bare").rlike(r"^[mg]\.\w+")
    found = F.when(marked, F.trim(F.substring_index("_bare", "###", -1))).when(is_id, F.col("_bare")).otherwise(F.coalesce("_id", "_bare"))
    return joined.withColumn(column, found).where(~(marked & (F.col(column) == ""))).drop("_bare", "_name", "_id")


def shaped(result: object) -> list[list]:
    """An answer over tables as rows: a value is one row, of a flat list each value is one; whole numbers, also as text, lose their .0."""

    def cell(v: object) -> object:
        try:
            whole = isinstance(v, (float, str)) and float(v) == int(float(v))
        except (ValueError, OverflowError):  # text, and what is no finite number
            return v
        return type(v)(int(float(v))) if whole and isinstance(v, str) else int(v) if whole else v

    if result is None:
        return []
    values = list(result) if isinstance(result, (list, tuple)) else [result]
    if all(isinstance(row, (list, tuple)) for row in values):
        return [[cell(v) for v in row] for row in values]
    return [[cell(v)] for v in values]
