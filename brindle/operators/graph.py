"""Knowledge-graph triples (s, p, o) as frames: types, subgraphs, sparse boxes and inferred keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import identifier

# Predicates that state a type, in small letters.
TYPE_PREDICATES = ("type", "rdf:type", "instance_of", "type.object.type", "a")


def is_type(p: Column) -> Column:
    return F.lower(p).isin(*TYPE_PREDICATES)


def types(triples: DataFrame) -> DataFrame:
    return triples.where(is_type(F.col("p"))).select(F.col("s").alias("entity"), F.col("o").alias("entity_type")).distinct()


def subgraph(triples: DataFrame, topics: DataFrame, relations: list[str], hops: int) -> DataFrame:
    """Distinct triples of relations that touch a node within hops - 1 steps, in either direction, of a topic.

    Each end of an edge also leads to itself, so a step keeps the nodes met
    before, and the plan names the set of the step before once: it grows in
    proportion with hops.
    """
    edges = triples.where(F.col("p").isin(*relations)).select("s", "p", "o").distinct()
    if hops < 1:
        return edges.limit(0)
    ends = [edges.select(F.col(a).alias("u"), F.col(b).alias("v")) for a in "so" for b in "so"]
    sides = reduce(DataFrame.union, ends).distinct()
    near = topics.select(F.col(topics.columns[0]).alias("node")).distinct()
    for _ in range(hops - 1):
        near = sides.join(near, F.col("u") == F.col("node"), "left_semi").select(F.col("v").alias("node")).distinct()
    touch = lambda c: edges.join(near, F.col(c) == F.col("node"), "left_semi")
    return touch("s").union(touch("o")).distinct()


def typed(triples: DataFrame, entity_types: DataFrame) -> DataFrame:
    """Triples with each type of their subject, entity without one."""
    return triples.join(entity_types, F.col("s") == F.col("entity"), "left").select("s", "p", "o", F.coalesce("entity_type", F.lit("entity")).alias("entity_type"))


def sparse_box(triples: DataFrame, entity_type: str, subject: str, relations: list[str]) -> DataFrame:
    """One row for each distinct triple of the type's subjects: the subject, and the object in its relation's column."""
    own = triples.where(F.col("entity_type") == entity_type)
    return own.select(F.col("s").alias(subject), *[F.when(identifier(F.col("p")) == r, F.col("o")).alias(r) for r in relations]).distinct()


def inferred_keys(boxes: dict[str, DataFrame]) -> DataFrame:
    """Column pairs (table-column) of different boxes that share a value."""
    from brindle.operators.profile import distinct_cells

    c = distinct_cells(boxes).select(F.col("table_name").alias("t"), F.concat_ws("-", "table_name", "column_name").alias("name"), "cell")
    a, b = c.alias("a"), c.alias("b")
    # Pairs of columns are as few as the schema has; they are reduced before they leave a partition.
    return a.join(b, F.expr("a.cell = b.cell AND a.t < b.t")).groupBy(F.col("a.name").alias("left_column"), F.col("b.name").alias("right_column")).agg(F.lit(1).alias("_")).drop("_")


def id_to_name(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """column with the ids that names (id, name, pos) knows replaced, for cells that are one id; of repeated ids the last name counts."""
    last = names.groupBy(F.col("id").alias("_id")).agg(F.max_by("name", "pos").alias("_name"))
    joined = df.join(last, F.col(column) == F.col("_id"), "left")
    return joined.withColumn(column, F.coalesce("_name", F.col(column))).drop("_id", "_name")


ID = r"\b[mg]\.[A-Za-z0-9_]++\b"


def names_in_text(df: DataFrame, key: list[str], column: str, names: DataFrame, most_names: int = 100_000) -> DataFrame:
    """column with each id inside its text replaced by its name, where names (id, name, pos) knows it; key is unique in df.

    Only texts with an id are taken apart, and only ids are joined. Null and empty texts, and unknown ids, stay.
    """
    last = names.groupBy(F.col("id").alias("_id")).agg(F.max_by("name", "pos").alias("_name"))
    if last.limit(most_names + 1).count() <= most_names:
        last = F.broadcast(last)
    whole = F.struct(*key)
    pieces = F.regexp_extract_all(column, F.lit(rf"(?sU){ID}|.+?(?={ID}|\z)"), F.lit(0))
    is_id = F.col("_piece").rlike(rf"(?U)^{ID}\z")
    split = df.where(F.col(column).rlike(f"(?U){ID}")).select(whole.alias("_key"), F.posexplode(pieces).alias("_pos", "_piece"))
    named = split.where(is_id).join(last, F.col("_piece") == F.col("_id"), "left").select("_key", "_pos", F.coalesce("_name", "_piece").alias("_piece"))
    parts = F.array_sort(F.collect_list(F.struct("_pos", "_piece")))
    built = split.where(~is_id).unionByName(named).groupBy("_key").agg(F.array_join(F.transform(parts, lambda p: p["_piece"]), "").alias("_text"))
    joined = df.join(built, whole.eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(column, F.coalesce("_text", column)).drop("_key", "_text")


def two_hops(triples: DataFrame, first: str, second: str) -> DataFrame:
    """start, middle and end of paths through a compound node."""
    a = triples.where(F.col("p") == first).select(F.col("s").alias("start"), F.col("o").alias("middle"))
    b = triples.where(F.col("p") == second).select(F.col("s").alias("middle"), F.col("o").alias("end"))
    return a.join(b, "middle").select("start", "middle", "end")


def triples_of(df: DataFrame, key: Column, columns: dict[str, Column]) -> DataFrame:
    """A triple for each non-null value of columns, by predicate."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), c.cast("string").alias("o")) for p, c in columns.items()])
    return df.select(key.alias("s"), F.inline(pairs)).where("o IS NOT NULL").select("s", "p", "o")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
