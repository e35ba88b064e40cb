"""Keys, bridge tables and pruning over schema metadata, which is small by nature."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keys(meta: DataFrame) -> DataFrame:
    """table_name, column_names and kind (primary) from positional metadata: table_names, column_names (table, name), primary_keys (arrays of places)."""
    exploded = meta.select("table_names", "column_names", F.posexplode("primary_keys").alias("place", "key"))
    column = lambda i: F.get("column_names", i)
    return exploded.select(
        F.get("table_names", column(F.get("key", F.lit(0)))["table"]).alias("table_name"), F.array_join(F.transform("key", lambda i: column(i)["name"]), ",").alias("column_names"), F.lit("primary").alias("kind"),
    )


def foreign_keys(meta: DataFrame) -> DataFrame:
    column = lambda i: F.get("column_names", i)
    pair = meta.select("table_names", "column_names", F.explode("foreign_keys").alias("key"))
    end = lambda k: (F.get("table_names", column(F.get("key", F.lit(k)))["table"]), column(F.get("key", F.lit(k)))["name"])
    (a, b), (c, d) = end(0), end(1)
    return pair.select(a.alias("from_table"), b.alias("from_column"), c.alias("to_table"), d.alias("to_column"))


def shortest_path(edges: list[tuple[str, str]], start: str, goal: str) -> list[str]:
    """Tables from start to goal over undirected foreign keys, [] where there is no way; of equally short ones the first by name."""
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    came: dict[str, str | None] = {start: None}
    queue = deque([start])
    while queue:
        t = queue.popleft()
        if t == goal:
            path = []
            while t is not None:
                path.append(t)
                t = came[t]
            return path[::-1]
        for n in sorted(near.get(t, ())):
            if n not in came:
                came[n] = t
                queue.append(n)
    return []


def bridge_tables(edges: list[tuple[str, str]], linked: list[str]) -> set[str]:
    """Tables on the shortest paths between linked ones that aren't linked themselves."""
    found = set()
    for i, a in enumerate(sorted(linked)):
        for b in sorted(linked)[i + 1 :]:
            found.update(shortest_path(edges, a, b))
    return found - set(linked)


def bridges(spark: SparkSession, edges: list[tuple[str, str]], linked: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in sorted(bridge_tables(edges, linked))], "table_name string")


def linked_tables(paths: DataFrame) -> DataFrame:
    """Distinct small-letter table names of a column path: table or table.column."""
    return paths.select(F.lower(F.element_at(F.split("path", r"\."), 1)).alias("table_name")).where("table_name <> ''").distinct()


def pruned(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """Foreign keys whose both ends are among tables."""
    t = tables.select(F.col("table_name").alias("_t"))
    return fks.join(t, F.col("from_table") == F.col("_t"), "left_semi").join(t, F.col("to_table") == F.col("_t"), "left_semi")
