"""Metadata around boxes: keys from files and databases, column descriptions, boxes of a graph on disk, pruned and empty tables."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import graph
from brindle.sources.boxes import Boxes
from brindle.sources.readers import clean_header, csv_strings, sqlite_tables

KEYS = "table_name string, column_names string, kind string"
LINKS = "from_table string, from_column string, to_table string, to_column string"
MEANINGS = "table_name string, column_name string, meaning string"


# --- keys


def sqlite_keys(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Primary and foreign keys of a SQLite file, composite ones in their order; a reference without columns means the target's key."""
    own, links = [], []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        primary = {}
        for t in sqlite_tables(path):
            info = con.execute("SELECT name, pk FROM pragma_table_info(?) WHERE pk > 0 ORDER BY pk", (t,)).fetchall()
            primary[t] = [c for c, _ in info]
            own += [(t, ",".join(primary[t]), "primary")] * bool(info)
        for t in primary:
            for target, k, column, goal in con.execute('SELECT "table", seq, "from", "to" FROM pragma_foreign_key_list(?) ORDER BY id, seq', (t,)).fetchall():
                goal = goal or (primary.get(target, [])[k : k + 1] or [None])[0]
                links += [(t, column, target, goal)] * (goal is not None)
    return spark.createDataFrame(own, KEYS), spark.createDataFrame(links, LINKS)


def graph_keys(spark: SparkSession, boxes: dict[str, DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """Keys of a graph's boxes: the first column of each, and the pairs "table-column" of path, a JSON array of arrays of them."""
    own = [(t, df.columns[0], "primary") for t, df in boxes.items() if df.columns]
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
    # A table's name may hold a -, so the last one parts it from the column.
    table, column = lambda c: F.regexp_extract(c, r"^(.*)-([^-]*)$", 1), lambda c: F.regexp_extract(c, r"^(.*)-([^-]*)$", 2)
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    links = pairs.where(F.size("p") >= 2).select(table(a).alias("from_table"), column(a).alias("from_column"), table(b).alias("to_table"), column(b).alias("to_column"))
    return spark.createDataFrame(own, KEYS), links


def target_of(links: DataFrame, table: str, column: str) -> DataFrame:
    """The tables and columns that a column refers to."""
    return links.where((F.col("from_table") == table) & (F.col("from_column") == column)).select("to_table", "to_column").distinct()


# --- descriptions


def described(spark: SparkSession, paths: dict[str, str], encoding: str = "ISO-8859-1") -> DataFrame:
    """table_name, column_name and meaning from a CSV of descriptions for each table; the columns go by name, whatever their order."""
    out = spark.createDataFrame([], MEANINGS)
    for table, path in paths.items():
        df = csv_strings(spark, path, encoding=encoding)
        # A byte order mark read as Latin-1 leaves three letters before the first name.
        df = df.toDF(*[clean_header(c.removeprefix("ï»¿")).strip('"').lower() for c in df.columns])
        text = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in ("column_description", "value_description") if c in df.columns]
        name = next((c for c in ("original_column_name", "column_name") if c in df.columns), df.columns[0])
        meaning = F.nullif(F.concat_ws("; ", *text), F.lit("")) if text else F.lit(None).cast("string")
        out = out.unionByName(df.select(F.lit(table).alias("table_name"), F.trim(F.col(f"`{name}`")).alias("column_name"), meaning.alias("meaning")))
    return out.where("column_name <> ''")


def with_meanings(frames: dict[str, DataFrame], meanings: DataFrame) -> dict[str, DataFrame]:
    """frames whose columns carry their meanings as metadata, so that a schema's text shows them. Meanings are as few as the schema's columns."""
    known = {(r.table_name.lower(), r.column_name.lower()): r.meaning for r in meanings.where("meaning IS NOT NULL").collect()}
    said = lambda t, c: {"metadata": {"meaning": known[t.lower(), c.lower()]}} if (t.lower(), c.lower()) in known else {}
    return {t: df.select(*[F.col(f"`{c}`").alias(c, **said(t, c)) for c in df.columns]) for t, df in frames.items()}


# --- boxes of a graph


def graph_boxes(triples: DataFrame, relations: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """A box for each type of subject, `entity` for those without one; a subject of several types is in the box of each.

    A box has the relations that its subjects have, in order of name. The pairs
    of type and relation come to the driver: they are the schema, not the data.
    """
    facts = triples.where(~graph.is_type(F.col("p")))
    if relations is not None:
        facts = facts.where(F.col("p").isin(*relations))
    typed = graph.typed(facts, graph.types(triples))
    schema: dict[str, list[str]] = {}
    for r in typed.select("entity_type", graph.identifier(F.col("p")).alias("r")).distinct().orderBy("entity_type", "r").collect():
        schema.setdefault(r.entity_type, []).append(r.r)
    return {kind: graph.sparse_box(typed, kind, kind, names) for kind, names in schema.items()}


def write_boxes(boxes: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes a folder of CSV parts with headers for each box and foreign_key.json, lines of two "table-column"; returns the pairs."""
    for name, df in boxes.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True, quote='"', escape='"', emptyValue='""')
    links = graph.inferred_keys(boxes)
    pairs = links.orderBy("left_column", "right_column").select(F.array("left_column", "right_column").alias("p")).agg(F.to_json(F.sort_array(F.collect_list("p"))).alias("value"))
    pairs.coalesce(1).write.mode("overwrite").text(f"{folder}/foreign_key.json")
    return links


def read_boxes(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: csv_strings(spark, f"{folder}/{n}") for n in names}


# --- tables by id, and pruning


def table_by_id(spark: SparkSession, folder: str, table_id: str, ending: str = "csv") -> DataFrame:
    """The CSV of a table id anywhere below folder; an error where there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{table_id}.{ending}").load(folder).select("path")
    path = files.agg(F.min("path").alias("path")).first().path
    if path is None:
        raise FileNotFoundError(f"there is no {table_id}.{ending} below {folder}")
    return csv_strings(spark, path)


def filled(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """frames that have a row; the test reads no more than one."""
    return {t: df for t, df in frames.items() if not df.isEmpty()}


def kept_tables(boxes: Boxes, keys: DataFrame, links: DataFrame, tables: Iterable[str]) -> tuple[Boxes, DataFrame, DataFrame]:
    """Boxes, primary keys, and foreign keys with both ends, of tables, named without regard to case."""
    chosen = {t.lower() for t in tables}
    out = Boxes(boxes.spark)
    out.frames = {t: df for t, df in boxes.frames.items() if t.lower() in chosen}
    among = lambda c: F.lower(c).isin(*chosen) if chosen else F.lit(False)
    return out, keys.where(among("table_name")), links.where(among("from_table") & among("to_table"))


def table_of(columns: Iterable[str], boxes: Boxes, sources: Iterable[str] = ()) -> str | None:
    """The box that a frame with these columns comes from: of its sources if known, else of all, the one that has most of its columns; the first by name of equals, none without any."""
    own = set(columns)
    names = [s for s in sources if s in boxes.frames] or sorted(boxes.frames)
    best = max(names, key=lambda n: (len(own & set(boxes[n].columns)), [-ord(x) for x in n]), default=None)
    return best if best is not None and own & set(boxes[best].columns) else None


def context(boxes: Boxes, keys: DataFrame, links: DataFrame, samples: int = 3) -> dict[str, str]:
    """What planners read of boxes: schema, keys, links and samples, each as text."""
    sample = {t: [json.dumps([None if v is None else str(v) for v in r], ensure_ascii=False) for r in boxes.preview(t, samples)] for t in boxes.frames}
    return {
        "schema": boxes.schema_text(),
        "primary_keys": "\n".join(f"{r.table_name}: {r.column_names}" for r in keys.orderBy("table_name").collect()),
        "foreign_keys": "\n".join(f"{r.from_table}.{r.from_column} = {r.to_table}.{r.to_column}" for r in links.orderBy(*links.columns).collect()),
        "samples": "\n".join(f"{t}: {row}" for t, rows in sample.items() for row in rows),
    }
