"""Readers of the shapes that questions come with: CSV tables, embedded tables, triples, SQLite files."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def clean_header(name: str) -> str:
    return " ".join(name.replace("﻿", "").split("\n")).strip()


def csv_strings(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, malformed lines skipped, header cleaned."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, mode="DROPMALFORMED", multiLine=True, quote='"', escape='"', encoding=encoding)
    return df.toDF(*[clean_header(c) for c in df.columns])


def embedded_table(records: DataFrame, table: str = "table_json") -> DataFrame:
    """id, row number, column and cell of tables kept as JSON {header, rows}."""
    parsed = records.select("id", F.from_json(table, "header array<string>, rows array<array<string>>").alias("t"))
    rows = parsed.select("id", "t.header", F.posexplode("t.rows").alias("row_no", "row"))
    return rows.select("id", "row_no", F.posexplode("header").alias("column_no", "column_name"), "row").select("id", "row_no", "column_name", F.get("row", F.col("column_no")).alias("cell"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o from JSON lines (subject or s, ...), or from text with tabs or commas, by the name's end; incomplete rows are left out."""
    if path.endswith((".json", ".jsonl")):
        raw = spark.read.schema("subject string, predicate string, object string, s string, p string, o string").json(path, multiLine=path.endswith(".json"))
        df = raw.select(F.coalesce("subject", "s").alias("s"), F.coalesce("predicate", "p").alias("p"), F.coalesce("object", "o").alias("o"))
    else:
        df = spark.read.schema("s string, p string, o string").csv(path, sep="," if path.endswith(".csv") else "\t")
    return df.dropna()


def examples(spark: SparkSession, path: str, ids: list[str] | None = None, id_column: str = "id") -> DataFrame:
    df = spark.read.json(path, multiLine=True)
    return df if ids is None else df.where(F.col(id_column).cast("string").isin(*ids))


def checked_copy(spark: SparkSession, source: str, target: str, expected: int) -> int:
    """JSON lines to JSON files; a different number of records than expected is an error, as is a bad line."""
    df = spark.read.json(source, mode="FAILFAST")
    n = df.count()
    if n != expected:
        raise ValueError(f"{source} has {n} records, not {expected}")
    df.write.mode("overwrite").json(target)
    return n


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """One task for each range of row ids; equality and null filters become part of the query."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table = options["path"], options["table"]
        self.parts, self.schema = int(options.get("partitions", "4")), schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters):
        from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, IsNotNull, LessThan, LessThanOrEqual

        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and isinstance(f.value, (int, float, str)) and len(f.attribute) == 1:
                self.where.append(f'"{f.attribute[0]}" {signs[type(f)]} ?')
                self.values.append(f.value)
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.where.append(f'"{f.attribute[0]}" IS NOT NULL')
            yield f  # Spark applies it again: SQLite compares across types

    def _open(self) -> sqlite3.Connection:
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        con.text_factory = lambda b: b.decode(errors="replace")
        return con

    def partitions(self) -> list[_Range]:
        with self._open() as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        kinds = {"bigint": int, "double": float, "string": str}
        cast = [kinds[f.dataType.simpleString()] for f in self.schema]
        names = ", ".join(f'"{f.name}"' for f in self.schema)
        where = " AND ".join(["rowid >= ? AND rowid < ?", *self.where])
        with self._open() as con:
            for row in con.execute(f'SELECT {names} FROM "{self.table}" WHERE {where}', (part.low, part.high, *self.values)):
                yield tuple(None if v is None else c(v) for v, c in zip(row, cast, strict=True))


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("table", t).load(path); path must be one that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            info = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        kind = lambda k: T.LongType() if "INT" in k.upper() else T.DoubleType() if any(x in k.upper() for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.StringType()
        return T.StructType([T.StructField(c[1], kind(c[2] or "")) for c in info])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def sqlite_boxes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    spark.dataSource.register(SqliteSource)
    return {t: spark.read.format("sqlite").option("table", t).load(path) for t in sqlite_tables(path)}
