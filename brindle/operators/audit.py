"""Checks of data releases: counts, projections, forbidden keys and checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.graph import union


def complete(datasets: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """dataset, n_records, expected and complete for each dataset with its expected count."""
    one = lambda name, df, n: df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_records"), F.lit(n).alias("expected"), (F.count(F.lit(1)) == n).alias("complete"))
    return union([one(name, df, n) for name, (df, n) in datasets.items()])


def projected(records: DataFrame, columns: list[str], fallback_id: str) -> DataFrame:
    """Only columns, of those that records have; id falls back to another column where it is missing or null."""
    other = F.col(fallback_id).cast("string")
    own = {"id": F.coalesce(F.col("id").cast("string"), other) if "id" in records.columns else other}
    return records.select(*[own.get(c, F.col(c)).alias(c) for c in columns if c in own or c in records.columns])


def nested_keys(df: DataFrame, column: str, forbidden: list[str]) -> DataFrame:
    """key and n: the rows whose JSON has a forbidden key at any depth.

    A key is a string before a colon; strings go as wholes, so one inside a value is none.
    """
    keys = F.regexp_extract_all(column, F.lit(r'"((?:[^"\\]|\\.)*+)"(\s*:)?'), F.lit(0))
    names = F.transform(F.filter(keys, lambda k: k.endswith(":")), lambda k: F.regexp_extract(k, r'^"((?:[^"\\]|\\.)*+)"', 1))
    wanted = F.array(*[F.lit(k) for k in forbidden])
    return df.select(F.explode(F.array_intersect(names, wanted)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def checksum(df: DataFrame) -> Column:
    """An aggregate that is equal for equal rows in any order: the sum of the first 60 bits of each row's SHA-256."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return F.sum(F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)"))


def released(df: DataFrame, path: str) -> dict[str, int | str]:
    """Writes df as JSON lines; records and checksum of what is read back, which must equal those of df."""
    ours = df.agg(F.count(F.lit(1)).alias("n"), checksum(df).alias("h")).first()
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    theirs = back.agg(F.count(F.lit(1)).alias("n"), checksum(back).alias("h")).first()
    if ours != theirs:
        raise ValueError(f"{path} holds {theirs.n} records that differ from the {ours.n} written")
    return {"records": theirs.n, "checksum": str(theirs.h or 0)}
