"""What the operators share: tables, the shared folder, words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words between ASCII white space; and runs of digits, small ASCII letters and all characters beyond
#: ASCII, that is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, which Java's regex engine matches some 25 times slower when so written.
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[0-9a-z\x80-\x{10FFFF}]+"

_PATHS: dict[int, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where a session of one machine names none (tests) a temporary folder
    takes its place, and goes with the process; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/brindle-{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives lost executors.

    The shuffle files of the job go when it is over; until then lost ones can be made again.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more: jobs that did are over."""
    for df in tables:
        spark, path = df.sparkSession, _PATHS[id(df)]
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    translate() reads a string character by character; lower() does the same
    for texts whose other characters have no lower case, and much faster.
    """
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when((F.octet_length(text) == F.length(text)) | (beyond == F.lower(beyond)), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, pattern: str = SPACED) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


RUN = 256


def running(items: Column, zero: Column, move: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """An array (of type kind) of made(acc, x) for each x of items, where acc is what move() made of zero and all items before.

    Arrays grow by copies, so runs of RUN items are put together first: time is
    close to proportion with the items, not with their square.
    """
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  evaluates value once

    def whole(own: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            x = F.get(own, i)
            return F.struct(move(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(made(acc["at"], x))).alias("out"))

        def run(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.sequence(k * RUN, F.least((k + 1) * RUN, F.size(own)) - 1), F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), step)
            return let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

        start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / RUN).cast("int")), start, run, lambda acc: F.flatten(acc["out"]))

    return let(items, lambda own: F.when(F.size(own) > 0, whole(own)).otherwise(F.array().cast(f"array<{kind}>")))
