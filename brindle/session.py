"""Session settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def merged(base: dict, over: dict) -> dict:
    """base with the values of over; dictionaries in both are merged in their turn, and neither argument changes."""
    both = {k: merged(base[k], v) for k, v in over.items() if isinstance(v, dict) and isinstance(base.get(k), dict)}
    return {**base, **over, **both}


def setting(tree: dict, name: str, default: object = None) -> object:
    """The value at a dotted name, or default where a part of it is missing."""
    first, _, rest = name.partition(".")
    if not isinstance(tree, dict) or first not in tree:
        return default
    return setting(tree[first], rest, default) if rest else tree[first]


def local_session(cores: int | None = None, memory: str = "8g", app: str = "brindle", **extra: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    conf = SETTINGS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(n), "spark.driver.host": "127.0.0.1"}
    builder = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=conf | extra)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
