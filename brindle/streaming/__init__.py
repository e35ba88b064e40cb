"""Incremental results. The data model is batch only; this sink alone grows while examples come in."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_results(stream: DataFrame, path: str, checkpoint: str):
    """Appends finished examples of a stream as they come, each once: a restarted query goes on at its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
