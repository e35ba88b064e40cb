"""A training corpus from raw documents: each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, decontaminate, ngram_join, quality, secrets
from brindle.llm.common import table, written
from brindle.llm.pieces import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the decision is by doc_id and text, so rows of one doc_id are judged apart."""
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    judged = quality.judge(docs.withColumn("_tag", tag), table(spark, sf_dir, "labels"), more=["_tag"])
    gone = written(judged.where("NOT kept").select(F.col("doc_id").alias("_d"), F.col("_tag").alias("_t")).distinct(), "rejected")
    if gone.count() <= 1_000_000:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_d"]) & (tag == gone["_t"]), "left_anti")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, 0.8."""
    return ngram_join.one_of_each(docs, 5, 80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; documents without any stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # columns of any name stay apart
    found = secrets.scan(rows, ["row"])
    text, hit = F.col("row.text"), F.size("spans") > 0
    new = found.select("row", hit.alias("hit"), F.when(hit, secrets.redacted(F.coalesce(text, F.lit("")), F.col("spans"))).otherwise(text).alias("new"))
    own = {"text": F.col("new"), "n_chars": F.when(F.col("hit"), F.length("new").cast("bigint")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return new.select(*[own[c].alias(c) if c in own else F.col(f"row.{c}").alias(c) for c in docs.columns])


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    return bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: SQL has no BPE; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
