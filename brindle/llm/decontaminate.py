"""Benchmark decontamination. DataFrame functions only.

The benchmark's normalised word n-grams (whole items where they are shorter)
become a table of hash, words and item ids. Each document's windows are
hashed in one pass and looked up in the hash set, which goes to the executors
inside the plan while it holds at most most_hashes; the few windows that pass
are joined with the table on the hash, and count only when the words are
equal. For a larger benchmark the set becomes a bitmap of at least eight bits
for each window (MOST_BITS at most) in which two bits of the hash are looked up,
so that few windows but the true ones leave their document; these are joined
by broadcast up to most_hashes * 20 rows and by shuffle beyond, with equal results.

Null and empty texts have no words: such documents have no hit, such items no
window. Items that repeat an item_id are one item with several texts. Rows of
documents are kept apart even when they repeat; an empty benchmark hits
nothing. Columns beyond those named are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import ALNUM, lowered, words, written

MOST_BITS = 1 << 25


def _hashed(name: str, n: int) -> Column:
    """The hash of an array of at most n words, as of so many columns."""
    hashed = F.lit(None).cast("bigint")
    for size in range(n, 0, -1):
        hashed = F.when(F.size(name) == size, F.xxhash64(*[F.get(name, F.lit(k)) for k in range(size)])).otherwise(hashed)
    return hashed


def windows(items: DataFrame, n: int) -> DataFrame:
    """hash, words (array), size and items (array of ids as strings) of each window of the benchmark."""
    w = F.col("w")
    size = F.least(F.size(w), F.lit(n))
    starts = F.sequence(F.lit(1), F.size(w) - size + 1)
    return (
        items.select(F.col("item_id").cast("string").alias("item"), words(lowered(F.coalesce(F.col("text"), F.lit(""))), ALNUM).alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice(w, i, size))).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
        .select(_hashed("words", n).alias("hash"), "words", F.size("words").alias("size"), "items")
    )


def bitmap(hashes: DataFrame, rows: int) -> tuple[Column, int]:
    """An array of longs with two bits set for each hash, as a literal, and its length, a power of two."""
    longs = max(64, min(MOST_BITS, 8 * rows) // 64)
    longs = min(MOST_BITS // 64, 1 << (longs - 1).bit_length())
    h = F.explode(F.array("hash", F.shiftrightunsigned("hash", 32))).alias("h")
    at = F.shiftrightunsigned("h", 6).bitwiseAND(longs - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    found = hashes.select(h).groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).collect()  # MOST_BITS / 64 rows at most
    own = [0] * longs
    for at, bits in found:
        own[at] = bits
    return F.split(F.lit(",".join(map(str, own))), ",").cast("array<bigint>"), longs


def hits(docs: DataFrame, items: DataFrame, keep: list[str], n: int = 10, most_hashes: int = 100_000) -> DataFrame:
    """keep, n_words, hit (start and end of every benchmark window, in words) and items (ids) for each row of docs."""
    table = written(windows(items, n), "windows")
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # at most n values
    rows = table.count()
    w = F.col("_w")
    df = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), words(lowered(F.coalesce(F.col("text"), F.lit(""))), ALNUM).alias("_w"))
    df = df.select(*keep, "_row", "_w", F.size("_w").cast("long").alias("n_words"))

    none = "array<struct<start:int,size:int,hash:bigint>>"
    inside = rows <= most_hashes

    def known(values: DataFrame) -> str:
        got = values.distinct().collect()
        return ", ".join(f"bigint('{r[0]}')" if r[0] == -(2**63) else f"{r[0]}L" for r in got)

    def window(size: int) -> str:
        return ", ".join(f"get(_w, i + {k})" for k in range(size))

    def candidates(size: int) -> Column:
        """Windows whose hash is in the set; there, the hash of their first and last word is looked up before."""
        own = table.where(F.col("size") == size)
        enough = F.size(w) >= size
        empty = F.array().cast(none)
        if inside:
            ends = own.select(F.xxhash64(F.get("words", F.lit(0)), F.get("words", F.lit(size - 1))))
            test = f"xxhash64(get(_w, i), get(_w, i + {size - 1})) IN ({known(ends)}) AND xxhash64({window(size)}) IN ({known(own.select('hash'))})"
            made = f"transform(filter(sequence(0, size(_w) - {size}), i -> {test}), i -> struct(i AS start, {size} AS size, xxhash64({window(size)}) AS hash))"
            return F.when(enough, F.expr(made)).otherwise(empty)
        bits, longs = bitmap(own.select("hash"), rows)
        is_set = lambda h: F.bit_get(F.get(bits, F.shiftrightunsigned(h, 6).bitwiseAND(longs - 1).cast("int")), h.bitwiseAND(63).cast("int")) == 1
        all_ = F.expr(f"transform(sequence(0, size(_w) - {size}), i -> struct(i AS start, {size} AS size, xxhash64({window(size)}) AS hash))")
        return F.when(enough, F.filter(all_, lambda x: is_set(x["hash"]) & is_set(F.shiftrightunsigned(x["hash"], 32)))).otherwise(empty)

    cand = F.concat(F.array().cast(none), *[candidates(s) for s in sizes])
    df = df.select(*keep, "_row", "n_words", "_w", cand.alias("_c"))
    df = df.select(*keep, "_row", "n_words", F.explode_outer(F.transform("_c", lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), x["hash"].alias("hash"), F.slice(w, x["start"] + 1, x["size"]).alias("words")))).alias("c"))
    df = df.select(*keep, "_row", "n_words", "c.*")
    right = table.select(F.col("hash").alias("_hash"), F.col("words").alias("_words"), "items")
    if rows <= most_hashes * 20:
        right = F.broadcast(right)
    joined = df.join(right, (df["hash"] == F.col("_hash")) & (df["words"] == F.col("_words")), "left")
    hit = F.when(F.col("items").isNotNull(), F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end")))
    grouped = joined.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in [*keep, "n_words"]], F.array_sort(F.collect_list(hit)).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return grouped.select(*keep, "n_words", "hit", "items")


def n_hit(hit: Column) -> Column:
    """Words inside any of the spans, which come in order."""
    return F.aggregate(
        hit, F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["at"]))).alias("n")),
        lambda acc: acc["n"],
    )


def report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    df = hits(docs, items, ["doc_id"], n)
    return df.select(
        "doc_id", "n_words", n_hit(F.col("hit")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def without_hits(docs: DataFrame, items: DataFrame, n: int = 10, spans: bool = False, most_broadcast: int = 200_000) -> DataFrame:
    """docs without the rows that hold a benchmark window; with spans, those rows stay without the words hit (the others joined by spaces).

    Rows are told apart by doc_id and a hash of the text. The rows that hit
    are broadcast only when there are most_broadcast at most.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    bad = hits(docs.select("doc_id", "text", F.xxhash64(text).alias("tag")), items, ["doc_id", "tag"], n).where(F.size("hit") > 0)
    bad = written(bad.groupBy("doc_id", "tag").agg(F.first("hit").alias("hit")), "hits")
    small = F.broadcast(bad) if bad.count() <= most_broadcast else bad
    same = docs["doc_id"].eqNullSafe(small["doc_id"]) & (F.xxhash64(text) == small["tag"])
    if not spans:
        return docs.join(small, same, "left_anti")
    hit = small["hit"]
    inside = lambda i: F.exists(hit, lambda h: (h["start"] <= i) & (i < h["end"]))
    left = F.concat_ws(" ", F.filter(words(lowered(text), ALNUM), lambda x, i: ~inside(i)))
    new = F.when(hit.isNotNull(), left).otherwise(docs["text"])
    return docs.join(small, same, "left").select(*[new.alias(c) if c == "text" else docs[c] for c in docs.columns])
