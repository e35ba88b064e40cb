"""Quality rules with risk-controlled cutoffs. DataFrame functions only.

Every document gets the base measures and a few ratios. Labelled good
documents are the holdout: for each stratum and rule, cutoffs are tried from
the mildest to the strictest, and one is certified while an exact binomial
test rejects "this cutoff turns away more than alpha / rules of the good
documents" at level delta / (strata * rules). Within a rule, the fixed order
needs no further correction; over strata and rules, Bonferroni's holds. So
with probability 1 - delta no stratum loses more than alpha of its good
documents to these rules. The fixed base rule comes before and is not part of
that promise. A stratum with too few labels has no cutoff and loses nothing.

Null text has no words and fails the base rule. A null stratum value is a
stratum of its own. Repeated rows are judged one by one; labels with a null
doc_id or quality are ignored; repeated labels count once. Without label
rows no cutoff holds. An empty table gives an empty result. Columns of
documents beyond those named are left out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACED, words, written

SYMBOLS = "[#*$%&|<>]+"
#: Bits of a sort key that hold a position; the rest are hash.
POSITION_BITS = 26


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose value is above the cutoff. Cutoffs run from mild to strict."""

    name: str
    value: Column
    cutoffs: tuple[float, ...]


def rules() -> tuple[Rule, ...]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return (
        Rule("symbols", F.col("n_symbols") / n, (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
        Rule("repeats", F.col("n_repeat_words") / n, (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
        Rule("same_lines", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4)),
        Rule("shouting", F.col("n_bangs") / n, (2.0, 1.5, 1.0, 0.7, 0.5, 0.3)),
        Rule("capitals", F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)), (0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
    )


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and the measures of each row of docs (text, and the columns of keep)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = F.lit((1 << POSITION_BITS) - 1)
    df = docs.select(*keep, text.alias("_t")).select(*keep, "_t", words(F.col("_t")).alias("_w"))
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_char = lambda chars: (F.length(t) - F.length(F.regexp_replace(t, chars, ""))).cast("long")
    df = df.select(
        *keep, "_w", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        n_char(SYMBOLS).alias("n_symbols"), n_char("!+").alias("n_bangs"), n_char("[A-Z]+").alias("n_capitals"),
        lines.alias("_l"),
    )
    w = F.col("_w")
    seq = F.sequence(F.lit(0), F.size(w) - 3)
    df = df.select(
        *keep, "_w", "n_words", "word_chars", "n_symbols", "n_bangs", "n_capitals",
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        # Windows as longs: low hash bits above, the position below. Sorted, equal windows are neighbours.
        F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.sort_array(F.transform(seq, lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), POSITION_BITS).bitwiseOR(i.cast("long"))))
        ).alias("_k"),
    )
    k = F.col("_k")
    top = lambda x: F.shiftright(x, POSITION_BITS)
    pos = lambda x: x.bitwiseAND(mask).cast("int")
    index = F.when(F.size(k) > 1, F.sequence(F.lit(1), F.size(k) - 1)).otherwise(F.array().cast("array<int>"))
    differ = lambda a, b: (F.get(w, a) != F.get(w, b)) | (F.get(w, a + 1) != F.get(w, b + 1)) | (F.get(w, a + 2) != F.get(w, b + 2))
    df = df.withColumn(
        "_pairs",  # neighbours with one hash
        F.filter(index, lambda j: top(F.get(k, j)) == top(F.get(k, j - 1))),
    ).withColumn(
        "_clash",  # one hash, other words: then the windows themselves are sorted
        (F.size(w) > (1 << POSITION_BITS)) | F.exists("_pairs", lambda j: differ(pos(F.get(k, j)), pos(F.get(k, j - 1)))),
    )
    fast = F.array_distinct(F.flatten(F.transform("_pairs", lambda j: F.array(pos(F.get(k, j - 1)), pos(F.get(k, j))))))
    whole = F.array_sort(F.transform(seq, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.col("_clash"), whole)).withColumn(
        "_at",
        F.when(
            F.col("_clash"),
            F.transform(
                F.filter(index, lambda j: (F.get("_s", j)["a"] == F.get("_s", j - 1)["a"]) & (F.get("_s", j)["b"] == F.get("_s", j - 1)["b"]) & (F.get("_s", j)["c"] == F.get("_s", j - 1)["c"])),
                lambda j: F.array(F.get("_s", j - 1)["i"], F.get("_s", j)["i"]),
            ),
        ),
    )
    at = F.array_sort(F.when(F.col("_clash"), F.array_distinct(F.flatten("_at"))).otherwise(fast))
    covered = F.aggregate(
        at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"), "n_bangs", "n_capitals")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p), exact: the last term by logarithms, the others by their ratios. 1 where k is beyond the mean."""
    from math import log

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_choose = F.aggregate(steps, F.lit(0.0), lambda acc, j: acc + F.log((n - k + j) / j))
    last = F.exp(log_choose + k * log(p) + (n - k) * log(1 - p))
    ratios = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["term"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("term"),
            (acc["sum"] + acc["term"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), last * ratios))


def certified(measured: DataFrame, labels: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """One row for each stratum with labels: stratum, and by rule the strictest certified cutoff or null."""
    own = rules()
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
    held = measured.where(~base_failed()).join(good, measured.doc_id == good["_id"]).dropDuplicates([stratum, "_same"])
    counts = [F.count_if(r.value > c).alias(f"{i}_{j}") for i, r in enumerate(own) for j, c in enumerate(r.cutoffs)]
    per = held.groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("n"), *counts)
    per = written(per, "cutoffs")  # as many rows as strata
    strata = max(1, per.count())
    level = delta / (strata * len(own))
    chosen = []
    for i, r in enumerate(own):
        passes = F.lit(True)
        best = F.lit(None).cast("double")
        for j, c in enumerate(r.cutoffs):
            passes = passes & (_tail(F.col(f"{i}_{j}"), F.col("n"), alpha / len(own)) <= level)
            best = F.when(passes, F.lit(float(c))).otherwise(best)
        chosen.append(best.alias(f"cut_{r.name}"))
    return per.select("_stratum", *chosen)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, most_strata: int = 10_000, more: list[str] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of docs, and the columns named in more.

    Cutoffs are broadcast only when there are most_strata rows of them at
    most; otherwise the join is left to Spark, which splits hot strata.
    """
    key = F.coalesce(F.col(stratum).cast("string"), F.lit("\x00null"))
    more = more or []
    same = F.xxhash64(F.coalesce("text", F.lit("")))
    measured = written(measures(docs.select("doc_id", "text", key.alias("_key"), same.alias("_same"), *more), ["doc_id", "_key", "_same", *more]), "measures")
    cuts = written(certified(measured, labels, "_key", alpha, delta), "certified")
    if cuts.count() <= most_strata:
        cuts = F.broadcast(cuts)
    rejected = F.lit(False)
    for r in rules():
        rejected = rejected | F.coalesce(r.value > F.col(f"cut_{r.name}"), F.lit(False))
    joined = measured.join(cuts, measured["_key"] == F.col("_stratum"), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), "n_lines", "n_bangs", "n_capitals", *more)
