"""Retrieval of examples by embedding similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def norm(v: Column) -> Column:
    return F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.lit(FLOOR))


def dot(v: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(v, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)


def cosine_top(memory: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """vec_id and score of the k most similar rows of memory (vec_id, embedding); ties by vec_id. The query travels inside the plan."""
    length = max(sum(x * x for x in query) ** 0.5, FLOOR)
    rows = memory if where is None else memory.where(where)
    score = F.round(dot(F.col("embedding"), query) / (norm(F.col("embedding")) * length), 6)
    return rows.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def fingerprint(memory: DataFrame, model: str) -> str:
    """A name for the cached vectors of these examples, from an order-free sum of row hashes."""
    row = memory.agg(F.sum(F.xxhash64(*memory.columns).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    import hashlib

    return hashlib.sha256(f"{model}:{row.h}:{row.n}".encode()).hexdigest()


def verified_memory(rows: DataFrame) -> DataFrame:
    """Records (dataset_id, id, question, code, ok, pos) that succeeded and have a question and code; the first of each dataset and id."""
    from brindle.operators.frame import first_of

    good = rows.where(F.col("ok") & (F.coalesce("question", F.lit("")) != "") & (F.coalesce("code", F.lit("")) != ""))
    return first_of(good, ["dataset_id", "id"], [F.col("pos")]).drop("pos")


def pending(examples: DataFrame, finished: DataFrame, key: str, target: int | None = None) -> DataFrame:
    """Examples that aren't finished, up to target in key order."""
    left = examples.join(finished.select(key).distinct(), key, "left_anti")
    return left if target is None else left.orderBy(key).limit(target)


MODES = ("cross_task", "same_dataset", "disabled")


def retrieved(memory: DataFrame, query: list[float], k: int, mode: str = "cross_task", dataset: str = "") -> DataFrame:
    """vec_id and score of the k examples (dataset_id, vec_id, embedding) most like query: of all, of one dataset in any case of its name, or none."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {MODES}")
    if mode == "disabled" or k <= 0:
        return memory.select("vec_id", F.lit(0.0).alias("score")).limit(0)
    return cosine_top(memory, query, k, F.lower("dataset_id") == dataset.lower() if mode == "same_dataset" else None)


def demonstrations(found: DataFrame, memory: DataFrame) -> str:
    """What a planner reads of the examples found (vec_id, score), best first: no cell values, only schema, reasoning and code."""
    rows = memory.join(found, "vec_id").orderBy(F.desc("score"), "vec_id").collect()  # as many as were asked for
    fenced = lambda x: f"```python\n{x or ''}\n```"
    blocks = [f"### Example {i} from {r.dataset_id} (similarity {r.score:.4f})\n{r.question}\nBoxes without rows:\n{fenced(r.schema)}\nWhy: {r.reasoning}\nChecked code:\n{fenced(r.code)}" for i, r in enumerate(rows, 1)]
    return "\n\n".join(["## Examples of other questions", *blocks]) if blocks else ""
