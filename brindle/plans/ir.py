"""Plans: ordered, named steps that lower to lazy frames."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import frame
from brindle.sources.boxes import Boxes


@dataclass(frozen=True)
class Step:
    """op over the frames named in inputs, result under name."""

    name: str
    op: str
    inputs: tuple[str, ...]
    args: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...]


def _aggregates(spec: dict[str, tuple[str, str]]) -> dict:
    kinds = {"sum": frame.total, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.count_distinct}
    return {name: kinds[kind](F.expr(guarded(expr, True))) for name, (kind, expr) in spec.items()}


OPS: dict[str, Callable[..., DataFrame]] = {
    "filter": lambda df, where: df.where(guarded(where, True)),
    "project": lambda df, columns: df.select(*[F.expr(guarded(c, True)) for c in columns]),
    "merge": lambda a, b, left_on, right_on, many=False: frame.merge(a, b, left_on, right_on, many=many),
    "group": lambda df, keys, aggregates: frame.group(df, keys, **_aggregates(aggregates)),
    "sort": lambda df, by: frame.ordered(df, *by),
    "head": lambda df, n: df.limit(n),
    "largest": lambda df, n, column, position: frame.largest(df, n, column, position),
    "distinct": lambda df: df.distinct(),
    "union": lambda a, b: a.unionByName(b),
}

# The parts that a parsed query may have, functions that it may not call, and table functions that it may.
NODES = set("""
    Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project
    Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot Window WithWindowDefinition
""".split())  # fmt: skip
DENIED = set("current_catalog current_database current_schema current_user input_file_block_length input_file_block_start input_file_name java_method reflect session_user try_reflect user version".split())
TABLE_FUNCTIONS = {"explode", "posexplode", "range"}


class Refused(ValueError):
    """A security violation, found before anything runs."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check(node, sql: str, is_plan: bool) -> None:
    """Refuses a part of a parsed plan that isn't allowed: commands, files as tables, calls out of SQL."""
    todo = [(node, is_plan)]
    while todo:
        x, plan = todo.pop()
        kind = x.getClass().getSimpleName()
        refused = kind if plan and kind not in NODES else None
        if kind == "UnresolvedRelation" and len(parts := _items(x.multipartIdentifier())) > 1:
            refused = ".".join(parts)
        elif kind == "UnresolvedTableValuedFunction" and _items(x.name())[-1].lower() not in TABLE_FUNCTIONS:
            refused = _items(x.name())[-1]
        elif kind == "UnresolvedFunction" and (_items(x.nameParts())[-1].lower() in DENIED or x.nameParts().size() > 1):
            refused = _items(x.nameParts())[-1]
        elif kind == "UnresolvedGenerator" and x.name().funcName().lower() in DENIED:
            refused = x.name().funcName()
        elif kind == "UnresolvedAttribute" and x.name().lower() in ("current_user", "session_user"):  # functions without parentheses
            refused = x.name()
        if refused:
            raise Refused(f"security violation: {refused} is not allowed in {sql!r}")
        todo += [(y, plan) for y in _items(x.children())]
        if plan:
            todo += [(y, False) for y in _items(x.expressions())] + [(y, True) for y in _items(x.innerChildren())]
        elif kind in ("Exists", "LateralSubquery", "ListQuery", "ScalarSubquery"):
            todo.append((x.plan(), True))


def guarded(sql: str, expression: bool = False) -> str:
    """sql, a query or an expression, when Spark parses it to one statement whose parts are all allowed. Names of columns and tables are free."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`", "''", sql)
    if ";" in bare.rstrip().removesuffix(";"):
        raise Refused(f"security violation: ; is not allowed in {sql!r}")
    parser = SparkSession.active()._jsparkSession.sessionState().sqlParser()
    _check(parser.parseExpression(sql) if expression else parser.parsePlan(sql), sql, not expression)
    return sql


def lower_steps(plan: Plan, boxes: Boxes) -> dict[str, DataFrame]:
    """The frame of each step. Columns and types are resolved step by step, without running anything."""
    frames = dict(boxes.frames)
    for step in plan.steps:
        if step.op not in OPS:
            raise Refused(f"security violation: there is no step {step.op}")
        frames[step.name] = OPS[step.op](*[frames[i] for i in step.inputs], **step.args)
    return {step.name: frames[step.name] for step in plan.steps}


def lower(plan: Plan, boxes: Boxes) -> DataFrame:
    return lower_steps(plan, boxes)[plan.steps[-1].name]


@dataclass(frozen=True)
class State:
    """What a planner sees of a step's frame; n_rows only when asked for, as it costs a pass."""

    name: str
    types: dict[str, str]
    samples: list[dict[str, str]]
    n_rows: int | None = None

    def text(self) -> str:
        size = f"{'?' if self.n_rows is None else self.n_rows} rows x {len(self.types)} columns"
        values = "".join(f"\n#   {c} ({t}): {', '.join(str(s[c]) for s in self.samples)}" for c, t in self.types.items())
        return f"# {self.name}: {size}{values}"


def state(name: str, df: DataFrame, samples: int = 3, count: bool = False, most_chars: int = 100) -> State:
    rows = df.limit(samples).collect()
    cut = lambda v: v if len(v) <= most_chars else v[:most_chars] + "..."
    return State(name, dict(df.dtypes), [{c: cut(str(v)) for c, v in zip(df.columns, r, strict=True)} for r in rows], df.count() if count else None)


def states(frames: dict[str, DataFrame], known: set[str] = frozenset(), samples: int = 3) -> list[State]:
    """The states of frames that aren't known yet."""
    return [state(name, df, samples) for name, df in frames.items() if name not in known]


@dataclass
class Result:
    """rows of a success; frame, which is lazy, has all rows of a result of any size."""

    success: bool
    rows: list[tuple]
    error: str = ""
    frame: DataFrame | None = None


class TooLong(TimeoutError):
    """The jobs of a step were cancelled."""


def within_time(spark: SparkSession, seconds: float, work: Callable[[], list]) -> list:
    """What work returns; the Spark jobs that it has started are cancelled by their tag when seconds are over."""
    tag, over = f"brindle-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if over.is_set():
            raise TooLong(f"cancelled after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


class Planner(Protocol):
    def plan(self, question: str, schema: str) -> Plan: ...

    def repair(self, plan: Plan, error: str) -> Plan: ...


class Scripted:
    """A planner with prepared plans: the first for the question, the others as repairs."""

    def __init__(self, plans: dict[str, list[Plan]]):
        self.plans, self.at = plans, ("", 0)

    def plan(self, question: str, schema: str) -> Plan:
        self.at = (question, 0)
        return self.plans[question][0]

    def repair(self, plan: Plan, error: str) -> Plan:
        question, k = self.at
        self.at = (question, min(k + 1, len(self.plans[question]) - 1))
        return self.plans[question][self.at[1]]


def answer(question: str, boxes: Boxes, planner: Planner, rounds: int = 3, most_rows: int = 10_000, seconds: float = 30.0) -> Result:
    """Plans, lowers, repairs up to rounds times, and runs once.

    Jobs are cancelled after seconds. A result of more than most_rows rows is
    no success and its rows are not cut: the frame has them all.
    """
    plan, error, df = planner.plan(question, boxes.schema_text()), "", None
    for k in range(rounds + 1):
        try:
            df = lower(plan, boxes)
            rows = within_time(boxes.spark, seconds, df.limit(most_rows + 1).collect)
            if len(rows) > most_rows:
                return Result(False, [], f"more than {most_rows} rows", df)
            return Result(True, [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in rows], frame=df)
        except Exception as e:  # the planner sees any failure of its plan
            error = str(e)
            if isinstance(e, Refused):
                break
            plan = planner.repair(plan, error) if k < rounds else plan
    return Result(False, [], error, df)
