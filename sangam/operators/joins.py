"""Joins: kinds, conditions, algorithm hints and join trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "natural": "inner"}
COMPARE = {"=": Column.__eq__, "<>": Column.__ne__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
HINTS = {"nested_loop": "broadcast_nl", "hash": "shuffle_hash", "merge": "merge", "auto": None}
MAX_TABLES = 8
#: A side is broadcast for a nested loop only up to this many estimated bytes.
NESTED_LOOP_BYTES = 64 << 20


@dataclass(frozen=True)
class Condition:
    left: str
    op: str
    right: str


def condition(parts: list[Condition], left: str = "l", right: str = "r") -> Column:
    """Comparisons joined by AND; null on either side never matches."""
    out = F.lit(True)
    for i, c in enumerate(parts):
        own = COMPARE[c.op](F.col(f"{left}.{c.left}"), F.col(f"{right}.{c.right}"))
        out = own if i == 0 else out & own
    return out


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    have = {c.lower() for c in right.columns}
    return [c for c in left.columns if c.lower() in have]


def estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def choose_algorithm(left: DataFrame, right: DataFrame, equi: bool) -> str:
    """Nested loop for small or non-equal joins, else Spark's choice: AQE knows
    sizes at run time and turns merge joins into hash joins itself."""
    if not equi:
        return "nested_loop"
    return "auto" if min(estimated_bytes(left), estimated_bytes(right)) > 0 else "hash"


def join(left: DataFrame, right: DataFrame, kind: str = "inner", on: list[Condition] | None = None, using: list[str] | None = None, algorithm: str = "auto") -> DataFrame:
    """One join.  natural: on all common columns (an error without any)."""
    how = KINDS[kind]
    if kind == "natural":
        using = common_columns(left, right)
        if not using:
            raise ValueError("NATURAL JOIN without a common column")
    if kind == "cross":
        return left.alias("l").crossJoin(right.alias("r"))
    if algorithm == "nested_loop" and estimated_bytes(right) <= NESTED_LOOP_BYTES:
        right = F.broadcast(right)
    elif HINTS.get(algorithm) and algorithm != "nested_loop":
        right = right.hint(HINTS[algorithm])
    if using:
        return left.join(right, using, how)
    return left.alias("l").join(right.alias("r"), condition(on or []), how)


def join_tree(first: DataFrame, steps: list[dict]) -> DataFrame:
    """Joins in turn, MAX_TABLES tables at most; each step: table, kind, on/using, algorithm."""
    if len(steps) >= MAX_TABLES:
        raise ValueError(f"at most {MAX_TABLES} tables")
    for step in steps:
        first = join(first, step["table"], step.get("kind", "inner"), step.get("on"), step.get("using"), step.get("algorithm", "auto"))
    return first


def iterate(joined: DataFrame) -> Iterator[Row]:
    """Rows as they come, a partition at a time in the driver."""
    return joined.toLocalIterator(prefetchPartitions=True)
