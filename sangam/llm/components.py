"""Connected components of an edge table, within spaces that don't mix.

Few edges (`task_edges` at most, counted first) go to one task, which links
them in memory.  More are linked by large-star and small-star rounds: every
node's larger (then smaller) neighbours go to its least neighbour until nothing
changes.  A round is two aggregations with map-side combining and two joins on a
node; it is checkpointed.  Both ways give every node the least of its component,
so the size decides only the plan.  The rounds end by themselves: each that
changes anything lowers the sum of the edges' ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

NAMES = ["space", "node", "component"]


def least_reachable(space: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(space, node, least node of its component) of the nodes with an edge."""
    s, x = np.concatenate([space, space]), np.concatenate([u, v])
    order = np.lexsort((x, s))
    new = np.ones(len(x), bool)
    new[1:] = (s[order][1:] != s[order][:-1]) | (x[order][1:] != x[order][:-1])
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1  # in order of (space, node): the least number is the least node
    a, b = number[: len(u)], number[len(u) :]
    root = np.arange(int(new.sum()))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for end in (a, b):
            np.minimum.at(root, root[end], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    head = order[new]
    return s[head], x[head], x[head][root]


def connected(edges: DataFrame, task_edges: int = 1 << 20) -> DataFrame:
    """edges (space, u, v: long) -> (space, node, component): the least node
    reachable; nodes with an edge only.  Self-edges and repeated edges are allowed."""
    ready(edges.sparkSession)
    now = edges.where("u <> v").select("space", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    if now.count() <= task_edges:

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [[x.to_numpy(zero_copy_only=False) for x in batch.columns] for batch in batches if batch.num_rows]
            columns = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=NAMES)

        return now.coalesce(1).mapInArrow(link, ", ".join(f"{x} long" for x in NAMES))
    return star_rounds(now)


def star_rounds(now: DataFrame) -> DataFrame:
    """The distributed way; edges are distinct and v < u."""
    before = None
    while True:
        both = now.union(now.select("space", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("space", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, ["space", "u"]).where("v <> m").select("space", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("space", "u").agg(F.min("v").alias("m"))
        pulled = large.join(least, ["space", "u"])
        now = pulled.where("v <> m").select("space", F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("space", "u", F.col("m").alias("v"))).distinct().checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("space", "u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    own = now.select("space", F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select("space", F.col("u").alias("node"), F.col("v").alias("component")).union(own).distinct()
