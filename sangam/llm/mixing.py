"""Mixing sources to target weights by iterative proportional fitting.

In DataFrame functions only.  Documents are counted in cells (source, language,
topic) by their tokens, and each value of a dimension has a factor; a cell's
weight is its tokens times the factors of its values.  The factors are raked in
turn to the marginal targets until the largest miss of a share is below a
tolerance.  A document's sampling probability is its cell's factor, scaled.  The
scale fixes how many tokens are expected: `budget`, or as many as make the
probability 1 in the largest among the cells with at least `min_share` of the
tokens (among all cells where none has).  Cells that would need more than 1 then
get 1, and what they lack is raked over the others until the margins hold
(`fill`).  Where they cannot be held for that many tokens, the scale is that of
the largest factor of all cells: fewer tokens, the same margins.  A document is
sampled when a hash of its doc_id falls below its probability: the same rows on
every run, whatever is lost and run again.

Cells come from one aggregation that combines before its shuffle, and so do the
margins of each step, so that neither a hot source nor a large number of cells
meets in one task.  Factors are small tables, of one row a value: up to
`SMALL` values they travel with the plan, beyond they are checkpointed and the
joins are left to Spark, and so is the last join beyond `max_cells` cells.

Targets are shares of tokens by value.  Values without a target keep their
share of the input; targets of values that do not occur are dropped; the rest
is scaled to 1.  Without a target a dimension is not raked.  Targets that no
weights can meet (a value that occurs only with others that have none, say) give
a warning with the largest miss.

Topics come from a function of the text column that the caller may give; the
default is a few fixed rules (see `topic_of`).

Defined cases: null source, language or text count as the value `(none)`; empty
texts have no tokens and weight 0 but keep their cell's probability; repeated
rows are sampled alike; an empty table gives an empty result; columns of the
input named like a result column are left out of the result.
"""

from __future__ import annotations

import copy
import json
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

NONE = "(none)"
RESULT = ("n_tokens", "cell_source", "cell_lang", "cell_topic", "probability", "draw", "sampled")
#: Values of a dimension whose factors travel with the plan.
SMALL = 2_000
DIMENSIONS = ("cell_source", "cell_lang", "cell_topic")


def n_tokens(text: Column) -> Column:
    """Words of a text: runs other than of space and control characters."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("long")


def topic_of(text: Column) -> Column:
    """The first rule that holds: legal, contact, listing, markup, prose."""
    low = F.lower(text)
    legal = F.contains(low, F.lit("license")) | F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("rights reserved"))
    contact = F.contains(text, F.lit("@")) | F.contains(text, F.lit("555-"))
    return (
        F.when(text.isNull(), NONE)
        .when(legal, "legal")
        .when(contact, "contact")
        .when(F.contains(text, F.lit(" | ")), "listing")
        .when(F.contains(text, F.lit("***")) | F.contains(text, F.lit("$$$")) | F.contains(text, F.lit("<")), "markup")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame, topic: Callable[[Column], Column] = topic_of) -> DataFrame:
    docs = docs.select(*[x for x in docs.columns if x not in RESULT])
    value = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(NONE))
    return docs.select("*", n_tokens(F.col("text")).alias("n_tokens"), value("source").alias("cell_source"), value("lang").alias("cell_lang"), topic(F.col("text")).alias("cell_topic"))


class Factors:
    """Values of a dimension with their target (a share) and factor: numbers that
    travel with the plan, or a checkpointed table where there are over SMALL."""

    def __init__(self, dimension: str, table: DataFrame, n_values: int):
        self.dimension, self.table, self.values = dimension, None, {}
        if n_values <= SMALL:
            self.values = {r[dimension]: (r.target, 1.0) for r in table.collect()}
        else:
            self.table = table.withColumn("factor", F.lit(1.0)).checkpoint()

    def joined(self, frame: DataFrame) -> DataFrame:
        return frame if self.table is None else frame.join(self.table.select(self.dimension, F.col("factor").alias(f"_{self.dimension}")), self.dimension)

    def sql(self) -> str:
        """The factor of a row's value."""
        if self.table is not None:
            return f"_{self.dimension}"
        text = json.dumps({v: f for v, (_, f) in self.values.items()}).replace("\\", "\\\\").replace("'", "\\'")
        return f"from_json('{text}', 'map<string,double>')[{self.dimension}]"

    def met(self, margin: DataFrame, expected: float) -> float:
        """Factors scaled from the margins (value, margin) to the targets; how far a share was off."""
        if self.table is None:
            found = {r[0]: r[1] or 0.0 for r in margin.collect()}
            off = max((abs(found.get(v, 0.0) / expected - t) for v, (t, _) in self.values.items()), default=0.0)
            self.values = {v: (t, f * t * expected / found[v] if found.get(v) else 0.0) for v, (t, f) in self.values.items()}
            return off
        factor = F.when(F.col("margin") > 0, F.col("factor") * F.col("target") * expected / F.col("margin")).otherwise(0.0)
        off = F.abs(F.coalesce("margin", F.lit(0.0)) / expected - F.col("target"))
        now = self.table.join(margin, self.dimension, "left").select(self.dimension, "target", factor.alias("factor"), off.alias("off")).checkpoint()
        self.table = now.drop("off")
        return now.agg(F.max("off")).first()[0] or 0.0


def factors(cells: DataFrame, targets: dict[str, dict[str, float]]) -> dict[str, Factors]:
    """For each dimension with targets: its values with target (a share) and factor 1."""
    out = {}
    for d, wanted in targets.items():
        if not wanted:
            continue
        given = F.create_map(*[F.lit(x) for pair in wanted.items() for x in (pair[0], float(pair[1]))])[F.col(d)]
        own = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("tokens")).withColumn("given", given)
        total, fixed, free, n_values = (x or 0.0 for x in own.agg(F.sum("tokens"), F.sum("given"), F.sum(F.when(F.col("given").isNull(), F.col("tokens"))), F.count("*")).first())
        rest = max(0.0, 1 - fixed) / free if free else 0.0  # for each token of a value without target
        whole = fixed + rest * free
        target = F.coalesce("given", F.col("tokens") * rest) / whole if whole else F.col("tokens") / max(total, 1e-9)
        out[d] = Factors(d, own.select(d, target.alias("target")), n_values)
    return out


def weighted(cells: DataFrame, tables: dict[str, Factors], scale: float = 1.0) -> tuple[DataFrame, str]:
    """cells, with columns that the factor needs, and the SQL of the factor of a cell."""
    for table in tables.values():
        cells = table.joined(cells)
    return cells, " * ".join([f"cast('{scale!r}' AS double)", *(t.sql() for t in tables.values())])


def _round(cells: DataFrame, tables: dict[str, Factors], expected: float, scale: float = 1.0, most: float | None = None) -> float:
    """Every dimension's factors raked once, in turn; the largest miss of a share
    that was met.  most: the largest probability that counts."""
    worst = 0.0
    for d, table in tables.items():
        frame, factor = weighted(cells, tables, scale)
        taken = factor if most is None else f"least(cast({most} AS double), {factor})"
        worst = max(worst, table.met(frame.groupBy(d).agg(F.expr(f"sum(tokens * {taken})").alias("margin")), expected))
    return worst


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int = 100, tolerance: float = 1e-6) -> tuple[dict[str, Factors], float]:
    """The factor tables that meet the targets, and the largest miss that is left."""
    tables, expected = factors(cells, targets), float(cells.agg(F.sum("tokens")).first()[0] or 0)
    misses: list[float] = []
    while tables and expected and len(misses) < rounds and (not misses or misses[-1] > tolerance):
        misses.append(_round(cells, tables, expected))
        if len(misses) > 10 and misses[-1] > 0.9 * misses[-10]:  # it comes no nearer
            break
    miss = misses[-1] if misses else 0.0
    if miss > 1e-3:
        warnings.warn(f"the targets cannot all be met: a share is off by {miss:.4f}", stacklevel=2)
    return tables, miss


def fill(cells: DataFrame, tables: dict[str, Factors], scale: float, expected: float, near: float, rounds: int = 40) -> DataFrame | None:
    """cells with `probability`, 1 at most: `expected` tokens at the targets'
    margins, up to `near`, or None if they are not held after all rounds."""
    tables = {d: copy.copy(t) for d, t in tables.items()}
    for _ in range(rounds):
        if _round(cells, tables, expected, scale, 1.0) <= near:
            frame, factor = weighted(cells, tables, scale)
            return frame.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.expr(factor))).otherwise(min(1.0, scale)).alias("probability"))
    return None


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], budget: float | None = None, seed: int = 17, max_cells: int = 20_000, min_share: float = 0.001, topic: Callable[[Column], Column] = topic_of) -> DataFrame:
    """docs with n_tokens, the cell, probability, draw (a hash of doc_id in
    [0, 1)) and sampled.  targets: by dimension (source, lang, topic)."""
    ready(docs.sparkSession)
    cells_of = with_cells(docs, topic)
    cells = cells_of.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).checkpoint()
    n_cells, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    if n_cells <= max_cells:  # few rows: a step is one task
        cells = cells.coalesce(1).checkpoint()
    tables, miss = rake(cells, {f"cell_{d}": t for d, t in targets.items()})
    frame, factor = weighted(cells, tables)
    raked = frame.select(*DIMENSIONS, "tokens", F.expr(factor).alias("factor"))
    held = F.when(F.col("tokens") > 0, F.col("factor"))
    large = F.when(F.col("tokens") >= min_share * (total or 0), held)
    weight, most, most_large = raked.agg(F.sum(F.col("tokens") * F.col("factor")), F.max(held), F.max(large)).first()
    whole = 1.0 / max(most or 0.0, 1e-12)
    scale = 1.0 / max(most_large or most or 0.0, 1e-12) if budget is None else budget / max(weight or 0.0, 1e-12)
    rates = None
    if most and scale > whole * (1 + 1e-9) and tables:
        rates = fill(cells, tables, scale, scale * weight, miss + 1e-5)
        scale = whole
    if rates is None:
        rates = raked.select(*DIMENSIONS, F.least(F.lit(1.0), F.when(F.col("tokens") > 0, F.col("factor")).otherwise(1.0) * scale).alias("probability"))
    rates = rates.checkpoint()
    rates = F.broadcast(rates) if n_cells <= max_cells else rates
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return cells_of.join(rates, list(DIMENSIONS)).select(*[x for x in cells_of.columns], "probability", draw.alias("draw"), (draw < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]], budget: float | None = None, seed: int = 17, topic: Callable[[Column], Column] = topic_of) -> DataFrame:
    """The sampled documents; columns as they came."""
    mixed = mix(docs.withColumn("_all", F.struct(*docs.columns)), targets, budget, seed, topic=topic)
    return mixed.where("sampled").select("_all.*")
