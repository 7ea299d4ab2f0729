"""Secondary indexes: names in the catalog and sorted layouts.

Parquet keeps the least and largest value of each row group, so that a layout
sorted by the index columns prunes files and row groups for `=` and ranges.
CREATE INDEX rewrites the table in that order; lookups are pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, CatalogError

TYPES = ("BTREE", "HASH")


def create_index(catalog: Catalog, table: str, columns: list[str], name: str | None = None, unique: bool = False, kind: str = "BTREE") -> str:
    own = catalog.get(table)
    names = {f.lower(): f for f in own.struct.names}
    if missing := [c for c in columns if c.lower() not in names]:
        raise CatalogError(f"{table} has no column {missing[0]}")
    if kind.upper() not in TYPES:
        raise CatalogError(f"index type {kind} is not supported: a sorted layout serves {' and '.join(TYPES)} only")
    columns = [names[c.lower()] for c in columns]
    name = name or f"idx_{table.lower()}_{'_'.join(c.lower() for c in columns)}"
    if name in own.indexes:
        raise CatalogError(f"index {name} exists already")
    frame = catalog.frame(table)
    if unique and not frame.groupBy(*columns).count().where("count > 1").isEmpty():
        raise CatalogError(f"{table}: values of {', '.join(columns)} repeat")
    if own.paths:
        catalog.write(table, frame.repartition(*columns).sortWithinPartitions(*columns) if kind.upper() == "HASH" else frame.repartitionByRange(*columns).sortWithinPartitions(*columns))
    catalog.set(table, indexes=own.indexes | {name: {"columns": columns, "unique": unique, "type": kind.upper()}})
    return name


def drop_index(catalog: Catalog, table: str, name: str) -> None:
    own = catalog.get(table)
    if name not in own.indexes:
        raise CatalogError(f"index {name} does not exist")
    catalog.set(table, indexes={k: v for k, v in own.indexes.items() if k != name})


def list_indexes(catalog: Catalog) -> DataFrame:
    rows = [(t, n, ",".join(i["columns"]), i["unique"], i["type"], ddl(t, n, i)) for t, m in catalog.tables().items() for n, i in m.indexes.items()]
    return catalog.spark.createDataFrame(rows, "table string, name string, columns string, unique boolean, type string, ddl string")


def ddl(table: str, name: str, index: dict) -> str:
    return f"CREATE {'UNIQUE ' if index['unique'] else ''}INDEX {name} ON {table} ({', '.join(index['columns'])})"


def scan_range(df: DataFrame, column: str, low: object = None, high: object = None, low_inclusive: bool = True, high_inclusive: bool = True, backwards: bool = False, ordered: bool = True) -> DataFrame:
    """Rows with the column between two ends, either open or closed or missing."""
    where: Column = F.lit(True)
    c = F.col(column)
    if low is not None:
        where = where & (c >= low if low_inclusive else c > low)
    if high is not None:
        where = where & (c <= high if high_inclusive else c < high)
    out = df.where(where)
    return out.orderBy(c.desc() if backwards else c.asc()) if ordered else out


def is_covering(index: dict, columns: list[str]) -> bool:
    return {c.lower() for c in columns} <= {c.lower() for c in index["columns"]}


def find_best(catalog: Catalog, table: str, columns: list[str]) -> str | None:
    """The index with the longest prefix of columns that a query filters by."""
    wanted, best, most = {c.lower() for c in columns}, None, 0
    for name, index in catalog.get(table).indexes.items():
        n = 0
        while n < len(index["columns"]) and index["columns"][n].lower() in wanted:
            n += 1
        if n > most:
            best, most = name, n
    return best


def analyze(df: DataFrame) -> DataFrame:
    """column, n_rows, n_null, n_distinct (approximate), min and max as text: one pass."""
    parts = [F.count("*").alias("_rows")]
    for i, c in enumerate(df.columns):
        q = F.col(f"`{c}`")
        parts += [F.count(q).alias(f"n{i}"), F.approx_count_distinct(q).alias(f"d{i}"), F.min(q.cast("string")).alias(f"l{i}") if "array" in df.schema[c].dataType.simpleString() else F.min(q).cast("string").alias(f"l{i}"), F.max(q.cast("string")).alias(f"h{i}") if "array" in df.schema[c].dataType.simpleString() else F.max(q).cast("string").alias(f"h{i}")]
    one = df.agg(*parts)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("_rows").alias("n_rows"), (F.col("_rows") - F.col(f"n{i}")).alias("n_null"), F.col(f"d{i}").alias("n_distinct"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")) for i, c in enumerate(df.columns)]))
    return one.select(rows.alias("r")).select("r.*")


def selectivity(op: str, n_distinct: int | None = None) -> float:
    """Estimated share of rows for a predicate."""
    # The estimates of the language's planner.
    shares = {"=": 0.1, "<": 0.33, ">": 0.33, "<=": 0.33, ">=": 0.33, "<>": 0.9, "!=": 0.9, "LIKE": 0.5, "LIKE_PREFIX": 0.1, "IS NULL": 0.01, "IS NOT NULL": 0.99, "IN": 0.3, "BETWEEN": 0.25}
    if op == "=" and n_distinct:
        return 1 / n_distinct
    return shares.get(op.upper(), 0.5)


def estimate_rows(n_rows: int, predicates: list[tuple[str, int | None]]) -> int:
    for op, distinct in predicates:
        n_rows = n_rows * selectivity(op, distinct)
    return max(0, round(n_rows))
