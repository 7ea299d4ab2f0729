"""INSERT, UPDATE, DELETE and ALTER over the versioned catalog."""

from __future__ import annotations

import copy
import json
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sqlgen import numeric_prefix
from ..sources.catalog import Catalog, CatalogError, Table

AUTO = object()


def coerce(value: object, kind: T.DataType) -> object:
    """A literal for a column: texts become numbers by their prefix, 1 and 0 booleans."""
    if value is None or value is AUTO:
        return value
    if isinstance(kind, T.LongType | T.IntegerType):
        return int(numeric_prefix(str(value))) if not isinstance(value, bool) else int(value)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return float(numeric_prefix(str(value)))
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else str(value).lower() not in ("0", "false", "", "0.0")
    if isinstance(kind, T.StringType):
        return str(value)
    return value


def create_table(catalog: Catalog, name: str, columns: list[tuple[str, str, dict]], key: list[str] | None = None) -> None:
    """columns: (name, Spark type, options pk / not_null / unique / default);
    key: the columns of a primary key of several."""
    names = [c.lower() for c, _, _ in columns]
    if len(set(names)) != len(names) or not names:
        raise CatalogError(f"{name}: columns must be named once each")
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k, _ in columns])
    pk = None if key else next((c for c, _, o in columns if o.get("pk")), columns[0][0])
    if key:
        key = [_column(names, [c for c, _, _ in columns], name, k) for k in key]
    catalog.create(name, Table(json.loads(schema.json()), pk=pk, keys=[key] if key else [], unique=[c for c, _, o in columns if o.get("unique")], not_null=[c for c, _, o in columns if o.get("not_null") or c in (key or [])], defaults={c: o["default"] for c, _, o in columns if "default" in o}))


def _column(lower: list[str], names: list[str], table: str, column: str) -> str:
    if column.lower() not in lower:
        raise CatalogError(f"{table} has no column {column}")
    return names[lower.index(column.lower())]


def insert_values(catalog: Catalog, name: str, rows: list[list[object]], columns: list[str] | None = None) -> DataFrame:
    """Rows in order: AUTO takes the next number, a row whose key exists is
    skipped with a warning.  Returns (inserted, skipped)."""
    table = catalog.get(name)
    struct, fields = table.struct, {f.name.lower(): f for f in table.struct.fields}
    given = [c.lower() for c in columns] if columns else [f.name.lower() for f in struct.fields]
    if unknown := [c for c in given if c not in fields]:
        raise CatalogError(f"{name} has no column {unknown[0]}")
    keys = [tuple(c.lower() for c in own) for own in table.unique_sets()]
    sequence, ready = table.sequence, []
    for row in rows:
        if len(row) != len(given):
            raise CatalogError(f"{name}: {len(row)} values for {len(given)} columns")
        own = {c: coerce(v, fields[c].dataType) for c, v in zip(given, row, strict=True)}
        for c, f in fields.items():
            own.setdefault(c, coerce(table.defaults.get(f.name), f.dataType))
            if c not in given and table.pk and c == table.pk.lower() and own[c] is None:
                own[c] = AUTO
            if own[c] is AUTO:
                sequence += 1
                own[c] = coerce(sequence, f.dataType)
            elif table.pk and c == table.pk.lower() and own[c] is not None and str(own[c]).isdigit():
                sequence = max(sequence, int(own[c]))
            if own[c] is None and f.name in table.not_null:
                raise CatalogError(f"{name}.{f.name} must not be null")
        ready.append(tuple(own[f.name.lower()] for f in struct.fields))
    names = [f.name.lower() for f in struct.fields]
    of = lambda r, key: tuple(r[names.index(c)] for c in key)
    taken: dict[tuple, set] = {}
    present = catalog.frame(name)
    for key in keys:
        first = list({of(r, key)[0] for r in ready if None not in of(r, key)})
        taken[key] = {tuple(x) for x in present.where(F.col(key[0]).isin(first)).select(*key).collect()} if first else set()
    kept = []
    for r in ready:
        # a key with a null in it is never equal to another
        if clash := next((k for k in keys if of(r, k) in taken[k] and None not in of(r, k)), None):
            warnings.warn(f"{name}: a row with {', '.join(clash)} = {', '.join(map(str, of(r, clash)))} exists, skipped", stacklevel=2)
            continue
        for k in keys:
            taken[k].add(of(r, k))
        kept.append(r)
    if kept:
        new = catalog.spark.createDataFrame(kept, struct)
        check_references(catalog, table, new)
        catalog.write(name, new, append=True)
    catalog.set(name, sequence=sequence)
    return catalog.spark.createDataFrame([(len(kept), len(ready) - len(kept))], "inserted long, skipped long")


def insert_frame(catalog: Catalog, name: str, rows: DataFrame) -> DataFrame:
    """Rows of a DataFrame (of any size): the first of each key that is not there yet."""
    table = catalog.get(name)
    struct = table.struct
    if len(rows.columns) != len(struct.fields):
        raise CatalogError(f"{name}: {len(rows.columns)} columns for {len(struct.fields)}")
    typed = rows.toDF(*struct.names).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in struct.fields])
    check_not_null(name, table, typed)
    sets = table.unique_sets()
    if sets:  # the order of the rows decides which of a key comes first
        typed = typed.withColumn("_at", F.monotonically_increasing_id())
    for key in sets:
        order = Window.partitionBy(*key).orderBy("_at")
        some_null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in key])
        typed = typed.withColumn("_n", F.row_number().over(order)).where(some_null | (F.col("_n") == 1)).drop("_n")
        typed = typed.join(catalog.frame(name).select(*key), key, "left_anti").select(*struct.names, "_at")
    typed = typed.select(*struct.names)
    check_references(catalog, table, typed)
    catalog.write(name, typed, append=True)
    new = catalog.spark.read.schema(struct).parquet(catalog.get(name).paths[-1])
    counted = table.pk is not None and isinstance(struct[table.pk].dataType, T.LongType)
    n, top = new.agg(F.count("*"), F.max(table.pk) if counted else F.lit(None)).first()
    if counted:
        catalog.set(name, sequence=max(table.sequence, top or 0))
    return catalog.spark.createDataFrame([(n,)], "inserted long")


def check_not_null(name: str, table: Table, rows: DataFrame) -> None:
    """One pass over the rows, and none where no column is NOT NULL."""
    if table.not_null:
        nulls = rows.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in table.not_null]).first()
        if bad := next((c for c in table.not_null if nulls[c]), None):
            raise CatalogError(f"{name}.{bad} must not be null")


def check_references(catalog: Catalog, table: Table, rows: DataFrame) -> None:
    for label, fk in table.foreign_keys.items():
        parent = catalog.frame(fk["table"]).select(F.col(fk["ref"]).alias(fk["column"]))
        if not rows.where(F.col(fk["column"]).isNotNull()).join(parent, fk["column"], "left_anti").isEmpty():
            raise CatalogError(f"{label}: no such {fk['column']} in {fk['table']}")


def update(catalog: Catalog, name: str, changes: dict[str, str], where: str | None) -> DataFrame:
    """changes: column -> SQL expression.  Returns (updated)."""
    table, frame = catalog.get(name), catalog.frame(name)
    fields = {f.name.lower(): f for f in table.struct.fields}
    if unknown := [c for c in changes if c.lower() not in fields]:
        raise CatalogError(f"{name} has no column {unknown[0]}")
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    new = {fields[c.lower()].name: F.expr(e).cast(fields[c.lower()].dataType) for c, e in changes.items()}
    changed = frame.withColumn("_hit", hit).select(*[F.when(F.col("_hit"), new[f.name]).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in new else F.col(f"`{f.name}`") for f in table.struct.fields])
    for key in table.unique_sets():
        if set(key) & set(new) and not changed.dropna(subset=key).groupBy(*key).count().where("count > 1").isEmpty():
            raise CatalogError(f"{name}.{', '.join(key)} would no longer be unique")
    if set(table.not_null) & set(new):
        check_not_null(name, table, changed)
    if {fk["column"] for fk in table.foreign_keys.values()} & set(new):
        check_references(catalog, table, changed)
    n = frame.where(hit).count()
    if n:
        children = _follow_keys(catalog, name, frame, changed, hit, new)
        catalog.write(name, changed)
        for child, rows in children.items():
            catalog.write(child, rows)
    return catalog.spark.createDataFrame([(n,)], "updated long")


def _children(catalog: Catalog, name: str) -> list[tuple[str, Table, str, dict]]:
    return [(child, t, label, fk) for child, t in catalog.tables().items() for label, fk in t.foreign_keys.items() if fk["table"] == name.lower()]


def _follow_keys(catalog: Catalog, name: str, frame: DataFrame, changed: DataFrame, hit: Column, new: dict[str, Column]) -> dict[str, DataFrame]:
    """The tables that refer to changed keys, with the new keys (CASCADE);
    RESTRICT refuses if a row would refer to none."""
    out: dict[str, DataFrame] = {}
    for child, t, label, fk in _children(catalog, name):
        if fk["ref"] not in new:
            continue
        own = fk["column"]
        rows = out.get(child, catalog.frame(child))
        moved = frame.where(hit).select(F.col(fk["ref"]).alias(own), new[fk["ref"]].alias("_new")).where(~F.col("_new").eqNullSafe(F.col(own)) & F.col(own).isNotNull())
        if fk["on_update"] == "CASCADE":
            moved = moved.withColumn("_moved", F.lit(True))
            value = F.when(F.col("_moved"), F.col("_new")).otherwise(F.col(f"`{own}`"))
            out[child] = rows.join(moved, own, "left").withColumn(own, value).select(*t.struct.names)
            if any(x["ref"] == own for _, _, _, x in _children(catalog, child)):
                raise CatalogError(f"{label}: {child}.{own} is referred to itself, update it first")
        elif not rows.join(moved, own, "left_semi").join(changed.select(F.col(fk["ref"]).alias(own)), own, "left_anti").isEmpty():
            raise CatalogError(f"{label}: rows of {child} refer to {name}")
    return out


def delete(catalog: Catalog, name: str, where: str | None) -> DataFrame:
    """Rows whose predicate is true go, those where it is unknown stay.  All
    tables down the cascade are judged before any is written."""
    frame = catalog.frame(name)
    catalog.get(name)
    hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    gone = frame.where(hit)
    n = gone.count()
    if n:
        left = {name.lower(): frame.where(~hit)}
        _cascade(catalog, name.lower(), gone, left)
        for table, rows in left.items():
            catalog.write(table, rows)
    return catalog.spark.createDataFrame([(n,)], "deleted long")


def _cascade(catalog: Catalog, name: str, gone: DataFrame, left: dict[str, DataFrame]) -> None:
    """What is left of the tables that refer to the rows that go, and so on below."""
    for child, t, label, fk in _children(catalog, name):
        rows = left.get(child, catalog.frame(child))
        keys = gone.select(F.col(fk["ref"]).alias(fk["column"])).dropna().distinct()
        orphans = rows.join(keys, fk["column"], "left_semi").select(*t.struct.names)
        if orphans.isEmpty():
            continue
        if fk["on_delete"] != "CASCADE":
            raise CatalogError(f"{label}: rows of {child} refer to {name}")
        left[child] = rows.join(keys, fk["column"], "left_anti").select(*t.struct.names)
        _cascade(catalog, child, orphans, left)


def rewrite(catalog: Catalog, name: str, frame: DataFrame, **changes: object) -> None:
    catalog.write(name, frame)
    if changes:
        catalog.set(name, **changes)


def add_column(catalog: Catalog, name: str, column: str, kind: str, options: dict) -> None:
    table, frame = catalog.get(name), catalog.frame(name)
    if column.lower() in (f.lower() for f in frame.columns):
        raise CatalogError(f"{name}.{column} exists already")
    default = coerce(options.get("default"), T._parse_datatype_string(kind))
    if options.get("not_null") and default is None and not frame.isEmpty():
        raise CatalogError(f"{name}.{column}: NOT NULL needs a default")
    changes = {"not_null": [*table.not_null, *([column] if options.get("not_null") else [])], "unique": [*table.unique, *([column] if options.get("unique") else [])], "defaults": table.defaults | ({column: options["default"]} if "default" in options else {})}
    rewrite(catalog, name, frame.withColumn(column, F.lit(default).cast(kind)), **changes)


def drop_column(catalog: Catalog, name: str, column: str) -> None:
    table = catalog.get(name)
    own = _named(table, name, column)
    if own == table.pk or any(own in k for k in table.keys):
        raise CatalogError(f"{name}.{column} is the key")
    rewrite(catalog, name, catalog.frame(name).drop(own), not_null=[c for c in table.not_null if c != own], unique=[c for c in table.unique if c != own], defaults={k: v for k, v in table.defaults.items() if k != own}, foreign_keys={k: v for k, v in table.foreign_keys.items() if v["column"] != own}, indexes={k: v for k, v in table.indexes.items() if own not in v["columns"]}, keys=[k for k in table.keys if own not in k])


def _named(table: Table, name: str, column: str) -> str:
    own = next((f.name for f in table.struct.fields if f.name.lower() == column.lower()), None)
    if own is None:
        raise CatalogError(f"{name} has no column {column}")
    return own


def rename_column(catalog: Catalog, name: str, old: str, new: str) -> None:
    table = catalog.get(name)
    own = _named(table, name, old)
    if new.lower() in (f.lower() for f in table.struct.names):
        raise CatalogError(f"{name}.{new} exists already")
    swap = lambda c: new if c == own else c
    foreign = copy.deepcopy(table.foreign_keys)
    for fk in foreign.values():
        fk["column"] = swap(fk["column"])
    indexes = {k: v | {"columns": [swap(c) for c in v["columns"]]} for k, v in table.indexes.items()}
    rewrite(catalog, name, catalog.frame(name).withColumnRenamed(own, new), pk=swap(table.pk) if table.pk else None, not_null=[swap(c) for c in table.not_null], unique=[swap(c) for c in table.unique], defaults={swap(k): v for k, v in table.defaults.items()}, foreign_keys=foreign, indexes=indexes, keys=[[swap(c) for c in k] for k in table.keys])


def modify_column(catalog: Catalog, name: str, column: str, kind: str) -> None:
    own = _named(catalog.get(name), name, column)
    rewrite(catalog, name, catalog.frame(name).withColumn(own, F.col(own).try_cast(kind)))


def add_foreign_key(catalog: Catalog, name: str, label: str, column: str, parent: str, ref: str, on_delete: str = "RESTRICT", on_update: str = "RESTRICT") -> None:
    table = catalog.get(name)
    own, theirs = _named(table, name, column), _named(catalog.get(parent), parent, ref)
    if label in table.foreign_keys:
        raise CatalogError(f"constraint {label} exists already")
    changed = copy.deepcopy(table)
    changed.foreign_keys = {**table.foreign_keys, label: {"column": own, "table": parent.lower(), "ref": theirs, "on_delete": on_delete, "on_update": on_update}}
    check_references(catalog, changed, catalog.frame(name))
    catalog.set(name, foreign_keys=changed.foreign_keys)


def drop_constraint(catalog: Catalog, name: str, label: str) -> None:
    table = catalog.get(name)
    if label not in table.foreign_keys:
        raise CatalogError(f"constraint {label} does not exist")
    catalog.set(name, foreign_keys={k: v for k, v in table.foreign_keys.items() if k != label})
