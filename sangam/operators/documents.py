"""MongoDB-style filters, updates and aggregation pipelines as DataFrame plans.

A document DataFrame has ordinary columns, and may have one column of JSON text
in which fields that are no column are looked up.  Stages fold into one lazy
plan, so that Catalyst pushes filters and prunes columns as usual.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Resolver = Callable[[str], "Field"]
# Names of value types, as $type takes them.
TYPE_NAMES = {"string": ["STRING"], "int": ["BIGINT"], "long": ["BIGINT"], "double": ["DOUBLE"], "number": ["BIGINT", "DOUBLE"], "bool": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}


class Field:
    """One field of a document: a column, or a path of the JSON column."""

    def __init__(self, column: Column | None, kind: T.DataType | None, variant: Column | None = None):
        self.column, self.kind, self.variant = column, kind, variant

    def text(self) -> Column:
        return self.column.cast("string") if self.variant is None else F.try_variant_get(self.variant, "$", "string")

    def value(self) -> Column:
        """For projections and keys: the column itself, or the JSON value as text."""
        return self.column if self.variant is None else self.text()

    def number(self) -> Column:
        if self.variant is None:
            return self.column.try_cast("double") if not isinstance(self.kind, T.NumericType) else self.column
        return F.when(self._is("BIGINT", "DOUBLE", "DECIMAL"), F.try_variant_get(self.variant, "$", "double"))

    def _is(self, *names: str) -> Column:
        return F.regexp_extract(F.schema_of_variant(self.variant), r"^[A-Z]+", 0).isin(*names)

    def exists(self) -> Column:
        return (self.column if self.variant is None else self.variant).isNotNull()

    def is_null(self) -> Column:
        """Missing or JSON null."""
        return self.column.isNull() if self.variant is None else self.variant.isNull() | F.is_variant_null(self.variant)

    def type_in(self, names: list[str]) -> Column:
        if self.variant is not None:
            return self._is(*names)
        own = {T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.DoubleType: "DOUBLE", T.FloatType: "DOUBLE"}.get(type(self.kind), "BIGINT" if isinstance(self.kind, T.IntegralType) else "ARRAY" if isinstance(self.kind, T.ArrayType) else "OBJECT")
        return F.when(self.column.isNull(), F.lit("VOID" in names)).otherwise(F.lit(own in names))

    def comparable(self, value: object) -> Column:
        """This field as the type of value; null where it has another type."""
        if isinstance(value, bool):
            if self.variant is None:
                return self.column.try_cast("boolean")
            return F.when(self._is("BOOLEAN"), F.try_variant_get(self.variant, "$", "boolean"))
        if isinstance(value, int | float):
            return self.number()
        if self.variant is None:
            return self.column.cast("string") if isinstance(self.kind, T.StringType) else self.column
        return F.when(self._is("STRING"), self.text())


def resolver(df: DataFrame, json_column: str | None = None) -> Resolver:
    names = {f.name.lower(): f for f in df.schema.fields}

    def find(path: str) -> Field:
        head, _, rest = path.partition(".")
        own = names.get(head.lower())
        if own is None and json_column is None:
            return Field(F.lit(None).cast("string"), T.StringType())
        if own is None or (json_column and head.lower() == json_column.lower() and rest):
            inner = path if own is None else rest
            keys = "".join(f"[{k}]" if k.isdigit() else f"['{k}']" if not re.fullmatch(r"\w+", k) else f".{k}" for k in inner.split("."))
            return Field(None, None, F.try_variant_get(F.try_parse_json(F.col(f"`{json_column}`")), f"${keys}", "variant"))
        column, kind = F.col(f"`{own.name}`"), own.dataType
        for k in rest.split(".") if rest else []:
            column = column[k]
            kind = next((f.dataType for f in getattr(kind, "fields", []) if f.name == k), None)
        return Field(column, kind)

    return find


def compile_filter(wanted: dict, field: Resolver, exact: bool = False) -> Column:
    """A Mongo filter as a predicate; missing fields and other types do not match.
    Plain comparisons reach the scan; exact: never null (needed where the
    predicate is negated), which a scan cannot use."""
    parts = []
    for key, value in wanted.items():
        if key in ("$and", "$or", "$nor"):
            inner = [compile_filter(x, field, exact or key == "$nor") for x in value]
            joined = reduce(lambda a, b: a & b if key == "$and" else a | b, inner)
            parts.append(~joined if key == "$nor" else joined)
        elif isinstance(value, dict) and value and all(k.startswith("$") for k in value):
            parts.append(_operators(field(key), value, exact))
        else:
            parts.append(_equals(field(key), value, exact))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _known(test: Column, exact: bool) -> Column:
    return F.coalesce(test, F.lit(False)) if exact else test


def _equals(f: Field, value: object, exact: bool) -> Column:
    if value is None:
        return f.is_null()
    if isinstance(value, dict | list):
        import json

        return _known(f.text() == json.dumps(value, separators=(",", ":")), exact)
    return _known(f.comparable(value) == F.lit(value), exact)


def _differs(f: Field, values: list) -> Column:
    """Missing, of another type, or another value than each."""
    parts = []
    for v in values:
        if v is None or isinstance(v, dict | list):
            parts.append(~_equals(f, v, True))
        else:
            own = f.comparable(v)
            parts.append(own.isNull() | (own != F.lit(v)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _operators(f: Field, ops: dict, exact: bool = False) -> Column:
    compare = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}
    parts = []
    for op, value in ops.items():
        if op == "$eq":
            parts.append(_equals(f, value, exact))
        elif op == "$ne":
            parts.append(_differs(f, [value]))
        elif op in compare:
            parts.append(_known(compare[op](f.comparable(value), F.lit(value)), exact))
        elif op == "$in":
            parts.append(reduce(lambda a, b: a | b, [_equals(f, v, exact) for v in value], F.lit(False)))
        elif op == "$nin":
            parts.append(_differs(f, value))
        elif op == "$exists":
            parts.append(f.exists() if value else ~f.exists())
        elif op == "$type":
            names = [n for v in (value if isinstance(value, list) else [value]) for n in TYPE_NAMES[v]]
            parts.append(_known(f.type_in(names), exact))
        elif op == "$regex":
            flags = ops.get("$options", "")
            parts.append(_known(f.comparable("").rlike(("(?" + flags + ")" if flags else "") + value), exact))
        elif op == "$not":
            parts.append(~(_operators(f, value, True) if isinstance(value, dict) else _equals(f, value, True)))
        elif op != "$options":
            raise ValueError(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, parts)


ARITHMETIC = {"$add": Column.__add__, "$subtract": Column.__sub__, "$multiply": Column.__mul__, "$divide": Column.__truediv__}


def expression(value: object, field: Resolver) -> Column:
    """`$field`, literals, and a few operators."""
    if isinstance(value, str) and value.startswith("$"):
        return field(value[1:]).value()
    if isinstance(value, dict):
        (op, args), *rest = value.items()
        if rest or not op.startswith("$"):
            return F.struct(*[expression(v, field).alias(k) for k, v in value.items()])
        if op == "$literal":
            return F.lit(args)
        if op in ARITHMETIC:
            return reduce(ARITHMETIC[op], [_number(a, field) for a in args])
        if op == "$concat":
            return F.concat(*[expression(a, field).cast("string") for a in args])
        if op in ("$toUpper", "$toLower"):
            return (F.upper if op == "$toUpper" else F.lower)(expression(args, field))
        if op == "$ifNull":
            return F.coalesce(*[expression(a, field) for a in args])
        if op == "$cond":
            test, then, other = args if isinstance(args, list) else (args["if"], args["then"], args["else"])
            return F.when(compile_filter(test, field), expression(then, field)).otherwise(expression(other, field))
        if op == "$size":
            return F.size(expression(args, field))
        raise ValueError(f"unknown expression {op}")
    return F.lit(value)


def _number(value: object, field: Resolver) -> Column:
    return field(value[1:]).number() if isinstance(value, str) and value.startswith("$") else expression(value, field)


def _accumulator(spec: dict, field: Resolver) -> Column:
    ((op, value),) = spec.items()
    if op == "$sum":
        return F.count("*") if value == 1 else F.sum(_number(value, field))
    if op == "$avg":
        return F.avg(_number(value, field))
    if op == "$count":
        return F.count("*")
    if op in ("$min", "$max"):
        own = field(value[1:]) if isinstance(value, str) else None
        return (F.min if op == "$min" else F.max)(own.number() if own is not None and own.variant is not None else expression(value, field))
    if op == "$push":
        return F.collect_list(expression(value, field))
    if op == "$addToSet":
        return F.array_sort(F.collect_set(expression(value, field)))
    if op in ("$first", "$last"):
        return (F.first if op == "$first" else F.last)(expression(value, field))
    raise ValueError(f"unknown accumulator {op}")


def _project(df: DataFrame, spec: dict, field: Resolver) -> DataFrame:
    if all(v in (0, False) for v in spec.values()):
        return df.drop(*spec)
    return df.select(*[(field(k).value() if v in (1, True) else expression(v, field)).alias(k.replace(".", "_")) for k, v in spec.items() if v not in (0, False)])


def _group(df: DataFrame, spec: dict, field: Resolver) -> DataFrame:
    key = spec.get("_id")
    accumulators = [_accumulator(v, field).alias(k) for k, v in spec.items() if k != "_id"] or [F.count("*").alias("_n")]
    if key is None:
        return df.agg(*accumulators)
    keys = [expression(v, field).alias(k) for k, v in key.items()] if isinstance(key, dict) else [expression(key, field).alias("_id")]
    return df.groupBy(*keys).agg(*accumulators)


def _unwind(df: DataFrame, spec: object, field: Resolver) -> DataFrame:
    options = {"path": spec} if isinstance(spec, str) else spec
    name = options["path"].lstrip("$")
    own = field(name)
    column = own.column if own.variant is None else F.try_variant_get(own.variant, "$", "array<string>")
    explode = F.explode_outer if options.get("preserveNullAndEmptyArrays") else F.explode
    alias = name.replace(".", "_")
    return df.select(*[c for c in df.columns if c != alias], explode(column).alias(alias))


def lookup(df: DataFrame, other: DataFrame, local: str, foreign: str, name: str, field: Resolver | None = None) -> DataFrame:
    """Left join into an array of the matching rows, empty where there are none.
    Without a grouping of df: the right side is gathered by key, then joined."""
    find = field or resolver(df)
    right = other.select(F.col(foreign).alias("_key"), F.struct(*other.columns).alias("_row"))
    right = right.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.array_sort(F.collect_list("_row")).alias(name))
    joined = df.withColumn("_local", find(local).value()).join(right, F.col("_local") == F.col("_key"), "left").drop("_local", "_key")
    kind = joined.schema[name].dataType.simpleString()
    return joined.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def aggregate(df: DataFrame, stages: list[dict], json_column: str | None = None, collections: Callable[[str], DataFrame] | None = None, out: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """A pipeline: $match $project $group $sort $limit $skip $count $unwind
    $lookup $addFields $set $out."""
    for stage in stages:
        ((op, spec),) = stage.items()
        own_json = json_column if json_column in df.columns else None
        field = resolver(df, own_json)
        if op == "$match":
            df = df.where(compile_filter(spec, field))
        elif op == "$project":
            df = _project(df, spec, field)
        elif op == "$group":
            df = _group(df, spec, field)
        elif op == "$sort":
            df = df.orderBy(*[(field(k).value().asc_nulls_first() if v in (1, "asc") else field(k).value().desc_nulls_last()) for k, v in spec.items()])
        elif op == "$limit":
            df = df.limit(int(spec))
        elif op == "$skip":
            df = df.offset(int(spec))
        elif op == "$count":
            df = df.agg(F.count("*").alias(spec if isinstance(spec, str) else "count"))
        elif op == "$unwind":
            df = _unwind(df, spec, field)
        elif op in ("$addFields", "$set"):
            df = df.withColumns({k: expression(v, field) for k, v in spec.items()})
        elif op == "$lookup":
            if collections is None:
                raise ValueError("$lookup needs a way to find collections")
            df = lookup(df, collections(spec["from"]), spec["localField"], spec["foreignField"], spec["as"], field)
        elif op == "$out":
            if out is None:
                raise ValueError("$out needs a way to write collections")
            out(spec, df)
        else:
            raise ValueError(f"unknown stage {op}")
    return df


def merged(doc: dict, change: dict) -> dict:
    """An update: $set, $unset and $inc, or a plain merge."""
    if not any(k.startswith("$") for k in change):
        return doc | change
    doc = dict(doc)
    for op, fields in change.items():
        for k, v in fields.items():
            if op == "$set":
                doc[k] = v
            elif op == "$unset":
                doc.pop(k, None)
            elif op == "$inc":
                doc[k] = (doc.get(k) or 0) + v
            else:
                raise ValueError(f"unknown update {op}")
    return doc
