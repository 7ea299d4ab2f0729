"""EXPORT, IMPORT, BACKUP and RESTORE.

A backup is a folder: manifest.json, and one folder a table in the format's
files (binary is Parquet), or one script for SQL.  Everything but the manifest
is written and read by Spark's own readers and writers.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dml
from .catalog import Catalog, CatalogError, Table

CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "\\N", "lineSep": "\n", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
FORMATS = ("BINARY", "PARQUET", "JSON", "CSV", "SQL")
VERSION = 1


def write(df: DataFrame, path: str, form: str = "CSV", compress: bool = False) -> None:
    writer = df.write.mode("errorifexists")
    if form.upper() == "CSV":
        writer.options(**CSV, **({"compression": "gzip"} if compress else {})).option("multiLine", True).csv(path)
    elif form.upper() == "JSON":
        writer.options(ignoreNullFields=False, **({"compression": "gzip"} if compress else {})).json(path)
    elif form.upper() in ("BINARY", "PARQUET"):
        writer.option("compression", "gzip" if compress else "snappy").parquet(path)
    else:
        raise CatalogError(f"unknown format {form}")


def read(catalog: Catalog, path: str, schema: T.StructType, form: str = "CSV") -> DataFrame:
    if not catalog.files.exists(path):
        raise CatalogError(f"{path} does not exist")
    reader = catalog.spark.read.schema(schema)
    if form.upper() == "CSV":
        return reader.options(**{k: v for k, v in CSV.items() if k != "lineSep"}).option("multiLine", True).csv(path)
    if form.upper() == "JSON":
        return reader.json(path)
    if form.upper() in ("BINARY", "PARQUET"):
        return reader.parquet(path)
    raise CatalogError(f"unknown format {form}")


def export_table(catalog: Catalog, name: str, path: str, form: str = "CSV", compress: bool = False) -> None:
    write(catalog.frame(name), path, form, compress)


def import_table(catalog: Catalog, name: str, path: str, form: str = "CSV") -> DataFrame:
    """INSERT semantics: rows whose key exists, and later ones of a key, are skipped."""
    return dml.insert_frame(catalog, name, read(catalog, path, catalog.get(name).struct, form))


def sql_literal(column: str, kind: T.DataType):
    c = F.col(f"`{column}`")
    text = F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    plain = c.cast("string") if isinstance(kind, T.NumericType | T.BooleanType) else F.regexp_replace(text, "\n", r"\\n")
    return F.coalesce(plain, F.lit("NULL"))


def sql_dump(catalog: Catalog, name: str, db: str | None = None) -> DataFrame:
    """(n, line): CREATE TABLE, then an INSERT a row."""
    table = catalog.tables(db)[name.lower()]
    kinds = {T.LongType: "INT", T.IntegerType: "INT", T.DoubleType: "FLOAT", T.BooleanType: "BOOL"}
    columns = ", ".join(f"{f.name} {kinds.get(type(f.dataType), 'TEXT')}{' PRIMARY KEY' if f.name == table.pk else ''}" for f in table.struct.fields)
    columns += "".join(f", PRIMARY KEY ({', '.join(k)})" for k in table.keys[:1])
    values = F.concat_ws(", ", *[sql_literal(f.name, f.dataType) for f in table.struct.fields])
    rows = catalog.frame(name, db).select(F.lit(1).alias("n"), F.concat(F.lit(f"INSERT INTO {name} VALUES ("), values, F.lit(");")).alias("line"))
    head = catalog.spark.createDataFrame([(0, f"CREATE TABLE {name} ({columns});")], "n int, line string")
    return head.unionByName(rows)


def backup(catalog: Catalog, path: str, form: str = "BINARY", db: str | None = None, compress: bool = False) -> dict:
    form = form.upper()
    if form not in FORMATS:
        raise CatalogError(f"unknown format {form}")
    if catalog.files.exists(path):
        raise CatalogError(f"{path} exists already")
    tables = catalog.tables(db)
    manifest = {"version": VERSION, "timestamp": int(time.time()), "format": form, "database": db or catalog.current, "compressed": compress, "tables": {}}
    for name, t in tables.items():
        frame = catalog.frame(name, db or catalog.current)
        if form == "SQL":
            sql_dump(catalog, name, db).orderBy("n").select("line").write.text(f"{path}/{name}")
        else:
            write(frame, f"{path}/{name}", form, compress)
        stat = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        manifest["tables"][name] = {"rows": stat.n, "checksum": str(stat.h), "schema": t.schema, "kind": t.kind, "pk": t.pk, "sequence": t.sequence, "unique": t.unique, "not_null": t.not_null, "defaults": t.defaults, "foreign_keys": t.foreign_keys, "indexes": t.indexes, "keys": t.keys}
    catalog.files.write(f"{path}/manifest.json", json.dumps(manifest))
    return manifest


def info(catalog: Catalog, path: str) -> dict:
    if not catalog.files.exists(f"{path}/manifest.json"):
        raise CatalogError(f"{path} is no backup")
    return json.loads(catalog.files.read(f"{path}/manifest.json"))


def contents(catalog: Catalog, path: str) -> DataFrame:
    return catalog.spark.createDataFrame([(n, t["kind"], t["rows"]) for n, t in info(catalog, path)["tables"].items()], "name string, kind string, rows long")


def _rows(catalog: Catalog, path: str, name: str, manifest: dict) -> DataFrame:
    schema = T.StructType.fromJson(manifest["tables"][name]["schema"])
    if manifest["format"] != "SQL":
        return read(catalog, f"{path}/{name}", schema, manifest["format"])
    from ..plans.lexer import tokenize

    def parse(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for line in batch["line"]:
                row, sign = [], 1
                for t in tokenize(line)[5:-2]:
                    if t.text == "-":
                        sign = -1
                    elif t.kind in ("string", "number", "word"):
                        upper = t.text.upper()
                        row.append(None if t.kind == "word" and upper == "NULL" else ("-" if sign < 0 else "") + (upper.lower() if t.kind == "word" else t.text))
                        sign = 1
                out.append(row)
            yield pd.DataFrame(out, columns=schema.names, dtype=object)

    lines = catalog.spark.read.text(f"{path}/{name}").toDF("line").where(F.col("line").startswith("INSERT"))
    texts = lines.mapInPandas(parse, T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
    return texts.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def verify(catalog: Catalog, path: str) -> DataFrame:
    """name, ok: row counts and checksums against the manifest."""
    manifest, out = info(catalog, path), []
    for name, t in manifest["tables"].items():
        frame = _rows(catalog, path, name, manifest)
        stat = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        out.append((name, stat.n == t["rows"] and str(stat.h) == t["checksum"]))
    return catalog.spark.createDataFrame(out, "name string, ok boolean")


def restore(catalog: Catalog, path: str, db: str | None = None, drop_existing: bool = True) -> list[str]:
    """The tables of a backup, in db (which becomes current) or the present database."""
    manifest = info(catalog, path)
    if db:
        if db.lower() not in catalog.databases:
            catalog.create_database(db)
        catalog.use(db)
    for name, t in manifest["tables"].items():
        if name in catalog.tables():
            if not drop_existing:
                raise CatalogError(f"{name} exists already")
            catalog.tables().pop(name)
        rows = _rows(catalog, path, name, manifest)
        catalog.create(name, Table(**{k: v for k, v in t.items() if k not in ("rows", "checksum")}))
        catalog.write(name, rows)
    return sorted(manifest["tables"])
