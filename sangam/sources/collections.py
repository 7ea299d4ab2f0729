"""Document collections: JSON text with `_id`, a version and two times."""

from __future__ import annotations

import json
import secrets
import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import documents
from .catalog import Catalog, CatalogError, Table

SCHEMA = T.StructType([T.StructField("_id", T.StringType()), T.StructField("doc", T.StringType()), T.StructField("_version", T.LongType()), T.StructField("_created", T.LongType()), T.StructField("_updated", T.LongType())])


class Collections:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def create(self, name: str) -> None:
        self.catalog.create(name, Table(json.loads(SCHEMA.json()), kind="collection", pk="_id"))

    def drop(self, name: str) -> None:
        self.catalog.drop(name, "collection")

    def names(self) -> list[str]:
        return sorted(n for n, t in self.catalog.tables().items() if t.kind == "collection")

    def _ensure(self, name: str) -> Table:
        if name.lower() not in self.catalog.tables():
            self.create(name)
        return self.catalog.get(name, "collection")

    def frame(self, name: str) -> DataFrame:
        self.catalog.get(name, "collection")
        return self.catalog.frame(name)

    def insert(self, name: str, docs: list[dict | str], sequential: bool = False) -> list[str]:
        """sequential: ids 1, 2, ... of the collection; else a given _id or 20 hex digits."""
        table = self._ensure(name)
        sequence, rows, now = table.sequence, [], int(time.time())
        for doc in docs:
            body = json.loads(doc) if isinstance(doc, str) else dict(doc)
            if sequential:
                sequence += 1
                own = str(sequence)
            else:
                own = str(body.get("_id") or secrets.token_hex(10))
            rows.append((own, json.dumps(body, ensure_ascii=False), 1, now, now))
        ids = [r[0] for r in rows]
        if len(set(ids)) < len(ids) or not self.frame(name).where(F.col("_id").isin(ids)).isEmpty():
            raise CatalogError(f"{name}: a document with this _id exists")
        self.catalog.write(name, self.catalog.spark.createDataFrame(rows, SCHEMA), append=True)
        self.catalog.set(name, sequence=sequence)
        return ids

    def find(self, name: str, wanted: dict | None = None) -> DataFrame:
        df = self.frame(name)
        return df.where(documents.compile_filter(wanted or {}, documents.resolver(df, "doc")))

    def find_one(self, name: str, wanted: dict | None = None) -> DataFrame:
        return self.find(name, wanted).orderBy("_id").limit(1)

    def get(self, name: str, own: str) -> DataFrame:
        return self.frame(name).where(F.col("_id") == str(own))

    def delete(self, name: str, wanted: dict, one: bool = False) -> int:
        df = self.frame(name)
        hit = documents.compile_filter(wanted, documents.resolver(df, "doc"), exact=True)
        if one:
            first = df.where(hit).orderBy("_id").limit(1).select("_id").collect()
            hit = F.col("_id").isin([r[0] for r in first]) if first else F.lit(False)
        n = df.where(hit).count()
        if n:
            self.catalog.write(name, df.where(~hit))
        return n

    def update(self, name: str, wanted: dict, change: dict, one: bool = False) -> int:
        df = self.frame(name)
        hit = documents.compile_filter(wanted, documents.resolver(df, "doc"), exact=True)
        if one:
            first = df.where(hit).orderBy("_id").limit(1).select("_id").collect()
            hit = F.col("_id").isin([r[0] for r in first]) if first else F.lit(False)
        n = df.where(hit).count()

        @F.pandas_udf("string")
        def apply(docs: pd.Series) -> pd.Series:
            return docs.map(lambda d: json.dumps(documents.merged(json.loads(d), change), ensure_ascii=False))

        if n:
            new = df.withColumn("_hit", hit)
            changed = new.where("_hit").withColumn("doc", apply("doc")).withColumn("_version", F.col("_version") + 1).withColumn("_updated", F.lit(int(time.time())).cast("long"))
            self.catalog.write(name, new.where("not _hit").unionByName(changed).select(*SCHEMA.names))
        return n

    def upsert(self, name: str, doc: dict, wanted: dict | None = None) -> str:
        """By filter, or by the document's _id; without either it is inserted."""
        self._ensure(name)
        if wanted is None:
            if "_id" not in doc:
                return self.insert(name, [doc])[0]
            wanted = {"_id": str(doc["_id"])}
        found = self.find_one(name, wanted).select("_id").collect()
        if not found:
            return self.insert(name, [doc])[0]
        self.update(name, {"_id": found[0][0]}, doc, one=True)
        return found[0][0]

    def aggregate(self, name: str, stages: list[dict]) -> DataFrame:
        def out(target: str, df: DataFrame) -> None:
            now = int(time.time())
            rows = df.select(F.monotonically_increasing_id().cast("string").alias("_id"), F.to_json(F.struct(*df.columns)).alias("doc"), F.lit(1).cast("long").alias("_version"), F.lit(now).cast("long").alias("_created"), F.lit(now).cast("long").alias("_updated"))
            self._ensure(target)
            self.catalog.write(target, rows)  # the old rows go when the new ones are written

        return documents.aggregate(self.frame(name), stages, "doc", self.catalog.frame, out)
