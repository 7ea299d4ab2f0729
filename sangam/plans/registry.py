"""The registered queries of the engine's own operators and their oracles.

Most are statements of the language over the attached Parquet tables; the rest
run scripts over a scratch catalog, or the DataFrame operators directly.  Names
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, joins
from ..sources import indexes, transfer
from ..sources.catalog import CatalogError
from ..sources.workspace import scratch
from ..streaming import windows
from .engine import Engine

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# name: (statement, oracle; None: the statement is plain SQL that both read)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "scan_star": ("CHUNO * SE nation", "SELECT * FROM nation"),
    "project_cols": ("DIKHAO o_orderkey, o_totalprice SE orders", "SELECT o_orderkey, o_totalprice FROM orders"),
    "project_alias": ("DIKHAO o.o_orderkey JAISE k, o.o_totalprice * 2 JAISE twice SE orders JAISE o", "SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders"),
    "pk_lookup": ("DIKHAO * SE customer JAHAN c_custkey = 77", "SELECT * FROM customer WHERE c_custkey = 77"),
    "filter_cmp": ("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <> 2000 AND o_custkey < 700", None),
    "filter_and_or": ("DIKHAO o_orderkey SE orders JAHAN o_orderstatus = 'F' AUR (o_totalprice > 3000 YA o_custkey < 50)", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 3000 OR o_custkey < 50)"),
    "filter_not": ("DIKHAO o_orderkey SE orders JAHAN NAHI o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F'"),
    "filter_like": ("DIKHAO p_partkey, p_name SE part JAHAN p_name JAISA '%1%'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%'"),
    "filter_in": ("DIKHAO c_custkey SE customer JAHAN c_mktsegment ANDAR ('BUILDING', 'MACHINERY')", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_between": ("DIKHAO p_partkey SE part JAHAN p_size BEECH 5 AUR 20", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20"),
    "filter_null": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 4000 WHERE o.o_orderkey IS NULL", None),
    "filter_lenient_literal": ("SELECT o_orderkey FROM orders WHERE o_custkey = '12abc'", "SELECT o_orderkey FROM orders WHERE o_custkey = 12"),
    "bool_literals": ("DIKHAO r_regionkey SE region JAHAN (r_regionkey > 1) = SACH", "SELECT r_regionkey FROM region WHERE (r_regionkey > 1) = TRUE"),
    "case_when": (
        "DIKHAO o_orderkey, MAAMLA JAB o_totalprice > 3000 TAB 'big' JAB o_totalprice > 1000 PHIR 'mid' WARNA 'small' KHATAM JAISE size SE orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 3000 THEN 'big' WHEN o_totalprice > 1000 THEN 'mid' ELSE 'small' END AS size FROM orders",
    ),
    "string_escapes": ("SELECT r_regionkey, 'it''s\\t\"x\"' AS s FROM region", "SELECT r_regionkey, 'it''s' || chr(9) || '\"x\"' AS s FROM region"),
    "scalar_subquery": ("DIKHAO c_custkey SE customer JAHAN c_nationkey = (DIKHAO n_nationkey SE nation JAHAN n_nationkey = 7)", "SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_nationkey = 7)"),
    "scalar_subquery_empty": ("SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_nationkey = 700)", None),
    "nested_subquery": ("SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM region))", None),
    "in_subquery": ("DIKHAO c_custkey SE customer JAHAN c_nationkey ANDAR (DIKHAO n_nationkey SE nation JAHAN n_regionkey = 1)", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "exists_subquery": ("DIKHAO c_custkey SE customer c JAHAN MAUJOOD (DIKHAO 1 SE orders o JAHAN o.o_custkey = c.c_custkey AUR o.o_totalprice > 4500)", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 4500)"),
    "not_exists_subquery": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 2500)", None),
    "join_inner": ("DIKHAO c_name, o_orderkey SE customer MILAO orders ON c_custkey = o_custkey", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"),
    "join_left": (
        "DIKHAO c.c_custkey, o.o_orderkey SE customer c BAAYA BAHAR MILAO (DIKHAO * SE orders JAHAN o_totalprice > 4000) o ON c.c_custkey = o.o_custkey",
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 4000) o ON c.c_custkey = o.o_custkey",
    ),
    "join_right": (
        "DIKHAO c.c_custkey, o.o_orderkey SE (DIKHAO * SE customer JAHAN c_nationkey < 5) c DAAYA MILAO orders o ON c.c_custkey = o.o_custkey",
        "SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 5) c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey",
    ),
    "join_full": (
        "DIKHAO c.c_custkey, o.o_orderkey SE (DIKHAO * SE customer JAHAN c_nationkey < 5) c POORA BAHAR MILAO (DIKHAO * SE orders JAHAN o_totalprice > 4000) o ON c.c_custkey = o.o_custkey",
        "SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 5) c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 4000) o ON c.c_custkey = o.o_custkey",
    ),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_natural": (
        "DIKHAO doc_id, lang, quality SE (DIKHAO doc_id, lang SE documents) d KUDRATI MILAO (DIKHAO doc_id, quality SE labels) l",
        "SELECT doc_id, lang, quality FROM (SELECT doc_id, lang FROM documents) d NATURAL JOIN (SELECT doc_id, quality FROM labels) l",
    ),
    "join_using": ("DIKHAO doc_id, source, toxic SE documents MILAO labels ISTEMAL (doc_id)", "SELECT doc_id, source, toxic FROM documents JOIN labels USING (doc_id)"),
    "join_theta": ("SELECT r.r_regionkey, n.n_nationkey FROM region r JOIN nation n ON r.r_regionkey < n.n_regionkey", None),
    "join_self": ("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_multi": (
        "SELECT r_name, COUNT(*) AS n, ROUND(SUM(CAST(l_quantity AS DECIMAL(18,2))), 2) AS qty FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name",
        "SELECT r_name, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS qty FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name",
    ),
    "join_derived": ("SELECT n_name, t.n FROM nation JOIN (SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey) t ON n_nationkey = t.c_nationkey", None),
    "agg_count": ("DIKHAO GINO(*) JAISE n, GINO(o_custkey) JAISE m SE orders", "SELECT COUNT(*) AS n, COUNT(o_custkey) AS m FROM orders"),
    "agg_sum": ("DIKHAO JODO(o_custkey) JAISE s SE orders", "SELECT CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders"),
    "agg_avg": ("DIKHAO ROUND(AUSAAT(o_custkey), 6) JAISE a SE orders", "SELECT ROUND(AVG(o_custkey), 6) AS a FROM orders"),
    "agg_min_max": ("DIKHAO SABSE_CHOTA(o_totalprice) JAISE lo, SABSE_BADA(o_totalprice) JAISE hi SE orders", "SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders"),
    "agg_group": ("DIKHAO o_orderstatus, GINO(*) JAISE n SE orders JAHAN o_totalprice > 1000 SAMOOH DWARA o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus"),
    "agg_group_multi": (
        "DIKHAO l_returnflag, l_linestatus, GINO(*) JAISE n, JODO(CAST(l_extendedprice AS DECIMAL(18,2))) JAISE total, SABSE_CHOTA(l_tax) JAISE tax SE lineitem SAMOOH DWARA l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, MIN(l_tax) AS tax FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "agg_having": ("DIKHAO o_custkey, GINO(*) JAISE n SE orders SAMOOH DWARA o_custkey RAKHTE GINO(*) > 12", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"),
    "agg_implicit": ("SELECT COUNT(*) AS n, MAX(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05", None),
    "agg_empty": ("SELECT COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders WHERE o_orderkey < 0", None),
    "distinct": ("DIKHAO ALAG o_orderpriority, o_orderstatus SE orders", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders"),
    "order_multi": ("DIKHAO o_orderkey, o_orderstatus, o_totalprice SE orders KRAM DWARA o_orderstatus CHADHTE, o_totalprice UTARTE, o_orderkey SEEMA 50", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey LIMIT 50"),
    "limit_offset": ("DIKHAO o_orderkey SE orders KRAM DWARA o_orderkey SEEMA 20 PAAR 30", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30"),
    "limit_zero": ("SELECT o_orderkey FROM orders LIMIT 0", None),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "order_unprojected": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10", None),
    "json_field": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    # extensions: not in the reference's language
    "ext_window": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders", None),
    "ext_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", None),
    "ext_rollup": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)", None),
}

#: Hash, merge and nested-loop joins as DataFrame operators.
HINTED = "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 2000"

STUDENTS = [(1, "Rahul", 20, "A"), (2, "Priya", 21, "A+"), (3, "Amit", 19, "B"), (4, "Sneha", 22, "A"), (5, "Vikram", 20, "C")]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, scratch(spark)).attach_parquet(sf_dir, TABLES)


def statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement(STATEMENTS["agg_group"][0])(spark, sf_dir)


def _hinted(algorithm: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        customer, orders = e.catalog.frame("customer"), e.catalog.frame("orders").where("o_totalprice > 2000")
        return joins.join(customer, orders, "inner", [joins.Condition("c_custkey", "=", "o_custkey")], algorithm=algorithm).select("c_custkey", "o_orderkey")

    return run


def _documents(name: str, wanted: dict, columns: list[str], json_column: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return df.where(documents.compile_filter(wanted, documents.resolver(df, json_column))).select(*columns)

    return run


def _pipeline(name: str, stages: list[dict], json_column: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents.aggregate(spark.read.parquet(f"{sf_dir}/{name}.parquet"), stages, json_column, lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet"))

    return run


# name: (query, oracle)
DOCUMENTS: dict[str, tuple[Callable, str | None]] = {
    "doc_find_eq": (_documents("events", {"k": 87}, ["event_id"], "props"), "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 87"),
    "doc_find_ops": (_documents("events", {"k": {"$gte": 20, "$lt": 40, "$ne": 30}, "event_type": {"$in": ["click", "view"]}}, ["event_id"], "props"), "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 20 AND CAST(json_extract_string(props, '$.k') AS BIGINT) < 40 AND CAST(json_extract_string(props, '$.k') AS BIGINT) <> 30 AND event_type IN ('click', 'view')"),
    "doc_nin": (_documents("conversations", {"role": {"$nin": ["user"]}}, ["conv_id", "turn"]), "SELECT conv_id, turn FROM conversations WHERE role NOT IN ('user')"),
    "doc_regex": (_documents("conversations", {"text": {"$regex": "^[A-M]"}}, ["conv_id", "turn"]), "SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '^[A-M]')"),
    "doc_exists": (_documents("events", {"k": {"$exists": True}, "zz": {"$exists": False}}, ["event_id"], "props"), "SELECT event_id FROM events WHERE json_exists(props, '$.k') AND NOT json_exists(props, '$.zz')"),
    "doc_type": (_documents("events", {"k": {"$type": "int"}}, ["event_id"], "props"), "SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT')"),
    "doc_logical": (
        _documents("events", {"$or": [{"k": {"$lt": 5}}, {"$and": [{"event_type": "click"}, {"value": {"$gt": 50}}]}], "$nor": [{"user_id": 3}], "k": {"$not": {"$gt": 90}}}, ["event_id"], "props"),
        "SELECT event_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE (k < 5 OR (event_type = 'click' AND value > 50)) AND NOT user_id = 3 AND NOT k > 90",
    ),
    "doc_match": (_pipeline("events", [{"$match": {"event_type": "click"}}, {"$project": {"event_id": 1, "user_id": 1}}]), "SELECT event_id, user_id FROM events WHERE event_type = 'click'"),
    "doc_project": (_pipeline("events", [{"$project": {"event_id": 1, "twice": {"$multiply": ["$k", 2]}}}], "props"), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 2 AS twice FROM events"),
    "doc_group": (
        _pipeline("events", [{"$group": {"_id": "$event_type", "n": {"$sum": 1}, "k_sum": {"$sum": "$k"}, "k_max": {"$max": "$k"}}}], "props"),
        "SELECT event_type AS _id, COUNT(*) AS n, SUM(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k_sum, MAX(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k_max FROM events GROUP BY event_type",
    ),
    "doc_sort_limit_skip": (_pipeline("events", [{"$sort": {"user_id": 1, "event_id": -1}}, {"$skip": 5}, {"$limit": 20}, {"$project": {"event_id": 1, "user_id": 1}}]), "SELECT event_id, user_id FROM events ORDER BY user_id, event_id DESC LIMIT 20 OFFSET 5"),
    "doc_count": (_pipeline("events", [{"$match": {"k": {"$gt": 50}}}, {"$count": "count"}], "props"), "SELECT COUNT(*) AS count FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50"),
    "doc_unwind": (
        _pipeline("conversations", [{"$group": {"_id": "$conv_id", "turns": {"$push": "$turn"}}}, {"$unwind": "$turns"}]),
        "SELECT conv_id AS _id, turn AS turns FROM conversations",
    ),
    "doc_addfields": (_pipeline("events", [{"$addFields": {"label": {"$concat": ["$event_type", "-", "$user_id"]}}}, {"$project": {"event_id": 1, "label": 1}}]), "SELECT event_id, event_type || '-' || CAST(user_id AS VARCHAR) AS label FROM events"),
    "doc_cond": (_pipeline("events", [{"$project": {"event_id": 1, "size": {"$cond": [{"value": {"$gt": 50}}, "high", "low"]}}}]), "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS size FROM events"),
    "doc_lookup": (
        _pipeline("nation", [{"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "customers"}}, {"$project": {"n_nationkey": 1, "n": {"$size": "$customers"}}}]),
        "SELECT n_nationkey, CAST(COUNT(c_custkey) AS INTEGER) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey",
    ),
}


def _script(text: str, last: str, setup: str = "CREATE TABLE t (id INT PK, name TEXT, age INT, grade TEXT)"):
    """A DML script over a small catalog table, then a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.sql(setup)
        e.sql("INSERT INTO t VALUES " + ", ".join(f"({i}, '{n}', {a}, '{g}')" for i, n, a, g in STUDENTS))
        e.script(text)
        return e.sql(last)

    return run


def _values(rows: list[tuple], columns: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if not isinstance(v, int) else f"CAST({v} AS BIGINT)" for v in r) + ")" for r in rows) + f") v({columns})"


ALL = "SELECT * FROM t"
SCRIPTS: dict[str, tuple[Callable, str]] = {
    "dml_insert_skip_dup": (_script("DALO MEIN t MAAN (2, 'Other', 1, 'Z'), (6, 'Neha', 21, 'B+'), (6, 'Twice', 1, 'Z')", ALL), _values([*STUDENTS, (6, "Neha", 21, "B+")], "id, name, age, grade")),
    "dml_auto": (_script("INSERT INTO t VALUES (AUTO, 'a', 1, 'A'), (40, 'b', 2, 'B'), (AUTO, 'c', 3, 'C')", ALL), _values([*STUDENTS, (6, "a", 1, "A"), (40, "b", 2, "B"), (41, "c", 3, "C")], "id, name, age, grade")),
    "dml_update": (_script("BADLO t RAKHO_YEH age = age + 1, grade = 'Z' JAHAN grade = 'A'", ALL), _values([(i, n, a + (g == "A"), "Z" if g == "A" else g) for i, n, a, g in STUDENTS], "id, name, age, grade")),
    "dml_delete": (_script("NIKALO SE t JAHAN age = 20", ALL), _values([r for r in STUDENTS if r[2] != 20], "id, name, age, grade")),
    "dml_delete_null": (_script("INSERT INTO t VALUES (9, 'n', NULL, 'A'); DELETE FROM t WHERE age > 0", ALL), "SELECT CAST(9 AS BIGINT) AS id, 'n' AS name, CAST(NULL AS BIGINT) AS age, 'A' AS grade"),
    "alter_add": (_script("ALTER TABLE t ADD COLUMN city TEXT DEFAULT 'x'", "SELECT id, city FROM t"), _values([(r[0], "x") for r in STUDENTS], "id, city")),
    "alter_drop": (_script("ALTER TABLE t DROP COLUMN grade", ALL), _values([r[:3] for r in STUDENTS], "id, name, age")),
    "alter_rename": (_script("ALTER TABLE t NAAM_BADLO STAMBH grade TO mark", ALL), _values(STUDENTS, "id, name, age, mark")),
    "alter_modify": (_script("ALTER TABLE t MODIFY age TEXT", "SELECT id, age FROM t"), _values([(r[0], str(r[2])) for r in STUDENTS], "id, age")),
    "txn_rollback": (_script("SHURU; NIKALO SE t JAHAN id > 0; WAPAS", ALL), _values(STUDENTS, "id, name, age, grade")),
    "txn_savepoint": (
        _script("BEGIN; INSERT INTO t VALUES (20, 'p', 1, 'A'); NISHAAN s; INSERT INTO t VALUES (21, 'q', 1, 'A'); ROLLBACK TO s; PUKKA", ALL),
        _values([*STUDENTS, (20, "p", 1, "A")], "id, name, age, grade"),
    ),
    "txn_release": (_script("BEGIN; SAVEPOINT a; DELETE FROM t WHERE id = 1; RELEASE SAVEPOINT a; COMMIT", ALL), _values(STUDENTS[1:], "id, name, age, grade")),
    "prepared_exec": (_script("TAYYAR p JAISE DIKHAO id, name SE t JAHAN age = ? AUR grade <> ?", "CHALAO p ISTEMAL (20, 'C')"), _values([(1, "Rahul")], "id, name")),
    "database_use": (_script("CREATE DATABASE other; USE other; CREATE TABLE u (id INT); INSERT INTO u VALUES (7)", "SELECT a.id, b.name FROM u a JOIN public.t b ON b.id < a.id WHERE b.grade = 'B'"), _values([(7, "Amit")], "id, name")),
    "foreign_key_cascade": (
        _script("CREATE TABLE c (id INT PK, t_id INT); INSERT INTO c VALUES (1, 1), (2, 2), (3, 1); ALTER TABLE c ADD CONSTRAINT fk FOREIGN KEY (t_id) REFERENCES t(id) ON DELETE CASCADE; DELETE FROM t WHERE id = 1", "SELECT id, t_id FROM c"),
        _values([(2, 2)], "id, t_id"),
    ),
    "insert_select": (_script("CREATE TABLE r (k INT PK, name TEXT); INSERT INTO r SELECT r_regionkey, r_name FROM region", "SELECT k, name FROM r"), "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region"),
    "dml_upsert": (
        _script("UPSERT docs {\"_id\": \"a\", \"n\": 1}; DAL_YA_BADLO docs {\"_id\": \"a\", \"m\": 2}; UPSERT docs {\"_id\": \"b\", \"n\": 5}", "SELECT `_id` AS own, get_json_object(doc, '$.n') AS n, get_json_object(doc, '$.m') AS m, `_version` AS version FROM docs"),
        "SELECT * FROM (VALUES ('a', '1', '2', CAST(2 AS BIGINT)), ('b', '5', NULL, CAST(1 AS BIGINT))) v(own, n, m, version)",
    ),
    "doc_rakho_dhundo": (_script("RAKHO logs {\"level\": \"info\", \"ts\": 1}; RAKHO logs {\"level\": \"error\", \"ts\": 2}; HATAO logs 1", "SELECT `_id` AS own, get_json_object(doc, '$.level') AS level FROM logs"), "SELECT '2' AS own, 'error' AS level"),
    "doc_ikatha": (
        _script("RAKHO logs {\"level\": \"info\", \"ts\": 1}; RAKHO logs {\"level\": \"error\", \"ts\": 2}; RAKHO logs {\"level\": \"info\", \"ts\": 5}", "IKATHA logs [{\"$group\": {\"_id\": \"$level\", \"n\": {\"$sum\": 1}, \"last\": {\"$max\": \"$ts\"}}}]"),
        "SELECT * FROM (VALUES ('info', CAST(2 AS BIGINT), CAST(5 AS DOUBLE)), ('error', CAST(1 AS BIGINT), CAST(2 AS DOUBLE))) v(_id, n, last)",
    ),
}


ORDERS = "CREATE TABLE o (k INT PK, cust INT, status TEXT, price FLOAT); INSERT INTO o SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
ORDERS_SQL = "SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS cust, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS price FROM orders"


def _on_orders(text: str, last: str = "SELECT * FROM o", setup: str = ORDERS):
    """Statements over a catalog table as large as orders, then a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.script(setup)
        e.script(text)
        return e.sql(last)

    return run


LOGS = "; ".join(f"RAKHO logs {d}" for d in ('{"level": "info", "ts": 1}', '{"level": "error", "ts": 2, "tags": ["a"]}', '{"level": "info", "ts": 5}', '{"ts": "late"}'))
LOG_COLUMNS = "SELECT `_id` AS own, get_json_object(doc, '$.level') AS level, get_json_object(doc, '$.ts') AS ts FROM "


def _logs(act: Callable[[Engine], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.script(LOGS)
        return act(e)

    return run


def _log_rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("_id").alias("own"), F.get_json_object("doc", "$.level").alias("level"), F.get_json_object("doc", "$.ts").alias("ts"))


def _log_values(rows: list[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in rows) + ") v(own, level, ts)"


def _after(change: Callable[[Engine], object]):
    def act(e: Engine) -> DataFrame:
        change(e)
        return e.sql(LOG_COLUMNS + "logs")

    return act


def _other_database(form: str):
    """BACKUP of a database that is not the current one, RESTOREd beside it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, path = engine(spark, sf_dir), scratch(spark, "backup")
        e.script("CREATE DATABASE oth; CREATE TABLE s (k INT PK, v TEXT); INSERT INTO s VALUES (111, 'here'); USE oth; CREATE TABLE s (k INT PK, v TEXT); INSERT INTO s SELECT n_nationkey, n_name FROM nation; USE public")
        e.sql(f"BACKUP DATABASE oth TO '{path}' FORMAT {form}")
        e.sql(f"RESTORE DATABASE again FROM '{path}'")
        return e.sql("SELECT * FROM s")

    return run


def _quoted(compressed: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, path = engine(spark, sf_dir), scratch(spark, "export")
        e.script("CREATE TABLE d (k INT PK, v TEXT); INSERT INTO d SELECT doc_id, text FROM documents; INSERT INTO d VALUES (-1, 'a,\"b\"'), (-2, NULL), (-3, 'x\\ny')")
        e.sql(f"EXPORT TABLE d TO '{path}' FORMAT CSV {compressed}")
        e.script(f"DELETE FROM d; IMPORT TABLE d FROM '{path}' FORMAT CSV")
        return e.sql("SELECT * FROM d")

    return run


def _two_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions on one catalog take turns: neither loses the other's tables."""
    root = scratch(spark)
    a, b = Engine(spark, root), Engine(spark, root)
    a.script("CREATE TABLE x (id INT PK); INSERT INTO x VALUES (1)")
    b.script("CREATE TABLE y (id INT PK); INSERT INTO y VALUES (2); INSERT INTO x VALUES (3)")
    a.script("INSERT INTO x VALUES (4); CREATE TABLE z (id INT PK)")
    return Engine(spark, root).sql("SELECT id FROM x UNION ALL SELECT id FROM y UNION ALL SELECT id FROM z")


def _index_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.script("CREATE TABLE p (k INT PK, size INT, brand TEXT); INSERT INTO p SELECT p_partkey, p_size, p_name FROM part; CREATE INDEX ON p (size, brand)")
    return indexes.scan_range(e.catalog.frame("p"), "size", 15, 15, ordered=False).select("k")


def _refused(*statements: str):
    """Statements against a NOT NULL column: how many are refused, and the rows as they were."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, refused = engine(spark, sf_dir), 0
        e.sql("CREATE TABLE t (id INT PK, name TEXT NOT NULL, age INT, grade TEXT)")
        e.sql("INSERT INTO t VALUES " + ", ".join(f"({i}, '{n}', {a}, '{g}')" for i, n, a, g in STUDENTS))
        for text in statements:
            try:
                e.sql(text)
            except CatalogError:
                refused += 1
        return e.sql("SELECT * FROM t").withColumn("refused", F.lit(refused).cast("long"))

    return run


GRANDCHILDREN = "CREATE TABLE c (id INT PK, t_id INT); INSERT INTO c VALUES (1, 1), (2, 2), (3, 1); CREATE TABLE d (id INT PK, c_id INT); INSERT INTO d VALUES (10, 1), (20, 2), (30, 3); ALTER TABLE c ADD CONSTRAINT fk FOREIGN KEY (t_id) REFERENCES t(id) ON DELETE CASCADE ON UPDATE CASCADE; ALTER TABLE d ADD CONSTRAINT fd FOREIGN KEY (c_id) REFERENCES c(id) ON DELETE CASCADE; "

# statements that change tables of a size, constraints, and the rest of the document and file statements
CHANGES: dict[str, tuple[Callable, str]] = {
    "dml_orders_insert": (_on_orders("INSERT INTO o SELECT o_orderkey, o_custkey, 'again', 0 FROM orders"), ORDERS_SQL),
    "dml_orders_update": (_on_orders("BADLO o RAKHO_YEH price = price * 2, status = 'X' JAHAN cust < 100 AUR status = 'F'"), f"SELECT k, cust, CASE WHEN cust < 100 AND status = 'F' THEN 'X' ELSE status END AS status, CASE WHEN cust < 100 AND status = 'F' THEN price * 2 ELSE price END AS price FROM ({ORDERS_SQL})"),
    "dml_orders_delete": (_on_orders("NIKALO SE o JAHAN price > 1000"), f"SELECT * FROM ({ORDERS_SQL}) WHERE NOT price > 1000"),
    "dml_delete_in": (_on_orders("DELETE FROM o WHERE cust IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"), f"SELECT * FROM ({ORDERS_SQL}) WHERE cust NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"),
    "dml_delete_exists": (_on_orders("DELETE FROM o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = cust AND c.c_nationkey = 3)"), f"SELECT * FROM ({ORDERS_SQL}) WHERE cust NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"),
    "dml_delete_not_in_empty": (_on_orders("DELETE FROM o WHERE cust NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 0)", "SELECT COUNT(*) AS n FROM o"), "SELECT CAST(0 AS BIGINT) AS n"),
    "dml_update_in": (_on_orders("UPDATE o SET price = -1.0 WHERE k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"), f"SELECT k, cust, status, CASE WHEN k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN -1.0 ELSE price END AS price FROM ({ORDERS_SQL})"),
    "composite_key": (_script("CREATE TABLE k (a INT, b INT, PRIMARY KEY (a, b)); INSERT INTO k VALUES (1, 1), (1, 2), (1, 3), (1, 2)", "SELECT a, b FROM k"), _values([(1, 1), (1, 2), (1, 3)], "a, b")),
    "composite_key_select": (_on_orders("CREATE TABLE l (o INT, n INT, q FLOAT, PRIMARY KEY (o, n)); INSERT INTO l SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem; INSERT INTO l SELECT l_orderkey, l_linenumber, 0 FROM lineitem", "SELECT o, COUNT(*) AS c FROM l GROUP BY o", "SELECT 1"), "SELECT CAST(l_orderkey AS BIGINT) AS o, COUNT(DISTINCT l_linenumber) AS c FROM lineitem GROUP BY l_orderkey"),
    "unique_index": (_script("CREATE UNIQUE INDEX ON t (name); INSERT INTO t VALUES (8, 'Amit', 1, 'Z'), (9, 'New', 1, 'Z'); INSERT INTO t SELECT id + 100, name, age, grade FROM t WHERE id < 3", "SELECT id, name FROM t"), _values([*(r[:2] for r in STUDENTS), (9, "New")], "id, name")),
    "not_null_kept": (_refused("UPDATE t SET name = NULL WHERE id = 1", "INSERT INTO t SELECT 70, NULL, 1, 'A'", "INSERT INTO t VALUES (71, NULL, 1, 'A')"), _values([(*r, 3) for r in STUDENTS], "id, name, age, grade, refused")),
    "foreign_key_nested": (_script(GRANDCHILDREN + "DELETE FROM t WHERE id = 1", "SELECT c.id AS c, d.id AS d FROM c FULL JOIN d ON d.c_id = c.id"), _values([(2, 20)], "c, d")),
    "foreign_key_update": (_script(GRANDCHILDREN + "UPDATE t SET id = 50 WHERE id = 1", "SELECT c.id, c.t_id, t.name FROM c JOIN t ON t.id = c.t_id"), _values([(1, 50, "Rahul"), (2, 2, "Priya"), (3, 50, "Rahul")], "id, t_id, name")),
    "drop_constraint": (_script(GRANDCHILDREN + "ALTER TABLE c DROP CONSTRAINT fk; DELETE FROM t WHERE id = 1", "SELECT id, t_id FROM c"), _values([(1, 1), (2, 2), (3, 1)], "id, t_id")),
    "lenient_by_table": (_script("CREATE TABLE m (k TEXT PK); INSERT INTO m VALUES ('abc'), ('7'); CREATE TABLE n (k INT PK); INSERT INTO n VALUES (0), (7)", "SELECT m.k AS a, n.k AS b FROM m CROSS JOIN n WHERE m.k = 'abc' AND n.k = '7x'"), "SELECT 'abc' AS a, CAST(7 AS BIGINT) AS b"),
    "show_tables": (_script("CREATE TABLE u (id INT); DROP TABLE u", "SHOW TABLES", "CREATE TABLE t (id INT PK, name TEXT, age INT, grade TEXT)"), "SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in [*TABLES, "t"]) + ") v(name)"),
    "show_databases": (_script("CREATE DATABASE one; CREATE DATABASE two; DROP DATABASE two", "SHOW DATABASES"), "SELECT * FROM (VALUES ('one'), ('public')) v(name)"),
    "describe_table": (_script("", "DESCRIBE t"), "SELECT * FROM (VALUES ('id', 'bigint', TRUE), ('name', 'string', FALSE), ('age', 'bigint', FALSE), ('grade', 'string', FALSE)) v(\"column\", type, pk)"),
    "explain_statement": (lambda spark, sf_dir: engine(spark, sf_dir).sql("SAMJHAO SELECT * FROM orders WHERE o_custkey = 5").select(F.contains("plan", F.lit("o_custkey")).alias("planned")), "SELECT TRUE AS planned"),
    "two_sessions": (_two_sessions, "SELECT * FROM (VALUES (CAST(1 AS BIGINT)), (3), (4), (2)) v(id)"),
    "doc_khojo": (_logs(lambda e: _log_rows(e.sql('KHOJO logs {"level": "info", "ts": {"$gt": 1}}'))), _log_values([("3", "info", "5")])),
    "doc_find_ne": (_logs(lambda e: _log_rows(e.sql('FIND logs {"level": {"$ne": "info"}}'))), _log_values([("2", "error", "2"), ("4", None, "late")])),
    "doc_mangwao": (_logs(lambda e: _log_rows(e.sql("MANGWAO logs 2").unionByName(e.sql("DHUNDO logs JAHAN level = 'info'")))), _log_values([("2", "error", "2"), ("1", "info", "1"), ("3", "info", "5")])),
    "doc_get_all": (_logs(lambda e: _log_rows(e.sql("MANGWAO logs"))), _log_values([("1", "info", "1"), ("2", "error", "2"), ("3", "info", "5"), ("4", None, "late")])),
    "doc_update_many": (_logs(_after(lambda e: e.collections.update("logs", {"level": "info"}, {"$set": {"level": "seen"}, "$inc": {"ts": 10}}))), _log_values([("1", "seen", "11"), ("2", "error", "2"), ("3", "seen", "15"), ("4", None, "late")])),
    "doc_update_one": (_logs(_after(lambda e: e.collections.update("logs", {"level": "info"}, {"$unset": {"level": ""}}, one=True))), _log_values([("1", None, "1"), ("2", "error", "2"), ("3", "info", "5"), ("4", None, "late")])),
    "doc_delete_many": (_logs(_after(lambda e: e.collections.delete("logs", {"level": {"$ne": "info"}}))), _log_values([("1", "info", "1"), ("3", "info", "5")])),
    "doc_delete_one": (_logs(_after(lambda e: e.collections.delete("logs", {"level": "info"}, one=True))), _log_values([("2", "error", "2"), ("3", "info", "5"), ("4", None, "late")])),
    "doc_out": (_logs(lambda e: (e.sql('IKATHA logs [{"$match": {"level": "info"}}, {"$group": {"_id": "$level", "n": {"$sum": 1}}}, {"$out": "found"}]'), e.sql("SELECT get_json_object(doc, '$.n') AS n FROM found"))[1]), "SELECT '2' AS n"),
}
CHANGES |= {f"backup_other_{f.lower()}": (_other_database(f), "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation") for f in ("BINARY", "CSV", "JSON", "SQL")}
QUOTED_SQL = "SELECT CAST(doc_id AS BIGINT) AS k, text AS v FROM documents UNION ALL SELECT -1, 'a,\"b\"' UNION ALL SELECT -2, NULL UNION ALL SELECT -3, 'x' || chr(10) || 'y'"
CHANGES |= {"export_quotes": (_quoted(""), QUOTED_SQL), "export_gzip": (_quoted("COMPRESSED"), QUOTED_SQL), "index_equality": (_index_equal, "SELECT p_partkey AS k FROM part WHERE p_size = 15")}


def _round_trip(form: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, path = engine(spark, sf_dir), scratch(spark, "export")
        e.sql("CREATE TABLE o (o_orderkey INT PK, o_orderstatus TEXT, o_totalprice FLOAT)")
        e.sql(f"EXPORT TABLE orders TO '{path}' FORMAT {form}") if form == "PARQUET" else transfer.write(e.sql("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"), path, form)
        if form == "PARQUET":
            return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")
        e.sql(f"IMPORT TABLE o FROM '{path}' FORMAT {form}")
        return e.sql("SELECT * FROM o")

    return run


def _backup(form: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, path = engine(spark, sf_dir), scratch(spark, "backup")
        e.script("CREATE TABLE n (k INT PK, name TEXT, region INT); INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation; CREATE TABLE e (id INT)")
        e.sql(f"BACKUP DATABASE public TO '{path}' FORMAT {form}")
        e.script(f"DROP TABLE n; RESTORE DATABASE copy FROM '{path}'")
        return e.sql("SELECT * FROM n")

    return run


def _index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.script("CREATE TABLE p (k INT PK, size INT); INSERT INTO p SELECT p_partkey, p_size FROM part; CREATE INDEX ON p (size)")
    return indexes.scan_range(e.catalog.frame("p"), "size", 10, 20, low_inclusive=False, ordered=False)


def _analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("ANALYZE TABLE orders").where(F.col("column").isin("o_orderkey", "o_orderstatus")).select("column", "n_rows", "n_null", "min", "max")


def _iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    joined = e.sql("SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
    return spark.createDataFrame(list(joins.iterate(joined)), joined.schema)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = windows.read_parquet_stream(spark, f"{sf_dir}/events.parquet")
    counts = windows.run_to_table(windows.window_counts(events, window="1 day"), scratch(spark, "stream"), scratch(spark, "stream-state"))
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).cast("double").alias("total"))


FILES: dict[str, tuple[Callable, str]] = {
    "csv_roundtrip": (_round_trip("CSV"), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    "json_roundtrip": (_round_trip("JSON"), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    "parquet_export": (_round_trip("PARQUET"), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    **{f"backup_restore_{f.lower()}": (_backup(f), "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation") for f in ("BINARY", "CSV", "JSON", "SQL")},
    "index_range": (_index_range, "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size > 10 AND p_size <= 20"),
    "analyze_table": (
        _analyze,
        "SELECT 'o_orderkey' AS \"column\", COUNT(*) AS n_rows, COUNT(*) - COUNT(o_orderkey) AS n_null, CAST(MIN(o_orderkey) AS VARCHAR) AS min, CAST(MAX(o_orderkey) AS VARCHAR) AS max FROM orders UNION ALL SELECT 'o_orderstatus', COUNT(*), COUNT(*) - COUNT(o_orderstatus), MIN(o_orderstatus), MAX(o_orderstatus) FROM orders",
    ),
    "ext_stream_windows": (_stream, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, COUNT(*) AS n, CAST(ROUND(SUM(CAST(value AS DECIMAL(18,4))), 2) AS DOUBLE) AS total FROM events GROUP BY ALL"),
    "join_iterator": (_iterator, "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: statement(text) for k, (text, _) in STATEMENTS.items()}
    found |= {f"join_{a}_hint": _hinted(b) for a, b in (("hash", "hash"), ("merge", "merge"), ("nl", "nested_loop"))}
    for group in (DOCUMENTS, SCRIPTS, CHANGES, FILES):
        found |= {k: f for k, (f, _) in group.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found = {k: oracle or text for k, (text, oracle) in STATEMENTS.items()}
    found |= {f"join_{a}_hint": HINTED for a in ("hash", "merge", "nl")}
    for group in (DOCUMENTS, SCRIPTS, CHANGES, FILES):
        found |= {k: sql for k, (_, sql) in group.items() if sql}
    return found
