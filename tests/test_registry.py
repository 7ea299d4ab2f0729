"""Every registered query of the engine against its oracle, on sf0.001."""

import decimal
import os

import duckdb
import pytest

from sangam.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_oracle(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    want = oracle.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_order_is_kept(spark):
    rows = registry.queries()["order_multi"](spark, SF).collect()
    keys = [(r.o_orderstatus, -r.o_totalprice, r.o_orderkey) for r in rows]
    assert keys == sorted(keys)


def test_filters_and_columns_reach_the_scan(spark):
    text = registry.queries()["pk_lookup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,77)]" in text
    text = registry.queries()["agg_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in text


@pytest.mark.parametrize(("name", "pushed"), [("doc_match", "EqualTo(event_type,click)"), ("doc_nin", "Not(EqualTo(role,user))"), ("doc_find_ops", "EqualTo(event_type,click)")])
def test_document_filters_reach_the_scan(spark, name, pushed):
    text = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in text.split("PushedFilters: ")[1:])
    assert pushed in filters or (name == "doc_find_ops" and "In(event_type, [click,view])" in filters), filters


def test_tables_are_opened_when_named(spark):
    e = registry.engine(spark, SF)
    e.sql("SELECT * FROM nation")
    assert [n for n, held in e.catalog.attached.items() if not callable(held)] == ["nation"]
