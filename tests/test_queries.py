"""Every registered query against its SQL, and what its plan may not contain."""
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events orders supplier".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(row[i]) for i in order) for row in rows])


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, SF)
    got = [tuple(r) for r in frame.collect()]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert canonical(frame.columns, got) == canonical(columns, cursor.fetchall())


def test_entry(spark):
    frame = contract.entry(spark)
    assert {"query_id", "doc_id", "rank", "rrf_score", "excerpt"} <= set(frame.columns)
    assert frame.limit(1).count() == 1


def test_scans_read_only_what_is_needed(spark):
    plan = contract.queries()["lexical_search_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    history = contract.queries()["turn_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in history


def test_typed_parts_of_a_metadata_filter_reach_the_scan(spark):
    plan = contract.queries()["search_by_nested_metadata"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(lang, [de,en])" in plan or "In(lang, [en,de])" in plan
