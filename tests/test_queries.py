"""Every registered query with an oracle agrees with it; the others run and have a stable schema."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from docspark import queries

SF = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    return x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(queries.ORACLE_SQL[name])
    assert got == canonical([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_driver_contract(spark):
    assert set(queries.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0


def test_gate_stays_in_the_jvm(spark):
    plan = queries.gate_pages(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name", ["gate_pages", "content_list_elements", "char_spans", "chunk_plan"])
def test_partitions_do_not_matter(spark, monkeypatch, name):
    want = sorted(map(repr, queries.QUERIES[name](spark, SF).collect()))
    plain = queries.table
    monkeypatch.setattr(queries, "table", lambda *a: plain(*a).repartition(7))
    assert sorted(map(repr, queries.QUERIES[name](spark, SF).collect())) == want


def test_element_rows_are_those_of_blocks_in_one_pass(spark):
    from docspark.operators import documents, elements

    blocks = [{"type": "table", "table_body": "<table><tr><td>a</td></tr></table>", "page_idx": 1}, "stray", {"type": "title", "text": "T"}, {"text": "x", "bbox": [1, "a"]}, {"text": "y", "page_idx": -1}, {"text": "z", "page_idx": "no"}]
    import json

    df = spark.createDataFrame([("a", json.dumps(blocks)), ("b", "{"), ("c", "[]")], "doc_key string, content string")
    columns = ["doc_key", "seq", "block_pos", "page_idx", "type", "text", "bbox", "element_id"]
    want = elements.route_blocks(elements.explode_blocks(df)).select(columns)
    got = documents.element_rows(df).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Window" not in plan
