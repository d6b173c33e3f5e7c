import duckdb
import pytest

from docspark.llm import queries
from tests.test_queries import canonical


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE_SQL[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c[0] for c in want.description], want.fetchall())


def test_each_operator_has_its_query():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, len(names) + 1)]
