"""Every query of the library with SQL gives DuckDB's rows on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tidemark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_oracles_rows(spark, con, name, tmp_path):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    df.select(*columns).write.parquet(f"file://{tmp_path}/out")
    listed = ", ".join(f'"{c}"' for c in columns)
    got = con.execute(f"select {listed} from '{tmp_path}/out/*.parquet'")
    got, kinds = got.fetchall(), [d[1] for d in got.description]
    want = con.execute(f"select {listed} from ({queries.SQL[name]})")
    want, expected = want.fetchall(), [d[1] for d in want.description]
    assert got and kinds == expected
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
