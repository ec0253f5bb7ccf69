import os

import pytest

from siftwell.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    tidy = lambda x: round(x, 9) if isinstance(x, float) else x
    ours = sorted(repr([tidy(r[k]) for k in columns]) for r in found.collect())
    cursor = c.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    theirs = sorted(repr([tidy(r[names.index(k)]) for k in columns]) for r in cursor.fetchall())
    assert ours == theirs


def test_entry_points(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
