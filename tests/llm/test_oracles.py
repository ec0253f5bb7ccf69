import os

import pytest

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["op8_suffixes", "op9_jaccard", "op13_audit"])
def test_registered_query_agrees_with_sql(spark, name):
    import duckdb

    from siftwell.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for table in ("documents", "labels"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = QUERIES[name](spark, DATA)
    cursor = c.execute(ORACLES[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", ["op8_suffixes", "op9_jaccard", "op13_audit"])
def test_sql_of_the_small_corpus(spark, docs, tmp_path, name):
    """Nulls, empty and short texts, copies, near copies and a text that repeats itself."""
    import duckdb

    from siftwell.llm.queries import ORACLES, QUERIES

    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1 if i % 2 else None, i % 3) for i in range(0, 150, 3)] + [(3, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for table in ("documents", "labels"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    cursor = c.execute(ORACLES[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == sorted(cursor.fetchall())
