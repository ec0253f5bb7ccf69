import zlib

import pytest

CONTRACTS = {
    "op1_langid": ({"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}, 3, 1),
    "op2_pitman_yor": ({"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}, 7, 2),
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_registered_query_keeps_its_columns_and_fold(spark, docs, tmp_path, name):
    from siftwell.llm.queries import QUERIES

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, n, rest = CONTRACTS[name]
    found = QUERIES[name](spark, str(tmp_path))
    assert list(columns.items()) == found.dtypes[: len(columns)]
    rows = found.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest)
        assert None not in tuple(r)[: len(columns)]
    if name == "op1_langid":
        assert {r["lang_pred"] for r in rows} <= {"en", "de", "und"} and all(0 <= r["score"] <= 1 for r in rows)
    else:
        assert len({r["train_tokens"] for r in rows}) == 1 and all(0 <= r["n_known"] <= r["n_tokens"] for r in rows)
