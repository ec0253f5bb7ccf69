import pytest

from siftwell.operators import rules
from siftwell.operators.rules import Rule


def test_verdict_from_conditions_is_that_of_the_fields(spark):
    """Ties go to the first path, a null condition is low, one rule works, none is refused."""
    table = spark.createDataFrame([(i, i % 4 if i % 5 else None, f"v{i % 3}") for i in range(40)], "id long, a int, b string")
    some = [Rule("/b", "b", "b = 'v1'", 0.9, 0.1, 0.6), Rule("/a", "a", "a > 1", 0.9, 0.1, 0.8), Rule("/c", "a + 1", "a IS NULL", 0.95, 0.1, 0.7)]
    for chosen in (some, some[:1]):
        found = rules.assess(table, "id", chosen, 0.9)
        again = rules.rolled_up(found.select("id", "fields"), 0.9)
        assert found.columns == again.columns
        assert sorted(found.collect()) == sorted(again.collect())
    with pytest.raises(ValueError):
        rules.assess(table, "id", [])


def test_a_filter_on_the_verdict_comes_before_the_fields(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 AS a").write.parquet(f"{tmp_path}/t")
    found = rules.assess(spark.read.parquet(f"{tmp_path}/t"), "id", [Rule("/a", "a", "a = 1"), Rule("/id", "id", "id > 8")]).where("warning")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array(") < plan.index("Filter") and "array(" not in plan[plan.index("Filter") :]
    assert found.count() == 4
