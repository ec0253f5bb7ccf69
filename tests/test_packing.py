import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import packing


def greedy(tokens, budget, cap):
    out, batch, used, members = [], 0, 0, 0
    for n in tokens:
        if members and (used + n > budget or members == cap):
            batch, used, members = batch + 1, 0, 0
        used, members = used + n, members + 1
        out.append((batch, used))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_parts_put_together_are_the_whole(seed):
    rng = random.Random(seed)
    budget, cap = rng.choice([1, 30, 100, 400]), rng.choice([1, 2, 5, 1 << 62])
    tokens = [rng.choice([0, 0, 1, 5, 17, 40, 150]) if seed % 3 else rng.randint(1, 60) for _ in range(rng.randint(1, 300))]
    wanted, state, at = greedy(tokens, budget, cap), packing._Open(), 0
    while at < len(tokens):
        part = np.array(tokens[at : at + rng.randint(1, 60)])
        batch, used, after = packing._filled(part, state, budget, cap)
        assert list(zip(batch.tolist(), used.tolist(), strict=True)) == wanted[at : at + len(part)]
        if at:
            ways = [x for e in packing._entrances(part, budget, cap) for x in e]
            assert packing._after(state, len(part), int(part.sum()), ways, budget, cap) == after
        state, at = after, at + len(part)


@pytest.fixture
def ranges(spark):
    """Small frames keep several ranges."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("cap", [None, 4])
@pytest.mark.parametrize("group", [["g"], []])
def test_budget_over_ranges(ranges, cap, group):
    """One group has two thirds of all rows, one is null, one has a single row."""
    rng = random.Random(3)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"g{i % 4}", i, rng.choice([0, 3, 20, 90, 300])) for i in range(900)] + [("one", 1000, 5)]
    found = packing.budgeted(ranges.createDataFrame(rows, "g string, id long, tokens long").repartition(5), group, "id", 200, cap)
    wanted = set()
    for g in {r[0] for r in rows} if group else [0]:
        own = sorted(r[1:] for r in rows if not group or r[0] == g)
        wanted |= {(i, *x) for (i, _), x in zip(own, greedy([n for _, n in own], 200, cap), strict=True)}
    assert {tuple(r) for r in found.select("id", "batch", "used").collect()} == wanted
    assert found.columns == ["g", "id", "tokens", "batch", "used"]


def test_budget_of_nothing(ranges):
    assert packing.budgeted(ranges.createDataFrame([], "g string, id long, tokens long"), ["g"], "id", 10).collect() == []


def test_places_over_ranges(ranges):
    """Descending keys with nulls last, ties told apart by the next key, columns that aren't keys kept."""
    rows = [(i, None if i % 5 == 0 else i % 7, f"x{i}") for i in range(500)]
    frame = ranges.createDataFrame(rows, "id long, k long, other string").repartition(3)
    found = packing.ranked(frame, F.col("k").desc_nulls_last(), "id")
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(*r, i) for i, r in enumerate(wanted)]
    assert packing.ranked(frame.where("id < 0"), "id").collect() == []
