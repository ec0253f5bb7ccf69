"""The content-addressed store of answers: probing, duplicates, upserts, and the checks on answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "request_hash"


def hits(plans: DataFrame, store: DataFrame) -> DataFrame:
    """Plans whose key the store has."""
    return plans.join(store.select(KEY), KEY, "left_semi").select(plans.columns)


def misses(plans: DataFrame, store: DataFrame) -> DataFrame:
    """Plans whose key the store lacks."""
    return plans.join(store.select(KEY), KEY, "left_anti").select(plans.columns)


def probed(plans: DataFrame, store: DataFrame) -> DataFrame:
    """Plans with the store's columns and whether it has them; the store has a key once."""
    return plans.join(store.withColumn("cached", F.lit(True)), KEY, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def representatives(plans: DataFrame) -> DataFrame:
    """Plans with the id of the first plan of the same key: a partial aggregation and a join, so that a key
    that many plans share isn't gathered in one task."""
    first = plans.groupBy(KEY).agg(F.min_by("id", "ordinal").alias("representative"))
    return plans.join(first, KEY)


def cached_flags(plans: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Plans with cached: whether an earlier plan (of the same window, if given) has the same key."""
    keys = [KEY, *within]
    first = plans.groupBy(*keys).agg(F.min("ordinal").alias("_first"))
    return plans.join(first, keys).withColumn("cached", F.col("ordinal") > F.col("_first")).drop("_first")


def latest(store: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The last answer of each key of an append-only store; of answers at one time the greatest."""
    order = F.struct("assessed_at", *columns)
    return store.groupBy(KEY).agg(*[F.max_by(c, order).alias(c) for c in columns], F.max("assessed_at").alias("assessed_at"))


def answer_verdict(probabilities: Column, choice: Column, tolerance: Column) -> Column:
    """ok, or what is wrong with an answer: a probability out of range, their sum, or a choice that isn't the likeliest."""
    values = F.map_values(probabilities)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(F.exists(values, lambda x: F.isnan(x) | (x < 0) | (x > 1)), "range")
        .when(F.abs(total - 1) > tolerance, "sum")
        .when(F.element_at(probabilities, choice).isNull() | (F.element_at(probabilities, choice) < F.array_max(values)), "choice")
        .otherwise("ok")
    )


def windowed(plans: DataFrame, size: int) -> DataFrame:
    """Plans with window_id: `size` consecutive ordinals each, for dense ordinals from 0."""
    return plans.withColumn("window_id", F.floor(F.col("ordinal") / size))


def answer_problem(kind: Column, choice: Column, probabilities: Column, confidence: Column, labels: Column) -> Column:
    """ok, or what is wrong with an answer to a question of these labels: kind, labels, range, sum or choice.

    Probabilities may miss 1 by half a hundredth for each label where all of them are told to two decimals, else by
    a thousandth. The choice must be a likeliest label; NaN is out of range.
    """
    values = F.map_values(probabilities)
    chance = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    rounded = F.forall(values, lambda x: F.abs(x * 100 - F.round(x * 100)) < 1e-9)
    tolerance = F.when(rounded, 0.005 * F.size(values)).otherwise(0.001) + 1e-12
    own = F.try_element_at(probabilities, choice)
    same = F.array_sort(F.map_keys(probabilities)).eqNullSafe(F.array_sort(labels))
    return (
        F.when(F.coalesce(kind, F.lit("")) != "choice", "kind")
        .when(~same, "labels")
        .when(~F.forall(values, chance) | ~F.coalesce(chance(confidence), F.lit(False)), "range")
        .when(F.abs(total - 1) > tolerance, "sum")
        .when(own.isNull() | (own < F.array_max(values)), "choice")
        .otherwise("ok")
    )


def response_problem(model: Column, questions: Column, answered: Column, usage: Column) -> Column:
    """ok, or what is wrong with a response: no model, answers to other questions than those asked (lists of their
    names), or a usage (JSON text, null where there is none) that is no object."""
    asked = F.array_sort(questions).eqNullSafe(F.array_sort(answered)) & (F.size(F.array_distinct(answered)) == F.size(answered))
    return F.when(model.isNull() | (model == ""), "model").when(~asked, "questions").when(usage.isNotNull() & F.json_object_keys(usage).isNull(), "usage").otherwise("ok")
