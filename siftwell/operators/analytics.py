"""Agreement metrics, comparisons, samples and shortlists over assessed rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .packing import ranked


def confusion(rows: DataFrame, gold: str, pred: str, kinds: Sequence[str]) -> DataFrame:
    """(gold, one column of counts for each kind of prediction): a row for each kind, zeros included."""
    counts = rows.where(F.col(gold).isin([*kinds])).agg(*[F.count_if((F.col(gold) == g) & (F.col(pred) == p)).alias(f"{i} {j}") for i, g in enumerate(kinds) for j, p in enumerate(kinds)])
    one = [F.struct(F.lit(g).alias("gold"), *[F.col(f"{i} {j}").alias(p) for j, p in enumerate(kinds)]) for i, g in enumerate(kinds)]
    return counts.select(F.explode(F.array(*one)).alias("r")).select("r.*")


def metrics(rows: DataFrame, gold: str, pred: str, kinds: Sequence[str], negative: str, by: str | Sequence[str] | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """n, accuracy, majority (share of the commonest gold kind), precision and recall of `negative`.

    With by, a row for each of its values and one (null) for all, from one pass, and so on for several columns
    from the last; a ratio without a denominator is null. `more` are further aggregates of the same pass.
    """
    g, p = F.col(gold), F.col(pred)
    both = F.count_if((g == negative) & (p == negative))
    columns = [
        F.count(F.lit(1)).alias("n"),
        F.avg((g == p).cast("double")).alias("accuracy"),
        (F.greatest(*[F.count_if(g == k) for k in kinds]) / F.count(F.lit(1))).alias("majority"),
        F.try_divide(both, F.count_if(p == negative)).alias("precision"),
        F.try_divide(both, F.count_if(g == negative)).alias("recall"),
        *more,
    ]
    return rows.agg(*columns) if by is None else rows.rollup(*([by] if isinstance(by, str) else by)).agg(*columns)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """How field rows (id, path, label, score, confidence) of two modes differ."""
    both = a.alias("a").join(b.alias("b"), ["id", "path"])
    delta = lambda x: F.max(F.abs(F.col(f"a.{x}") - F.col(f"b.{x}")))
    return both.agg(F.count(F.lit(1)).alias("fields"), F.count_if(F.col("a.label") != F.col("b.label")).alias("label_changes"), delta("score").alias("max_score_delta"), delta("confidence").alias("max_confidence_delta"))


def salted_hash(salt: str, columns: Sequence[str]):
    return F.sha2(F.concat_ws(":", F.lit(salt), *[F.col(c).cast("string") for c in columns]), 256)


def hash_sample(rows: DataFrame, salt: str, columns: Sequence[str], n: int) -> DataFrame:
    """The n rows whose salted hash h comes first: the same rows whatever the partitioning."""
    return rows.withColumn("h", salted_hash(salt, columns)).orderBy("h").limit(n)


def stratified(rows: DataFrame, strata: Sequence[str], salt: str, columns: Sequence[str], n: int) -> DataFrame:
    """The first n rows by salted hash of each stratum, with their place k in it."""
    window = Window.partitionBy(*strata).orderBy(salted_hash(salt, columns))
    return rows.withColumn("k", F.row_number().over(window).cast("long")).where(F.col("k") <= n)


def interleaved(rows: DataFrame, place: str, order: Sequence[str]) -> DataFrame:
    """rows with place: first all first ones, then all second ones, and so on."""
    return ranked(rows, place, *order).withColumn("place", F.col("place") + 1)


def alternating(rows: DataFrame, domain: str, label: str, query: str, salt: str, columns: Sequence[str], labels: Sequence) -> DataFrame:
    """For each domain a row for each of labels in turn: the first by salted hash that has the label and a query that
    no earlier one has. Columns step (from 1) and h are added; a step that finds no row is left out.

    Of n labels no row counts but the first of the n first queries of its label, so what a domain's fold gets is at
    most n rows a label, whatever the table's size; the first row of a query is a partial aggregation.
    """
    n, kinds = len(labels), [*dict.fromkeys(labels)]
    hashed = rows.where(F.col(label).isin(kinds)).withColumn("h", salted_hash(salt, columns))
    first = hashed.groupBy(domain, label, query).agg(F.min_by(F.struct(*hashed.columns), "h").alias("_row"))
    nth = F.row_number().over(Window.partitionBy(domain, label).orderBy("_row.h"))
    few = first.withColumn("_k", nth).where(F.col("_k") <= n).select("_row.*")

    def fold(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("h", kind="stable")
        used: set = set()
        picked: list[int] = []
        steps: list[int] = []
        for step, wanted in enumerate(labels, 1):
            for i in np.flatnonzero((found[label] == wanted).to_numpy()):
                if found[query].iloc[i] not in used:
                    used.add(found[query].iloc[i])
                    picked.append(int(i))
                    steps.append(step)
                    break
        return found.iloc[picked].assign(step=np.array(steps, dtype=np.int64))

    schema = T.StructType([*few.schema, T.StructField("step", T.LongType())])
    return few.groupBy(domain).applyInPandas(fold, schema)


def planned(rows: DataFrame) -> DataFrame:
    """What a preview's rows (request_hash, layout, estimated_tokens) come to: planned_requests,
    estimated_input_tokens, layouts."""
    return rows.agg(F.count(F.lit(1)).alias("planned_requests"), F.sum("estimated_tokens").alias("estimated_input_tokens"), F.array_sort(F.collect_set("layout")).alias("layouts"))


def shortlist(rows: DataFrame, top: int, threshold: float, ordinal: str) -> DataFrame:
    """The `top` rows of greatest score at or above threshold, ties by ordinal, with rank and how many match.

    A score that is null, not finite or out of 0..1 fails the whole list. The count is a separate aggregate,
    so that the list itself is a bounded top-k in every task.
    """
    bad = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)
    checked = rows.where(F.when(bad, F.raise_error(F.lit("a score must lie in 0..1"))).otherwise(F.col("score") >= threshold))
    best = checked.orderBy(F.desc("score"), ordinal).limit(top)
    numbered = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), ordinal)).cast("long"))
    return numbered.withColumn("matching", checked.agg(F.count(F.lit(1))).scalar())
