"""Declarative field rules: the offline evaluator that Catalyst plans whole.

A rule gives a field's chance of being an anomaly as a CASE over the row, so scoring is part of the scan's
generated code: nothing is shuffled or sent to Python, and the fields of an entry stay together in its row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMAL, ANOMALY = "NORMAL", "ANOMALY"


@dataclass(frozen=True)
class Rule:
    """Field `path`, whose text is the SQL expression `value`, is anomalous where `when` holds."""

    path: str
    value: str
    when: str
    high: float = 0.9
    low: float = 0.1
    confidence: float = 0.8

    def chance(self) -> Column:
        """The score of this field: a literal of two, by the condition."""
        return F.when(F.expr(self.when), F.lit(self.high)).otherwise(F.lit(self.low))

    def struct(self) -> Column:
        """path, value, label, confidence, score of this field."""
        score = self.chance()
        return F.struct(
            F.lit(self.path).alias("path"),
            F.expr(f"CAST({self.value} AS STRING)").alias("value"),
            F.when(score >= 0.5, ANOMALY).otherwise(NORMAL).alias("label"),
            F.lit(self.confidence).alias("confidence"),
            score.alias("score"),
        )


def assess(table: DataFrame, entry_id: str, rules: Sequence[Rule], threshold: float = 0.5) -> DataFrame:
    """A row (id, fields, label, confidence, score, warning) for each row of table.

    Fields stand in code-point order of their paths; the entry has label, confidence and score of the field
    of greatest score, the first path winning ties.
    """
    ordered = sorted(rules, key=lambda r: r.path)
    fields = F.array(*[r.struct() for r in ordered]).alias("fields")
    if not ordered:
        raise ValueError("an assessment needs a rule")
    # the verdict is made of the conditions themselves, so that a filter on it runs before any field is built
    scores = [r.chance() for r in ordered]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    confidence = F.coalesce(*[F.when(x == best, F.lit(r.confidence)) for x, r in zip(scores, ordered, strict=True)])
    label = F.when(best >= 0.5, ANOMALY).otherwise(NORMAL)
    return table.select(F.expr(entry_id).alias("id"), fields, label.alias("label"), confidence.alias("confidence"), best.alias("score"), (best >= threshold).alias("warning"))


def rolled_up(entries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """entries with label, confidence, score and warning of its fields column, within the row."""
    best = F.array_min(F.transform("fields", lambda f: F.struct((-f["score"]).alias("k"), f["path"].alias("path"), f["label"].alias("label"), f["confidence"].alias("confidence"), f["score"].alias("score"))))
    chosen = entries.withColumn("_best", best)
    kept = [c for c in entries.columns if c not in ("label", "confidence", "score", "warning")]
    return chosen.select(*kept, "_best.label", "_best.confidence", "_best.score", (F.col("_best.score") >= threshold).alias("warning"))


def field_rows(entries: DataFrame) -> DataFrame:
    """A row for each field, with its entry's verdict as entry_* columns."""
    parent = [F.col(x).alias(f"entry_{x}") for x in ("label", "confidence", "score", "warning") if x in entries.columns]
    kept = [x for x in entries.columns if x not in ("fields", "label", "confidence", "score", "warning")]
    return entries.select(*kept, *parent, F.explode("fields").alias("_f")).select(*kept, *[f"entry_{x}" for x in ("label", "confidence", "score", "warning") if x in entries.columns], "_f.*")


def roll_up_rows(fields: DataFrame, keys: Sequence[str] = ("id",), threshold: float = 0.5) -> DataFrame:
    """The same roll-up where fields come as rows of their own: one aggregation, combined before the shuffle."""
    order = F.struct((-F.col("score")).alias("k"), F.col("path"))
    best = fields.groupBy(*keys).agg(F.min_by(F.struct("label", "confidence", "score"), order).alias("_best"))
    return best.select(*keys, "_best.*", (F.col("_best.score") >= threshold).alias("warning"))


def rule_sql(table: str, entry_id: str, rules: Sequence[Rule]) -> str:
    """The field rows of the rules as ANSI SQL: (id, path, value, label, confidence, score)."""
    parts = []
    for r in rules:
        score = f"CASE WHEN {r.when} THEN CAST({r.high} AS DOUBLE) ELSE CAST({r.low} AS DOUBLE) END"
        parts.append(f"SELECT {entry_id} AS id, '{r.path}' AS path, CAST({r.value} AS VARCHAR) AS value, CASE WHEN {score} >= 0.5 THEN 'ANOMALY' ELSE 'NORMAL' END AS label, CAST({r.confidence} AS DOUBLE) AS confidence, {score} AS score FROM {table}")
    return " UNION ALL ".join(parts)
