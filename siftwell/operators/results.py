"""What becomes of saved reports: metrics against people's labels, and tables for people to read."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import metrics


def judged(fields: DataFrame, gold: DataFrame, outcome: str = "/answer_text") -> DataFrame:
    """Field rows (id, path, label, ...) joined with gold (id, path, domain, gold): a case for each field, with kind
    outcome or step and the label as predicted. A field or a label without the other fails the job."""
    rest = [c for c in ("probabilities", "confidence", "request_hash") if c in fields.columns]
    both = fields.select("id", "path", F.col("label").alias("predicted"), *rest).join(gold.select("id", "path", "domain", "gold"), ["id", "path"], "full")
    alone = F.col("gold").isNull() | F.col("predicted").isNull()
    checked = both.where(F.when(alone, F.raise_error(F.concat(F.lit("not in both report and labels: "), F.col("id"), F.lit(" "), F.col("path")))).otherwise(F.lit(True)))
    return checked.select("id", "domain", F.when(F.col("path") == outcome, "outcome").otherwise("step").alias("kind"), "path", "gold", "predicted", *rest)


def agreement(cases: DataFrame, kinds: Sequence[str], negative: str) -> DataFrame:
    """Metrics of each kind of case, by domain and (domain null) over all, with confusion: a row of counts by
    prediction for each label of gold."""
    counts = F.array(*[F.array(*[F.count_if((F.col("gold") == g) & (F.col("predicted") == p)) for p in kinds]) for g in kinds])
    return metrics(cases, "gold", "predicted", kinds, negative, by=["kind", "domain"], more=[counts.alias("confusion")]).where(F.col("kind").isNotNull())


def write_evaluation(cases: DataFrame, kinds: Sequence[str], negative: str, path: str) -> None:
    """path/metrics: agreement() as JSON rows; path/fields: all cases as JSON rows, by Spark's writers."""
    agreement(cases, kinds, negative).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")  # a row for each kind and domain
    cases.write.mode("overwrite").json(f"{path}/fields")


def name_of(path: str = "/ident") -> Column:
    """An entry's id, with the text of its field `path` behind it if it has one."""
    value = F.get(F.filter("fields", lambda f: f["path"] == path), F.lit(0))["value"]
    return F.concat_ws(" · ", F.col("id"), F.when(value != "", value))


def entry_table(report: DataFrame, named: str = "/ident") -> DataFrame:
    """Every entry: entry, label, score, warning (Yes or No)."""
    return report.select(name_of(named).alias("entry"), "label", F.round("score", 2).alias("score"), F.when(F.col("warning"), "Yes").otherwise("No").alias("warning"))


def flagged_table(report: DataFrame, threshold: float = 0.5, named: str = "/ident") -> DataFrame:
    """Fields whose score reaches the threshold: entry, field, value, score. Entries without any are left out
    before their fields are taken apart."""
    some = report.where(F.exists("fields", lambda f: f["score"] >= threshold))
    fields = some.select(name_of(named).alias("entry"), F.explode(F.filter("fields", lambda f: f["score"] >= threshold)).alias("f"))
    return fields.select("entry", F.col("f.path").alias("field"), F.col("f.value").alias("value"), F.round("f.score", 2).alias("score"))


def first_warning(report: DataFrame, order: str = "id") -> DataFrame:
    """The first entry with a warning, whole: at most one row."""
    return report.where("warning").orderBy(order).limit(1)


def write_tables(report: DataFrame, path: str, order: str = "id", summary: str = "", threshold: float = 0.5, named: str = "/ident") -> None:
    """A Markdown page of a report: its models and days, the summary, and the three tables above, in order.

    Rows are written as they come, a partition at a time; nothing else stays in the driver.
    """
    head = report.agg(F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set(F.substring(F.col("assessed_at").cast("string"), 1, 10))).alias("days")).first()
    cell = lambda x: str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    sorted_ = report.orderBy(order)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"Model: **{', '.join(head['models'])}**; assessed on **{', '.join(head['days'])}**.\n\n")
        if summary:
            f.write(f"```text\n{summary.strip()}\n```\n\n")
        f.write("| Entry | Label | Score | Warning |\n| --- | --- | ---: | --- |\n")
        for r in entry_table(sorted_, named).toLocalIterator():
            f.write(f"| {cell(r['entry'])} | {cell(r['label'])} | {r['score']:.2f} | {r['warning']} |\n")
        f.write(f"\nFields with a score of {threshold} or more:\n\n| Entry | Field | Value | Score |\n| --- | --- | --- | ---: |\n")
        for r in flagged_table(sorted_, threshold, named).toLocalIterator():
            f.write(f"| {cell(r['entry'])} | `{cell(r['field'])}` | `{cell(r['value'])}` | {r['score']:.2f} |\n")
        for r in first_warning(report, order).toJSON().collect():
            f.write(f"\nOne whole entry with a warning:\n\n```json\n{json.dumps(json.loads(r), indent=2, ensure_ascii=False)}\n```\n")
