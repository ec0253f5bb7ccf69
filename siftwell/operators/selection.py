"""Which fields of an entry are assessed, and which entries are skipped for want of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import pointer_tokens
from ..functions.columns import is_present


class SelectionError(ValueError):
    """A selection that contradicts itself, or that no entry can meet."""


@dataclass(frozen=True)
class Selection:
    """Required pointers, of which an entry must have all, and optional ones."""

    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    @classmethod
    def of(cls, required: Sequence[str] = (), optional: Sequence[str] = (), relaxed: bool = False) -> Selection:
        if relaxed and not (required or optional):
            raise SelectionError("relaxed needs a selection of fields")
        for x in (*required, *optional):
            pointer_tokens(x)
        if len({*required}) < len(required) or len({*optional}) < len(optional):
            raise SelectionError("a field is selected twice")
        if {*required} & {*optional}:
            raise SelectionError("a field can't be both required and optional")
        return cls((), (*required, *optional)) if relaxed else cls(tuple(required), tuple(optional))

    @property
    def all(self) -> tuple[str, ...]:
        return (*self.required, *self.optional)

    def narrow(self, entries: DataFrame, entry: str = "entry") -> DataFrame:
        """entries with keep (selected pointers present), absent (the others) and blocking (why it's skipped).

        An entry is assessed where blocking is empty: all required pointers are there, and any pointer is.
        """
        held = {p: is_present(F.col(entry), p) for p in self.all}
        some = lambda paths, there: F.array_compact(F.array(*[F.when(held[p] if there else ~held[p], F.lit(p)) for p in paths])) if paths else F.array().cast("array<string>")
        out = entries.withColumns({"keep": F.array_sort(some(self.all, True)), "absent": some(self.all, False)})
        none = F.size("keep") == 0
        return out.withColumn("blocking", F.when(none, F.col("absent")).otherwise(some(self.required, False)))

    def apply(self, entries: DataFrame, entry: str = "entry") -> DataFrame:
        return self.narrow(entries, entry).where(F.size("blocking") == 0)

    def verify(self, entries: DataFrame, entry: str = "entry") -> None:
        """One aggregate: every pointer occurs somewhere, and some entry is left; no entries at all is no error."""
        counts = [F.count_if(is_present(F.col(entry), p)).alias(f"p{i}") for i, p in enumerate(self.all)]
        row = self.narrow(entries, entry).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("blocking") == 0).alias("kept"), *counts).first()
        if not row["n"]:
            return
        missing = [p for i, p in enumerate(self.all) if not row[f"p{i}"]]
        if missing:
            raise SelectionError("Field does not exist: " + ", ".join(missing))
        if not row["kept"]:
            raise SelectionError("no entry has all the required fields together")


def skip_causes(narrowed: DataFrame) -> DataFrame:
    """(cause, entries), the most common first."""
    causes = narrowed.where(F.size("blocking") > 0).select(F.explode("blocking").alias("cause"))
    return causes.groupBy("cause").agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("entries"), "cause")


def duplicates(entries: DataFrame, key: str | Column = "id") -> DataFrame:
    """(id, entries) of the ids that occur more than once."""
    return entries.groupBy(F.col(key).alias("id") if isinstance(key, str) else key.alias("id")).agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")
