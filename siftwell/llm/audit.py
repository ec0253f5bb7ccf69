"""Filter interaction audit: which filters overlap, in any order, with duplicates found by partition refinement."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, hash_runs, keyed, offsets_of, pieces, text_bytes, words, written

FILTERS = "ABCDE"
#: Fixed values of the filters' contract.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
_CAPITAL = np.isin(np.arange(256), range(65, 91))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: Code points of the first block; each later one reaches four times as far.
HEAD = 256


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[at])


def text_failures(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails; a null is empty."""
    data, at = text_bytes(column)
    starts, ends, counts = words(data, at)
    h = hash_runs(data, starts, ends)
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    distinct = np.bincount(of[fresh], minlength=len(counts))
    chars = _per_text((data & 0xC0) != 0x80, at)
    fails = [counts < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * counts, 100 * _per_text(_CAPITAL[data], at) > MOST_CAPITALS * chars, _per_text(_SYMBOL[data], at) > 0]
    return sum(x.astype(np.int32) << i for i, x in enumerate(fails))


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch, "text"):
            kept = [x for x in some.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(x)) for x in kept), pa.array(text_failures(some.column(some.schema.get_field_index("text"))), pa.int32())], names=[*kept, "fails"])


def _block(text: str, level: int) -> Column:
    """Hash of a text's block of a level: code points [0, 256), [256, 1024), [1024, 4096), ..."""
    lo = 0 if level == 0 else HEAD * 4 ** (level - 1)
    return F.xxhash64(F.substring(text, lo + 1, HEAD * 4**level - lo))


def later_copies(rows: DataFrame, narrow: DataFrame) -> tuple[DataFrame, list[str]]:
    """`ord` of each row whose text a row of smaller doc_id has, and the tables to discard after use.

    rows: (ord, doc_id, text), ord unique; narrow: (ord, doc_id, n_chars, head) of the same rows, head being the
    first block's hash. Parts start as the rows of one length and first block; the texts of what isn't alone are
    fetched once and hashed by further blocks, and each block splits the parts and drops those left with one
    row. What has survived all blocks is compared as whole texts: a part whose texts agree has one least id,
    and where they don't, each text has its own. Parts are counted and their least ids taken by partial
    aggregation, so that a text of any number of copies meets in a row a task.
    """
    spark, gone = rows.sparkSession, []
    shared = narrow.groupBy("n_chars", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n_chars", "head")
    alive = narrow.join(shared, ["n_chars", "head"], "left_semi").select("ord", "n_chars", F.xxhash64("n_chars", "head").alias("cell"))
    alive, path = written(alive, "audit-cells")
    gone.append(path)
    longest = alive.agg(F.max("n_chars")).first()[0] or 0
    levels = 1
    while HEAD * 4 ** (levels - 1) < longest:
        levels += 1
    texts, path = written(rows.join(alive.select("ord", "cell"), "ord", "left_semi").select("ord", "doc_id", "text", F.array(*[_block("text", i) for i in range(levels)]).alias("blocks")), "audit-texts")
    gone.append(path)
    alive = alive.join(texts.select("ord", "blocks"), "ord").select("ord", "cell", "blocks")
    for level in range(1, levels):
        finer = alive.withColumn("cell", F.xxhash64("cell", F.col("blocks")[level]))
        several = finer.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
        alive, path = written(finer.join(several, "cell", "left_semi").select("ord", "cell", "blocks"), "audit-cells")
        gone.append(path)
    whole = alive.select("ord", "cell").join(texts.select("ord", "doc_id", "text"), "ord")
    least, path = written(whole.groupBy("cell", "text").agg(F.min("doc_id").alias("least")), "audit-least")
    gone.append(path)
    cells = least.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"))
    agreed, split = cells.where("n = 1").select("cell", "least"), cells.where("n > 1").select("cell")
    members = alive.select("ord", "cell").join(texts.select("ord", "doc_id"), "ord")
    plain = members.join(agreed, "cell").where("doc_id > least").select("ord")
    mixed = whole.join(F.broadcast(split) if split.isEmpty() else split, "cell", "left_semi").join(least, ["cell", "text"]).where("doc_id > least").select("ord")
    found, path = written(plain.unionByName(mixed), "audit-copies")
    discard(spark, *gone)
    return found, [path]


def failures(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """(doc_id, part, fails) for every row, with the bits of the filters it fails; and the tables to discard after use.

    A null text is empty, a null part ''. Empty texts equal one another. Of repeated rows none fails for the
    other, as their ids are the same; a null id is neither smaller nor larger than another.
    """
    rows = keyed(docs, id_col, text_col, carry=True).select("ord", "doc_id", "text", F.coalesce(F.col("row")[part_col], F.lit("")).alias("part"))
    wide = rows.select("ord", "doc_id", "part", F.length("text").alias("n_chars"), _block("text", 0).alias("head"), "text")
    narrow, path = written(wide.mapInArrow(_failures, "ord long, doc_id long, part string, n_chars int, head long, fails int"), "audit-rows")
    copies, gone = later_copies(rows.select("ord", "doc_id", "text"), narrow)
    marked = narrow.join(copies.withColumn("copy", F.lit(1 << FILTERS.index("E"))), "ord", "left")
    return marked.select("doc_id", "part", F.col("fails").bitwiseOR(F.coalesce("copy", F.lit(0))).alias("fails")), [path, *gone]


def _sum(counts: str, keep) -> Column:
    """The sum of the counts at those masks for which keep(mask) holds; one expression."""
    return F.aggregate(F.transform(F.col(counts), lambda n, mask: F.when(keep(mask), n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x + y)


def interactions(found: DataFrame, labels: DataFrame) -> DataFrame:
    """What each order of the filters removes at each step, a row for each part, order and step.

    found: (doc_id, part, fails); labels: (doc_id, quality, toxic). A document labelled more than once counts
    as good or toxic once, where any label says so. Documents are counted by part and mask first (a mask being
    the set of filters failed, of 32), and the 120 orders are told from these counts alone, so no text or
    document is met again. Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. A table without rows gives none.
    """
    n = len(FILTERS)
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    by_mask = found.join(said, "doc_id", "left").groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("good", "toxic")])
    kinds = ("n", "good", "toxic")
    wide = by_mask.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("fails") == m, F.col(x))), F.lit(0)) for m in range(1 << n)]).alias(x) for x in kinds])
    steps = [(order, i + 1, sum(1 << FILTERS.index(x) for x in order[:i]), 1 << FILTERS.index(order[i])) for order in map("".join, permutations(FILTERS)) for i in range(n)]
    every = wide.withColumn("s", F.explode(F.from_json(F.lit(str([{"o": o, "i": i, "b": b, "f": f} for o, i, b, f in steps]).replace("'", '"')), "array<struct<o:string,i:int,b:int,f:int>>")))
    before, own = F.col("s.b"), F.col("s.f")
    here = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    told = every.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.i").alias("step"), own.alias("own"),
        _sum("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        _sum("n", here).alias("removed"),
        _sum("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        _sum("n", lambda m: m == own).alias("unique_fails"),
        _sum("good", here).alias("good_lost"), _sum("toxic", here).alias("toxic_lost"),
    )
    return told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """interactions() of failures(): a report small enough to be written and read again, so nothing else stays behind."""
    found, gone = failures(docs, part_col, id_col, text_col)
    report, _ = written(interactions(found, labels.select("doc_id", "quality", "toxic")), "audit-report")
    discard(docs.sparkSession, *gone)
    return report
