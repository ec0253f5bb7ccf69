"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

A text is the multiset of its words (lower case), a word's weight being its count. For sample k and term x
the hash of (x, k) gives r and c, both gamma(2, 1), and b, uniform. With weight w, t = floor(ln w / r + b)
and ln a = ln c - r (t - b + 1); the term of least a is the sample, and two texts share it with the
probability of their generalised Jaccard similarity (sum of least over sum of greatest weights). Because a
follows from (x, t, k) alone, the least a itself stands for the sample.

The text moves in one exchange, by ranges of doc_id with each range's successor; all the rest, the term
counts included, happens in the partitions that this makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread

#: ln a of a text without words: no term gives it.
_EMPTY = 1e300


def log_a(term: Column, log_weight: Column, k: int) -> Column:
    """The rank of a term (a 64-bit hash) of a log weight in sample k: the text's least one is its sample."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    low21 = lambda x: (x.bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) / (1 << 21)
    r = -F.ln(low21(one) * low21(F.shiftrightunsigned(one, 21)))
    b = low21(F.shiftrightunsigned(one, 42))
    c = -F.ln((two.bitwiseAND(F.lit((1 << 32) - 1)).cast("double") + 0.5) * (F.shiftrightunsigned(two, 32).cast("double") + 0.5) / float(1 << 64))
    t = F.floor(log_weight / r + b).cast("double")
    return F.ln(c) - r * (t - b + 1)


def with_next(docs: DataFrame, rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, place, doc_id, text, next_text, ghost): each text with that of the next doc_id, the last with the first.

    Rows of a part stand in order of (doc_id, text), nulls first, at place 1, 2, ...; a ghost is the first
    row of the following part, shown once more at this part's end.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part, _ = spread(plain, "doc_id", rows)
    dealt = plain.withColumn("part", part)
    # at most one row for each part, and parts are bounded: small enough to broadcast
    first = dealt.groupBy("part").agg(F.min(F.struct("doc_id")).alias("first"))
    everywhere = Window.orderBy("part")
    after = first.select(F.col("part").alias("to"), F.coalesce(F.lead("first").over(everywhere), F.first("first").over(everywhere))["doc_id"].alias("id"))
    ghosts = dealt.join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", F.col("to").alias("part"), F.lit(True).alias("ghost"))
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    both = dealt.select("doc_id", "text", "part", F.lit(False).alias("ghost")).unionByName(ghosts)
    return both.withColumns({"place": F.row_number().over(order), "next_text": F.lead("text").over(order)})


def fingerprints(docs: DataFrame, samples: int = 32, rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, a row for each row of docs.

    The edited text has the last half (rounded down) of the code points replaced by as many from the start
    of the next document's text. A null text is empty; a text without words has a fingerprint that only
    such texts share; equal texts have equal fingerprints. Repeated rows each give a row; ids may be null.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (8 hex digits a sample),
    near_edited, near_next (part of the samples shared).
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows_ = with_next(docs, rows, id_col, text_col).withColumn("edited", F.when(~F.col("ghost"), F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))))
    keys = ["part", "place"]
    sides = rows_.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("s")).select(*keys, "s.side", "s.t")
    terms = sides.where("t is not null").select(*keys, "side", F.explode(F.split(F.lower("t"), r"[\x09-\x0D\x20]+")).alias("word")).where("word != ''")
    # only numbers are kept for each term, so that both aggregations stay hash aggregations
    counted = terms.groupBy(*keys, "side", F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    weighed = counted.select(*keys, "side", "term", F.ln("n").alias("log_n"))
    signed = weighed.groupBy(*keys, "side").agg(*[F.min(log_a(F.col("term"), F.col("log_n"), k)).alias(f"a{k}") for k in range(samples)])
    signed = signed.select(*keys, "side", F.array(*[F.col(f"a{k}") for k in range(samples)]).alias("a"))
    # from here on a row has numbers for each text, no terms: joining them moves little
    info = rows_.select(*keys, "doc_id", "ghost", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("sha"))
    both = signed.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == side, F.col("a"))).alias(name) for side, name in ((0, "a"), (1, "e"))])
    paired = info.join(both, keys, "left")
    none = F.array(*[F.lit(_EMPTY)] * samples)
    paired = paired.withColumns({x: F.coalesce(F.col(x), none) for x in "ae"})
    final = paired.withColumn("next_a", F.lead("a").over(Window.partitionBy("part").orderBy("place")))
    near = lambda x, y: sum(((F.get(F.col(x), F.lit(k)) == F.get(F.col(y), F.lit(k))).cast("int") for k in range(samples)), F.lit(0)) / float(samples)
    text = lambda x: F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.get(F.col(x), F.lit(k))).bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0") for k in range(samples)])
    return final.where(~F.col("ghost")).select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), text("a").alias("fingerprint"), text("e").alias("edited_fingerprint"), near("a", "e").alias("near_edited"), near("a", "next_a").alias("near_next"))
