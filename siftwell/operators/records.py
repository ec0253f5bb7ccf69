"""Records of lines over ranges of a text: line numbers, and to which record each line belongs, for any cut.

A text comes as ranges, of a file or of a column. Within a range, lines are numbered and given to the last line
that opens a record by a window over that range alone. What a range passes on is a row: how many lines it has, the
last of them that opens a record, and a flag of its last line. These rows are put together in order, so that each
range knows what is open before it. No task sees more than a range's lines, or the summaries of one text's ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that makes a line blank.
BLANK = r"(?U)^[\s\x1c-\x1f]*$"
_EDGES = r"(?U)^\s+|\s+$"
ENTRY = ("id", "source", "entry_json", "fields")


def cut(rows: DataFrame, source: str, text: str, size: int) -> DataFrame:
    """(source, piece, text): each text of a column in pieces of `size` code points, wherever a line may end."""
    # one pass over a text: a substring for each piece would count from the text's beginning each time
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return rows.select(F.col(source).alias("source"), F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array(F.col(text)))).alias("piece", "text"))


def _earlier(rows: DataFrame) -> Window:
    return Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)


def piece_lines(pieces: DataFrame) -> DataFrame:
    """(source, piece, line_no, line) of (source, piece, text), whose pieces may be cut within lines.

    The number of a piece's first line is the number of line ends before it. Only the first and last parts of a
    piece can belong to a line that another piece has a share of, so only these are put together; a line belongs
    to the piece that it begins in. A last line without an end counts unless it's empty.
    """
    split = pieces.select("source", "piece", F.split("text", "\n").alias("_l"))
    before = split.groupBy("source", "piece").agg((F.max(F.size("_l")) - 1).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("source"))
    before = before.select("source", "piece", F.coalesce(F.sum("_n").over(_earlier(before)), F.lit(0)).alias("_before"), (total + 1).alias("_last"))
    placed = split.join(before, ["source", "piece"]).select("source", "piece", "_before", "_last", F.size("_l").alias("_k"), F.posexplode("_l").alias("_i", "line"))
    placed = placed.withColumn("line_no", F.col("_before") + F.col("_i") + 1)
    inner = (F.col("_i") > 0) & (F.col("_i") < F.col("_k") - 1)
    whole = placed.where(inner).select("source", "piece", "line_no", "line")
    shared = placed.where(~inner).groupBy("source", "line_no").agg(F.array_sort(F.collect_list(F.struct("piece", "line"))).alias("_p"), F.max("_last").alias("_last"))
    # a line counts to the first piece that has a share of it, be it empty, so numbers rise with pieces
    joined = shared.select("source", F.get("_p", 0)["piece"].alias("piece"), "line_no", F.array_join(F.transform("_p", lambda p: p["line"]), "").alias("line"), "_last")
    ended = joined.where((F.col("line_no") < F.col("_last")) | (F.col("line") != "")).drop("_last")
    return whole.unionByName(ended)


def file_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(source, piece, line_no, line) of text files in UTF-8, plain or compressed, in any store Spark reads.

    Spark cuts files into blocks and gives each line to the block that it begins in; lines are counted within a
    block, and blocks' counts give the number of each one's first line. A byte order mark isn't part of a line.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    counts = raw.groupBy("source", "piece").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("source", "piece", F.coalesce(F.sum("_n").over(_earlier(counts)), F.lit(0)).alias("_before"))
    numbered = raw.withColumn("_k", F.row_number().over(Window.partitionBy("source", "piece").orderBy("_at"))).join(before, ["source", "piece"])
    first = F.when(F.col("_before") + F.col("_k") == 1, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))
    return numbered.select("source", "piece", (F.col("_before") + F.col("_k")).alias("line_no"), first.alias("line"))


def follows(lines: DataFrame, flag: Column, name: str) -> DataFrame:
    """lines with `name`: the flag of the line before, in the same text; null for a text's first line."""
    told = lines.withColumn("_f", flag)
    last = told.groupBy("source", "piece").agg(F.max_by("_f", "line_no").alias("_last"))
    carried = last.select("source", "piece", F.last("_last", ignorenulls=True).over(_earlier(last)).alias("_carried"))
    own = F.lag("_f").over(Window.partitionBy("source", "piece").orderBy("line_no"))
    return told.withColumn("_own", own).join(carried, ["source", "piece"], "left").select(*lines.columns, F.coalesce("_own", "_carried").alias(name))


def carried(lines: DataFrame, opens: Column, name: str = "start") -> DataFrame:
    """lines with `name`: the number of the last line, this one or before it, that opens a record; null before the first."""
    told = lines.withColumn("_o", F.when(opens, F.col("line_no")))
    last = told.groupBy("source", "piece").agg(F.max("_o").alias("_last"))
    before = last.select("source", "piece", F.max("_last").over(_earlier(last)).alias("_before"))
    own = F.max("_o").over(Window.partitionBy("source", "piece").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return told.withColumn("_own", own).join(before, ["source", "piece"], "left").select(*lines.columns, F.coalesce("_own", "_before").alias(name))


def grouped(lines: DataFrame, *more: str) -> DataFrame:
    """(source, start, lines): a record for each start, with its (line_no, line, ...) in order; a record is one row."""
    return lines.where("start IS NOT NULL").groupBy("source", "start").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", *more))).alias("lines"))


def _fail(where: Column, what: str) -> Column:
    return F.raise_error(F.concat(where, F.lit(f": {what}")))


def _place(line: str = "line_no") -> Column:
    return F.concat_ws(":", F.col("source"), F.col(line).cast("string"))


def _quoted(text: Column) -> Column:
    found = F.to_json(F.array(text))
    return F.substring(found, F.lit(2), F.length(found) - 2)


def text_entries(lines: DataFrame, split: str = "paragraphs") -> DataFrame:
    """(id, source, entry_json, fields) of lines or of blocks between blank lines; entries hold `text`.

    Lines keep what stands before their line end; lines should come from file_lines(..., line_sep="\\n"), so that a
    carriage return within a block stays.
    """
    blank = F.col("line").rlike(BLANK)
    if split == "lines":
        found = lines.where(~blank).select("source", F.col("line_no").alias("start"), F.col("line").alias("text"))
    else:
        opened = carried(follows(lines, blank, "_gap"), ~blank & F.coalesce("_gap", F.lit(True)))
        blocks = grouped(opened.where(~blank))
        found = blocks.select("source", "start", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    text = F.regexp_replace("text", r"[\r\n]+$", "")
    return found.select(F.col("start").cast("string").alias("id"), _place("start").alias("source"), F.concat(F.lit('{"text":'), _quoted(text), F.lit("}")).alias("entry_json"), F.array(F.lit("/text")).alias("fields"))


def fasta_entries(lines: DataFrame) -> DataFrame:
    """(id, source, entry_json, fields) of sequences under > headers: id, description, sequence without white space."""
    told = lines.withColumn("line", F.regexp_replace("line", _EDGES, ""))
    head = F.startswith("line", F.lit(">"))
    placed = carried(told, head).where("line <> ''")
    lost = F.when(F.col("start").isNull(), _fail(_place(), "a sequence stands before the first header")).otherwise(F.lit(True))
    found = grouped(placed.where(lost))
    about = F.regexp_replace(F.substring(F.get("lines", 0)["line"], 2, 1 << 30), _EDGES, "")
    rest = F.array_join(F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: x["line"]), "")
    parts = F.array(F.regexp_extract(about, r"(?U)^\S+", 0), F.regexp_replace(about, r"(?U)^\S+\s*", ""))
    rows = found.select("source", "start", parts.alias("h"), F.regexp_replace(rest, r"(?U)\s+", "").alias("sequence"))
    where = _place("start")
    name = F.when(F.get("h", 0) == "", _fail(where, "a header names nothing")).when(F.col("sequence") == "", _fail(where, "a header has no sequence")).otherwise(F.get("h", 0))
    data = F.to_json(F.struct(F.get("h", 1).alias("description"), name.alias("id"), F.col("sequence").alias("sequence")))
    return rows.select(name.alias("id"), where.alias("source"), data.alias("entry_json"), F.array(*[F.lit(f"/{x}") for x in ("id", "description", "sequence")]).alias("fields"))


def gmt_entries(lines: DataFrame) -> DataFrame:
    """(id, source, entry_json, fields) of named sets: name, description and members between tabs."""
    rows = lines.where(~F.col("line").rlike(BLANK)).select("source", "line_no", F.split(F.regexp_replace("line", r"[\r\n]+$", ""), "\t").alias("c"))
    members = F.slice("c", F.lit(3), F.greatest(F.size("c") - 2, F.lit(0)))
    good = (F.size("c") >= 3) & (F.get("c", 0) != "") & ~F.exists(members, lambda x: x == "")
    name = F.when(good, F.get("c", 0)).otherwise(_fail(_place(), "a set is a name, a description and members"))
    data = F.to_json(F.struct(F.get("c", 1).alias("description"), members.alias("members"), name.alias("name")))
    return rows.select(name.alias("id"), _place().alias("source"), data.alias("entry_json"), F.array(*[F.lit(f"/{x}") for x in ("name", "description", "members")]).alias("fields"))


def joined_lines(lines: DataFrame) -> DataFrame:
    """Lines of which those that end in an odd number of backslashes go on in the next; a line has its first one's number."""
    slashes = F.length(F.regexp_extract("line", r"(\\*)$", 1))
    more = slashes % 2 == 1
    placed = carried(follows(lines, more, "_more"), ~F.coalesce("_more", F.lit(False)))
    part = placed.withColumn("_open", more).withColumn("line", F.when(F.col("_open"), F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line")))
    found = grouped(part.select("source", "piece", "line_no", "line", "_open", "start"), "_open", "piece")
    end = F.element_at("lines", -1)["_open"]
    text = F.when(end, _fail(_place("start"), "the last line goes on, but nothing follows")).otherwise(F.array_join(F.transform("lines", lambda x: x["line"]), ""))
    return found.select("source", F.get("lines", 0)["piece"].alias("piece"), F.col("start").alias("line_no"), text.alias("line"))


def obo_entries(lines: DataFrame, stanza: str = "") -> DataFrame:
    """(id, source, entry_json, fields) of stanzas: every tag is a list of its values in order, each of them a field."""
    told = joined_lines(lines).withColumn("line", F.regexp_replace("line", _EDGES, ""))
    told = told.where((F.col("line") != "") & ~F.startswith("line", F.lit("!")))
    head = F.startswith("line", F.lit("["))
    kind = F.regexp_extract("line", r"^\[\s*([^\[\]]*?)\s*\]\s*(?:!.*)?$", 1)
    tag = F.regexp_replace(F.regexp_extract("line", r"^([^:]*):", 1), _EDGES, "")
    value = F.regexp_replace(F.regexp_replace("line", r"^[^:]*:", ""), _EDGES, "")
    wrong = F.when(head & (kind == ""), _fail(_place(), "a stanza's header is malformed")).when(~head & F.col("start").isNotNull() & ((tag == "") | (tag == "_stanza")), _fail(_place(), "a line is no tag with a value")).otherwise(F.lit(True))
    placed = carried(told, head).where(wrong).withColumn("kind", F.when(head, kind)).withColumn("tag", tag).withColumn("value", value)
    found = grouped(placed, "kind", "tag", "value").withColumn("kind", F.get("lines", 0)["kind"])
    if stanza:
        found = found.where(F.col("kind") == stanza)
    rows = found.withColumn("rest", F.slice("lines", F.lit(2), F.size("lines"))).withColumn("tags", F.array_distinct(F.transform("rest", lambda x: x["tag"])))
    values = lambda t: F.transform(F.filter("rest", lambda x: x["tag"] == t), lambda x: x["value"])
    pair = lambda k, v: F.struct(k.alias("k"), F.concat(_quoted(k), F.lit(":"), v).alias("v"))
    pairs = F.array_sort(F.concat(F.array(pair(F.lit("_stanza"), _quoted(F.col("kind")))), F.transform("tags", lambda t: pair(t, F.to_json(values(t))))))
    escaped = lambda t: F.replace(F.replace(t, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    own = F.flatten(F.transform("tags", lambda t: F.transform(F.sequence(F.lit(0), F.size(values(t)) - 1), lambda i: F.concat(F.lit("/"), escaped(t), F.lit("/"), i.cast("string")))))
    name = F.get(values(F.lit("id")), 0)
    return rows.select(F.coalesce(F.when(name != "", name), F.concat(F.lit("stanza:"), F.col("start").cast("string"))).alias("id"), _place("start").alias("source"), F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["v"]), ","), F.lit("}")).alias("entry_json"), F.when(F.size("tags") > 0, own).otherwise(F.array(F.lit("/_stanza"))).alias("fields"))
