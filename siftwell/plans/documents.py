"""Queries of records by ranges, and of entries out of JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fanout, records
from .registry import query, table

#: Pieces that texts are cut into, so that a line and a record span several.
PIECE = 97


def _lines_sql(name: str, key: str, text: str) -> str:
    return f"WITH a AS (SELECT {key} AS id, string_split({text}, chr(10)) AS l FROM {name}), n AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n, len(l) AS k FROM a), t AS (SELECT id, line, n FROM n WHERE n < k OR line <> '')"


def _records_sql(name: str, key: str, text: str, opens: str) -> str:
    return _lines_sql(name, key, text) + f", o AS (SELECT *, max(CASE WHEN {opens} THEN n END) OVER (PARTITION BY id ORDER BY n) AS start FROM t) SELECT id, start, count(*) AS lines, sha256(string_agg(line, chr(10) ORDER BY n)) AS record_hash FROM o WHERE start IS NOT NULL GROUP BY id, start"


def _told(lines: DataFrame, opens) -> DataFrame:
    found = records.grouped(records.carried(lines, opens))
    return found.select(F.col("source").alias("id"), "start", F.size("lines").cast("long").alias("lines"), F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("record_hash"))


@query("line_numbers", _lines_sql("documents", "doc_id", "text") + " SELECT id, CAST(n AS BIGINT) AS line_no, sha256(line) AS line_hash FROM t")
def line_numbers(spark, d):
    """Lines of texts that come in pieces cut anywhere."""
    lines = records.piece_lines(records.cut(table(spark, d, "documents"), "doc_id", "text", PIECE))
    return lines.select(F.col("source").alias("id"), "line_no", F.sha2("line", 256).alias("line_hash"))


@query("stanza_records", _records_sql("documents", "doc_id", "text", "line LIKE 'Licensed%' OR line LIKE 'The %' OR line LIKE 'La %'"))
def stanza_records(spark, d):
    """Records from one opening line to the next, of which a piece may hold any part."""
    lines = records.piece_lines(records.cut(table(spark, d, "documents"), "doc_id", "text", PIECE))
    line = F.col("line")
    return _told(lines, line.startswith("Licensed") | line.startswith("The ") | line.startswith("La "))


@query("page_records", _records_sql("pages", "page_id", "replace(html, '<', chr(10) || '<')", "line LIKE '<p>%' OR line LIKE '<h1>%'"))
def page_records(spark, d):
    pages = table(spark, d, "pages").withColumn("text", F.replace("html", F.lit("<"), F.lit("\n<")))
    lines = records.piece_lines(records.cut(pages, "page_id", "text", PIECE))
    return _told(lines, F.col("line").startswith("<p>") | F.col("line").startswith("<h1>"))


_BLOCKS = _lines_sql("documents", "doc_id", "replace(text, '. ', '.' || chr(10) || chr(10))") + ", b AS (SELECT *, CASE WHEN trim(line) <> '' AND coalesce(lag(trim(line)) OVER (PARTITION BY id ORDER BY n), '') = '' THEN n END AS o FROM t), s AS (SELECT *, max(o) OVER (PARTITION BY id ORDER BY n) AS start FROM b WHERE trim(line) <> '') SELECT id, CAST(start AS VARCHAR) AS block, sha256(string_agg(line, chr(10) ORDER BY n)) AS block_hash FROM s GROUP BY id, start"


@query("paragraph_entries", _BLOCKS)
def paragraph_entries(spark, d):
    """Blocks between blank lines as entries with a `text`."""
    docs = table(spark, d, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))
    found = records.text_entries(records.piece_lines(records.cut(docs, "doc_id", "text", PIECE)))
    return found.select(F.split("source", ":")[0].cast("long").alias("id"), F.col("id").alias("block"), F.sha2(F.get_json_object("entry_json", "$.text"), 256).alias("block_hash"))


# --- JSON columns -------------------------------------------------------------------------------------------


def _talks(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return turns.select("conv_id", F.parse_json(F.to_json(F.struct(F.struct("messages").alias("talk")))).alias("entry"))


@query("records_fan_out", "SELECT conv_id, CAST(turn AS VARCHAR) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role, sha256(text) AS text_hash, '/role,/text,/turn' AS fields FROM conversations")
def records_fan_out(spark, d):
    """An entry for each item of the list that a pointer leads to, with ids and default fields of its own."""
    found = fanout.fan_out(_talks(spark, d), "entry", "/talk/messages", "turn", "conv_id")
    data = F.col("data")
    return found.select("conv_id", "id", "place", F.try_variant_get(data, "$.role", "string").alias("role"), F.sha2(F.try_variant_get(data, "$.text", "string"), 256).alias("text_hash"), F.array_join(fanout.default_fields(data), ",").alias("fields"))


@query("event_entries", "SELECT event_id, '1' AS id, '/' || unnest(json_keys(props)) AS field, json_extract_string(props, '$.k') AS value FROM events")
def event_entries(spark, d):
    events = table(spark, d, "events").select("event_id", F.parse_json("props").alias("entry"))
    found = fanout.checked(fanout.fan_out(events, "entry"), "data", ["/k"])
    return found.select("event_id", "id", F.explode(fanout.default_fields(F.col("data"))).alias("field"), F.try_variant_get("data", "$.k", "string").alias("value"))


def _odd_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries whose keys depend on the row: {"lang": .., "<source>": {"<lang>": n, "l": [..]}}."""
    docs = table(spark, d, "documents")
    text = F.concat(F.lit('{"lang":"'), "lang", F.lit('","'), "source", F.lit('":{"'), "lang", F.lit('":'), F.col("n_chars").cast("string"), F.when(F.col("n_chars") % 5 == 0, ',"l":[1,null]').otherwise(""), F.lit("}}"))
    return docs.select(F.parse_json(text).alias("entry"))


_POINTERS = "WITH p AS (SELECT doc_id, unnest(list_concat(['/lang', '/' || source, '/' || source || '/' || lang], CASE WHEN n_chars % 5 = 0 THEN ['/' || source || '/l', '/' || source || '/l/0', '/' || source || '/l/1'] ELSE [] END)) AS pointer FROM documents)"


@query("pointer_statistics", _POINTERS + " SELECT pointer, count(*) AS entries FROM p GROUP BY pointer")
def pointer_statistics(spark, d):
    """How many entries have each pointer, from one pass over entries of any shape."""
    return fanout.pointer_counts(fanout.shapes(_odd_shapes(spark, d), "entry"))


_SELECTED = ("/lang", "/src1", "/src1/de", "/src2", "/src2/l/1", "/none")


@query("selection_problems", _POINTERS + f""", w AS (SELECT unnest({list(_SELECTED)}) AS pointer), k AS (SELECT w.pointer, EXISTS (SELECT 1 FROM p WHERE p.pointer = w.pointer) AS known FROM w),
m AS (SELECT DISTINCT a.pointer AS a, b.pointer AS b FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.pointer < b.pointer WHERE a.pointer IN (SELECT pointer FROM w) AND b.pointer IN (SELECT pointer FROM w))
SELECT 'unknown' AS problem, pointer AS pointers FROM k WHERE NOT known UNION ALL SELECT 'apart', a.pointer || ' ' || b.pointer FROM k a JOIN k b ON a.pointer < b.pointer AND a.known AND b.known WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.a = a.pointer AND m.b = b.pointer)""")
def selection_problems(spark, d):
    found = fanout.selection_problems(fanout.shapes(_odd_shapes(spark, d), "entry"), _SELECTED)
    return found.select("problem", F.array_join("pointers", " ").alias("pointers"))
