"""Every query of the engine, with the SQL that DuckDB runs for comparison.

A query is a function of (spark, sf_dir); its docstring-like note is the operators it shows. All run over
whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_present, resolved, token_estimate, value_text
from ..operators import analytics, cache, packing, report, results, rules, selection, traces
from ..operators.rules import Rule
from .registry import ORACLES, QUERIES, query, table  # noqa: F401

ORDERS = [
    Rule("/o_orderpriority", "o_orderpriority", "o_orderpriority = '1-URGENT'", 0.9, 0.15, 0.7),
    Rule("/o_orderstatus", "o_orderstatus", "o_orderstatus = 'F'", 0.6, 0.2, 0.75),
    Rule("/o_totalprice", "CAST(floor(o_totalprice) AS BIGINT)", "o_totalprice > 400000", 0.9, 0.1, 0.95),
]
ORDERS_STRICT = [
    Rule("/o_orderpriority", "o_orderpriority", "o_orderpriority IN ('1-URGENT', '2-HIGH')", 0.85, 0.15, 0.7),
    Rule("/o_orderstatus", "o_orderstatus", "o_orderstatus = 'F'", 0.6, 0.2, 0.65),
    Rule("/o_totalprice", "CAST(floor(o_totalprice) AS BIGINT)", "o_totalprice > 350000", 0.9, 0.1, 0.95),
]
LINES = [
    Rule("/l_discount", "CAST(floor(l_discount * 1000) AS BIGINT)", "l_discount > 0.085", 0.8, 0.2, 0.6),
    Rule("/l_quantity", "CAST(floor(l_quantity) AS BIGINT)", "l_quantity > 45", 0.95, 0.05, 0.9),
    Rule("/l_tax", "CAST(floor(l_tax * 1000) AS BIGINT)", "l_tax > 0.065", 0.8, 0.3, 0.85),
]
CUSTOMERS = [
    Rule("/c_acctbal", "CAST(floor(c_acctbal) AS BIGINT)", "c_acctbal < 0", 0.97, 0.12, 0.9),
    Rule("/c_mktsegment", "c_mktsegment", "c_mktsegment = 'MACHINERY'", 0.7, 0.12, 0.95),
    Rule("/c_nationkey", "c_nationkey", "c_nationkey < 3", 0.7, 0.3, 0.65),
]
LINE_ID = "concat_ws(':', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING))"
LINE_ID_SQL = "concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber)"


def orders(spark: SparkSession, d: str, found=ORDERS) -> DataFrame:
    return rules.assess(table(spark, d, "orders"), "o_orderkey", found)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return rules.assess(table(spark, d, "lineitem"), LINE_ID, LINES)


def customers(spark: SparkSession, d: str) -> DataFrame:
    return rules.assess(table(spark, d, "customer"), "c_custkey", CUSTOMERS)


def rolled(table_: str, entry_id: str, found, threshold: float = 0.5) -> str:
    """WITH f (field rows) and e (rolled-up entries)."""
    return f"""WITH f AS ({rules.rule_sql(table_, entry_id, found)}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, path) AS k FROM f),
e AS (SELECT id, label, confidence, score, score >= {threshold} AS warning FROM r WHERE k = 1)"""


ORDERS_SQL, LINES_SQL, CUSTOMERS_SQL = rolled("orders", "o_orderkey", ORDERS), rolled("lineitem", LINE_ID_SQL, LINES), rolled("customer", "c_custkey", CUSTOMERS)


# --- projection: fields of entries -------------------------------------------------------------------


@query("field_unpivot", "SELECT s_suppkey AS id, '/s_name' AS path, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, '/s_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT s_suppkey, '/s_suppkey', CAST(s_suppkey AS VARCHAR) FROM supplier")
def field_unpivot(spark, d):
    t = table(spark, d, "supplier")
    return t.select(F.col("s_suppkey").alias("id"), F.expr("stack(3, '/s_name', s_name, '/s_nationkey', CAST(s_nationkey AS STRING), '/s_suppkey', CAST(s_suppkey AS STRING)) AS (path, value)"))


@query("field_scores", f"SELECT id, path, value, label, confidence, score FROM ({rules.rule_sql('orders', 'o_orderkey', ORDERS)})")
def field_scores(spark, d):
    return rules.field_rows(orders(spark, d)).select("id", "path", "value", "label", "confidence", "score")


@query("field_scores_lineitem", f"SELECT id, path, label, score FROM ({rules.rule_sql('lineitem', LINE_ID_SQL, LINES)})")
def field_scores_lineitem(spark, d):
    return rules.field_rows(lines(spark, d)).select("id", "path", "label", "score")


@query("entry_rollup", ORDERS_SQL + " SELECT id, label, confidence, score, warning FROM e")
def entry_rollup(spark, d):
    return orders(spark, d).select("id", "label", "confidence", "score", "warning")


@query("entry_rollup_lineitem", LINES_SQL + " SELECT id, label, confidence, score, warning FROM e")
def entry_rollup_lineitem(spark, d):
    return lines(spark, d).select("id", "label", "confidence", "score", "warning")


@query("rollup_of_rows", CUSTOMERS_SQL + " SELECT id, label, confidence, score, warning FROM e")
def rollup_of_rows(spark, d):
    return rules.roll_up_rows(rules.field_rows(customers(spark, d))).select("id", "label", "confidence", "score", "warning")


@query("multiclass_rollup", """WITH f AS (SELECT p_partkey AS id, '/p_size' AS path, CASE WHEN p_size > 45 THEN 'SUSPECT' WHEN p_size < 3 THEN 'BROKEN' ELSE 'NORMAL' END AS label, CASE WHEN p_size > 45 THEN 0.3 WHEN p_size < 3 THEN 0.9 ELSE 0.05 END AS score FROM part
UNION ALL SELECT p_partkey, '/p_type', CASE WHEN p_type = 'ECONOMY' THEN 'NORMAL' ELSE 'SUSPECT' END, CASE WHEN p_type = 'ECONOMY' THEN 0.4 ELSE 0.1 END FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, path) AS k FROM f)
SELECT id, label, CAST(score AS DOUBLE) AS score FROM r WHERE k = 1""")
def multiclass_rollup(spark, d):
    field = lambda path, label, score: F.struct(F.lit(path).alias("path"), F.expr(label).alias("label"), F.lit(1.0).alias("confidence"), F.expr(f"CAST({score} AS DOUBLE)").alias("score"))
    size = field("/p_size", "CASE WHEN p_size > 45 THEN 'SUSPECT' WHEN p_size < 3 THEN 'BROKEN' ELSE 'NORMAL' END", "CASE WHEN p_size > 45 THEN 0.3 WHEN p_size < 3 THEN 0.9 ELSE 0.05 END")
    kind = field("/p_type", "CASE WHEN p_type = 'ECONOMY' THEN 'NORMAL' ELSE 'SUSPECT' END", "CASE WHEN p_type = 'ECONOMY' THEN 0.4 ELSE 0.1 END")
    return rules.rolled_up(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(size, kind).alias("fields"))).select("id", "label", "score")


@query("field_view_parent_context", CUSTOMERS_SQL + " SELECT f.id, f.path, f.label, f.score, e.label AS entry_label, e.score AS entry_score, e.confidence AS entry_confidence, e.warning AS entry_warning FROM f JOIN e ON f.id = e.id")
def field_view_parent_context(spark, d):
    return rules.field_rows(customers(spark, d)).select("id", "path", "label", "score", "entry_label", "entry_score", "entry_confidence", "entry_warning")


@query("csv_entry_expansion", rolled("supplier", "s_suppkey", [Rule("/s_acctbal", "CAST(floor(s_acctbal) AS BIGINT)", "s_acctbal < 0", 0.9, 0.1), Rule("/s_name", "s_name", "s_nationkey = 7", 0.6, 0.2)]) + " SELECT e.id, e.label, e.score, f.path AS field_path, f.value AS field_value, f.label AS field_label, f.score AS field_score FROM e JOIN f ON e.id = f.id")
def csv_entry_expansion(spark, d):
    found = rules.assess(table(spark, d, "supplier"), "s_suppkey", [Rule("/s_acctbal", "CAST(floor(s_acctbal) AS BIGINT)", "s_acctbal < 0", 0.9, 0.1), Rule("/s_name", "s_name", "s_nationkey = 7", 0.6, 0.2)])
    entry = [F.col(f"entry_{x}").alias(x) for x in ("label", "score")]
    return rules.field_rows(found).select("id", *entry, *[F.col(x).alias(f"field_{x}") for x in ("path", "value", "label", "score")])


@query("flagged_fields", LINES_SQL + " SELECT id, path, score FROM f WHERE score >= 0.5")
def flagged_fields(spark, d):
    return rules.field_rows(lines(spark, d)).where("score >= 0.5").select("id", "path", "score")


# --- filters and orders --------------------------------------------------------------------------------


@query("warnings_only", LINES_SQL + " SELECT id, label, score FROM e WHERE warning")
def warnings_only(spark, d):
    return report.warnings_only(lines(spark, d)).select("id", "label", "score")


@query("threshold_inclusive", rolled("lineitem", LINE_ID_SQL, LINES, 0.8) + " SELECT id, score, warning FROM e WHERE warning")
def threshold_inclusive(spark, d):
    return report.warnings_only(rules.assess(table(spark, d, "lineitem"), LINE_ID, LINES, 0.8)).select("id", "score", "warning")


@query("anomalies_any_field", ORDERS_SQL + " SELECT id, label, score FROM e WHERE EXISTS (SELECT 1 FROM f WHERE f.id = e.id AND f.label = 'ANOMALY')")
def anomalies_any_field(spark, d):
    return report.anomalies_only(orders(spark, d), rules.ANOMALY).select("id", "label", "score")


@query("anomalies_field_rows", ORDERS_SQL + " SELECT id, path, score FROM f WHERE label = 'ANOMALY'")
def anomalies_field_rows(spark, d):
    return report.anomalies_only(rules.field_rows(orders(spark, d)), rules.ANOMALY, "fields").select("id", "path", "score")


def _ranked(frame: DataFrame, *keys: Column) -> DataFrame:
    """A rank over all rows, from a sort by ranges."""
    return packing.ranked(frame, *keys).withColumn("rank", F.col("place") + 1).drop("place")


@query("sort_score_rank", CUSTOMERS_SQL + " SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM e")
def sort_score_rank(spark, d):
    return _ranked(customers(spark, d), report.sort_key("score").desc(), F.col("id")).select("id", "score", "rank")


@query("sort_confidence_rank", CUSTOMERS_SQL + " SELECT id, confidence, row_number() OVER (ORDER BY confidence DESC, id) AS rank FROM e")
def sort_confidence_rank(spark, d):
    return _ranked(customers(spark, d), report.sort_key("confidence").desc(), F.col("id")).select("id", "confidence", "rank")


@query("sort_anomaly_confidence_rank", CUSTOMERS_SQL + ", a AS (SELECT id, max(confidence) AS key FROM f WHERE label = 'ANOMALY' GROUP BY id) SELECT id, key, row_number() OVER (ORDER BY key DESC, id) AS rank FROM a")
def sort_anomaly_confidence_rank(spark, d):
    found = report.anomalies_only(customers(spark, d), rules.ANOMALY).withColumn("key", report.sort_key("confidence", rules.ANOMALY))
    return _ranked(found, F.col("key").desc(), F.col("id")).select("id", "key", "rank")


@query("where_expr_entries", ORDERS_SQL + " SELECT id, label, score FROM e WHERE score > 0.5 AND label IN ('ANOMALY') AND NOT (confidence < 0.72)")
def where_expr_entries(spark, d):
    return report.where(orders(spark, d), "score > 0.5 AND label IN ('ANOMALY') AND NOT (confidence < 0.72)").select("id", "label", "score")


@query("where_expr_fields", ORDERS_SQL + " SELECT id, path, value FROM f WHERE path = '/o_totalprice' AND CAST(value AS BIGINT) BETWEEN 399000 AND 401000")
def where_expr_fields(spark, d):
    return report.where(rules.field_rows(orders(spark, d)), "path = '/o_totalprice' AND value::BIGINT BETWEEN 399000 AND 401000").select("id", "path", "value")


@query("where_dialect_entries", LINES_SQL + " SELECT id, score FROM e WHERE (score * 100)::INTEGER // 7 > 11 AND split_part(id, ':', 1)::BIGINT % 2 AND 2 ** 3 < 9 AND strftime(strptime('1998-07-05', '%Y-%m-%d'), '%d.%m.%y') = '05.07.98' AND id[1:1] <> '4'")
def where_dialect_entries(spark, d):
    found = report.where(lines(spark, d), "(score * 100)::INTEGER // 7 > 11 AND (split_part(id, ':', 1)::BIGINT % 2)::BOOLEAN AND 2 ** 3 < 9 AND strftime(strptime('1998-07-05', '%Y-%m-%d'), '%d.%m.%y') = '05.07.98' AND id[1:1] <> '4'")
    return found.select("id", "score")


@query("where_json_fields", "SELECT event_id AS id, props FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90")
def where_json_fields(spark, d):
    return report.where(table(spark, d, "events").select(F.col("event_id").alias("id"), "props"), "CAST(props ->> 'k' AS INT) >= 90")


@query("order_by_nulls_last_rank", "SELECT o_orderkey AS id, nullif(o_orderstatus, 'P') AS status, row_number() OVER (ORDER BY nullif(o_orderstatus, 'P') DESC NULLS LAST, o_orderkey) AS rank FROM orders")
def order_by_nulls_last_rank(spark, d):
    found = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    return _ranked(found, *report.order_keys(found, "status DESC"), F.col("id"))


@query("limit_before_filter", f"WITH o AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500), {rolled('o', 'o_orderkey', ORDERS)[5:]} SELECT id, score FROM e WHERE warning")
def limit_before_filter(spark, d):
    first = table(spark, d, "orders").orderBy("o_orderkey").limit(500)
    return report.warnings_only(rules.assess(first, "o_orderkey", ORDERS)).select("id", "score")


# --- selection -----------------------------------------------------------------------------------------

_SPARSE = "concat('{\"k\":', CAST(event_id % 100 AS STRING), CASE WHEN event_id % 3 = 0 THEN ',\"a\":null' ELSE '' END, CASE WHEN event_id % 4 < 2 THEN ',\"b\":\"x\"' ELSE '' END, '}')"
_HAS = "SELECT event_id AS id, event_id % 3 = 0 AS a, event_id % 4 < 2 AS b FROM events"


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """Events as entries of which some lack fields and some hold JSON null."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.parse_json(F.expr(_SPARSE)).alias("entry"))


def _lists(frame: DataFrame) -> DataFrame:
    return frame.select("id", F.concat_ws(",", "keep").alias("keep"), F.concat_ws(",", "absent").alias("absent"))


@query("required_fields", f"SELECT id, '/a,/b' AS keep, '' AS absent FROM ({_HAS}) WHERE a AND b")
def required_fields(spark, d):
    return _lists(selection.Selection.of(["/a", "/b"]).apply(sparse(spark, d)))


@query("optional_fields", f"SELECT id, CASE WHEN b THEN '/a,/b' ELSE '/a' END AS keep, CASE WHEN b THEN '' ELSE '/b' END AS absent FROM ({_HAS}) WHERE a")
def optional_fields(spark, d):
    return _lists(selection.Selection.of(["/a"], ["/b"]).apply(sparse(spark, d)))


@query("relaxed_fields", f"SELECT id, concat_ws(',', CASE WHEN a THEN '/a' END, CASE WHEN b THEN '/b' END) AS keep, concat_ws(',', CASE WHEN NOT a THEN '/a' END, CASE WHEN NOT b THEN '/b' END) AS absent FROM ({_HAS}) WHERE a OR b")
def relaxed_fields(spark, d):
    return _lists(selection.Selection.of(["/a", "/b"], relaxed=True).apply(sparse(spark, d)))


@query("skip_causes", f"WITH h AS ({_HAS}), c AS (SELECT '/a' AS cause FROM h WHERE NOT a UNION ALL SELECT '/b' FROM h WHERE NOT b) SELECT cause, count(*) AS entries FROM c GROUP BY cause")
def skip_causes(spark, d):
    return selection.skip_causes(selection.Selection.of(["/a", "/b"]).narrow(sparse(spark, d)))


@query("selection_counts", f"SELECT count(*) AS entries, count(*) FILTER (WHERE a) AS with_a, count(*) FILTER (WHERE b) AS with_b, count(*) FILTER (WHERE a AND b) AS assessed FROM ({_HAS})")
def selection_counts(spark, d):
    found = selection.Selection.of(["/a", "/b"]).narrow(sparse(spark, d))
    return found.agg(F.count(F.lit(1)).alias("entries"), F.count_if(is_present(F.col("entry"), "/a")).alias("with_a"), F.count_if(is_present(F.col("entry"), "/b")).alias("with_b"), F.count_if(F.size("blocking") == 0).alias("assessed"))


@query("pointer_resolve_props", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.missing') AS missing FROM events")
def pointer_resolve_props(spark, d):
    entry = F.parse_json("props")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), resolved(entry, "/k", "long").alias("k"), is_present(entry, "/missing").alias("missing"))


@query("pointer_null_present", f"SELECT id, a AS present, CASE WHEN a THEN 'null' END AS value FROM ({_HAS})")
def pointer_null_present(spark, d):
    found = sparse(spark, d)
    return found.select("id", is_present(F.col("entry"), "/a").alias("present"), F.to_json(resolved(F.col("entry"), "/a")).alias("value"))


# --- text sources --------------------------------------------------------------------------------------


@query("text_lines", "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), y AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM x) SELECT doc_id, CAST(n AS BIGINT) AS line_no, sha256(line) AS line_hash FROM y WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''")
def text_lines(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return found.where(F.trim("line", F.lit(" \t\r")) != "").select("doc_id", (F.col("n") + 1).cast("long").alias("line_no"), F.sha2("line", 256).alias("line_hash"))


@query("text_paragraphs", r"WITH x AS (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n[ \t]*\n') AS p FROM documents), y AS (SELECT doc_id, unnest(p) AS block, generate_subscripts(p, 1) AS n FROM x) SELECT doc_id, CAST(n AS BIGINT) AS paragraph, sha256(block) AS block_hash FROM y WHERE trim(block) <> ''")
def text_paragraphs(spark, d):
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    found = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(doubled, r"\n[ \t]*\n")).alias("n", "block"))
    return found.where(F.trim("block") != "").select("doc_id", (F.col("n") + 1).cast("long").alias("paragraph"), F.sha2("block", 256).alias("block_hash"))


@query("text_file", "SELECT doc_id, sha256(text) AS text_hash, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE trim(text) <> ''")
def text_file(spark, d):
    return table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.octet_length("text").cast("long").alias("bytes"))


# --- identity, cache, duplicates -------------------------------------------------------------------------


@query("token_estimate", "SELECT doc_id, CAST(ceil(strlen(text) / 2.0) + 16 AS BIGINT) AS tokens FROM documents")
def token_estimate_(spark, d):
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query("duplicate_ids", "SELECT sha256(text) AS id, count(*) AS entries FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return selection.duplicates(table(spark, d, "documents"), F.sha2("text", 256))


_PRIOR = "SELECT sha256(CAST(o_custkey AS VARCHAR) || o_orderstatus) AS request_hash, min(o_orderkey) AS response FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1"
_PLANS = "SELECT o_orderkey AS id, sha256(CAST(o_custkey AS VARCHAR) || o_orderstatus) AS request_hash FROM orders"


def _plans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.concat(F.col("o_custkey").cast("string"), "o_orderstatus"), 256).alias("request_hash"))


def _prior(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d).where("id % 2 = 0").groupBy("request_hash").agg(F.min("id").alias("response"))


@query("cache_hits", f"SELECT p.id, p.request_hash FROM ({_PLANS}) p SEMI JOIN ({_PRIOR}) s ON p.request_hash = s.request_hash")
def cache_hits(spark, d):
    return cache.hits(_plans(spark, d), _prior(spark, d))


@query("cache_misses", f"SELECT p.id, p.request_hash FROM ({_PLANS}) p ANTI JOIN ({_PRIOR}) s ON p.request_hash = s.request_hash")
def cache_misses(spark, d):
    return cache.misses(_plans(spark, d), _prior(spark, d))


@query("cache_left_status", f"SELECT p.id, coalesce(s.response, -1) AS response, s.response IS NOT NULL AS cached FROM ({_PLANS}) p LEFT JOIN ({_PRIOR}) s ON p.request_hash = s.request_hash")
def cache_left_status(spark, d):
    return cache.probed(_plans(spark, d), _prior(spark, d)).select("id", F.coalesce("response", F.lit(-1)).alias("response"), "cached")


@query("latest_response", "WITH s AS (SELECT o_custkey AS request_hash, o_orderkey AS response, o_orderdate AS assessed_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT request_hash, response FROM s WHERE k = 1")
def latest_response(spark, d):
    store = table(spark, d, "orders").select(F.col("o_custkey").alias("request_hash"), F.col("o_orderkey").alias("response"), F.col("o_orderdate").alias("assessed_at"))
    return cache.latest(store, ["response"]).select("request_hash", "response")


_DOC_KEYS = "SELECT doc_id AS id, doc_id AS ordinal, sha256(text) AS request_hash FROM documents"


def _doc_plans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("request_hash"))


@query("dedupe_representative", f"SELECT id, min(id) OVER (PARTITION BY request_hash) AS representative FROM ({_DOC_KEYS})")
def dedupe_representative(spark, d):
    return cache.representatives(_doc_plans(spark, d)).select("id", "representative")


@query("cached_flag", f"SELECT id, row_number() OVER (PARTITION BY request_hash ORDER BY ordinal) > 1 AS cached FROM ({_DOC_KEYS})")
def cached_flag(spark, d):
    return cache.cached_flags(_doc_plans(spark, d)).select("id", "cached")


@query("cached_flag_windows", f"SELECT id, row_number() OVER (PARTITION BY request_hash, ordinal // 64 ORDER BY ordinal) > 1 AS cached FROM ({_DOC_KEYS})")
def cached_flag_windows(spark, d):
    return cache.cached_flags(_doc_plans(spark, d).withColumn("window_id", F.floor(F.col("ordinal") / 64)), ["window_id"]).select("id", "cached")


@query("changed_entries", "WITH a AS (SELECT c_custkey, sha256(c_name || c_mktsegment) AS h FROM customer), b AS (SELECT c_custkey, sha256(c_name || CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END) AS h FROM customer) SELECT b.c_custkey AS id FROM b ANTI JOIN a ON a.h = b.h")
def changed_entries(spark, d):
    t = table(spark, d, "customer")
    old = t.select(F.sha2(F.concat("c_name", "c_mktsegment"), 256).alias("request_hash"))
    new = t.select(F.col("c_custkey").alias("id"), F.sha2(F.concat("c_name", F.when(F.col("c_custkey") % 7 == 0, "CHANGED").otherwise(F.col("c_mktsegment"))), 256).alias("request_hash"))
    return cache.misses(new, old).select("id")


@query("followup_semi", f"SELECT id, path, score FROM (SELECT *, dense_rank() OVER (ORDER BY best DESC, id) AS place FROM (SELECT id, path, score, max(score) OVER (PARTITION BY id) AS best FROM ({rules.rule_sql('lineitem', LINE_ID_SQL, LINES)}))) WHERE place <= 50")
def followup_semi(spark, d):
    found = lines(spark, d)
    short = found.orderBy(F.desc("score"), "id").limit(50).select("id")
    return rules.field_rows(found.join(short, "id", "left_semi")).select("id", "path", "score")


# --- packing ---------------------------------------------------------------------------------------------


@query("batch_entry_cap", "SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders")
def batch_entry_cap(spark, d):
    return packing.capped(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 64)


_BUDGET_SQL = """WITH RECURSIVE s AS (SELECT source, doc_id AS id, CAST(ceil(strlen(text) / 2.0) + 16 AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
w AS (SELECT source, id, k, CAST(0 AS BIGINT) AS batch, tokens AS used FROM s WHERE k = 1
UNION ALL SELECT s.source, s.id, s.k, CASE WHEN w.used + s.tokens > 4000 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used + s.tokens > 4000 THEN s.tokens ELSE w.used + s.tokens END FROM w JOIN s ON s.source = w.source AND s.k = w.k + 1)
SELECT source, id, batch, used FROM w"""


@query("batch_token_budget", _BUDGET_SQL)
def batch_token_budget(spark, d):
    sized = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), token_estimate(F.col("text")).alias("tokens"))
    return packing.budgeted(sized, ["source"], "id", 4000).select("source", "id", "batch", "used")


# --- counters and answers ------------------------------------------------------------------------------------


@query("scan_summary", LINES_SQL + " SELECT count(*) AS entries, count(*) FILTER (WHERE warning) AS warnings, count(*) FILTER (WHERE score > 0.9) AS emitted FROM e")
def scan_summary(spark, d):
    return lines(spark, d).agg(F.count(F.lit(1)).alias("entries"), F.count_if("warning").alias("warnings"), F.count_if(F.col("score") > 0.9).alias("emitted"))


_PROBS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * 10, 2) AS a, round(1 - l_discount * 10, 2) + CASE WHEN l_linenumber = 3 THEN 0.5 ELSE 0 END AS b, CASE WHEN l_returnflag = 'R' THEN 'A' ELSE 'B' END AS choice FROM lineitem"


@query("response_validation", f"SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, CASE WHEN a < 0 OR a > 1 OR b < 0 OR b > 1 THEN 'range' WHEN abs(a + b - 1) > 0.01 THEN 'sum' WHEN (choice = 'A' AND a < b) OR (choice = 'B' AND b < a) THEN 'choice' ELSE 'ok' END AS verdict FROM ({_PROBS})")
def response_validation(spark, d):
    t = table(spark, d, "lineitem")
    a, b = F.round(F.col("l_discount") * 10, 2), F.round(1 - F.col("l_discount") * 10, 2) + F.when(F.col("l_linenumber") == 3, 0.5).otherwise(0.0)
    answers = t.select(F.expr(LINE_ID).alias("id"), F.create_map(F.lit("A"), a, F.lit("B"), b).alias("probabilities"), F.when(F.col("l_returnflag") == "R", "A").otherwise("B").alias("choice"))
    return answers.select("id", cache.answer_verdict(F.col("probabilities"), F.col("choice"), F.lit(0.01)).alias("verdict"))


_ROUNDED = "SELECT *, round(l_quantity / 70, k) AS a, round(1 - l_quantity / 70, k) + CASE l_linenumber WHEN 3 THEN 0.004 WHEN 5 THEN 0.01 ELSE 0 END AS b FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 3 END AS k FROM lineitem)"
_TWO = "abs(a * 100 - round(a * 100)) < 1e-9 AND abs(b * 100 - round(b * 100)) < 1e-9"


@query("answer_validation", f"SELECT {LINE_ID_SQL} AS id, CASE WHEN l_returnflag = 'N' AND l_linenumber = 2 THEN 'kind' WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN 'labels' WHEN b > 1 OR l_tax > 0.07 THEN 'range' WHEN abs(a + b - 1) > CASE WHEN {_TWO} THEN 0.01 ELSE 0.001 END + 1e-12 THEN 'sum' WHEN CASE WHEN l_returnflag = 'R' THEN a ELSE b END < greatest(a, b) THEN 'choice' ELSE 'ok' END AS verdict FROM ({_ROUNDED})")
def answer_validation(spark, d):
    """Answers checked as a scan checks them: labels, ranges, a sum as exact as its decimals, and the choice."""
    t = table(spark, d, "lineitem").withColumn("k", F.when(F.col("l_partkey") % 2 == 0, 2).otherwise(3))
    share = lambda x: F.when(F.col("k") == 2, F.round(x, 2)).otherwise(F.round(x, 3))
    a = share(F.col("l_quantity") / 70)
    b = share(1 - F.col("l_quantity") / 70) + F.when(F.col("l_linenumber") == 3, 0.004).when(F.col("l_linenumber") == 5, 0.01).otherwise(0.0)
    kind = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 2), "text").otherwise("choice")
    labels = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "A"), F.array(F.lit("A"))).otherwise(F.array(F.lit("B"), F.lit("A")))
    confidence = F.when(F.col("l_tax") > 0.07, F.lit(2.0)).otherwise(F.lit(0.5))
    found = cache.answer_problem(kind, F.when(F.col("l_returnflag") == "R", "A").otherwise("B"), F.create_map(F.lit("A"), a, F.lit("B"), b), confidence, labels)
    return t.select(F.expr(LINE_ID).alias("id"), found.alias("verdict"))


@query("shortlist_topk", LINES_SQL + ", m AS (SELECT *, count(*) OVER () AS matching FROM e WHERE score >= 0.5) SELECT id, score, matching, row_number() OVER (ORDER BY score DESC, id) AS rank FROM m ORDER BY score DESC, id LIMIT 25")
def shortlist_topk(spark, d):
    return analytics.shortlist(lines(spark, d).select("id", "score"), 25, 0.5, "id")


# --- analytics ---------------------------------------------------------------------------------------------

_GOLD = "SELECT d.source, CASE WHEN l.quality = 0 THEN 'bad' WHEN l.toxic = 1 THEN 'toxic' ELSE 'good' END AS gold, CASE WHEN d.n_chars < 300 THEN 'bad' WHEN d.n_chars % 11 = 0 THEN 'toxic' ELSE 'good' END AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
KINDS = ("bad", "good", "toxic")


def gold(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return joined.select("source", F.when(F.col("quality") == 0, "bad").when(F.col("toxic") == 1, "toxic").otherwise("good").alias("gold"), F.when(F.col("n_chars") < 300, "bad").when(F.col("n_chars") % 11 == 0, "toxic").otherwise("good").alias("pred"))


@query("confusion_matrix", "SELECT gold, " + ", ".join(f"count(*) FILTER (WHERE pred = '{k}') AS {k}" for k in KINDS) + f" FROM (VALUES ('bad'), ('good'), ('toxic')) k(gold) LEFT JOIN ({_GOLD}) g USING (gold) GROUP BY gold")
def confusion_matrix(spark, d):
    return analytics.confusion(gold(spark, d), "gold", "pred", KINDS)


_METRICS = "count(*) AS n, avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS accuracy, greatest(count(*) FILTER (WHERE gold = 'bad'), count(*) FILTER (WHERE gold = 'good'), count(*) FILTER (WHERE gold = 'toxic')) / count(*) AS majority, count(*) FILTER (WHERE gold = 'bad' AND pred = 'bad') / nullif(count(*) FILTER (WHERE pred = 'bad'), 0) AS precision, count(*) FILTER (WHERE gold = 'bad' AND pred = 'bad') / nullif(count(*) FILTER (WHERE gold = 'bad'), 0) AS recall"


@query("agreement_metrics", f"SELECT {_METRICS} FROM ({_GOLD})")
def agreement_metrics(spark, d):
    return analytics.metrics(gold(spark, d), "gold", "pred", KINDS, "bad")


@query("metrics_by_domain", f"SELECT source, {_METRICS} FROM ({_GOLD}) GROUP BY GROUPING SETS ((source), ())")
def metrics_by_domain(spark, d):
    return analytics.metrics(gold(spark, d), "gold", "pred", KINDS, "bad", by="source")


def _two(a: str, b: str) -> str:
    return f"WITH a AS ({a}), b AS ({b}) SELECT count(*) AS fields, count(*) FILTER (WHERE a.label <> b.label) AS label_changes, max(abs(a.score - b.score)) AS max_score_delta, max(abs(a.confidence - b.confidence)) AS max_confidence_delta FROM a JOIN b ON a.id = b.id AND a.path = b.path"


@query("mode_comparison", _two(rules.rule_sql("orders", "o_orderkey", ORDERS), rules.rule_sql("orders", "o_orderkey", ORDERS_STRICT)))
def mode_comparison(spark, d):
    return analytics.compare(rules.field_rows(orders(spark, d)), rules.field_rows(orders(spark, d, ORDERS_STRICT)))


_LABELLED = "SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality")


_CASES = f"SELECT CASE WHEN doc_id % 3 = 0 THEN 'outcome' ELSE 'step' END AS kind, d.source AS domain, CASE WHEN l.quality = 0 THEN 'bad' WHEN l.toxic = 1 THEN 'toxic' ELSE 'good' END AS gold, CASE WHEN d.n_chars < 300 THEN 'bad' WHEN d.n_chars % 11 = 0 THEN 'toxic' ELSE 'good' END AS pred FROM labels l JOIN documents d USING (doc_id)"
_CONFUSED = "[" + ", ".join("[" + ", ".join(f"count(*) FILTER (WHERE gold = '{g}' AND pred = '{p}')" for p in KINDS) + "]" for g in KINDS) + "]"


@query("evaluation_outputs", f"SELECT kind, domain, {_METRICS}, array_to_string(flatten({_CONFUSED}), ',') AS confusion FROM ({_CASES}) GROUP BY GROUPING SETS ((kind, domain), (kind))")
def evaluation_outputs(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    both = table(spark, d, "labels").join(documents, "doc_id")
    place = F.when(F.col("doc_id") % 3 == 0, "/answer_text").otherwise("/messages/1").alias("path")
    told = both.select(F.col("doc_id").cast("string").alias("id"), place, F.when(F.col("n_chars") < 300, "bad").when(F.col("n_chars") % 11 == 0, "toxic").otherwise("good").alias("label"))
    people = both.select(F.col("doc_id").cast("string").alias("id"), place, F.col("source").alias("domain"), F.when(F.col("quality") == 0, "bad").when(F.col("toxic") == 1, "toxic").otherwise("good").alias("gold"))
    found = results.agreement(results.judged(told, people), KINDS, "bad")
    return found.withColumn("confusion", F.concat_ws(",", F.transform(F.flatten("confusion"), lambda x: x.cast("string"))))


@query("result_entry_table", ORDERS_SQL + " SELECT CAST(e.id AS VARCHAR) || ' · ' || s.value AS entry, e.label, round(e.score, 2) AS score, CASE WHEN e.warning THEN 'Yes' ELSE 'No' END AS warning FROM e JOIN f s ON s.id = e.id AND s.path = '/o_orderstatus'")
def result_entry_table(spark, d):
    return results.entry_table(orders(spark, d), "/o_orderstatus")


@query("result_flagged_table", ORDERS_SQL + " SELECT CAST(f.id AS VARCHAR) || ' · ' || s.value AS entry, f.path AS field, f.value, round(f.score, 2) AS score FROM f JOIN f s ON s.id = f.id AND s.path = '/o_orderstatus' WHERE f.score >= 0.5")
def result_flagged_table(spark, d):
    return results.flagged_table(orders(spark, d), 0.5, "/o_orderstatus")


@query("alternating_pick", f"""WITH RECURSIVE c AS (SELECT source, quality, doc_id, doc_id % 37 AS q, sha256('7:' || source || ':' || doc_id) AS h FROM ({_LABELLED})),
p AS (SELECT DISTINCT source, 0 AS step, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS doc_id FROM c
UNION ALL SELECT p.source, p.step + 1, list_append(any_value(p.used), arg_min(c.q, c.h)), arg_min(c.doc_id, c.h) FROM p LEFT JOIN c ON c.source = p.source AND c.quality = p.step % 2 AND NOT list_contains(p.used, c.q) WHERE p.step < 6 GROUP BY p.source, p.step)
SELECT source, CAST(step AS BIGINT) AS step, doc_id FROM p WHERE doc_id IS NOT NULL""")
def alternating_pick(spark, d):
    rows = labelled(spark, d).withColumn("q", F.col("doc_id") % 37)
    return analytics.alternating(rows, "source", "quality", "q", "7", ["source", "doc_id"], [0, 1, 0, 1, 0, 1]).select("source", "step", "doc_id")


@query("hash_ordered_sample", f"SELECT doc_id, sha256('7:' || source || ':' || doc_id) AS h FROM ({_LABELLED}) ORDER BY h LIMIT 40")
def hash_ordered_sample(spark, d):
    return analytics.hash_sample(labelled(spark, d), "7", ["source", "doc_id"], 40).select("doc_id", "h")


_PICK = f"SELECT doc_id, source, quality, row_number() OVER (PARTITION BY source, quality ORDER BY sha256('7:' || source || ':' || doc_id)) AS k FROM ({_LABELLED})"


@query("stratified_pick", f"SELECT doc_id, source, quality, k FROM ({_PICK}) WHERE k <= 2")
def stratified_pick(spark, d):
    return analytics.stratified(labelled(spark, d), ["source", "quality"], "7", ["source", "doc_id"], 2)


@query("interleave", f"SELECT doc_id, source, k, row_number() OVER (ORDER BY k, source, quality, doc_id) AS place FROM ({_PICK}) WHERE k <= 2")
def interleave(spark, d):
    picked = analytics.stratified(labelled(spark, d), ["source", "quality"], "7", ["source", "doc_id"], 2)
    return analytics.interleaved(picked, "k", ["source", "quality", "doc_id"]).select("doc_id", "source", "k", "place")


@query("sampling_manifest", f"SELECT source, count(*) AS eligible, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad FROM ({_LABELLED}) GROUP BY source")
def sampling_manifest(spark, d):
    return labelled(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))


# --- traces ------------------------------------------------------------------------------------------------

_SEGMENTED = "SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM conversations"


@query("trace_segments", f"SELECT conv_id, segment, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS events FROM ({_SEGMENTED}) GROUP BY conv_id, segment")
def trace_segments(spark, d):
    return traces.segments(table(spark, d, "conversations")).select("conv_id", "segment", "first_turn", "last_turn", "events")


@query("trace_prior_messages", "SELECT conv_id, turn, coalesce(string_agg(CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END, ',' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior FROM conversations")
def trace_prior_messages(spark, d):
    return traces.prior_messages(table(spark, d, "conversations")).select("conv_id", "turn", F.concat_ws(",", "prior").alias("prior"))


@query("trace_prior_texts", "SELECT conv_id, turn, coalesce(string_agg(CASE WHEN role = 'user' THEN turn || '=' || text END, '|' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior FROM conversations")
def trace_prior_texts(spark, d):
    found = traces.prior_messages(table(spark, d, "conversations"), text="text")
    return found.select("conv_id", "turn", F.concat_ws("|", F.transform("prior", lambda m: F.concat(m["i"].cast("string"), F.lit("="), m["text"]))).alias("prior"))


@query("trace_prior_counts", "SELECT conv_id, turn, CAST(count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS n_prior FROM conversations")
def trace_prior_counts(spark, d):
    """How much of its conversation's shared context each turn has seen."""
    return traces.prior_counts(table(spark, d, "conversations"), size=3).select("conv_id", "turn", "n_prior")


@query("trace_last_context", "SELECT conv_id, max(turn) AS turn, coalesce(string_agg(turn || '=' || text, '|' ORDER BY turn) FILTER (WHERE role = 'user' AND turn < last), '') AS prior FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id")
def trace_last_context(spark, d):
    """What each conversation's last turn has before it, cut from the stretches that its turns share."""
    turns = table(spark, d, "conversations")
    counted = traces.prior_counts(turns, size=3)
    last = counted.join(turns.groupBy("conv_id").agg(F.max("turn").alias("turn")), ["conv_id", "turn"], "left_semi")
    found = traces.prior_lists(last.select("conv_id", "turn", "n_prior"), traces.context_pieces(turns, size=3))
    return found.select("conv_id", "turn", F.concat_ws("|", F.transform("prior", lambda m: F.concat(m["i"].cast("string"), F.lit("="), m["text"]))).alias("prior"))


@query("trace_selection", "SELECT CAST(conv_id AS VARCHAR) AS id, coalesce(string_agg('/messages/' || (k - 1), ',' ORDER BY k) FILTER (WHERE role = 'assistant') || ',', '') || '/answer_text' AS fields FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id")
def trace_selection(spark, d):
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"), F.max("text").alias("answer_text"))
    found = traces.selected(whole.withColumn("step_labels", F.lit("secret")), ["messages", "answer_text"], entry_id="conv_id")
    # a filter, as a column that nobody reads isn't computed
    leaked = F.when(F.contains("entry_json", F.lit("step_labels")), F.raise_error(F.concat(F.lit("labels are sent with "), "id"))).otherwise(F.lit(True))
    return found.where(leaked).select("id", F.concat_ws(",", "fields").alias("fields"))


@query("assistant_fields", "SELECT conv_id, string_agg('/messages/' || turn, ',' ORDER BY turn) AS fields FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def assistant_fields(spark, d):
    return traces.assistant_fields(table(spark, d, "conversations")).where(F.size("fields") > 0).select("conv_id", F.concat_ws(",", "fields").alias("fields"))


# --- tables as sources -----------------------------------------------------------------------------------------


@query("union_all_tables", "SELECT 'nation' AS tbl, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def union_all_tables(spark, d):
    parts = [table(spark, d, n).select(F.lit(n).alias("tbl"), F.col(f"{k}_{n}key" if n != "supplier" else "s_suppkey").cast("long").alias("id"), F.col(f"{k}_name").alias("name")) for n, k in (("nation", "n"), ("region", "r"), ("supplier", "s"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("db_key_identity", "SELECT concat('\"main\".\"lineitem\":key:[', l_orderkey, ',', l_partkey, ',', l_suppkey, ',', l_linenumber, ']') AS id, l_shipdate IS NULL AS undated FROM lineitem")
def db_key_identity(spark, d):
    from ..sources.tables import key_id

    t = table(spark, d, "lineitem")
    return t.select(key_id("main", "lineitem", t, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]).alias("id"), F.col("l_shipdate").isNull().alias("undated"))


@query("sql_value_text", "SELECT event_id AS id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts_text, CASE WHEN event_id % 3 = 0 THEN 'nan' WHEN event_id % 3 = 1 THEN 'inf' ELSE '-inf' END AS odd FROM events")
def sql_value_text(spark, d):
    t = table(spark, d, "events")
    odd = F.expr("CASE WHEN event_id % 3 = 0 THEN double('NaN') WHEN event_id % 3 = 1 THEN double('Infinity') ELSE double('-Infinity') END")
    from pyspark.sql import types as T

    return t.select(F.col("event_id").alias("id"), value_text(F.col("ts"), t.schema["ts"].dataType).alias("ts_text"), value_text(odd, T.DoubleType()).alias("odd"))


CATALOGUED = ("customer", "documents", "events", "nation", "orders", "region")


@query("catalog_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM (DESCRIBE {n})) AS columns, count(*) AS rows FROM {n}" for n in CATALOGUED))
def catalog_tables(spark, d):
    from ..sources.tables import catalogued

    return catalogued({n: table(spark, d, n) for n in CATALOGUED})


@query("table_entries", "SELECT concat('\"main\".\"nation\":key:[', n_nationkey, ']') AS id, concat('{\"n_name\":\"', n_name, '\",\"n_nationkey\":', n_nationkey, ',\"n_regionkey\":', n_regionkey, '}') AS entry_json FROM nation")
def table_entries(spark, d):
    from ..sources.tables import entries

    return entries(table(spark, d, "nation"), "nation", ["n_nationkey"]).select("id", "entry_json")


from . import documents, scans  # noqa: E402, F401
