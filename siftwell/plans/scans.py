"""Queries of scans: whole `documents` planned, packed, asked and put together, held against SQL that builds the same requests."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import ENDPOINT
from ..operators.config import DEFAULT_CRITERIA, Config
from ..operators.evaluators import ContextLimitError, LiteralEvaluator
from ..operators.packed import ledger, members_frame, plan_frame, preview_frame, requests_frame, usage, windows_frame
from ..operators.planner import QUESTION, BatchOptions
from ..operators.scan import scan_frame
from ..operators.shared import discard, shared_dir, written
from ..sources.tables import object_json
from .registry import query, table

OPTIONS = BatchOptions("auto")
CONFIG = Config(guidance="A document has a language, a source and a text. The text is in that language. " * 150)
#: Options and configuration under which about every customer's questions need two requests.
SPLIT_OPTIONS = BatchOptions(4, 700)
SPLIT_CONFIG = Config()
#: More questions than this are too many for the evaluator of `context_split_calls`.
MOST_QUESTIONS = 8
FIELDS = ("lang", "source", "text")


def entries(spark: SparkSession, d: str, name: str = "documents", key: str = "doc_id", fields: tuple = FIELDS) -> DataFrame:
    rows = table(spark, d, name)
    return rows.select(F.col(key).cast("long").alias("ordinal"), F.col(key).cast("string").alias("id"), F.lit(None).cast("string").alias("source"), object_json(rows, fields).alias("entry_json"), F.array(*[F.lit(f"/{x}") for x in fields]).alias("fields"), F.array().cast("array<string>").alias("absent"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d, "customer", "c_custkey", CUSTOMER_FIELDS)


class FewQuestions(LiteralEvaluator):
    """Finds requests of more than MOST_QUESTIONS questions too large."""

    def evaluate(self, request: dict) -> dict:
        if len(request["questions"]) > MOST_QUESTIONS:
            raise ContextLimitError("too many questions")
        return super().evaluate(request)


CUSTOMER_FIELDS = ("c_mktsegment", "c_name", "c_nationkey")
_JSON = "coalesce(CAST(to_json({0}) AS VARCHAR), 'null')"


def _tokens(text: str) -> str:
    return f"CAST(ceil(strlen({text}) / 2.0) + 16 AS BIGINT)"


def _state(config: Config) -> str:
    return f"""'"exemplars":[],"guidance":"{config.guidance}"}}'"""


def _question(entry: str) -> str:
    criteria = ",".join(f'"{k}":"{v}"' for k, v in sorted(DEFAULT_CRITERIA.items())).replace("'", "''")
    return f"""'{{"criteria":{{{criteria}}},"instructions":{{{entry}"field_path":"/' || path || '","field_value":' || v || ',"question":"{QUESTION}"}},"type":"choice"}}'"""


def packed_sql(name: str, key: str, fields: tuple[str, str, str], config: Config, options: BatchOptions) -> str:
    """The requests of a cold scan of a table whose rows have three fields.

    d, e: rows and their JSON texts; f: questions; p: rows with their layout and the first row of the same content;
    w: windows, by jumps from the first row of each to that of the next; u: questions asked; r: requests.
    """
    budget, state = options.tokens, _state(config)
    base = f"({_tokens("'{' || " + state)} + 64)"
    pays = f"AND 2 * alone - ({base} + 2 * size) >= greatest(256, 0.1 * 2 * alone)" if options.size == "auto" else ""
    size = f"CASE WHEN shares THEN size ELSE {budget} END"
    q = _tokens("f.q")
    return f"""WITH RECURSIVE d AS (SELECT {key} AS ordinal, {", ".join(f"{_JSON.format(x)} AS {x}" for x in fields)} FROM {name}),
e AS (SELECT *, '{{' || {" || ',' || ".join(f"'\"{x}\":' || {x}" for x in fields)} || '}}' AS e FROM d),
f AS (SELECT ordinal, e, k, path, v, {_question("\"entry\":' || e || ',")} AS q, {_question("")} AS q1 FROM (SELECT ordinal, e, unnest([0, 1, 2]) AS k, unnest({list(fields)}) AS path, unnest([{", ".join(fields)}]) AS v FROM e)),
s AS (SELECT ordinal, any_value(e) AS e, CAST(sum({_tokens("q")}) AS BIGINT) AS size, max({_tokens("q")}) AS largest, {_tokens("'{\"entry\":' || any_value(e) || ',' || " + state)} + 64 + CAST(sum({_tokens("q1")}) AS BIGINT) AS alone FROM f GROUP BY ordinal),
p AS (SELECT *, {base} + largest <= {options.context} {pays} AS shares, min(ordinal) OVER (PARTITION BY e) AS first FROM s),
t AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS i, sum({size}) OVER (ORDER BY ordinal) AS upto FROM p),
j AS MATERIALIZED (SELECT a.i, greatest(a.i + 1, least(coalesce(b.i, a.i + {options.cap}), a.i + {options.cap})) AS next FROM (SELECT i, upto - {size} + {budget} - {base} AS most FROM t) a ASOF LEFT JOIN t b ON a.most < b.upto),
w AS (SELECT CAST(1 AS BIGINT) AS i UNION ALL SELECT j.next FROM w JOIN j ON j.i = w.i),
x AS (SELECT t.*, w.i AS win FROM t ASOF JOIN w ON t.i >= w.i),
y AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY ordinal) - 1 AS place FROM x WHERE ordinal = first),
g AS (SELECT y.*, f.k, f.q, f.q1, {q} AS tokens, {base} + size > {budget} AND shares AS split, first_value({q}) OVER o AS t0, nth_value({q}, 2) OVER o AS t1, nth_value({q}, 3) OVER o AS t2
 FROM y JOIN f ON f.ordinal = y.ordinal WINDOW o AS (PARTITION BY y.ordinal ORDER BY f.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
u AS (SELECT *, CASE WHEN NOT split OR k = 0 THEN 0 WHEN k = 1 THEN CASE WHEN {base} + t0 + t1 > {budget} THEN 1 ELSE 0 END
 WHEN {base} + t0 + t1 > {budget} THEN CASE WHEN {base} + t1 + t2 > {budget} THEN 2 ELSE 1 END WHEN {base} + t0 + t1 + t2 > {budget} THEN 1 ELSE 0 END AS part,
 CASE WHEN shares THEN 'entry_' || place || '_field_' || k ELSE 'field_' || k END AS name FROM g),
r AS (SELECT win, part, bool_and(shares) AS shares, count(DISTINCT ordinal) AS entries, count(*) AS questions, CASE WHEN bool_and(shares) THEN {base} + CAST(sum(tokens) AS BIGINT) ELSE any_value(alone) END AS estimated_tokens,
 sha256('{{"endpoint":"{ENDPOINT}","request":{{"model":"{config.model}","questions":{{' || string_agg('"' || name || '":' || CASE WHEN shares THEN q ELSE q1 END, ',' ORDER BY name) || '}},"state":{{' || CASE WHEN bool_and(shares) THEN '' ELSE '"entry":' || any_value(e) || ',' END || {state} || '}}}}') AS request_hash FROM u GROUP BY win, part)
"""


PACKED_SQL = packed_sql("documents", "doc_id", FIELDS, CONFIG, OPTIONS)
SPLIT_SQL = packed_sql("customer", "c_custkey", CUSTOMER_FIELDS, SPLIT_CONFIG, SPLIT_OPTIONS)
_TOLD = "SELECT request_hash, CASE WHEN shares THEN 'shared' ELSE 'entry' END AS layout, entries, questions, estimated_tokens FROM r"


def _told(rows: DataFrame, config: Config, options: BatchOptions) -> DataFrame:
    planned, path = written(plan_frame(rows, config, options), "plans")
    requests = requests_frame(members_frame(planned, windows_frame(planned, config, options), None), config, options)
    found, _ = written(preview_frame(requests, config), "preview")
    discard(rows.sparkSession, path)
    return found.select("request_hash", "layout", "entries", "questions", "estimated_tokens")


@query("packed_requests", PACKED_SQL + _TOLD)
def packed_requests(spark, d):
    """What a cold scan sends: every request by its key, with what it holds and the estimate of its tokens."""
    return _told(entries(spark, d), CONFIG, OPTIONS)


@query("split_requests", SPLIT_SQL + _TOLD)
def split_requests(spark, d):
    """The same where entries are larger than a request may be, so that each spans several."""
    return _told(customers(spark, d), SPLIT_CONFIG, SPLIT_OPTIONS)


@query("layout_choice", PACKED_SQL + "SELECT ordinal AS id, CASE WHEN shares THEN 'shared' ELSE 'entry' END AS layout FROM p")
def layout_choice(spark, d):
    return plan_frame(entries(spark, d), CONFIG, OPTIONS).select(F.col("ordinal").alias("id"), "layout")


_ALONE = f"""'{{"model":"{CONFIG.model}","questions":{{' || string_agg('"field_' || k || '":' || q1, ',' ORDER BY k) || '}},"state":{{"entry":' || any_value(e) || ',' || {_state(CONFIG)} || '}}}}'"""


@query("request_key", PACKED_SQL + f"""SELECT ordinal AS id, sha256('{{"endpoint":"{ENDPOINT}","request":' || {_ALONE}) AS request_hash FROM f GROUP BY ordinal""")
def request_key(spark, d):
    """The keys of requests that ask about one entry each."""
    return plan_frame(entries(spark, d), CONFIG).select(F.col("ordinal").alias("id"), "request_hash")


def _scanned(rows: DataFrame, make, config: Config = CONFIG, options: BatchOptions = OPTIONS) -> tuple[DataFrame, DataFrame]:
    store = shared_dir(rows.sparkSession, "store")
    found = scan_frame(rows, config, store, make, options=options)
    return found, ledger(rows.sparkSession, store)


@query("packed_scan", PACKED_SQL + "SELECT ordinal, source = '\"src7\"' AS warning, CAST(CASE WHEN source = '\"src7\"' THEN 0.9 ELSE 0.1 END AS DOUBLE) AS score, ordinal > first AS cached FROM p JOIN d USING (ordinal)")
def packed_scan(spark, d):
    found, _ = _scanned(entries(spark, d), partial(LiteralEvaluator, ("src7",)))
    return found.select("ordinal", "warning", "score", "cached")


@query("split_scan", SPLIT_SQL + "SELECT ordinal, CASE WHEN c_mktsegment = '\"MACHINERY\"' THEN '/c_mktsegment' END AS warns, count(DISTINCT part) AS requests FROM u JOIN d USING (ordinal) GROUP BY ordinal, c_mktsegment")
def split_scan(spark, d):
    """Entries whose answers come from several requests, put together: what warns, and how many requests they took."""
    found, _ = _scanned(customers(spark, d), partial(LiteralEvaluator, ("MACHINERY",)), SPLIT_CONFIG, SPLIT_OPTIONS)
    worst = F.filter("fields", lambda f: f["score"] >= 0.5)
    return found.select("ordinal", F.get(worst, 0)["path"].alias("warns"), F.size(F.from_json(F.get_json_object("usage", "$.batch_request_hashes"), "array<string>")).cast("long").alias("requests"))


@query("request_ledger_usage", PACKED_SQL + "SELECT count(*) AS api_calls, CAST(0 AS BIGINT) AS refused, count(*) * 50 AS input_tokens, CAST(0 AS BIGINT) AS output_tokens FROM r")
def request_ledger_usage(spark, d):
    """Calls and tokens of a scan, from its ledger: entries that share a request, or span two, count nothing twice."""
    return usage(_scanned(entries(spark, d), LiteralEvaluator)[1])


_HALVES = f""", h AS (SELECT request_hash, questions AS n, 0 AS depth FROM r UNION ALL SELECT request_hash, CASE WHEN side = 0 THEN n // 2 ELSE n - n // 2 END, depth + 1 FROM h, (VALUES (0), (1)) v(side) WHERE n > {MOST_QUESTIONS})
SELECT request_hash, count(*) AS calls, count(*) FILTER (WHERE n <= {MOST_QUESTIONS}) AS answered, max(depth) AS rounds FROM h GROUP BY request_hash"""


@query("context_split_calls", PACKED_SQL.rstrip() + _HALVES)
def context_split_calls(spark, d):
    """Requests that the evaluator finds too large, halved round by round: calls, answers and rounds of each."""
    calls = _scanned(entries(spark, d), FewQuestions)[1]
    root = F.max(F.when(F.col("path") == "", F.col("request_hash")))
    return calls.groupBy("window", "part").agg(root.alias("request_hash"), F.count(F.lit(1)).alias("calls"), F.count_if("answered").alias("answered"), F.max(F.length("path")).alias("rounds")).drop("window", "part")
