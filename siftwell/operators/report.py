"""Report views, filters, orders and the guarded SQL row expressions over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values. Columns of the two views, in order; the texts of JSON columns are canonical JSON.
COMMON = [("id", "string"), ("source", "string"), ("label", "string"), ("score", "double"), ("confidence", "double"), ("warning", "boolean"), ("model", "string"), ("assessed_at", "string"), ("request_hash", "string"), ("cached", "boolean"), ("absent", "string"), ("usage", "string")]
ENTRY_VIEW = [*COMMON, ("fields", "string")]
FIELD_VIEW = [*COMMON, ("path", "string"), ("value", "string"), ("probabilities", "string"), ("entry_label", "string"), ("entry_score", "double"), ("entry_confidence", "double"), ("entry_warning", "boolean")]
JSON_COLUMNS = ("absent", "usage", "fields", "value", "probabilities")


class ReportError(ValueError):
    """An option of the report that can't be honoured."""


def view_schema(rows: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in (FIELD_VIEW if rows == "fields" else ENTRY_VIEW)])


#: Calls of the row-expression dialect and what Spark calls them.
FUNCTIONS = {"regexp_matches": "regexp_like", "starts_with": "startswith", "ends_with": "endswith", "strlen": "octet_length", "list_contains": "array_contains", "list_filter": "filter", "len": "size", "json_keys": "json_object_keys", "json_extract_string": "get_json_object"}
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|->>|->|::|//|\*\*|<=>|<>|>=|<=|!=|==|\|\||=>|[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\s+|.", re.S)
_FORBIDDEN = {"select": "subqueries", "over": "window functions", "explode": "generators", "posexplode": "generators", "inline": "generators", "stack": "generators", "limit": "a limit", "union": "set operations", "rand": "random functions", "random": "random functions", "randn": "random functions", "uuid": "random functions", "shuffle": "random functions"}


#: Fixed values. Codes of strftime and strptime, and the pattern letters that Spark has for them.
DATE_CODES = {"%a": "EEE", "%A": "EEEE", "%b": "MMM", "%B": "MMMM", "%d": "dd", "%-d": "d", "%f": "SSSSSS", "%H": "HH", "%-H": "H", "%I": "hh", "%-I": "h", "%j": "DDD", "%m": "MM", "%-m": "M", "%M": "mm", "%-M": "m", "%p": "a", "%S": "ss", "%-S": "s", "%y": "yy", "%Y": "yyyy"}
_DATES = {"strftime": "date_format", "strptime": "to_timestamp_ntz", "try_strptime": "try_to_timestamp", "epoch": None}


def date_pattern(codes: str) -> str:
    """A format of percent codes as Spark's date pattern; other letters are quoted."""
    out = []
    for x in re.findall(r"%-?.|[A-Za-z]+|'|[^A-Za-z%']+|%", codes, re.S):
        if x == "%%" or x[0] != "%":
            out.append("''" if x == "'" else f"'{x}'" if x.isalpha() else x[-1] if x == "%%" else x)
        elif x in DATE_CODES:
            out.append(DATE_CODES[x])
        else:
            raise ReportError(f"the date code {x} isn't supported")
    return "".join(out)


def _tokens(text: str) -> list[str]:
    return [x for x in _TOKEN.findall(text) if not x.isspace() and not x.startswith(("--", "/*"))]


def _json_path(literal: str) -> str:
    """The variant path of the right side of -> or ->>: a key, a $ path, or a pointer."""
    from ..functions.columns import variant_paths

    text = literal[1:-1].replace("''", "'")
    if text.startswith("$"):
        return text
    return variant_paths(text)[0] if text.startswith("/") else f"$['{text}']"


def _until(found: list[str], i: int, close: str) -> int:
    """The place of the closing bracket for the opening one at i."""
    depth = 0
    for j in range(i, len(found)):
        depth += (found[j] in "([") - (found[j] in ")]")
        if not depth:
            if found[j] != close:
                break
            return j
    raise ReportError("unbalanced brackets")


def _listed(found: list[str]) -> list[list[str]]:
    """The parts of a list of tokens between its outer commas."""
    depth, parts = 0, [[]]
    for x in found:
        depth += (x in "([") - (x in ")]")
        if x == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(x)
    return parts


def _date_call(name: str, arguments: list[list[str]], sliced: str) -> str:
    """A call of a date function; the format is a literal and may stand first or last."""
    if name == "epoch":
        if len(arguments) != 1:
            raise ReportError("epoch takes one value")
        when = _translated(arguments[0], sliced)
        return f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({when} AS TIMESTAMP_NTZ)) / 1e6D)"
    literal = [len(a) == 1 and a[0][0] == "'" for a in arguments]
    if len(arguments) != 2 or not any(literal):
        raise ReportError(f"{name} takes a value and a literal format")
    at = 1 if literal[1] else 0
    value = _translated(arguments[1 - at], sliced)
    pattern = date_pattern(arguments[at][0][1:-1].replace("''", "'")).replace("\\", "\\\\").replace("'", "\\'")
    return f"{_DATES[name]}({value}, '{pattern}')"


def _extracted(arguments: list[list[str]], sliced: str) -> str:
    """json_extract of a value and a literal path: what stands there, as JSON text."""
    if len(arguments) != 2 or len(arguments[1]) != 1 or arguments[1][0][0] != "'":
        raise ReportError("json_extract takes a value and a literal path")
    path = _json_path(arguments[1][0]).replace("\\", "\\\\").replace("'", "\\'")
    return f"to_json(try_variant_get(try_parse_json({_translated(arguments[0], sliced)}), '{path}', 'variant'))"


def translated(expression: str, sliced: str = "list") -> str:
    """A row expression in Spark's SQL; refuses what isn't an expression over one row.

    Places in [] count from 1; they are taken as those of lists, or of a text's characters if sliced is "text".
    """
    found = _tokens(expression)
    if not found:
        raise ReportError("the expression is empty")
    depth = 0
    for x in found:
        if x == ";":
            raise ReportError("only one expression is allowed")
        depth += (x == "(") - (x == ")")
        if depth < 0:
            raise ReportError("unbalanced brackets")
        if x.lower() in _FORBIDDEN:
            raise ReportError(f"{_FORBIDDEN[x.lower()]} are not allowed in a row expression")
    if depth:
        raise ReportError("unbalanced brackets")
    return _translated(found, sliced)


def _translated(found: list[str], sliced: str) -> str:
    out: list[str] = []
    i = 0
    while i < len(found):
        x, low, after = found[i], found[i].lower(), found[i + 1] if i + 1 < len(found) else ""
        if low in _DATES and after == "(":
            end = _until(found, i + 1, ")")
            out.append(_date_call(low, _listed(found[i + 2 : end]), sliced))
            i = end
        elif low == "json_extract" and after == "(":
            end = _until(found, i + 1, ")")
            out.append(_extracted(_listed(found[i + 2 : end]), sliced))
            i = end
        elif low in FUNCTIONS and after == "(":
            out.append(FUNCTIONS[low])
        elif low == "lambda" and ":" in found[i:]:
            end = found.index(":", i)
            names = " ".join(x for x in found[i + 1 : end] if x not in "()")
            out.append(f"({names}) ->" if "," in names else f"{names} ->")
            i = end
        elif x in ("->", "->>") and out and after and after[0] in "'0123456789":
            path = f"$[{after}]" if after[0] != "'" else _json_path(after)
            left = _operand(out)
            quoted = path.replace("\\", "\\\\").replace("'", "\\'")  # as a SQL literal
            kind = "'string'" if x == "->>" else "'variant'"
            out.append(f"try_variant_get(try_parse_json({left}), '{quoted}', {kind})")
            i += 1
        elif x == "//":
            out.append("div")
        elif x == "**" and out:
            end = _operand_end(found, i + 1)
            out.append(f"power({_operand(out)}, {_translated(found[i + 1 : end], sliced)})")
            i = end - 1
        elif x == "[" and out and re.fullmatch(r"[\w`)\]'].*|.*[)`]", out[-1], re.S):
            end = _until(found, i, "]")
            out.append(_subscript(_operand(out), found[i + 1 : end], sliced))
            i = end
        else:
            out.append(f"`{x[1:-1]}`" if x.startswith('"') else x)
        i += 1
    return " ".join(out)


def _subscript(left: str, inside: list[str], sliced: str) -> str:
    """left[i], or left[first:last] with both ends included and either left out."""
    if ":" not in inside:
        place = _translated(inside, sliced)
        return f"substring({left}, {place}, 1)" if sliced == "text" else f"try_element_at({left}, nullif({place}, 0))"
    at = inside.index(":")
    first = f"greatest(CAST({_translated(inside[:at], sliced)} AS INT), 1)" if inside[:at] else "1"
    size = "length" if sliced == "text" else "size"
    last = f"least(CAST({_translated(inside[at + 1 :], sliced)} AS INT), {size}({left}))" if inside[at + 1 :] else f"{size}({left})"
    return f"{'substring' if sliced == 'text' else 'slice'}({left}, {first}, greatest({last} - {first} + 1, 0))"


def _operand_end(found: list[str], i: int) -> int:
    """Where the operand that starts at i ends: a sign, a name or literal, and brackets behind it."""
    while i < len(found) and found[i] in ("-", "+"):
        i += 1
    if i == len(found):
        raise ReportError("an operand is missing")
    i = _until(found, i, ")") + 1 if found[i] == "(" else i + 1
    while i < len(found) and found[i] in ("(", "["):
        i = _until(found, i, ")" if found[i] == "(" else "]") + 1
    return i


def _operand(out: list[str]) -> str:
    """Take the last operand off the output: a name, or a bracketed expression with the name before it, and its casts."""
    last = out.pop()
    parts = [last]
    if last == ")":
        depth = 1
        while depth and out:
            last = out.pop()
            depth += (last == ")") - (last == "(")
            parts.append(last)
        if out and re.fullmatch(r"[A-Za-z_]\w*", out[-1]) and out[-1].lower() not in ("and", "or", "not", "in"):
            parts.append(out.pop())
    if len(out) > 1 and out[-1] == "::":
        out.pop()
        return f"{_operand(out)} :: {' '.join(reversed(parts))}"
    return " ".join(reversed(parts))


def _bound(report: DataFrame, expression: str) -> str:
    """The expression's SQL, bound to the report's columns; places in [] are a list's, or else a text's."""
    try:
        text = translated(expression)
        _bind(report, text)
        return text
    except ReportError:
        text = translated(expression, "text")
        if text == translated(expression):
            raise
    _bind(report, text)
    return text


def where(report: DataFrame, expression: str) -> DataFrame:
    """Rows for which the expression holds, numbers being true unless 0. It's bound on an empty frame first, so
    errors come before any work."""
    return report.where(F.expr(f"CAST(({_bound(report, expression)}) AS BOOLEAN)"))


def _bind(report: DataFrame, text: str) -> None:
    from pyspark.errors import PySparkException

    try:
        empty = report.sparkSession.createDataFrame([], report.schema)
        plan = empty.select(F.expr(text).alias("x"))
        shown = plan._jdf.queryExecution().analyzed().toString()
    except PySparkException as e:
        raise ReportError(str(e).strip().splitlines()[0]) from e
    if re.search(r"\b(Aggregate|Window|Generate|scalar-subquery|exists)\b", shown):
        raise ReportError("only expressions over one row are allowed")


def order_keys(report: DataFrame, expressions: str) -> list[Column]:
    """Sort columns of an ORDER BY list: nulls last unless told otherwise, whatever the direction. ALL is every column."""
    keys = []
    for part in _listed(_tokens(expressions)):
        nulls, descending = None, False
        if len(part) > 2 and part[-2].lower() == "nulls":
            nulls, part = part[-1].lower(), part[:-2]
        if part and part[-1].lower() in ("asc", "desc"):
            descending, part = part[-1].lower() == "desc", part[:-1]
        if not part:
            raise ReportError("an order is empty")
        if [x.lower() for x in part] == ["all"] and "all" not in [c.lower() for c in report.columns]:
            columns = [F.col(f"`{c}`") for c in report.columns]
        elif len(part) == 1 and part[0].isdigit():
            number = int(part[0])
            if not 1 <= number <= len(report.columns):
                raise ReportError(f"there is no column {number}")
            columns = [F.col(f"`{report.columns[number - 1]}`")]
        else:
            columns = [F.expr(_bound(report, " ".join(part)))]
        for c in columns:
            if descending:
                keys.append(c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last())
            else:
                keys.append(c.asc_nulls_first() if nulls == "first" else c.asc_nulls_last())
    return keys


def ordered(report: DataFrame, expressions: str, ordinal: str = "ordinal") -> DataFrame:
    return report.orderBy(*order_keys(report, expressions), F.col(ordinal).asc())


def warnings_only(report: DataFrame) -> DataFrame:
    return report.where("warning")


def anomalies_only(report: DataFrame, label: str, rows: str = "entries") -> DataFrame:
    """Entries of which any field has the label; of field rows, those that have it."""
    return report.where(F.col("label") == label) if rows == "fields" else report.where(F.exists("fields", lambda f: f["label"] == label))


def sort_key(kind: str, label: str | None = None, rows: str = "entries") -> Column:
    """score or confidence; with a label, entries sort by the greatest confidence among the fields that have it."""
    if kind == "score":
        return F.col("score")
    if label is not None and rows == "entries":
        return F.array_max(F.transform(F.filter("fields", lambda f: f["label"] == label), lambda f: f["confidence"]))
    return F.col("confidence")


def check_sorts(score: bool, confidence: bool, order_by: str | None) -> None:
    if sum((bool(score), bool(confidence), order_by is not None)) > 1:
        raise ReportError("only one of the sort options may be given")
