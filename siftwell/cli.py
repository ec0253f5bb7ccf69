"""Command line: preview, scan, formats, tables."""

from __future__ import annotations

import argparse
import copy
import functools
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

from .functions.canonical import canonical, present, scalar_id
from .operators.config import Config, load_config, with_inputs
from .operators.planner import BatchOptions, preview
from .operators.report import check_sorts
from .operators.scan import Stats, Store, scan
from .operators.selection import Selection, SelectionError
from .operators.sinks import filtered, guarded, queried, report_rows, sorted_rows, write_rows
from .sources.readers import FORMATS, Entry, reader_for


class Selecting:
    """A selection applied to a stream, counting what it skips and why."""

    def __init__(self, selection: Selection):
        self.selection, self.seen, self.kept = selection, 0, 0
        self.causes: Counter[str] = Counter()
        self.met: Counter[str] = Counter()

    def apply(self, entries: Iterable[Entry]) -> Iterator[Entry]:
        for e in entries:
            self.seen += 1
            if not self.selection.all:
                self.kept += 1
                yield e
                continue
            there = [p for p in self.selection.all if present(e.data, p)]
            self.met.update(there)
            blocking = [p for p in self.selection.required if p not in there] if there else list(self.selection.all)
            if blocking:
                self.causes.update(blocking)
                continue
            self.kept += 1
            yield Entry(e.id, e.data, there, e.source, [p for p in self.selection.all if p not in there])

    def verify(self, complete: bool) -> None:
        if not self.seen or not complete:
            return
        missing = [p for p in self.selection.all if not self.met[p]]
        if missing:
            raise SelectionError("Field does not exist: " + ", ".join(missing))
        if self.selection.all and not self.kept:
            raise SelectionError("no entry has all the required fields together")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftwell")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("preview", "scan"):
        p = commands.add_parser(name)
        p.add_argument("file")
        for x in ("--config", "--guidance", "--guidance-file", "--exemplars", "--model", "--id-column", "--format"):
            p.add_argument(x)
        p.add_argument("--batch-size", default="1")
        p.add_argument("--batch-tokens", type=int, default=48_000)
        p.add_argument("--field", "-f", action="append", default=[])
        p.add_argument("--optional-field", action="append", default=[])
        p.add_argument("--relaxed", action="store_true")
        p.add_argument("--output", "-o")
        p.add_argument("--format-option", action="append", default=[])
        p.add_argument("--table", action="append", default=[])
        p.add_argument("--limit", "-l", type=int, default=3 if name == "preview" else None)
        if name == "scan":
            p.add_argument("--cache", default=".siftwell-answers.jsonl")
            for x in (("--no-cache",), ("--refresh",), ("--warnings-only", "-w"), ("--anomalies-only", "-a"), ("--sort-score",), ("--sort-confidence", "-s")):
                p.add_argument(*x, action="store_true")
            p.add_argument("--threshold", "-t", type=float)
            p.add_argument("--output-format", "-O", choices=("jsonl", "csv", "yaml"), default="jsonl")
            p.add_argument("--rows", choices=("entries", "fields"), default="entries")
            p.add_argument("--where")
            p.add_argument("--order-by")
    p = commands.add_parser("formats")
    p.add_argument("name", nargs="?")
    p = commands.add_parser("tables")
    p.add_argument("file")
    p.add_argument("--format")
    return top


def _options(given: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in given:
        k, eq, v = x.partition("=")
        if not eq or not k:
            raise ValueError(f"a format option is KEY=VALUE, not {x!r}")
        if k in out:
            raise ValueError(f"format option {k} is given twice")
        out[k] = v
    return out


def _renamed(parser, id_column: str):
    """A copy of a parser with another id column, so that its own one isn't asked for; the parser itself if it
    has none. Partial functions and objects with an id_column are known."""
    if isinstance(parser, functools.partial) and "id_column" in parser.keywords:
        return functools.partial(parser, id_column=id_column)
    if hasattr(parser, "id_column"):
        parser = copy.copy(parser)
        parser.id_column = id_column
    return parser


def _source(a: argparse.Namespace, config: Config) -> Iterator[Entry]:
    if config.parser is not None:
        if a.format or a.format_option or a.table:
            raise ValueError("a parser of the configuration has no format options")
        parser = _renamed(config.parser, a.id_column) if a.id_column else config.parser
        for e in parser(a.file):
            if a.id_column and parser is config.parser:  # it has no id column of its own to replace
                e.id = scalar_id(e.data[a.id_column])
            yield e
        return
    yield from reader_for(a.file, a.format, _options(a.format_option), a.id_column, None, a.table or None)()


def run(argv: list[str] | None = None, spark=None, evaluator=None) -> int:
    """The command; 0 done, 1 failed, 2 misused, 130 interrupted. Results go to stdout or the output, the rest to stderr."""
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return _run(a, spark, evaluator)
    except KeyboardInterrupt:
        return 130
    except (ValueError, RuntimeError, OSError, LookupError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark, evaluator) -> int:
    if a.command == "formats":
        if a.name and a.name not in FORMATS:
            raise ValueError(f"unknown format {a.name!r}")
        for f in [FORMATS[a.name]] if a.name else FORMATS.values():
            print(f"{f.name}: {f.about} ({' '.join(f.suffixes)}); options: {', '.join(f'{k}={v!r}' for k, v in f.options.items()) or 'none'}")
        return 0
    if a.command == "tables":
        from .sources.databases import tables_of

        for t in tables_of(a.file):
            print(canonical(t.row()))
        return 0
    options = BatchOptions("auto" if a.batch_size == "auto" else int(a.batch_size), a.batch_tokens)
    if a.limit is not None and a.limit < 1:
        raise ValueError("the limit must be positive")
    if a.command == "scan":
        check_sorts(a.sort_score, a.sort_confidence, a.order_by)
    config = with_inputs(load_config(a.config) if a.config else Config(), a.guidance, a.guidance_file, a.exemplars, a.model, getattr(a, "threshold", None))
    selecting = Selecting(Selection.of(a.field, a.optional_field, a.relaxed))
    cache = None if a.command == "preview" or a.no_cache else a.cache
    output = guarded(a.output, a.file, a.config, a.guidance_file, a.exemplars, cache)
    # the limit counts entries to assess, and not one more is read
    entries = islice(selecting.apply(_source(a, config)), a.limit)
    if a.command == "preview":
        rows: Iterable[dict] = preview(entries, config, options)
        kind, view = "jsonl", "entries"
    else:
        stats, kind, view = Stats(), a.output_format, a.rows
        store = Store(cache) if cache else None
        if a.where or a.order_by:
            queried(spark or _session(), [], view, a.where, a.order_by)  # fails before anything is asked
        counts: Counter[str] = Counter()

        def results() -> Iterator[dict]:
            for r in scan(entries, config, store=store, refresh=a.refresh, evaluator=evaluator, options=options, stats=stats):
                counts.update(assessed=1, cached=int(r.cached), warnings=int(r.warning))
                yield from filtered(report_rows(r, view, config.threshold), view, a.warnings_only or a.threshold is not None, config.anomaly_label if a.anomalies_only else None)

        rows = results()
        if a.where or a.order_by:
            rows = queried(spark or _session(), list(rows), view, a.where, a.order_by)
        if a.sort_score or a.sort_confidence:
            rows = sorted_rows(list(rows), view, "score" if a.sort_score else "confidence", config.anomaly_label if a.anomalies_only else None)
    if output:
        with open(output, "w", encoding="utf-8", newline="") as f:
            n = write_rows(f, rows, kind, view)
    else:
        n = write_rows(sys.stdout, rows, kind, view)
    selecting.verify(a.limit is None or selecting.kept < a.limit)
    if a.command == "scan":
        print(f"assessed {counts['assessed']}, cached {counts['cached']}, warnings {counts['warnings']}, emitted {n}; api calls {stats.api_calls}, tokens in {stats.input_tokens}, out {stats.output_tokens}", file=sys.stderr)
    skipped = selecting.seen - selecting.kept
    if skipped:
        print(f"skipped {skipped}: " + ", ".join(f"{k} missing in {v}" for k, v in selecting.causes.most_common()), file=sys.stderr)
    return 0


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()


def main() -> None:
    sys.exit(run())


if __name__ == "__main__":
    main()
