"""The `entries` data source: spark.read.format("entries").option("format", "csv").load(path).

Each file is a partition, and so is each range of the keys of a database's table (`ranges` of them for each chosen
table, 1 unless told). Ordinals are partition << 40 | place, so that they ascend in reading order whatever is done
to the rows later. With a `limit` all is read in turn by one task, which stops early.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.canonical import canonical

SCHEMA = "ordinal long, id string, source string, entry_json string, fields array<string>, absent array<string>"
_OWN = ("path", "format", "idcolumn", "tables", "limit", "fields", "ranges")


class Piece(NamedTuple):
    """A file, or tables of a database, or a range of a table's keys."""

    path: str
    tables: list[str] | None = None
    within: tuple[int, int] | None = None


class Part(InputPartition):
    def __init__(self, number: int, pieces: list[Piece]):
        self.number, self.pieces = number, pieces


class EntriesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _pieces(self, path: str) -> Iterator[Piece]:
        from .databases import choose, database_kind, key_ranges, tables_of

        wanted = json.loads(self.options["tables"]) if "tables" in self.options else None
        if not database_kind(path):
            yield Piece(path, wanted)
            return
        ranges = 1 if "idcolumn" in {k.lower() for k in self.options} else int(self.options.get("ranges", 1))
        for t in choose(tables_of(path), wanted):
            for within in key_ranges(path, t, ranges):
                yield Piece(path, [t.selector], within)

    def partitions(self) -> list[Part]:
        path = self.options["path"]
        files = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]
        found = [x for f in files for x in self._pieces(f)]
        if "limit" in self.options:
            return [Part(0, found)]
        return [Part(i, [x]) for i, x in enumerate(found)]

    def read(self, partition: Part) -> Iterator[tuple]:
        from .readers import reader_for

        given = {k: v for k, v in self.options.items() if k.lower() not in _OWN}
        limit = int(self.options["limit"]) if "limit" in self.options else None
        fields = json.loads(self.options["fields"]) if "fields" in self.options else None

        def rows() -> Iterator:
            for x in partition.pieces:
                yield from reader_for(x.path, self.options.get("format"), given, self.options.get("idcolumn"), fields, x.tables, x.within)()

        for n, e in enumerate(islice(rows(), limit)):
            yield partition.number << 40 | n, e.id, e.source, canonical(e.data), e.paths(), e.absent


class EntriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EntriesReader:
        return EntriesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EntriesSource)
