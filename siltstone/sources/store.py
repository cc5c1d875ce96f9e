"""A paged store as a format of Spark: scans by part, page after page, with columns and filters asked of the store, and as a stream of new parts.

A store is a port: option `client` names a factory (`module:function`) that is given the other options and makes an object with

* parts() -> names of what can be scanned independently, in the order in which they came; each is a task, so no scan is capped on the driver, and new ones come last;
* scroll(part, cursor, limit, columns, equal) -> (rows as dicts, next cursor or None): a page of a part, from cursor (None first), of the columns asked for, and of
  rows whose columns have the values in `equal` alone.

The default client, Pages, is a folder of JSON-lines files. Equality with a constant is the store's work, all other filters are Spark's; columns are those of the schema
that is asked for: `spark.read.format("store").schema("doc_id long, text string").load(folder)`.

Cases: a field that a row lacks is null; other fields are left out; lines that are no JSON objects are left out, as are blank ones; no parts give no rows.
"""

from __future__ import annotations

import importlib
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a page.
LIMIT = 1000


class Pages:
    """A folder of JSON-lines files, each a part; a cursor is the place of a line."""

    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.fs, self.path = pa.fs.FileSystem.from_uri(path if "://" in path else re.sub("^(file:)?/", "file:///", path))

    def parts(self) -> list[str]:
        found = self.fs.get_file_info(pa.fs.FileSelector(self.path, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.base_name.endswith((".json", ".jsonl")) and not f.base_name.startswith((".", "_")))

    def scroll(self, part: str, cursor: int | None, limit: int, columns: list[str], equal: dict) -> tuple[list[dict], int | None]:
        rows: list[dict] = []
        with io.BufferedReader(self.fs.open_input_file(part)) as f:
            f.seek(cursor or 0)
            while len(rows) < limit:
                line = f.readline()
                if not line:
                    return rows, None
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if isinstance(row, dict) and all(row.get(c) == v for c, v in equal.items()):
                    rows.append({c: row.get(c) for c in columns})
            return rows, f.tell()


def _client(options: dict[str, str]):
    module, _, name = options.get("client", f"{__name__}:Pages").partition(":")
    return getattr(importlib.import_module(module), name)(options)


class _Part(InputPartition):
    def __init__(self, part: str):
        self.part = part


class _Scan:
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema, self.equal = options, schema, {}

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no parts
            return
        client, kinds, cursor = _client(self.options), to_arrow_schema(self.schema), None
        while True:
            rows, cursor = client.scroll(partition.part, cursor, int(self.options.get("limit", LIMIT)), self.schema.names, self.equal)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
            if cursor is None:
                return


class StoreReader(_Scan, DataSourceReader):
    def pushFilters(self, filters):
        """Keeps equality with a constant for the store, one for each column; gives all else back."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] not in self.equal and isinstance(f.value, (str, int)):
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        return [_Part(p) for p in _client(self.options).parts()]


class StoreStream(_Scan, DataSourceStreamReader):
    """Parts as they come: an offset is the number of parts before."""

    def initialOffset(self) -> dict:
        return {"parts": 0}

    def latestOffset(self) -> dict:
        return {"parts": len(_client(self.options).parts())}

    def partitions(self, start: dict, end: dict):
        return [_Part(p) for p in _client(self.options).parts()[start["parts"] : end["parts"]]]


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "store"

    def schema(self) -> str:
        return "doc_id long, text string"

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> StoreStream:
        return StoreStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets sources of its kind take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)


def scanned(spark: SparkSession, path: str, schema: str = "doc_id long, text string", **options: str) -> DataFrame:
    """The rows of a store with the columns of schema."""
    register(spark)
    return spark.read.format("store").schema(schema).options(**options).load(path)
