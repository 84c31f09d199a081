"""A data source for logs and datasets of records: partitions with bounds, pruning by filters, and a commit in two phases.

``register(spark)``, then ``format("routelens_records")``. A folder holds JSON lines in ``data`` and a
manifest for each commit in ``commits``. Tasks write files of their own, which nobody reads until the driver writes the
manifest that names them, so an aborted write leaves what was there. A commit named by the option ``batch`` is made
once: the same append tried again changes nothing. An overwrite is a manifest that tells readers to begin with it.

Paths are read by pyarrow's file systems, on executors as on the driver: a local folder that all share, or a store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Lines of a file at most.
FILE_LINES = 100_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _commits(path: str) -> list[dict]:
    """Manifests in the order of their numbers, from the last overwrite on."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    out: list[dict] = []
    for info in sorted((f for f in found if f.base_name.endswith(".json")), key=lambda f: f.base_name):
        with store.open_input_stream(info.path) as held:
            told = json.loads(held.read())
        out = [told] if told["overwrite"] else [*out, told]
    return out


@dataclass
class Part(InputPartition):
    """One file."""

    name: str


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, with the least and greatest value of each column in them."""

    files: list


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with a value choose files by their bounds; Spark still looks at every row."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1:
                self.filters.append(f)
            yield f

    def _able(self, bounds: dict) -> bool:
        for f in self.filters:
            if f.attribute[0] not in bounds:
                return False  # all its values are null
            low, high = bounds[f.attribute[0]]
            given = f.value
            try:
                if isinstance(f, In):
                    able = any(low <= v <= high for v in given if v is not None)
                elif isinstance(f, EqualTo):
                    able = low <= given <= high
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    able = high >= given
                else:
                    able = low <= given
            except TypeError:  # not comparable: leave it to Spark
                able = True
            if not able:
                return False
        return True

    def partitions(self) -> list[Part]:
        return [Part(f["name"]) for c in _commits(self.path) for f in c["files"] if self._able(f["bounds"])]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition is None:  # Spark's way of reading no partitions
            return
        store, root = _store(self.path)
        names = self.schema.names
        with store.open_input_stream(f"{root}/data/{partition.name}") as held:
            for line in held.read().decode().splitlines():
                row = json.loads(line)
                yield tuple(row.get(n) for n in names)


class Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, batch: str | None, overwrite: bool) -> None:
        self.path, self.names, self.batch, self.overwrite = path, schema.names, batch, overwrite

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/data", recursive=True)
        files, lines, bounds = [], [], {}

        def flush() -> None:
            nonlocal lines, bounds
            name = f"{uuid.uuid4().hex}.jsonl"
            with store.open_output_stream(f"{root}/data/{name}") as out:
                out.write("".join(lines).encode())
            files.append({"name": name, "rows": len(lines), "bounds": bounds})
            lines, bounds = [], {}

        for row in iterator:
            told = {n: v for n, v in zip(self.names, row, strict=True) if v is not None}
            lines.append(json.dumps(told, ensure_ascii=True) + "\n")
            for n, v in told.items():
                if isinstance(v, (str, int, float)):
                    low, high = bounds.get(n, (v, v))
                    bounds[n] = (min(low, v), max(high, v))
            if len(lines) == FILE_LINES:
                flush()
        if lines:
            flush()
        return Written(files)

    def commit(self, messages: list) -> None:
        """The manifest is written beside and renamed, so that readers see all of it or nothing."""
        store, root = _store(self.path)
        store.create_dir(f"{root}/commits", recursive=True)
        there = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/commits")) if f.base_name.endswith(".json")]
        if self.batch and any(name.partition("-")[2] == f"{self.batch}.json" for name in there):
            self.abort(messages)
            return
        number = 1 + max([0, *(int(name.partition("-")[0]) for name in there)])
        told = {"batch": self.batch, "overwrite": self.overwrite, "files": [f for m in messages if m for f in m.files]}
        draft = f"{root}/commits/{uuid.uuid4().hex}.draft"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(told).encode())
        store.move(draft, f"{root}/commits/{number:012d}-{self.batch or uuid.uuid4().hex}.json")

    def abort(self, messages: list) -> None:
        """Files that tasks have told of go; those of lost tasks are named by no manifest."""
        store, root = _store(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{root}/data/{f['name']}")


class Records(DataSource):
    """Options: path; columns (the schema to read, as DDL); batch (the name of an append)."""

    @classmethod
    def name(cls) -> str:
        return "routelens_records"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, self.options.get("batch"), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)
