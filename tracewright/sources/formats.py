"""Exports and bundles as formats of spark.read, by Python data sources.

    register(spark)
    spark.read.format("tracewright_export").option("lines", "true").load(folder)   # payload
    spark.read.format("tracewright_bundle").load(file)                             # the columns of knowledge.OBJECT

A task reads a file, or of a file whose rows are single lines a stretch of SPLIT bytes. Files are opened with pyarrow, so they must lie where it can: a mounted
path, HDFS, S3 or GCS; Spark's own readers (readers.read_export, knowledge.load_bundle) also reach other stores.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a task's stretch of a file of single lines.
SPLIT = 64 << 20
#: Rows of an Arrow batch.
ROWS = 2_000


@dataclass
class Stretch(InputPartition):
    """Lines that begin in start .. end of a file; the whole file if end is None."""

    path: str
    start: int
    end: int | None


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files but those whose names begin with a dot or underscore, in order."""
    from pyarrow import fs

    store, top = _store(path)
    info = store.get_file_info(top)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((scheme + f.path if scheme and not f.path.startswith(scheme) else f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in ("_", "."))


def _lines(part: Stretch) -> Iterator[str]:
    """The lines that begin in a stretch, whole; the one that the stretch begins in belongs to the stretch before."""
    store, at = _store(part.path)
    with store.open_input_file(at) as f:
        size = f.size()
        place = part.start
        if place:
            f.seek(place - 1)
            place = place - 1 + len(_line(f))
        f.seek(place)
        while place < min(part.end, size):
            line = _line(f)
            place += len(line)
            yield line.decode("utf-8", "replace")


def _line(f) -> bytes:
    """The rest of a line with its end, from a buffered file."""
    found = bytearray()
    while True:
        start = f.tell()
        block = f.read(1 << 16)
        if not block:
            return bytes(found)
        end = block.find(b"\n")
        if end >= 0:
            f.seek(start + end + 1)
            return bytes(found) + block[: end + 1]
        found += block


def _rows(part: Stretch) -> Iterator[list[str]]:
    if part.end is not None:
        yield from csv.reader(_lines(part))
        return
    store, at = _store(part.path)
    with store.open_input_stream(at) as f:
        yield from csv.reader(io.TextIOWrapper(f, "utf-8", "replace", newline=""))


class _Files(DataSourceReader):
    """Reads stretches; the columns of a row are those of the schema."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.lines, self.names = options["path"], str(options.get("lines", "false")).lower() == "true", schema.names
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        return [Stretch(p, a, min(a + self.split, n)) if self.lines else Stretch(p, 0, None) for p, n in _files(self.path) if n for a in (range(0, n, self.split) if self.lines else [0])]


class _ExportReader(_Files):
    """Of a header-less table the column that most often looks like a payload, as readers.payload_column tells it by the first file's first rows."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        from tracewright.sources.readers import LEAST, SAMPLE, TAGS

        first = []
        for p, n in _files(self.path)[:1]:
            for row in _rows(Stretch(p, 0, n if self.lines else None)):
                first.append(row)
                if len(first) == SAMPLE:
                    break

        def fits(text: str) -> bool:
            at = [text.find(f"{t}=") for t in TAGS]
            return 0 <= at[0] < at[1] < at[2] and text[at[1] + len(TAGS[1]) + 1 :][:1].isdigit()

        share = [sum(len(r) > c and fits(r[c]) for r in first) / len(first) for c in range(max(map(len, first), default=0))]
        self.column = share.index(max(share)) if share and max(share) >= LEAST else None

    def read(self, part: Stretch):
        import pyarrow as pa

        if part is None:  # no files
            return
        if self.column is None:
            raise ValueError(f"{self.path}: no column looks like a payload")
        held = []
        for row in _rows(part):
            if row:
                held.append(row[self.column] if len(row) > self.column and row[self.column] else None)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], self.names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], self.names)


class _BundleReader(_Files):
    """The objects of each file's bundle. A file is one task."""

    def read(self, part: Stretch):
        from pyspark.sql.types import Row

        if part is None:
            return
        store, at = _store(part.path)
        with store.open_input_stream(at) as f:
            objects = json.load(io.TextIOWrapper(f, "utf-8"))["objects"]
        for o in objects:
            yield Row(*[_shaped(o.get(f.name), f.dataType) for f in self.schema.fields])

    def __init__(self, options: dict, schema: StructType):
        super().__init__({**options, "lines": "false"}, schema)
        self.schema = schema


def _shaped(value, kind):
    """A JSON value as a type of the schema; what has another shape is null."""
    name = kind.typeName()
    if value is None:
        return None
    if name == "array":
        return [_shaped(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if name == "struct":
        return tuple(_shaped(value.get(f.name), f.dataType) for f in kind.fields) if isinstance(value, dict) else None
    if name == "boolean":
        return value if isinstance(value, bool) else None
    return value if isinstance(value, str) else json.dumps(value)


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracewright_export"

    def schema(self) -> str:
        return "payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ExportReader(self.options, schema)


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracewright_bundle"

    def schema(self) -> str:
        from tracewright.operators.knowledge import OBJECT

        return OBJECT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BundleReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(ExportSource)
    spark.dataSource.register(BundleSource)


def read_export(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """readers.read_export through the format: a row each with Timestamp, EventID, Hostname, Message and labelled values. lines: rows are single lines, so files are split over tasks. A table without a payload column is an error."""
    from tracewright.sources.readers import export_rows

    register(spark)
    return export_rows(spark.read.format("tracewright_export").option("lines", str(lines).lower()).load(path))
