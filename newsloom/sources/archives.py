"""Import files as a data source: ``spark.read.format("article_files").load(path)``.

CSV files and ZIPs of CSV files below a folder (or one file) are read with a partition for
each CSV, in a ZIP for each member; rows are streamed, and a member is never unpacked
whole. UTF-8 with or without a mark is tried first, then cp1251, in a pass over the bytes.
A schema that is given (``.schema("title string, text string")``) names the columns that
are read; others are never built. Paths may be of any file system that pyarrow opens.

Options: ``preferred``, a member's name that alone is read of the ZIPs that have it.
A file without a header, or without the columns that are needed, is an error that names it.
"""

from __future__ import annotations

import csv
import io
import os
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .readers import COLUMNS, ENCODINGS, BadImport

ROWS, BYTES = 5000, 8 << 20  # of a batch at most


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or os.path.isabs(path) else os.path.abspath(path))


def opens(path: str) -> bool:
    """Whether pyarrow can read the file of a path as Spark gives it."""
    try:
        fs, own = opened(path.removeprefix("file:"))
        with fs.open_input_file(own):
            return True
    except (OSError, ValueError):
        return False


def members(path: str) -> list[Member]:
    """A file itself, or the .csv members of a ZIP."""
    path = path.removeprefix("file:")
    if not path.lower().endswith(".zip"):
        return [Member(path, None)]
    fs, own = opened(path)
    with fs.open_input_file(own) as f, zipfile.ZipFile(f) as z:
        found = [m for m in z.namelist() if m.lower().endswith(".csv")]
    if not found:
        raise BadImport("the archive holds no CSV file")
    return [Member(path, m) for m in found]


@dataclass
class Member(InputPartition):
    path: str
    name: str | None  # in a ZIP

    def open(self) -> BinaryIO:
        fs, path = opened(self.path)
        f = fs.open_input_file(path)
        return zipfile.ZipFile(f).open(self.name) if self.name else f

    def encoding(self) -> str:
        """The first of ENCODINGS that all bytes are valid in."""
        for name in ENCODINGS:
            with self.open() as f, io.TextIOWrapper(f, name, newline="") as text:
                try:
                    while text.read(1 << 20):
                        pass
                    return name
                except UnicodeDecodeError:
                    continue
        raise BadImport(f"{self} is neither UTF-8 nor cp1251")

    def __str__(self) -> str:
        return self.path if self.name is None else f"{self.path}: {self.name}"


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.preferred, self.schema = options["path"], options.get("preferred"), schema

    def partitions(self) -> list[InputPartition]:
        fs, path = opened(self.path)
        kind = fs.get_file_info(path)
        found = [kind] if kind.is_file else sorted((x for x in fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if x.is_file), key=lambda x: x.path)
        out: list[InputPartition] = []
        scheme = self.path.split("://", 1)[0] + "://" if "://" in self.path else ""
        for x in found:
            name = x.path.lower()
            full = scheme + x.path if scheme else x.path
            if name.endswith(".csv"):
                out.append(Member(full, None))
            elif name.endswith(".zip"):
                with fs.open_input_file(x.path) as f, zipfile.ZipFile(f) as z:
                    own = [m for m in z.namelist() if m.lower().endswith(".csv")]
                if not own:
                    raise BadImport(f"{x.path} holds no CSV file")
                out += [Member(full, m) for m in [m for m in own if m.split("/")[-1] == self.preferred] or own]
        if not out:
            raise BadImport(f"no CSV or ZIP file below {self.path}")
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        wanted = [f.name for f in self.schema.fields]
        kinds = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f in self.schema.fields])
        name = partition.name or partition.path.rsplit("/", 1)[-1]
        with partition.open() as f, io.TextIOWrapper(f, partition.encoding(), newline="") as text:
            rows = csv.reader(text)
            header = next(rows, None)
            if not header:
                raise BadImport(f"{partition} is empty")
            if not {"title", "text"} <= set(header) or not {"date", "published_at"} & set(header):
                raise BadImport(f"{partition} lacks title, text or a date")
            at = {c: header.index(c) for c in wanted if c in header}
            held: list[list] = [[] for _ in wanted]
            size = 0

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(held, kinds, strict=True)], schema=kinds)

            for line, row in enumerate(rows, 2):
                if not row:
                    continue
                for column, c in zip(held, wanted, strict=True):
                    i = at.get(c)
                    column.append(name if c == "file" else line if c == "line" else row[i] if i is not None and i < len(row) else None)
                size += sum(map(len, row))
                if len(held[0]) >= ROWS or size >= BYTES:
                    yield batch()
                    held, size = [[] for _ in wanted], 0
            if held[0]:
                yield batch()


class ArticleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "article_files"

    def schema(self) -> StructType:
        return StructType([StructField("file", StringType()), StructField("line", LongType()), *[StructField(c, StringType()) for c in COLUMNS]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options), schema)


def read(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(ArticleFiles)
    r = spark.read.format("article_files").options(**options)
    return (r.schema(schema) if schema else r).load(path)


def zipped(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Write df as ZIP files of CSV files of at most ``rows`` rows, one ZIP for each partition that has any, and for the first.

    Rows stream into their file, and a ZIP appears under its name when it is whole.
    """
    columns = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000))
        first = next(parts, None)
        if first is None and TaskContext.get().partitionId():
            return
        fs, top = opened(path)
        fs.create_dir(top, recursive=True)
        number, n = TaskContext.get().partitionId(), 0
        name, temporary = f"{top}/part-{number:05d}.zip", f"{top}/.part-{number:05d}-{TaskContext.get().taskAttemptId()}"
        part = first
        with fs.open_output_stream(temporary) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            member = 0
            while part is not None or member == 0:
                held = 0
                with z.open(f"rows-{member}.csv", "w", force_zip64=True) as m, io.TextIOWrapper(m, "utf-8", newline="") as text:
                    out = csv.writer(text)
                    out.writerow(columns)
                    while part is not None and held < rows:
                        own = part.slice(0, rows - held)
                        out.writerows(zip(*[c.to_pylist() for c in own.columns], strict=True))
                        held, n = held + own.num_rows, n + own.num_rows
                        part = part.slice(own.num_rows) if own.num_rows < part.num_rows else next(parts, None)
                member += 1
        fs.move(temporary, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "rows": [n]})

    df.mapInArrow(write, "file string, rows long").collect()  # a row for each file
