"""Landed sentiment files as a data source: ``spark.read.format("landed_sentiment")``.

Options: ``path`` (folder of JSON-lines files, searched with its subfolders) and ``sources`` (comma
list, optional). Files are read in ranges of bytes; a vendor adapter overrides
``SentimentReader.rows``. Files in just this format are read faster by ``spark.read.json``.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "ticker string, date date, source string, score double, volume bigint"
ARROW = pa.schema([("ticker", pa.string()), ("date", pa.date32()), ("source", pa.string()), ("score", pa.float64()), ("volume", pa.int64())])
#: Bytes of a partition, rows of a batch.
SPLIT, BATCH = 64 << 20, 10_000


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a local path or a URI."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class FilePartition(InputPartition):
    """The lines of a file that start in a range of bytes."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class SentimentReader(DataSourceReader):
    def __init__(self, path: str, sources: set[str], split: int = SPLIT):
        self.path, self.sources, self.split = path, sources, split

    def partitions(self) -> list[InputPartition]:
        system, folder = open_folder(self.path)
        files = [f for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file and f.path.endswith(".json")]
        return [FilePartition(f.path, k, min(k + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for k in range(0, f.size, self.split)]

    def rows(self, path: str, start: int, end: int) -> Iterator[dict]:
        """The records of the lines that start in the range; the last may end beyond it."""
        system, _ = open_folder(self.path)
        with system.open_input_file(path) as file:
            # a line starts at the range's start if the byte before is a line end
            at = max(0, start - 1)
            file.seek(at)
            rest, skip = b"", start > 0
            while at < end:
                if not (chunk := file.read(1 << 20)):
                    break
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    if skip:
                        skip = False
                    elif at < end and line.strip():
                        yield json.loads(line)
                    at += len(line) + 1
            else:
                return
            if rest.strip() and not skip and at < end:
                yield json.loads(rest)

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        wanted = (r for r in self.rows(partition.path, partition.start, partition.end) if not self.sources or r["source"] in self.sources)
        while batch := list(islice(wanted, BATCH)):
            yield pa.RecordBatch.from_pylist([{**r, "date": dt.date.fromisoformat(r["date"])} for r in batch], schema=ARROW)


class LandedSentiment(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_sentiment"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        names = self.options.get("sources", "")
        return SentimentReader(self.options["path"], {s.strip() for s in names.split(",") if s.strip()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedSentiment)
