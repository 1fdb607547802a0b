"""A streaming source with offsets of its own over an archive of published segments.

``spark.readStream.format("offset_archive").schema(...).option("path", home).option("order", "offset").load()``: the offset of
the stream is the last value of the order column that it has given, so it can begin behind any row (option ``after``) and a
replay reads exactly the rows of its range again. Segments come from the commits; what is not committed does not exist.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class FilePart(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


class Reader(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.schema, self.home, self.order = schema, options["path"].rstrip("/"), options.get("order", "offset")
        self.first = int(options.get("after", "-1"))

    def segments(self) -> list[dict]:
        files, home = opened(self.home)
        found = files.get_file_info(fs.FileSelector(f"{home}/commits", allow_not_found=True))
        return [json.loads(files.open_input_stream(f.path).readall()) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith((".", "_"))]

    def initialOffset(self) -> dict:
        return {"after": self.first}

    def latestOffset(self) -> dict:
        return {"after": max([self.first, *(s["last"] for s in self.segments())])}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        """A task a file of the segments that meet (start, end]."""
        files, home = opened(self.home)
        parts = []
        for s in self.segments():
            if s["last"] > start["after"] and s["first"] <= end["after"]:
                found = files.get_file_info(fs.FileSelector(f"{home}/data/attempt={s['attempt']}"))
                prefix = self.home.removesuffix(home) if ":/" in self.home else ""
                parts += [FilePart(prefix + f.path, start["after"], end["after"]) for f in found if f.base_name.endswith(".parquet")]
        return parts

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        files, path = opened(partition.path)
        wanted = to_arrow_schema(self.schema)
        with files.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=list(dict.fromkeys([*wanted.names, self.order]))):
                at = batch.column(self.order)
                kept = batch.filter(pc.and_(pc.greater(at, partition.after), pc.less_equal(at, partition.upto)))
                yield pa.RecordBatch.from_arrays([kept.column(f.name).cast(f.type) for f in wanted], schema=wanted)

    def commit(self, end: dict) -> None:
        """Nothing to release: segments are immutable."""


class OffsetArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "offset_archive"

    def schema(self):
        raise ValueError("offset_archive needs .schema(...)")

    def streamReader(self, schema) -> Reader:
        return Reader(schema, self.options)
