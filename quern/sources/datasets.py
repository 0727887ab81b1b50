"""A dataset class of one's own as a table and as a stream.

The class takes a mapping of options and has a length and items by number, each a tuple of the schema's values. Ranges of
numbers are the partitions, and each task makes an instance for itself. As a stream, an offset is a number of items: what the
class has grown by since the last batch is the next one, and ``committed(number)``, if the class has it, hears what is done.
"""

from __future__ import annotations

import bisect
import importlib.util
import json
from collections.abc import Iterator
from typing import Any

import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ROWS_A_PARTITION = 10_000
#: Most partitions of a table: beyond, each gets more rows. Rows of a Parquet file that are held at a time.
MOST_PARTITIONS, HELD_ROWS = 1000, 4096


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


def _ranges(first: int, last: int, size: int) -> list[Range]:
    size = max(size, -(-(last - first) // MOST_PARTITIONS))
    return [Range(at, min(at + size, last)) for at in range(first, last, size)]


def _items(kind: type, options: dict[str, str], part: Range) -> Iterator[tuple]:
    dataset = kind(options)
    for i in range(part.first, part.last):
        yield tuple(dataset[i])


class _Reader(DataSourceReader):
    def __init__(self, kind: type, options: dict[str, str], size: int):
        self.kind, self.options, self.size = kind, options, size

    def partitions(self) -> list[Range]:
        return _ranges(0, len(self.kind(self.options)), self.size) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _items(self.kind, self.options, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, kind: type, options: dict[str, str], size: int):
        self.kind, self.options, self.size = kind, options, size

    def initialOffset(self) -> dict[str, int]:  # noqa: N802  Spark's name
        return {"items": 0}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        return {"items": len(self.kind(self.options))}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        return _ranges(start["items"], end["items"], self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return _items(self.kind, self.options, partition)

    def commit(self, end: dict[str, int]) -> None:
        done = getattr(self.kind, "committed", None)
        if done:
            done(self.kind(self.options), end["items"])


class ParquetRows:
    """Rows of some columns of a Parquet file by number.

    A row group is read in batches, and only the batch with the wanted row becomes Python's rows; rows in order read each once.
    """

    def __init__(self, options: dict[str, str]):
        fs, path = pyarrow.fs.FileSystem.from_uri(options["path"])
        self.file, self.columns = pq.ParquetFile(fs.open_input_file(path)), options["columns"].split(",")
        sizes = [self.file.metadata.row_group(g).num_rows for g in range(self.file.num_row_groups)]
        self.starts = [sum(sizes[:g]) for g in range(len(sizes))]
        self.rows, self.group, self.held = sum(sizes), -1, []
        self.first = self.next = 0

    def __len__(self) -> int:
        return self.rows

    def __getitem__(self, i: int) -> tuple:
        if not 0 <= i < self.rows:
            raise IndexError(i)
        if not self.first <= i < self.first + len(self.held):
            self._hold(i)
        return self.held[i - self.first]

    def _hold(self, i: int) -> None:
        group = bisect.bisect_right(self.starts, i) - 1
        if self.group != group or i < self.next:
            self.group, self.next = group, self.starts[group]
            self.batches = self.file.iter_batches(HELD_ROWS, row_groups=[group], columns=self.columns)
        while self.next <= i:
            batch = next(self.batches)
            self.first, self.next = self.next, self.next + batch.num_rows
        self.held = list(zip(*(batch.column(c).to_pylist() for c in self.columns), strict=True))


def load_class(path: str, name: str) -> type:
    """A dataset class of a Python file; it must have a length and items."""
    spec = importlib.util.spec_from_file_location("dataset_class", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    kind = getattr(module, name, None)
    if not isinstance(kind, type) or not all(hasattr(kind, x) for x in ("__len__", "__getitem__")):
        raise TypeError(f"{path} has no class {name!r} with a length and items")
    return kind


def _source(kind: type, schema: str) -> type[DataSource]:
    class Dataset(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"quern_{kind.__name__.lower()}"

        def schema(self) -> str:
            return schema

        def _own(self) -> tuple[type, dict[str, Any], int]:
            return kind, json.loads(self.options.get("own", "{}")), int(self.options.get("rows", ROWS_A_PARTITION))

        def reader(self, schema: Any) -> DataSourceReader:
            return _Reader(*self._own())

        def streamReader(self, schema: Any) -> DataSourceStreamReader:  # noqa: N802  Spark's name
            return _StreamReader(*self._own())

    return Dataset


def dataset(spark: SparkSession, kind: type, schema: str, options: dict[str, str] | None = None, rows: int = ROWS_A_PARTITION, stream: bool = False) -> DataFrame:
    """The items of a dataset class as a table, or as a stream of what it grows by."""
    source = _source(kind, schema)
    spark.dataSource.register(source)
    reader = (spark.readStream if stream else spark.read).format(source.name()).option("own", json.dumps(options or {})).option("rows", str(rows))
    return reader.load()
