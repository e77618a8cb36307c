"""A Spark data source over a landed archive: one partition for each month that is asked for, bounds applied where files are read.

The archive is a folder of ``month=2024-01`` folders with Parquet files of time, x, y and fields. Requests go by month, as a download service takes them; bounds on
time choose the months before any task starts, and those on time, x and y the row groups and rows inside. Spark hands its conditions down
(``register`` sets ``spark.sql.python.filterPushdown.enabled``); the options ``start``, ``stop``, ``x0``, ``x1``, ``y0`` and ``y1`` name bounds as well.

    register(spark)
    spark.read.format("voltmesh_archive").option("path", "s3://bucket/archive").load().where("time >= '2024-01-01' and x < 10")
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

_BOUNDS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "=="}
_AXES = ("time", "x", "y")


class Month(InputPartition):
    def __init__(self, month: str, files: list[str]):
        self.month, self.files = month, files


def _files(path: str) -> tuple[pafs.FileSystem, dict[str, list[str]]]:
    """The file system of an archive and its Parquet files by month."""
    system, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    months: dict[str, list[str]] = {}
    for found in system.get_file_info(pafs.FileSelector(root, recursive=True)):
        folder = found.path.rsplit("/", 2)[-2]
        if found.path.endswith(".parquet") and folder.startswith("month="):
            months.setdefault(folder[6:], []).append(found.path)
    return system, {k: sorted(v) for k, v in sorted(months.items())}


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voltmesh_archive"

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("an archive needs its path")
        return self.options["path"]

    def schema(self) -> StructType:
        system, months = _files(self._path())
        if not months:
            raise ValueError(f"no month=... folders with Parquet files in {self._path()}")
        return from_arrow_schema(ds.dataset(next(iter(months.values()))[0], filesystem=system, format="parquet").schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self._path(), schema, dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict[str, str]):
        self.path, self.names = path, schema.names
        self.arrow = to_arrow_schema(schema)
        self.zoned = {f.name: isinstance(f.dataType, TimestampType) for f in schema.fields if isinstance(f.dataType, TimestampType | TimestampNTZType)}
        self.bounds: list[tuple[str, str, object]] = []
        for key, column, sign in (("start", "time", ">="), ("stop", "time", "<="), ("x0", "x", ">="), ("x1", "x", "<="), ("y0", "y", ">="), ("y1", "y", "<=")):
            if key in options:
                self.bounds.append((column, sign, dt.datetime.fromisoformat(options[key]) if column == "time" else float(options[key])))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            sign = _BOUNDS.get(type(f))
            if sign and len(f.attribute) == 1 and f.attribute[0] in _AXES and f.value is not None:
                self.bounds.append((f.attribute[0], sign, f.value))
            else:
                yield f

    def _time(self, value: dt.datetime) -> dt.datetime:
        """As UTC without a zone."""
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value

    def _wanted(self, month: str) -> bool:
        for column, sign, value in self.bounds:
            if column == "time" and isinstance(value, dt.datetime):
                own = self._time(value).strftime("%Y-%m")
                if sign[0] == ">" and month < own or sign[0] == "<" and month > own or sign == "==" and month != own:
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        return [Month(m, files) for m, files in _files(self.path)[1].items() if self._wanted(m)]

    def read(self, partition: Month) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.files:  # no month is in the bounds
            return
        system = _files(self.path)[0]
        data = ds.dataset(partition.files, filesystem=system, format="parquet")
        chosen = None
        for column, sign, value in self.bounds:
            if isinstance(value, dt.datetime):
                value = pa.scalar(self._time(value), pa.timestamp("us")).cast(data.schema.field(column).type)
            one = {">": ds.field(column) > value, ">=": ds.field(column) >= value, "<": ds.field(column) < value, "<=": ds.field(column) <= value, "==": ds.field(column) == value}[sign]
            chosen = one if chosen is None else chosen & one
        for batch in data.to_batches(columns=self.names, filter=chosen):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in self.arrow], schema=self.arrow)
