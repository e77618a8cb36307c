"""A folder of tables under a manifest: tables are written beside each other and count once the manifest names them.

The manifest is one small file, replaced by a rename. A job that fails or is killed leaves a folder that nothing names, and all that was there before;
tables may so be read while they are replaced. What a manifest no longer names is deleted by the next operation.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "_cutout.json"

#: Columns that tables are divided by: months and tiles of the plane.
PARTS = ("month", "tile_x", "tile_y")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}")

    def manifest(self) -> dict | None:
        """What was committed last; None for a new folder."""
        where = self._at(_MANIFEST)
        files = where.getFileSystem(self.conf)
        if not files.exists(where):
            return None
        stream = files.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict, first: bool = True) -> dict:
        """first: the first commit of an operation, which deletes what the operation before it has replaced."""
        old = self.manifest() or {}
        manifest = manifest | {"previous": sorted({*self.folders(old), *([] if first else old.get("previous", []))})}
        target, beside = self._at(_MANIFEST), self._at(f".{_MANIFEST}-{uuid.uuid4().hex}")
        files = target.getFileSystem(self.conf)
        stream = files.create(beside)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        replaced = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replaced[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else files.getUri(), self.conf).rename(beside, target, replaced)
        for folder in sorted(set(old.get("previous", [])) - set(self.folders(manifest)) - set(manifest["previous"])):
            files.delete(self._at(folder), True)
        return manifest

    @staticmethod
    def folders(manifest: dict) -> list[str]:
        return [x["folder"] for x in manifest.get("tables", [])] + [x for x in (manifest.get("cells"),) if x]

    def write_rows(self, df: DataFrame, cells: DataFrame, tile: float, name: str) -> dict:
        """Rows by (time, cell_id) under a new folder, and its entry for a manifest. They are dealt by ranges of month, tile, time and cell, so that a month of a tile is as
        many files as its rows need, and a box or a time span is a few folders."""
        plain = df.select(*(c for c in df.columns if c not in PARTS))
        at = lambda c: F.floor(F.col(c) / F.lit(float(tile))).cast("int")
        placed = plain.join(cells.select("cell_id", at("x").alias("tile_x"), at("y").alias("tile_y")), "cell_id", "left")
        order = [*PARTS, "time", "cell_id"]
        rows = placed.withColumn("month", F.date_format("time", "yyyy-MM")).select(*plain.columns, *PARTS)
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(*PARTS).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return {"folder": folder, "schema": rows.schema.jsonValue(), "columns": [c for c in plain.columns if c not in ("time", "cell_id")]}

    def read_rows(self, entry: dict, columns: list[str]) -> DataFrame:
        """time, cell_id, the given columns, and those that the table is divided by."""
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{entry['folder']}").select("time", "cell_id", *columns, *PARTS)

    def write_cells(self, cells: DataFrame) -> str:
        folder = f"cells-{uuid.uuid4().hex}"
        cells.coalesce(1).write.parquet(f"{self.path}/{folder}")
        return folder


def merged(tables: list[DataFrame]) -> DataFrame:
    """The variables of all tables by (time, cell_id), in one grouped pass: a single shuffle, however many tables there are. A row that only some tables have has
    nulls in the variables of the others. No two tables have a variable in common."""
    own = [t.select(*(c for c in t.columns if c not in PARTS)) for t in tables]
    if len(own) == 1:
        return own[0]
    rows = own[0]
    for t in own[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    values = {f.name: f.metadata for t in own for f in t.schema.fields if f.name not in ("time", "cell_id")}
    return rows.groupBy("time", "cell_id").agg(*(F.any_value(c, True).alias(c, metadata=m) for c, m in values.items()))
