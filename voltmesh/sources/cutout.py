"""A cutout: weather rows (time, cell_id, variables), the cells of a regular grid, and what is known about both."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .datasets import MODULES
from .store import Store, merged


def grid_cells(spark: SparkSession, x: tuple[float, float], y: tuple[float, float], dx: float = 0.25, dy: float = 0.25) -> DataFrame:
    """Cells of the global lattice within the bounds (either order, inclusive): cell_id = iy * nx + ix, y outer."""

    def axis(low: float, bounds: tuple[float, float], step: float, size: float) -> list[float]:
        a, b = sorted(bounds)
        return [v for k in range(round(size / step)) if a <= (v := round(low + k * step, 9)) <= b]

    xs, ys = axis(-180.0, x, dx, 360.0), axis(-90.0, y, dy, 180.0)
    index = spark.range(len(xs) * len(ys)).select(F.col("id").alias("cell_id"), (F.col("id") % len(xs)).cast("int").alias("ix"), F.expr(f"int(id div {max(1, len(xs))})").alias("iy"))
    place = lambda low, step, c: F.round(F.lit(float(low)) + F.col(c) * F.lit(float(step)), 9)
    cells = index.withColumns({"x": place(xs[0], dx, "ix"), "y": place(ys[0], dy, "iy")}) if xs and ys else index.limit(0).withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    return cells.withColumns({"lon": F.col("x"), "lat": F.col("y")})


def time_steps(spark: SparkSession, start: str, stop: str, dt: str = "1 hour") -> DataFrame:
    return spark.sql("select explode(sequence(timestamp(:a), timestamp(:b), cast(:d as interval))) time".replace("cast(:d as interval)", f"interval {dt}"), args={"a": start, "b": stop})


def _marked(df: DataFrame, module: str, feature: str, wanted: list[str]) -> DataFrame:
    """Rows of a feature; each variable tells where it comes from."""
    return df.select("time", "cell_id", *(F.col(n).alias(n, metadata={"module": module, "feature": feature}) for n in wanted))


def _with_static(cells: DataFrame, df: DataFrame, wanted: list[str]) -> DataFrame:
    return cells.drop(*wanted).join(df.select("cell_id", *wanted), "cell_id", "left")


@dataclass
class Cutout:
    """``tables``: the stored tables behind ``weather``, with the columns that they are divided by; ``path``: where they are."""

    weather: DataFrame | None
    cells: DataFrame
    meta: dict = field(default_factory=dict)
    tables: tuple[DataFrame, ...] = ()
    path: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, **ignored) -> Cutout:
        """A stored cutout; other arguments are ignored with a warning."""
        if ignored:
            warnings.warn(f"arguments are ignored as {path} is there: {sorted(ignored)}", stacklevel=2)
        store = Store(spark, path)
        manifest = store.manifest()
        if manifest is None:
            raise FileNotFoundError(f"no cutout at {path}")
        # of a variable that several tables have, the last one counts
        owner = {c: k for k, x in enumerate(manifest["tables"]) for c in x["columns"]}
        wanted = [[c for c in x["columns"] if owner[c] == k] for k, x in enumerate(manifest["tables"])]
        tables = tuple(store.read_rows(x, own) for x, own in zip(manifest["tables"], wanted, strict=True) if own or not x["columns"])
        cells = spark.read.parquet(f"{store.path}/{manifest['cells']}")
        return cls(merged(list(tables)) if tables else None, cells, manifest["meta"], tables, path)

    @classmethod
    def create(cls, spark: SparkSession, module: str | list[str], time: tuple[str, str], bounds=None, x=None, y=None, dx: float = 0.25, dy: float = 0.25, dt: str = "1 hour", path: str | None = None) -> Cutout:
        """Coordinates only; ``prepare`` fills in the variables, in the folder ``path`` if there is one."""
        if bounds is not None:
            x, y = (bounds[0], bounds[2]), (bounds[1], bounds[3])
        if x is None or y is None or time is None:
            raise TypeError("a new cutout needs time, and bounds or x and y")
        modules = [module] if isinstance(module, str) else list(module)
        if len({MODULES[m].crs for m in modules}) > 1:
            raise AssertionError("all modules of a cutout need one coordinate system")
        return cls(None, grid_cells(spark, x, y, dx, dy), {"module": modules, "dx": dx, "dy": dy, "dt": dt, "time": list(time), "prepared_features": []}, path=path)

    @property
    def tile(self) -> float:
        """Width and height of a tile of stored rows, in units of the plane: 32 cells unless the description says otherwise."""
        return float(self.meta.get("tile") or 32 * (self.meta.get("dx") or self.summary["dx"] or 0.25))

    def save(self, path: str) -> str:
        """All rows as one table by month and tile, the cells, and the description. Also onto the folder it was opened from: what is
        there stays until the new tables are written, and readable for one save more."""
        store = Store(self.cells.sparkSession, path)
        tables = [] if self.weather is None else [store.write_rows(self.weather, self.cells, self.tile, "weather")]
        store.commit({"meta": self.meta | {"tile": self.tile}, "tables": tables, "cells": store.write_cells(self.cells)})
        return path

    def _missing(self, features: list[str] | None, overwrite: bool) -> Iterator[tuple[str, str, list[str]]]:
        """(module, feature, variables) that no earlier module has."""
        have = set() if overwrite else set(self.cells.columns) | set(() if self.weather is None else self.weather.columns)
        for module in self.meta["module"]:
            for feature, names in MODULES[module].features.items():
                wanted = [n for n in names if n not in have]
                if wanted and (features is None or feature in features):
                    have |= set(wanted)
                    yield module, feature, wanted

    def prepare(self, readers: dict[str, object], features: list[str] | None = None, overwrite: bool = False, path: str | None = None) -> Cutout:
        """Add the variables of each module's features that are missing: readers[module](cutout, feature) gives rows by
        (time, cell_id), or by cell_id for static ones. Earlier modules win for a variable that several have.

        A cutout with a folder (``path``, or the one it was opened from) writes each feature as a table of its own, named by the manifest as soon as it is
        complete; features that are there are not read or written again, so a run that broke off goes on where it stopped. Without one, the features
        are joined when they are asked for.
        """
        path = path or self.path
        if path:
            return self._prepare_stored(path, readers, features, overwrite)
        cells, got, parts, done = self.cells, list(self.meta.get("prepared_features", [])), [], []
        for module, feature, wanted in self._missing(features, overwrite):
            df = readers[module](self, feature)
            if feature in MODULES[module].static:
                cells = _with_static(cells, df, wanted)
            else:
                parts.append(_marked(df, module, feature, wanted))
                done += wanted
            got.append([module, feature])
        if self.weather is not None:
            parts.insert(0, self.weather.drop(*done))
        return Cutout(merged(parts) if parts else None, cells, self.meta | {"prepared_features": got})

    def _prepare_stored(self, path: str, readers: dict[str, object], features: list[str] | None, overwrite: bool) -> Cutout:
        spark = self.cells.sparkSession
        store = Store(spark, path)
        if store.manifest() is None:
            self.save(path)
        manifest = store.manifest()
        now = Cutout.open(spark, path)
        for k, (module, feature, wanted) in enumerate(list(now._missing(features, overwrite))):
            df = readers[module](now, feature)
            meta = manifest["meta"]
            got = [x for x in meta.get("prepared_features", []) if x != [module, feature]]
            manifest = manifest | {"meta": meta | {"prepared_features": [*got, [module, feature]]}}
            if feature in MODULES[module].static:
                manifest = manifest | {"cells": store.write_cells(_with_static(now.cells, df, wanted))}
                now.cells = spark.read.parquet(f"{store.path}/{manifest['cells']}")
            else:
                entry = store.write_rows(_marked(df, module, feature, wanted), now.cells, now.tile, f"{module}-{feature}")
                kept = [x | {"columns": [c for c in x["columns"] if c not in wanted]} for x in manifest["tables"]]
                manifest = manifest | {"tables": [*(x for x in kept if x["columns"]), entry]}
            manifest = store.commit(manifest, first=k == 0)
        return Cutout.open(spark, path)

    def sel(self, bounds=None, x=None, y=None, time=None, buffer: float = 0.0) -> Cutout:
        """Cells and rows within the bounds (inclusive, widened by ``buffer``) and times. Of a stored cutout only the months and tiles in question are read."""
        if bounds is not None:
            x, y = (bounds[0] - buffer, bounds[2] + buffer), (bounds[1] - buffer, bounds[3] + buffer)
        cells, held, stored = self.cells, [], []
        for name, span in (("x", x), ("y", y)):
            if span is not None:
                low, high = (float(v) for v in sorted(span))
                cells = cells.where(F.col(name).between(low, high))
                stored.append(F.col(f"tile_{name}").between(math.floor(low / self.tile), math.floor(high / self.tile)))
        if time is not None:
            first, last = (F.to_timestamp(F.lit(t)) for t in time)
            held.append(F.col("time").between(first, last))
            stored.append(F.col("month").between(F.date_format(first, "yyyy-MM"), F.date_format(last, "yyyy-MM")))
        if self.weather is None:
            return Cutout(None, cells, dict(self.meta))

        def chosen(df: DataFrame, conditions: list) -> DataFrame:
            for c in conditions:
                df = df.where(c)
            return df.join(cells.select("cell_id"), "cell_id", "left_semi")

        tables = tuple(chosen(t, [*stored, *held]) for t in self.tables)
        return Cutout(merged(list(tables)) if tables else chosen(self.weather, held), cells, dict(self.meta), tables)

    def nearest(self, x: float, y: float) -> DataFrame:
        """The cell whose centre is nearest on each axis."""
        far = F.abs(F.col("x") - float(x)) + F.abs(F.col("y") - float(y))
        return self.cells.agg(F.min_by("cell_id", F.struct(far, "cell_id")).alias("cell_id"))

    def merge(self, other: Cutout) -> Cutout:
        """Rows and variables of both; the own value wins where both have one."""
        both = self.weather.alias("a").join(other.weather.alias("b"), ["time", "cell_id"], "full")
        names = [*self.weather.columns, *(c for c in other.weather.columns if c not in self.weather.columns)]

        def pick(c: str):
            mine, theirs = c in self.weather.columns, c in other.weather.columns
            return (F.coalesce(f"a.{c}", f"b.{c}") if mine and theirs else F.col(f"a.{c}" if mine else f"b.{c}")).alias(c)

        cells = self.cells.unionByName(other.cells, allowMissingColumns=True).dropDuplicates(["cell_id"])
        meta = self.meta | {k: [*self.meta.get(k, []), *(v for v in other.meta.get(k, []) if v not in self.meta.get(k, []))] for k in ("module", "prepared_features")}
        return Cutout(both.select("time", "cell_id", *(pick(c) for c in names if c not in ("time", "cell_id"))), cells, meta)

    def equals(self, other: Cutout) -> bool:
        names = sorted(self.weather.columns)
        if names != sorted(other.weather.columns):
            return False
        a, b = self.weather.select(*names), other.weather.select(*names)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    @cached_property
    def summary(self) -> dict:
        """dx, dy (8 digits), shape, extent and bounds of the grid; half a step around the outer centres."""
        r = self.cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count_distinct("x"), F.count_distinct("y")).first()
        dx = round((r[1] - r[0]) / max(1, r[4] - 1), 8) if r[4] > 1 else self.meta.get("dx")
        dy = round((r[3] - r[2]) / max(1, r[5] - 1), 8) if r[5] > 1 else self.meta.get("dy")
        extent = [r[0] - dx / 2, r[1] + dx / 2, r[2] - dy / 2, r[3] + dy / 2]
        return {"dx": dx, "dy": dy, "shape": (r[5], r[4]), "extent": extent, "bounds": [extent[k] for k in (0, 2, 1, 3)]}

    @property
    def name(self) -> str | None:
        """The last part of the path, without an extension."""
        return self.path.rstrip("/").rpartition("/")[2].rpartition(".")[0] or self.path.rstrip("/").rpartition("/")[2] if self.path else None

    @property
    def dt(self) -> str | None:
        """Distance of the first two times, as Spark writes intervals of days and seconds; None with fewer times."""
        if self.weather is None:
            return self.meta.get("dt")
        first = self.weather.agg(F.min("time").alias("a"))
        second = self.weather.join(F.broadcast(first), F.col("time") > F.col("a")).agg((F.min("time") - F.min("a")).cast("string").alias("d")).first()
        return second[0]

    @property
    def chunks(self) -> dict[str, int] | None:
        """How stored rows are divided: cells of a tile along x and y, and files of all tables."""
        if not self.tables:
            return None
        s = self.summary
        return {"x": round(self.tile / s["dx"]), "y": round(self.tile / s["dy"]), "files": sum(len(t.inputFiles()) for t in self.tables)}

    @property
    def coords(self) -> dict[str, DataFrame]:
        """The axes x and y, and time if there is weather."""
        axes = {c: self.cells.select(c).distinct().orderBy(c) for c in ("x", "y")}
        return axes if self.weather is None else axes | {"time": self.weather.select("time").distinct().orderBy("time")}

    @property
    def transform(self) -> tuple[float, ...]:
        """(a, b, c, d, e, f) of the affine map from (column, row) to the plane: x = a column + b row + c, y = d column + e row + f."""
        s = self.summary
        return (s["dx"], 0.0, s["extent"][0], 0.0, s["dy"], s["extent"][2])

    @property
    def transform_r(self) -> tuple[float, ...]:
        """The same with rows from the top."""
        s = self.summary
        return (s["dx"], 0.0, s["extent"][0], 0.0, -s["dy"], s["extent"][3])

    @property
    def prepared(self) -> bool:
        wanted = {n for m in self.meta["module"] for names in MODULES[m].features.values() for n in names}
        return wanted <= set(self.weather.columns if self.weather is not None else []) | set(self.cells.columns)

    def grid(self) -> DataFrame:
        """cells with the boxes x0, x1, y0, y1."""
        s = self.summary
        half = lambda c, d: (F.col(c) - F.lit(d / 2), F.col(c) + F.lit(d / 2))
        (x0, x1), (y0, y1) = half("x", s["dx"]), half("y", s["dy"])
        return self.cells.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1})

    def uniform_layout(self) -> DataFrame:
        return self.cells.select("cell_id", F.lit(1.0).alias("capacity"))

    def layout_from_capacity_list(self, plants: DataFrame, column: str = "Capacity") -> DataFrame:
        """Capacities summed in the nearest cell (ties go right and up, plants outside go to the edge), 0 elsewhere."""
        s = self.summary
        (x0, y0), (ny, nx) = (s["extent"][0] + s["dx"] / 2, s["extent"][2] + s["dy"] / 2), s["shape"]
        snap = lambda c, low, step, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - F.lit(low)) / F.lit(step) + F.lit(0.5)))).cast("int")
        sums = plants.groupBy(snap("x", x0, s["dx"], nx).alias("ix"), snap("y", y0, s["dy"], ny).alias("iy")).agg(F.sum(column).alias("capacity"))
        return self.cells.join(sums, ["ix", "iy"], "left").select("cell_id", F.coalesce("capacity", F.lit(0.0)).alias("capacity"))

    def __repr__(self) -> str:
        return f"<Cutout {self.meta.get('module')} {self.summary['shape']} prepared_features={self.meta.get('prepared_features')}>"


