"""Stored cutouts: preparing in steps, breaking off, saving in place, and what is read of them."""

import pytest
from pyspark.sql import functions as F

from voltmesh.plans.weather import cutout
from voltmesh.sources.cutout import Cutout


def _reader(base, calls, broken=()):
    def read(c, feature):
        calls.append(feature)
        if feature in broken:
            raise OSError("the source is away")
        return base.weather if feature != "height" else base.weather.groupBy("cell_id").agg(F.max("height").alias("height"))

    return {"era5": read}


@pytest.fixture(scope="module")
def base(spark, sf_dir):
    return cutout(spark, sf_dir)


def _same(a, b):
    names = sorted(set(a.columns) & set(b.columns))
    x, y = a.select(*names), b.select(*names)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def test_prepare_goes_on_where_it_broke_off(spark, base, tmp_path):
    path, calls = str(tmp_path / "c"), []
    blank = Cutout(None, base.cells, base.meta, path=path)
    with pytest.raises(OSError):
        blank.prepare(_reader(base, calls, {"temperature"}))
    assert calls == ["height", "wind", "influx", "temperature"]
    half = Cutout.open(spark, path)
    assert half.meta["prepared_features"] == [["era5", x] for x in calls[:3]] and "wnd100m" in half.weather.columns and not half.prepared
    before = {f for t in half.tables for f in t.inputFiles()}
    ready = half.prepare(_reader(base, calls := []))
    assert calls == ["temperature", "runoff"] and ready.prepared
    assert before < {f for t in ready.tables for f in t.inputFiles()}  # what was there has not been touched
    ready.prepare(_reader(base, calls := []))
    assert calls == []
    assert _same(Cutout.open(spark, path).weather, base.weather)
    assert {f.name: f.metadata["feature"] for f in ready.weather.schema.fields if f.metadata}["runoff"] == "runoff"


def test_a_feature_is_replaced(spark, base, tmp_path):
    path = str(tmp_path / "c")
    Cutout(None, base.cells, base.meta, path=path).prepare(_reader(base, []))
    changed = Cutout(base.weather.withColumn("runoff", F.lit(7.0)), base.cells)
    again = Cutout.open(spark, path).prepare(_reader(changed, calls := []), features=["runoff"], overwrite=True)
    assert calls == ["runoff"] and {r[0] for r in again.weather.select("runoff").distinct().collect()} == {7.0}
    assert again.meta["prepared_features"].count(["era5", "runoff"]) == 1 and _same(again.weather.drop("runoff"), base.weather.drop("runoff"))


def test_saving_onto_the_own_folder_keeps_all_rows(spark, base, tmp_path):
    path = str(tmp_path / "c.parquet")
    base.save(path)
    opened = Cutout.open(spark, path)
    assert opened.equals(Cutout(base.weather, base.cells)) and opened.name == "c"
    for k in range(3):
        opened = Cutout.open(spark, path)
        Cutout(opened.weather.withColumn("more", F.lit(k)), opened.cells, opened.meta).save(path)
        assert opened.weather.count() == base.weather.count()  # the replaced table is still there
    last = Cutout.open(spark, path)
    assert last.weather.where("more = 2").count() == base.weather.count()
    assert len([p for p in (tmp_path / "c.parquet").iterdir() if p.name.startswith("weather-")]) == 2
    with pytest.raises(FileNotFoundError):
        Cutout.open(spark, str(tmp_path / "nothing"))


def test_a_failed_save_changes_nothing(spark, base, tmp_path):
    path = str(tmp_path / "c")
    base.save(path)
    bad = base.weather.withColumn("runoff", F.when(F.col("cell_id") == 5, F.raise_error(F.lit("no value"))).otherwise(F.col("runoff")))
    with pytest.raises(Exception, match="no value"):
        Cutout(bad, base.cells, base.meta).save(path)
    assert _same(Cutout.open(spark, path).weather, base.weather)


def test_features_meet_in_one_shuffle(spark, base, tmp_path):
    path = str(tmp_path / "c")
    ready = Cutout(None, base.cells, base.meta, path=path).prepare(_reader(base, []))
    assert len(ready.tables) == 4
    plan = ready.weather._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_box_reads_its_tiles_only(spark, base, tmp_path):
    path = str(tmp_path / "c")
    Cutout(base.weather, base.cells, base.meta | {"tile": 0.5}).save(path)
    stored = Cutout.open(spark, path)
    def files(c):
        """Files that the scan of the rows has read, from the plan that ran."""
        df = c.tables[0].select("time", "tile_x")
        df.collect()

        def scans(plan):
            name = plan.nodeName()
            if name.startswith("Scan parquet"):
                return [plan] if "tile_x" in plan.output().toString() else []
            inner = plan.executedPlan() if "Adaptive" in name else plan.plan() if "QueryStage" in name else None
            children = [inner] if inner is not None else [plan.children().apply(k) for k in range(plan.children().size())]
            return [x for c in children for x in scans(c)]

        return scans(df._jdf.queryExecution().executedPlan())[0].metrics().apply("numFiles").value()

    part = stored.sel(bounds=(5.0, 50.0, 5.3, 50.3))
    assert 0 < files(part) < files(stored) == len(stored.tables[0].inputFiles())
    assert _same(part.weather, base.sel(bounds=(5.0, 50.0, 5.3, 50.3)).weather)
    plan = part.weather._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "tile_x" in filters and "tile_y" in filters
    assert files(stored.sel(time=("2030-01-01", "2030-02-01"))) == 0
    assert stored.chunks == {"x": 2, "y": 2, "files": files(stored)} and stored.dt.startswith("INTERVAL")
