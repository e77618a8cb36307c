"""Runs of pixels against plain sets of pixels."""

import random

import pytest
from pyspark.sql import functions as F

from voltmesh.operators import raster, runs
from voltmesh.plans import overlays

BY = ["shape_id"]
KIND = "shape_id string, py int, x0 int, x1 int"


def _some(seed, sets=3, most=40):
    random.seed(seed)
    return [(f"s{random.randrange(sets)}", random.randrange(4), a := random.randrange(-30, 60), a + random.randrange(12)) for _ in range(most)]


def _pixels(rows):
    return {(s, x, y) for s, y, a, b in rows for x in range(a, b + 1)}


def _got(df):
    rows = [tuple(r) for r in df.select("shape_id", "py", "x0", "x1").collect()]
    by_row = {}
    for s, y, a, b in sorted(rows):
        assert a <= b and by_row.get((s, y), -(10**9)) < a - 1  # longest runs: they neither overlap nor touch
        by_row[s, y] = b
    return _pixels(rows)


@pytest.mark.parametrize("seed", range(3))
def test_sets(spark, seed):
    a, b = _some(seed), _some(seed + 100)
    da, db = (spark.createDataFrame(x, KIND) for x in (a, b))
    pa, pb = _pixels(a), _pixels(b)
    assert _got(runs.union(da, BY)) == pa
    assert _got(runs.subtract(da, db, BY)) == pa - pb
    assert _got(runs.intersect(da, db, BY)) == pa & pb
    assert {tuple(r) for r in runs.pixels(runs.of_pixels(runs.pixels(da, BY).unionByName(runs.pixels(da, BY)), BY), BY).select("shape_id", "px", "py").collect()} == pa
    common = {(x, y) for _, x, y in pb}
    met = runs.meet(runs.union(da, BY), runs.union(db.drop("shape_id"), []), BY)
    assert _got(runs.union(met, BY)) == {p for p in pa if p[1:] in common}
    for n in (0, 1, 5):
        assert _got(runs.dilate(da, n, BY)) == {(s, x + dx, y + dy) for s, x, y in pa for dy in range(-n, n + 1) for dx in range(abs(dy) - n, n - abs(dy) + 1)}


def test_meeting_over_tiles(spark):
    wide = spark.createDataFrame([("a", 0, -3000, 5000), ("b", 0, 1023, 1024)], KIND)
    common = spark.createDataFrame([(0, -2500, -2000), (0, 1000, 4000)], "py int, x0 int, x1 int")
    got = _got(runs.union(runs.meet(wide, common, BY), BY))
    assert got == _pixels([("a", 0, -2500, -2000), ("a", 0, 1000, 4000), ("b", 0, 1023, 1024)])
    assert runs.union(wide.limit(0), BY).count() == 0


def test_dilation_costs_runs_not_pixels(spark):
    n, long = 200, spark.createDataFrame([("s", 5 * k, 0, 1_000_000) for k in range(20)], KIND)
    got = runs.dilate(long, n, BY)
    rows = got.agg(F.count("*"), F.min("x0"), F.max("x1"), F.sum(runs.length())).first()
    assert rows[0] == 2 * n + 1 + 95 and rows[1] == -n and rows[2] == 1_000_000 + n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence(x0" not in plan and "px#" not in plan


def test_shapes_stay_runs_up_to_their_cells(spark, sf_dir):
    """No plan of shares tells single pixels of a shape apart; a raster's own pixels are read once for what it covers and once for what it takes."""
    shapes = overlays._squares(spark, sf_dir)
    codes = overlays._pixels(spark)
    container = raster.ExclusionContainer(4326, 0.01).add_raster(codes, codes=range(20), buffer=0.02).add_geometry(shapes, buffer=0.03)
    plan = raster.eligible_share(shapes, container)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(x0#" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
