"""What the plans of headline queries read and shuffle."""

import pytest

from voltmesh import catalog_queries
from voltmesh.operators import geometry, raster
from voltmesh.plans import overlays
from voltmesh.plans.weather import cutout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c07_wind", "c09_pv", "c14_line_rating", "s05a_wind"])
def test_weather_is_read_once(spark, sf_dir, name):
    assert plan(catalog_queries.queries()[name](spark, sf_dir)).count("/events.parquet") == 1


@pytest.mark.parametrize("name", ["c07_wind", "c09_pv", "c14_line_rating", "g02_raster_codes", "g03_buffer", "g06_reproject", "g12_availability", "j09_find_basin", "w01_rolling_mean"])
def test_no_nested_loops_and_no_single_task(spark, sf_dir, name):
    found = plan(catalog_queries.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found
    assert "Window" not in found or "SinglePartition" not in found


def test_pixel_rows_carry_no_outline(spark, sf_dir):
    found = plan(raster.shape_pixels(overlays._squares(spark, sf_dir), 0.01))
    lines = [x for x in found.splitlines() if "Exchange hashpartitioning" in x]
    assert len(lines) == 1 and "pts" not in found[: found.index("Generate")]


def test_a_month_is_written_in_ranges(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cutout(spark, sf_dir).save(str(tmp_path / "c"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "c").glob("weather-*/month=2024-01/tile_x=*/tile_y=*/*.parquet"))) > 1


def test_overlay_rows_carry_no_outline(spark, sf_dir):
    """Edges are told apart where the outlines are read; what is shuffled has numbers only, and no row of cells is one task's."""
    grid = cutout(spark, sf_dir).grid()
    for found in (geometry.indicator_matrix(grid, overlays._boxes(spark, sf_dir)), geometry.intersection_matrix(grid, overlays._lines(spark, sf_dir), lines=True)):
        text = found._jdf.queryExecution().executedPlan().toString()
        above = text[: text.index("explode(es#")]
        assert text.count("FileScan") == 1 and "pts#" not in above and "SinglePartition" not in above and "NestedLoop" not in above and "Exchange" in above


@pytest.mark.parametrize("name", ["a11_threshold", "c12_runoff", "j12_inflow", "c13_hydro"])
def test_no_values_are_gathered(spark, sf_dir, name):
    found = plan(catalog_queries.queries()[name](spark, sf_dir))
    assert "collect_list" not in found and "NestedLoop" not in found and "CartesianProduct" not in found
