"""The data source over a landed archive: months that are read, bounds that are pushed, rows that come back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from voltmesh.sources.archive_source import ArchiveReader, ArchiveSource, register


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.sql("select explode(sequence(timestamp'2023-01-05', timestamp'2024-06-09', interval 12 hours)) time")
    return df.withColumns({"x": F.hour("time") / 10 + F.day("time"), "y": F.lit(50.0) + F.month("time"), "v": F.unix_timestamp("time")})


@pytest.fixture(scope="module")
def archive(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landed") / "a")
    rows.withColumn("month", F.date_format("time", "yyyy-MM")).write.partitionBy("month").parquet(path)
    register(spark)
    return path


CONDITIONS = ["true", "time >= '2023-11-20 12:00:00' and time < '2024-02-03' and x > 4 and v % 7 <> 0", "time = '2023-12-01 12:00:00'", "y <= 53 and x between 2 and 9", "time > '2030-01-01'", "time < '2023-02-01' or x = 3"]


@pytest.mark.parametrize("where", CONDITIONS)
def test_conditions_are_handed_down(spark, rows, archive, where):
    got = spark.read.format("voltmesh_archive").option("path", archive).load().where(where)
    want = rows.where(where)
    assert got.columns == rows.columns and got.count() == want.count()
    assert got.exceptAll(want).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x and "RuntimeFilters" not in x]
    assert " or " in where or not any("time#" in x.replace("isnotnull(time#", "") for x in filters)


def test_months_are_chosen_before_any_task(spark, archive):
    schema = ArchiveSource({"path": archive}).schema()
    whole = ArchiveReader(archive, schema, {})
    assert len(whole.partitions()) == 18
    some = ArchiveReader(archive, schema, {})
    odd = EqualTo(("v",), 3)
    assert list(some.pushFilters([GreaterThanOrEqual(("time",), dt.datetime(2023, 11, 20)), LessThan(("time",), dt.datetime(2024, 2, 3)), odd])) == [odd]
    assert [p.month for p in some.partitions()] == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert [p.month for p in ArchiveReader(archive, schema, {"start": "2024-05-02", "stop": "2024-06-01"}).partitions()] == ["2024-05", "2024-06"]


def test_options_and_errors(spark, rows, archive, tmp_path):
    got = spark.read.format("voltmesh_archive").options(path=archive, start="2024-05-02", stop="2024-06-01", x0="3", x1="9.5").load()
    assert got.count() == rows.where("time between '2024-05-02' and '2024-06-01' and x between 3 and 9.5").count()
    for options in ({}, {"path": str(tmp_path)}):
        with pytest.raises(ValueError):
            ArchiveSource(options).schema()
