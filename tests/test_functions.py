import random

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import geometry, names
from parcelwise.functions.rounding import py_round, py_round_sql
from parcelwise.operators import units


def test_rounding_is_exact_in_both_engines(spark):
    import duckdb

    r = random.Random(1)
    xs = [2.675, 2.5, 0.125, 11.725, 7.5, 1.005] + [r.randint(600, 3000) / 2 / 100 for _ in range(400)] + [r.uniform(-1e6, 1e6) for _ in range(400)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[py_round(F.col("x"), n).alias(f"r{n}") for n in (2, 3, 4)]).collect()
    for row in got:
        assert [row[f"r{n}"] for n in (2, 3, 4)] == [round(row.x, n) for n in (2, 3, 4)], row.x
    sql = duckdb.connect()
    for x in xs[:200]:
        assert sql.execute(f"SELECT {py_round_sql('x', 2)} FROM (SELECT ?::DOUBLE AS x)", [x]).fetchone()[0] == round(x, 2)


def _area(spark, one, other):
    df = spark.createDataFrame([([[float(x), float(y)] for x, y in one], [[float(x), float(y)] for x, y in other])], "a array<array<double>>, b array<array<double>>")
    return df.select(geometry.intersection_area(F.col("a"), F.col("b")), geometry.area(F.col("a")), geometry.is_simple(F.col("b"))).first()


def test_intersections(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert _area(spark, square, [(2, 2), (6, 2), (6, 6), (2, 6)])[0] == pytest.approx(4)
    assert _area(spark, square, square[::-1])[0] == pytest.approx(16)
    assert _area(spark, square, [(4, 0), (8, 0), (8, 4), (4, 4)])[0] == pytest.approx(0)
    notched = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    assert _area(spark, square, notched)[0] == pytest.approx(_area(spark, notched, square)[0]) == pytest.approx(10)
    assert _area(spark, notched, [(1, 1), (3, 1), (3, 3), (2, 2), (1, 3)])[0] == pytest.approx(_area(spark, [(1, 1), (3, 1), (3, 3), (2, 2), (1, 3)], notched)[0])
    assert _area(spark, [(0, 0), (1, 1)], square)[0] == 0
    assert _area(spark, square, [(0, 0), (4, 4), (4, 0), (0, 4)])[2] is False


def test_boxes_of_nothing_are_zero(spark):
    row = spark.createDataFrame([([],), (None,)], "p array<array<double>>").select(geometry.bounding_box(F.col("p")).alias("b")).collect()
    assert [tuple(r.b) for r in row] == [(0.0,) * 8] * 2


def test_names(spark):
    one = spark.range(1)
    got = one.select(names.building_id(F.lit(7)), names.building_id(F.lit(1234)), names.flat_id(F.lit(0), F.lit(3)), names.flat_id(F.lit(12), F.lit(4)), names.floor_id(F.lit(100)), names.unit_id(F.lit("A"), F.lit("B001"), F.lit(0), F.lit("UG01")), names.view_of(F.lit("Yellow_zoom.jpg")), names.view_of(F.lit("x")), names.floor_label(F.lit(0)))
    assert tuple(got.first()) == ("B007", "B1234", "G03", "1204", "F100", "A-B001-F00-UG01", "low", "unknown", "Ground Floor")


def test_units(spark):
    df = spark.createDataFrame([(float(a),) for a in (-1, 0, 105, 175, 600, 750, 1172.5, 3000, 5000)], "a double")
    got = df.select(units.flats_per_floor(F.col("a")).alias("f"), units.height_of_area(F.col("a")).alias("h")).withColumn("n", units.floors_of_height(F.col("h"))).collect()
    assert [r.f for r in got] == [1, 1, 2, 2, 9, 10, 10, 10, 10]
    assert [r.h for r in got] == [6.0, 6.0, 6.0, 6.0, 6.0, 7.5, 11.72, 30.0, 30.0]
    assert [r.n for r in got] == [2, 2, 2, 2, 2, 2, 4, 10, 10]


def test_elevation(spark):
    d = [15.0, 15.1, 15.4, 14.9, 15.4, 14.9]
    df = spark.createDataFrame([("a", [100 + x for x in d], [100.0] * 6), ("b", [1.0], [5.0])], "building_id string, dsm array<double>, dem array<double>")
    got = {r.building_id: r for r in units.analyse_elevation(units.paired_samples(df)).collect()}
    assert got["a"].height_meters == 15.05 and got["a"].estimated_floors == 5
    assert got["b"].height_meters == 0.0 and got["b"].estimated_floors == 0
    with pytest.raises(Exception, match="differ in length"):
        units.paired_samples(spark.createDataFrame([("a", [1.0], [1.0, 2.0])], df.schema)).collect()
