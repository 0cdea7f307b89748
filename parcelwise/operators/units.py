"""Heights, floors and dwelling units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.names import flat_id, floor_id, floor_label, unit_id
from parcelwise.functions.rounding import py_round

FLOOR_HEIGHT, FLAT_AREA, LEAST_FLATS, MOST_FLATS = 3.0, 70.0, 1, 10
LEAST_HEIGHT, MOST_HEIGHT, AREA_PER_METER = 6.0, 30.0, 100.0


def height_of_area(area: Column) -> Column:
    return py_round(F.greatest(F.lit(LEAST_HEIGHT), F.least(F.lit(MOST_HEIGHT), F.coalesce(area, F.lit(0.0)) / AREA_PER_METER)), 2)


def floors_of_height(height: Column) -> Column:
    """At least one; halves go to the even number."""
    return F.greatest(F.rint(height / FLOOR_HEIGHT).cast("int"), F.lit(1))


def floors_of_elevation(height: Column, floor_height: float = FLOOR_HEIGHT) -> Column:
    """None for a height of 0 or less."""
    return F.when(height <= 0, 0).otherwise(F.greatest(F.rint(height / floor_height).cast("int"), F.lit(1)))


def flats_per_floor(area: Column) -> Column:
    flats = F.greatest(F.lit(LEAST_FLATS), F.least(F.lit(MOST_FLATS), F.rint(area / FLAT_AREA).cast("int")))
    return F.when(F.coalesce(area, F.lit(0.0)) <= 0, LEAST_FLATS).otherwise(flats)


def flat_ids(floor: Column, flats: Column) -> Column:
    """The IDs of a floor's flats; flats is 1 at least."""
    return F.transform(F.sequence(F.lit(1), flats), lambda i: flat_id(floor, i))


def apartments(area: Column, floors: Column) -> Column:
    """The apartments of a building: its floors, at least one, each with its flats."""
    count = F.when(floors <= 0, 1).otherwise(floors)
    flats = flats_per_floor(area)

    def floor(k: Column) -> Column:
        return F.struct(k.alias("floor_number"), floor_label(k).alias("floor_label"), area.alias("estimated_floor_area"), flats.alias("estimated_flat_count"), flat_ids(k, flats).alias("flats"), F.lit("PROTOTYPE_ESTIMATE").alias("data_source"))

    return F.struct(
        (flats * count).alias("total_estimated_flats"), flats.alias("estimated_flats_per_floor"), F.lit(FLAT_AREA).alias("average_apartment_area_assumption"),
        F.lit("PROTOTYPE_ESTIMATE").alias("data_source"), F.lit("ESTIMATED").alias("status"), F.transform(F.sequence(F.lit(0), count - 1), floor).alias("floors"),
    )


def unit_rows(buildings: DataFrame, authority: Column) -> DataFrame:
    """One row a unit: building_id, floor_number, floor_id, flat, unit_id; buildings need building_id, area_pixels and floors."""
    each = buildings.select("building_id", authority.alias("authority"), flats_per_floor(F.col("area_pixels")).alias("flats"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("floors"), F.lit(1)) - 1)).alias("floor_number"))
    flat = each.select("building_id", "authority", "floor_number", F.explode(flat_ids(F.col("floor_number"), F.col("flats"))).alias("flat"))
    return flat.select("building_id", "floor_number", floor_id(F.col("floor_number")).alias("floor_id"), "flat", unit_id(F.col("authority"), F.col("building_id"), F.col("floor_number"), F.col("flat")).alias("unit_id"))


def grand_totals(buildings: DataFrame) -> DataFrame:
    """One row of all buildings (with floors and flats a floor): buildings, floors, units."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return buildings.agg(F.count(F.lit(1)).alias("buildings"), total(F.col("floors")).alias("floors"), total(F.col("floors") * F.col("flats")).alias("units"))


def analyse_elevation(samples: DataFrame, key: str = "building_id", floor_height: float = FLOOR_HEIGHT) -> DataFrame:
    """Median of max(dsm - dem, 0) by building, rounded to 2 digits, and floors; samples without both don't count, none gives 0."""
    each = samples.select(key, F.greatest(F.col("dsm") - F.col("dem"), F.lit(0.0)).alias("rise"))
    median = each.groupBy(key).agg(F.coalesce(F.median("rise"), F.lit(0.0)).alias("median_height"))
    done = median.withColumn("height_meters", py_round(F.col("median_height"), 2))
    return done.withColumn("estimated_floors", floors_of_elevation(F.col("height_meters"), floor_height))


def paired_samples(arrays: DataFrame, key: str = "building_id") -> DataFrame:
    """(key, sample_idx, dsm, dem) out of two arrays a row; raises where their lengths differ."""
    same = F.when(F.size("dsm") != F.size("dem"), F.raise_error(F.lit("dsm and dem differ in length"))).otherwise(F.arrays_zip("dsm", "dem"))
    return arrays.select(key, F.posexplode(same).alias("sample_idx", "s")).select(key, "sample_idx", "s.dsm", "s.dem")
