"""Nested property records: built from footprints, merged with validation, given their identifiers, and exported as scene objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.geometry import bounding_box
from parcelwise.functions.names import NO_AUTHORITY_ID, building_property_id, floor_id, unit_id
from parcelwise.functions.rounding import py_round
from parcelwise.operators.units import apartments, floors_of_height, height_of_area

SCALE, CENTRE, LEAST_SIZE = 0.35, 64.0, 2.0
# Scene types by place
SCENE_TYPES = ("residential", "commercial", "institutional")


def build_properties(buildings: DataFrame) -> DataFrame:
    """One nested record a building, with ord; height and floors come from the area, not from the footprint's own."""
    base = buildings.select("ord", "building_id", F.col("area_pixels").cast("double").alias("area_pixels"), "polygon")
    base = base.withColumn("height", height_of_area(F.col("area_pixels"))).withColumn("floors", floors_of_height(F.col("height")))
    base = base.withColumn("apartments", apartments(F.col("area_pixels"), F.col("floors")))
    return base.select(
        "ord",
        "building_id",
        F.struct(F.lit("PIXEL").alias("coordinate_system"), F.col("polygon")).alias("geometry"),
        F.struct(
            "area_pixels", F.col("height").alias("height_meters"), F.col("floors").alias("estimated_floors"),
            F.col("apartments.total_estimated_flats").alias("estimated_total_flats"), F.col("apartments.estimated_flats_per_floor").alias("estimated_flats_per_floor"),
        ).alias("measurements"),
        "apartments",
        F.struct(F.lit("AI").alias("building_detection"), F.lit("TEMPORARY_ESTIMATE").alias("height"), F.lit("ESTIMATED").alias("floor_count")).alias("data_sources"),
        F.struct(F.lit(False).alias("land_record_match"), F.lit("NOT_VALIDATED").alias("status")).alias("validation"),
        F.lit(None).cast("string").alias("ulpin"),
    )


def merge_validation(properties: DataFrame, results: DataFrame) -> DataFrame:
    """The first result of each building_id replaces its validation; buildings without one stay NOT_VALIDATED."""
    result = F.struct(F.col("validation_status").alias("status"), "parcel_id", "overlap_iou", "building_coverage")
    first = results.groupBy("building_id").agg(F.min_by(result, "ord").alias("__v"))
    unknown = F.struct(F.lit("NOT_VALIDATED").alias("status"), F.lit(None).cast("string").alias("parcel_id"), F.lit(None).cast("double").alias("overlap_iou"), F.lit(None).cast("double").alias("building_coverage"))
    return properties.join(first, "building_id", "left").withColumn("validation", F.coalesce("__v", unknown)).drop("__v")


def add_identifiers(properties: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds the parcel's authority ID, the building's and the units' IDs, floor by floor, and the statuses."""
    joined = properties.join(ids.select(F.col("parcel_id").alias("__p"), "official_id"), F.col("validation.parcel_id") == F.col("__p"), "left")
    joined = joined.withColumn("official_ulpin", F.coalesce("official_id", F.lit(NO_AUTHORITY_ID))).withColumn("building_id", F.coalesce("building_id", F.lit("B001")))

    def floor(f: Column) -> Column:
        units = F.transform(f["flats"], lambda x: unit_id(F.col("official_ulpin"), F.col("building_id"), f["floor_number"], x))
        return f.withField("floor_id", floor_id(f["floor_number"])).withField("`3d_property_ids`", units)

    floors = F.transform("apartments.floors", floor)
    return joined.withColumns(
        {
            "apartments": F.col("apartments").withField("floors", floors),
            "ulpin_status": F.lit("PROTOTYPE_PLACEHOLDER"),
            "building_property_id": building_property_id(F.col("official_ulpin"), F.col("building_id")),
            "identifier_status": F.lit("PROTOTYPE"),
        }
    ).drop("__p", "official_id")


def scene_numbers(polygon: Column, height: Column, floors: Column, place: Column) -> dict[str, Column]:
    """x, z, w, d, h, floors and type of a scene object; place: 0-based."""
    box = bounding_box(polygon)
    at = lambda c: py_round((c - CENTRE) * SCALE, 3)
    size = lambda c: py_round(F.greatest(c * SCALE, F.lit(LEAST_SIZE)), 3)
    h = F.coalesce(height, F.lit(6.0))
    kind = F.element_at(F.array(*map(F.lit, SCENE_TYPES)), (F.pmod(place, F.lit(3)) + 1).cast("int"))
    return {"x": at(box["cx"]), "z": at(box["cy"]), "w": size(box["w"]), "d": size(box["d"]), "h": py_round(h, 3), "floors": F.coalesce(floors, floors_of_height(h)).cast("int"), "type": kind}


def scene_objects(properties: DataFrame, position: str = "position") -> DataFrame:
    """Scene objects of properties with a 0-based position; hasBasement is always false, ulpin is the record's own, always null."""
    n = scene_numbers(F.col("geometry.polygon"), F.col("measurements.height_meters"), F.col("measurements.estimated_floors"), F.col(position))
    return properties.select(
        F.col(position).cast("int").alias("id"), "building_id", *[c.alias(k) for k, c in n.items()], F.lit(False).alias("hasBasement"), "ulpin", F.coalesce("measurements.area_pixels", F.lit(0.0)).alias("area_pixels"),
        F.col("geometry.polygon").alias("polygon"), "validation", F.col("apartments").dropFields("average_apartment_area_assumption").alias("apartments"),
    )
