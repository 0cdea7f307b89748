"""The main chains: footprints and parcels to identified properties, and on to scene objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.operators.matching import match_parcels
from parcelwise.operators.positions import with_position
from parcelwise.operators.properties import add_identifiers, build_properties, merge_validation, scene_objects


def identified_properties(buildings: DataFrame, parcels: DataFrame, ids: DataFrame) -> DataFrame:
    """buildings and parcels have ord, their place in the input; errors are raised, not swallowed."""
    return add_identifiers(merge_validation(build_properties(buildings), match_parcels(buildings, parcels)), ids)


def scene(buildings: DataFrame, parcels: DataFrame, ids: DataFrame) -> DataFrame:
    return scene_objects(with_position(identified_properties(buildings, parcels, ids), F.col("ord"), [F.col("building_id")]))
