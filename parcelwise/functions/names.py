"""Identifiers, labels and classes of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders for the identifiers of parcels, and what a parcel without one has
AUTHORITY_IDS = {"P001": "1234567890ABCD", "P002": "2345678901BCDE", "P003": "3456789012CDEF"}
NO_AUTHORITY_ID = "00000000000000"
# Views by the first of these in a file's name
VIEWS = ("front", "left", "right", "low", "zoom")


def building_id(number: Column) -> Column:
    return F.format_string("B%03d", number.cast("long"))


def floor_label(floor: Column) -> Column:
    return F.when(floor == 0, F.lit("Ground Floor")).otherwise(F.concat(F.lit("Floor "), floor.cast("string")))


def floor_id(floor: Column) -> Column:
    return F.format_string("F%02d", floor.cast("int"))


def flat_id(floor: Column, number: Column) -> Column:
    return F.when(floor == 0, F.format_string("G%02d", number.cast("int"))).otherwise(F.format_string("%d%02d", floor.cast("int"), number.cast("int")))


def unit_id(authority: Column, building: Column, floor: Column, flat: Column) -> Column:
    """authority-building-Fff-Uflat; one U at the flat's start isn't repeated."""
    return F.concat_ws("-", authority, building, floor_id(floor), F.concat(F.lit("U"), F.regexp_replace(flat, "^U", "")))


def building_property_id(authority: Column, building: Column) -> Column:
    return F.concat_ws("-", authority, building)


def view_of(name: Column) -> Column:
    """The first of VIEWS that the lower-cased name contains, also within a word; else unknown."""
    low = F.lower(name)
    return reduce(lambda out, v: F.when(F.contains(low, F.lit(v)), F.lit(v)).otherwise(out), reversed(VIEWS), F.lit("unknown"))
