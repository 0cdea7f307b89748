"""Buildings matched to land parcels, and what results are merged with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.geometry import area, bounding_box, common_area, intersection_area, is_rectangle, is_simple, repaired, total_area
from parcelwise.functions.names import NO_AUTHORITY_ID, building_property_id
from parcelwise.functions.rounding import py_round

MATCH_AT, OUTSIDE_UNDER = 0.70, 0.10


def _levelled(df: DataFrame, key: str, side: str) -> DataFrame:
    """Key, ring, box, kind and own level (the box's longer side is 2^level at most) of each ring that has an extent and finite corners.

    kind: 2, a rectangle along the axes; 1, another ring that doesn't meet itself; 0, one that does.
    """
    ring, box, c = F.col(f"{side}_ring"), bounding_box(F.col("polygon")), lambda name: F.col(f"{side}_{name}")
    corners = F.struct(*[box[n].alias(f"{side}_{n}") for n in ("x1", "y1", "x2", "y2")])
    each = df.where(F.size("polygon") >= 3).select(key, F.col("polygon").alias(f"{side}_ring"), F.inline(F.array(corners)))
    longest, reach = F.greatest(c("x2") - c("x1"), c("y2") - c("y1")), F.abs(c("x1")) + F.abs(c("y1")) + F.abs(c("x2")) + F.abs(c("y2"))
    each = each.where((longest > 0) & (reach < float("inf")))  # NaN is above infinity
    kind = F.when(is_rectangle(ring, c("x1"), c("y1"), c("x2"), c("y2")), 2).when(is_simple(ring), 1).otherwise(0)
    return each.withColumns({f"{side}_level": F.ceil(F.log2(longest)).cast("int"), f"{side}_kind": kind})


def overlaps(buildings: DataFrame, parcels: DataFrame) -> DataFrame:
    """(building, parcel, iou, coverage) of all pairs with a common area; rows need `__b` and `__p` keys and `polygon`.

    A box's grid is that of its own size, so it touches four cells at most, and it goes to the coarser grids that boxes of the other
    side have, too. Two boxes meet by an equal join on the coarser one's grid; a pair counts only in the cell of the corner of its
    common box, so none comes twice. Boxes are compared before any exact area is worked out, and two rectangles need no clipping.
    Rings that meet themselves are measured by the parts that repaired() gives. A first job finds levels and kinds of rings; the
    plan has only the measures that those need.
    """
    sides = {"b": _levelled(buildings, "__b", "b"), "p": _levelled(parcels, "__p", "p")}
    seen = {s: df.groupBy(f"{s}_level").agg(F.min(f"{s}_kind")).collect() for s, df in sides.items()}  # levels are exponents of doubles: 2,100 at most
    levels, least = {s: sorted(r[0] for r in rows) for s, rows in seen.items()}, min((r[1] for rows in seen.values() for r in rows), default=2)

    def gridded(side: str, other: str) -> DataFrame:
        own, size, c = F.col(f"{side}_level"), F.pow(F.lit(2.0), "level"), lambda name: F.col(f"{side}_{name}")
        box, ring, df = (c("x2") - c("x1")) * (c("y2") - c("y1")), c("ring"), sides[side]
        if least == 2:
            df = df.withColumn(f"{side}_area", box).drop(f"{side}_ring")
        elif least == 1:
            df = df.withColumn(f"{side}_area", F.when(c("kind") == 2, box).otherwise(area(ring)))
        else:
            df = df.withColumn(f"{side}_ring", F.when(c("kind") > 0, F.array(ring)).otherwise(repaired(ring)))
            df = df.withColumn(f"{side}_area", F.when(c("kind") == 2, box).otherwise(total_area(ring)))
        coarser = F.filter(F.lit(levels[other]) if levels[other] else F.array().cast("array<int>"), lambda v: v > own)
        cells = lambda a, b: F.sequence(F.floor(c(a) / size), F.floor(c(b) / size))
        return df.withColumn("level", F.explode(F.concat(F.array(own), coarser))).withColumn("gx", F.explode(cells("x1", "x2"))).withColumn("gy", F.explode(cells("y1", "y2")))

    joined = gridded("b", "p").join(gridded("p", "b"), ["level", "gx", "gy"])
    x1, y1, size = F.greatest("b_x1", "p_x1"), F.greatest("b_y1", "p_y1"), F.pow(F.lit(2.0), "level")
    x2, y2 = F.least("b_x2", "p_x2"), F.least("b_y2", "p_y2")
    here = (F.greatest("b_level", "p_level") == F.col("level")) & (F.floor(x1 / size) == F.col("gx")) & (F.floor(y1 / size) == F.col("gy"))
    common = (x2 - x1) * (y2 - y1)
    if least < 2:
        exact = intersection_area(F.col("b_ring"), F.col("p_ring")) if least else common_area(F.col("b_ring"), F.col("p_ring"))
        common = F.when((F.col("b_kind") == 2) & (F.col("p_kind") == 2), common).otherwise(exact)
    both = joined.where((x1 < x2) & (y1 < y2) & here).select("__b", "__p", F.inline(F.array(F.struct(common.alias("common"), F.col("b_area").alias("own"), F.col("p_area").alias("other")))))
    union = F.col("own") + F.col("other") - F.col("common")
    return both.select("__b", "__p", F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("iou"), F.when(F.col("own") > 0, F.col("common") / F.col("own")).otherwise(0.0).alias("coverage")).where("iou > 0")


def status(parcel: Column, iou: Column, coverage: Column) -> Column:
    return F.when(parcel.isNull(), "UNREGISTERED").when(coverage < OUTSIDE_UNDER, "OUTSIDE_PARCEL").when(iou >= MATCH_AT, "MATCH").otherwise("PARTIAL_MATCH")


def match_parcels(buildings: DataFrame, parcels: DataFrame, order: str = "ord") -> DataFrame:
    """Each building's best parcel by overlap; of equal ones the first by `order`. Buildings need building_id, polygon and a unique `order`, too.

    Gives building_id, order, validation_status, parcel_id, overlap_iou and building_coverage; a building without any common area is UNREGISTERED.
    """
    b = buildings.select("building_id", F.col(order).alias("__b"), "polygon")
    p = parcels.select("parcel_id", F.col(order).alias("__p"), "polygon")
    found = overlaps(b.drop("building_id"), p.drop("parcel_id"))
    best = found.groupBy("__b").agg(F.max(F.struct("iou", (-F.col("__p")).alias("first"), "coverage")).alias("best"))
    named = best.select("__b", "best.iou", "best.coverage", (-F.col("best.first")).alias("__p")).join(p.select("__p", "parcel_id"), "__p")
    out = b.drop("polygon").join(named, "__b", "left")
    zero = lambda c: py_round(F.coalesce(c, F.lit(0.0)), 4)
    return out.select("building_id", F.col("__b").alias(order), status(F.col("parcel_id"), F.col("iou"), F.col("coverage")).alias("validation_status"), "parcel_id", zero("iou").alias("overlap_iou"), zero("coverage").alias("building_coverage"))


def merge_first(left: DataFrame, right: DataFrame, key: str, order: str, defaults: dict[str, Column]) -> DataFrame:
    """left with the columns of the first row of right by key and order; where there is none, the defaults."""
    names = [c for c in right.columns if c not in (key, order)]
    first = right.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("__r"))
    joined = left.join(first, key, "left")
    return joined.select(*left.columns, *[F.when(F.col("__r").isNull(), defaults[c]).otherwise(F.col(f"__r.{c}")).alias(c) if c in defaults else F.col(f"__r.{c}").alias(c) for c in names])


def with_authority(matched: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds official_ulpin (14 zeros for a null or unknown parcel) and building_property_id."""
    joined = matched.join(ids.select("parcel_id", "official_id"), "parcel_id", "left")
    official = F.coalesce("official_id", F.lit(NO_AUTHORITY_ID))
    return joined.select(*matched.columns, official.alias("official_ulpin"), building_property_id(official, F.col("building_id")).alias("building_property_id"))
