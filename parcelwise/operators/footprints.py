"""Footprints: a deterministic city grid, and buildings out of binary masks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions.geometry import rectangle
from parcelwise.functions.names import building_id
from parcelwise.operators.positions import with_position
from parcelwise.sources.files import shared_folder

# buildings' types by their number
TYPES = ("residential", "residential", "commercial", "residential", "institutional")
# Statuses of buildings that come from the grid
DETECTION, GEOMETRY = "DATASET_DERIVED_PROTOTYPE", "PROTOTYPE_ESTIMATE"
# The ground of synthetic images (red, green, blue)
BACKGROUND = (120, 150, 110)
LEAST_AREA, EPSILON = 50.0, 0.02


def city_grid(numbers: DataFrame, number: str = "n") -> DataFrame:
    """For building numbers from 1 on: rows of five, with sizes, floors, type and polygon by arithmetic."""
    n = F.col(number).cast("long")
    i = n - 1
    of = lambda a, k, m: (F.lit(a) + F.pmod(n * k, F.lit(m))).cast("int")
    base = numbers.select(n.alias("n"), building_id(n).alias("building_id"), of(8, 3, 9).alias("w"), of(7, 5, 8).alias("d"), of(2, 7, 6).alias("floors"), (18 + 22 * F.pmod(i, F.lit(5))).cast("int").alias("x"), (18 + 20 * F.floor(i / 5)).cast("int").alias("z"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(F.col("n") - 1, F.lit(5)) + 1).cast("int"))
    return base.withColumns(
        {
            "h": F.col("floors") * 3.0,
            "area_pixels": (F.col("w") * F.col("d")).cast("double"),
            "type": kind,
            "hasBasement": F.pmod("n", F.lit(5)) == 0,
            "polygon": rectangle(F.col("x") - F.col("w") / 2, F.col("z") - F.col("d") / 2, F.col("x") + F.col("w") / 2, F.col("z") + F.col("d") / 2),
        }
    )


def city_of_folders(folders: DataFrame) -> DataFrame:
    """The city grid of building folders (name, number, image_count), numbered from 1 by number, then name; raises where there is none.

    The order is that of building_folders(), whose length its own limit bounds. `ord` is the building's number.
    """
    if folders.isEmpty():
        raise ValueError("no building folders")
    placed = with_position(folders, F.col("number"), [F.col("name")])
    named = placed.select((F.col("position") + 1).alias("__n"), F.col("name").alias("source_folder"), F.col("image_count").alias("source_image_count"))
    grid = city_grid(named.select("__n"), "__n")
    full = grid.join(named, F.col("n") == F.col("__n")).drop("__n").withColumnRenamed("n", "ord")
    return full.withColumns({"detection_status": F.lit(DETECTION), "geometry_status": F.lit(GEOMETRY)})


def binarize(value: Column, over: float = 127) -> Column:
    return F.when(value > over, 255).otherwise(0)


def mask_runs(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x1, x2): unbroken runs of set pixels within a row of a mask, from (image_id, y, x, value)."""
    on = pixels.where("value > 0").select("image_id", "y", "x")
    island = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    return on.withColumn("g", island).groupBy("image_id", "y", "g").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("g")


def components(runs: DataFrame) -> DataFrame:
    """runs with `component`, the least place (y * 2^32 + x) of all runs that touch, corners included.

    Each round takes the least label of the runs a run touches, then the label's own label, until nothing changes.
    """
    spark = runs.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    runs = runs.withColumn("run", F.col("y").cast("long") * (1 << 32) + F.col("x1"))
    a, b = runs.alias("a"), runs.alias("b")
    touch = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.y") == F.col("b.y") + 1) & (F.col("a.x1") <= F.col("b.x2") + 1) & (F.col("b.x1") <= F.col("a.x2") + 1)
    edges = a.join(b, touch).select(F.col("a.image_id").alias("image_id"), F.col("a.run").alias("u"), F.col("b.run").alias("v"))
    edges = edges.unionByName(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v"))).checkpoint()
    labels = runs.select("image_id", F.col("run").alias("u"), F.col("run").alias("label")).checkpoint()
    while True:
        near = edges.join(labels.select("image_id", F.col("u").alias("v"), "label"), ["image_id", "v"]).groupBy("image_id", "u").agg(F.min("label").alias("near"))
        low = labels.join(near, ["image_id", "u"], "left").select("image_id", "u", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = low.select("image_id", F.col("u").alias("low"), F.col("low").alias("lower"))
        now = low.join(jump, ["image_id", "low"], "left").select("image_id", "u", "was", F.least("low", F.coalesce("lower", "low")).alias("label")).checkpoint()
        if now.where("was != label").isEmpty():
            return runs.join(now.select("image_id", F.col("u").alias("run"), F.col("label").alias("component")), ["image_id", "run"]).drop("run")
        labels = now.drop("was")


def _boundary(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The outer ring through the pixels of one component, from its topmost, then leftmost pixel, clockwise (y down), corners only."""
    around = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    start = min(cells, key=lambda c: (c[1], c[0]))
    ring, at, facing = [start], start, 0
    first = None
    while True:
        for k in range(8):
            turn = (facing + 5 + k) % 8
            to = (at[0] + around[turn][0], at[1] + around[turn][1])
            if to in cells:
                break
        else:
            return ring
        if (at, turn) == first:
            break
        first = first or (at, turn)
        if ring and len(ring) > 1 and facing == turn and ring[-1] == at:
            ring.pop()
        at, facing = to, turn
        ring.append(at)
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def _simplified(ring: list, epsilon: float) -> list:
    """Douglas and Peucker on a closed ring, cut at its first point and the one furthest from it."""
    if len(ring) < 3:
        return ring
    far = max(range(len(ring)), key=lambda i: (ring[i][0] - ring[0][0]) ** 2 + (ring[i][1] - ring[0][1]) ** 2)

    def between(points: list) -> list:
        kept, open_parts = {0, len(points) - 1}, [(0, len(points) - 1)]
        while open_parts:
            i, j = open_parts.pop()
            (x1, y1), (x2, y2) = points[i], points[j]
            length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
            off = [abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5 for x, y in points[i + 1 : j]]
            if off and max(off) > epsilon:
                k = i + 1 + off.index(max(off))
                kept.add(k)
                open_parts += [(i, k), (k, j)]
        return [points[i] for i in sorted(kept)]

    return between(ring[: far + 1])[:-1] + between([*ring[far:], ring[0]])[:-1]


def contours(labelled: DataFrame, least_area: float = LEAST_AREA, epsilon: float = EPSILON) -> DataFrame:
    """Footprints from components(): image_id, building_id, area_pixels (of the ring before it is simplified), polygon.

    Each component is traced by itself; small ones go before numbering, which runs by descending top row, then left column.
    """

    def trace(runs: pd.DataFrame) -> pd.DataFrame:
        ring = _boundary({(x, int(r.y)) for r in runs.itertuples() for x in range(int(r.x1), int(r.x2) + 1)})
        closed = list(zip(ring, ring[1:] + ring[:1], strict=True))
        size = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in closed)) / 2
        if size < least_area:
            return pd.DataFrame({"image_id": [], "area_pixels": [], "polygon": []}, dtype=object)
        length = sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in closed)
        return pd.DataFrame({"image_id": [runs.image_id.iloc[0]], "area_pixels": [float(size)], "polygon": [[[float(x), float(y)] for x, y in _simplified(ring, epsilon * length)]]})

    found = labelled.groupBy("image_id", "component").applyInPandas(trace, f"image_id {labelled.schema['image_id'].dataType.simpleString()}, area_pixels double, polygon array<array<double>>")
    top, left = F.array_min(F.transform("polygon", lambda p: p[1])), F.array_min(F.transform("polygon", lambda p: p[0]))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy(top.desc(), left.asc(), F.col("area_pixels").desc()))
    return found.select("image_id", building_id(number).alias("building_id"), "area_pixels", "polygon")


def rasterize(pixels: DataFrame, rectangles: DataFrame) -> DataFrame:
    """pixels (image_id, y, x, value) painted with (image_id, ord, x1, y1, x2, y2, value), corners inclusive; of several the last by ord wins."""
    p, r = pixels.alias("p"), rectangles.alias("r")
    within = (F.col("p.image_id") == F.col("r.image_id")) & F.col("p.x").between(F.col("r.x1"), F.col("r.x2")) & F.col("p.y").between(F.col("r.y1"), F.col("r.y2"))
    hit = p.join(r, within, "left").groupBy("p.image_id", "p.y", "p.x").agg(F.max_by("r.value", "r.ord").alias("paint"), F.first("p.value").alias("was"))
    return hit.select("image_id", "y", "x", F.coalesce("paint", "was").alias("value"))


def synthetic_rectangles(images: DataFrame, size: int = 640, seed: int = 7) -> DataFrame:
    """For (image_id): 3 to 8 rectangles an image, 50 to 140 by 50 to 120, ten pixels from the edges, red, green and blue of 170 to 230, by a seeded hash."""

    def pick(low: int | Column, high: int | Column, what: str) -> Column:
        return (F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "image_id", "ord"), F.lit(high) - F.lit(low) + 1)).cast("int")

    base = images.select("image_id", F.lit(-1).alias("ord")).withColumn("k", pick(3, 8, "count")).select("image_id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("ord"))
    base = base.withColumns({"w": pick(50, 140, "w"), "h": pick(50, 120, "h"), "red": pick(170, 230, "red"), "green": pick(170, 230, "green"), "blue": pick(170, 230, "blue")})
    base = base.withColumns({"x1": pick(10, F.lit(size - 10) - F.col("w"), "x"), "y1": pick(10, F.lit(size - 10) - F.col("h"), "y")})
    return base.select("image_id", "ord", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), "red", "green", "blue")


def synthetic_pixels(rectangles: DataFrame, size: int = 640) -> DataFrame:
    """(image_id, y, x, red, green, blue, mask): the rectangles on BACKGROUND, corners inclusive, later ones on top; mask is 255 within any, else 0.

    A pixel is worked out from its own image's rectangles (eight at most), so nothing is joined by places.
    """
    all_of = rectangles.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2", "red", "green", "blue")), asc=False).alias("r"))
    places = all_of.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    top = F.get(F.filter("r", lambda t: F.col("x").between(t["x1"], t["x2"]) & F.col("y").between(t["y1"], t["y2"])), F.lit(0))
    seen = places.select("image_id", "y", "x", top.alias("t"))
    colours = [F.coalesce(F.col(f"t.{c}"), F.lit(v)).alias(c) for c, v in zip(("red", "green", "blue"), BACKGROUND, strict=True)]
    return seen.select("image_id", "y", "x", *colours, F.when(F.col("t").isNull(), 0).otherwise(255).alias("mask"))


# Raster values: normalised, binary, in channel order, and resized by the nearest pixel.


def normalized(value: Column) -> Column:
    return value.cast("double") / 255.0


def sigmoid_mask(logit: Column) -> Column:
    return (1 / (1 + F.exp(-logit)) > 0.5).cast("int")


def channel_first(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Adds batch, always 0, and idx, the flat place of (batch, c, y, x)."""
    return pixels.withColumn("batch", F.lit(0)).withColumn("idx", F.col("c") * (height * width) + F.col("y") * width + F.col("x"))


def resized(pixels: DataFrame, height: int, width: int, new_height: int = 640, new_width: int = 640) -> DataFrame:
    """Nearest pixel: each old pixel goes to the new ones that fall on it, (path, y, x, c, value) in and out."""
    spread = lambda c, old, new: F.sequence(F.ceil(F.col(c) * new / old).cast("int"), F.ceil((F.col(c) + 1) * new / old).cast("int") - 1)
    some = lambda c, old, new: F.ceil((F.col(c) + 1) * new / old) > F.ceil(F.col(c) * new / old)
    kept = pixels.where(some("y", height, new_height) & some("x", width, new_width))
    down = kept.withColumn("ny", F.explode(spread("y", height, new_height)))
    return down.withColumn("nx", F.explode(spread("x", width, new_width))).select("path", F.col("ny").alias("y"), F.col("nx").alias("x"), "c", "value")
