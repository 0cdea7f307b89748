"""Scans: JSON records, images, and censuses of files and folders. All go through Spark's readers."""

from __future__ import annotations

import logging
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.functions.names import view_of
from parcelwise.functions.rounding import py_round

# Suffixes by what is looked for
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp")
CENSUS_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff")
#: Values of an image that a Python step gives at once.
SLICE_VALUES = 1 << 16


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records with `ord`, its place in the array; a missing file is an error, and so is one that is cut off or no JSON array.

    Missing fields and nulls both come as null. An array is one row and one task; records without such an end belong in JSON lines.
    """
    whole = spark.read.text(path, wholetext=True)
    found = F.from_json("value", f"array<struct<{_fields(schema)}>>", {"mode": "FAILFAST"})
    return whole.select(F.posexplode(F.coalesce(found, F.raise_error(F.lit("not a JSON array")))).alias("ord", "r")).select("r.*", "ord")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode, as executors elsewhere don't see the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"file://{tempfile.gettempdir()}/parcelwise-checkpoints"


def _fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def folder_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def find_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = CENSUS_SUFFIXES) -> DataFrame:
    """(path, length) of all files below folder with one of the suffixes, in any case; none for a missing folder. No content is read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long")
    return files.where(suffix(F.col("path")).isin(*suffixes))


def image_counts(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(building_id, image_count) for each of folders (building_id), empty ones too, counting jpg and jpeg by exact case only."""
    some = files.where(F.endswith("path", F.lit(".jpg")) | F.endswith("path", F.lit(".jpeg"))).groupBy(folder_name(F.col("path")).alias("building_id")).agg(F.count(F.lit(1)).alias("n"))
    return folders.join(some, "building_id", "left").select("building_id", F.coalesce("n", F.lit(0)).cast("int").alias("image_count"))


def building_folders(names: DataFrame, name: str = "name", prefix: str = "building", most: int = 20) -> DataFrame:
    """The first `most` names (a feature, not a cap) that begin with the prefix and a number, in any case, by their first number, then by name."""
    low = F.lower(F.col(name))
    number = F.regexp_extract(F.col(name), r"(\d+)", 1).cast("long")
    return names.where(low.rlike(rf"^{prefix}\d+")).select(F.col(name).alias("name"), number.alias("number")).orderBy("number", "name").limit(most)


def images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """(path, height, width, channels, mode, data); pixels are in the order B, G, R. Paths are written as find_files() has them."""
    raw = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_replace("image.origin", "^file:///", "file:/").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.mode", "image.data")


def image_set(spark: SparkSession, path: str) -> DataFrame:
    """images() with a suffix in IMAGE_SUFFIXES, in any case, in the order of their paths; what can't be decoded is left out, with a warning of how many."""
    files = find_files(spark, path, IMAGE_SUFFIXES)
    if files.isEmpty():
        return spark.createDataFrame([], "path string, height int, width int, channels int, mode int, data binary")
    found = images(spark, path).where(suffix(F.col("path")).isin(*IMAGE_SUFFIXES))
    bad = files.join(found.select("path"), "path", "left_anti").count()
    if bad:
        logging.getLogger(__name__).warning("%d images can't be decoded and are left out", bad)
    return found.orderBy("path")


def image_information(found: DataFrame) -> DataFrame:
    """(file_name, format, width, height, mode) of images(); the format goes by the suffix, JPEG for jpg."""
    kind = F.upper(F.regexp_replace(suffix(F.col("path")), "^jpg$", "jpeg"))
    return found.select(file_name(F.col("path")).alias("file_name"), kind.alias("format"), "width", "height", colour_mode(F.col("channels")).alias("mode"))


def colour_mode(channels: Column) -> Column:
    return F.when(channels == 1, "L").when(channels == 3, "RGB").when(channels == 4, "RGBA")


def image_inventory(found: DataFrame, files: DataFrame) -> DataFrame:
    """One row an image: building_id, filename, extension, width, height, mode, size_mb, view_type, error (null if it decodes); bad images stay."""
    joined = files.join(found.drop("data"), "path", "left")
    bad = F.col("width").isNull() | (F.col("width") < 0)
    mode = colour_mode(F.col("channels"))
    good = lambda c: F.when(~bad, c)
    return joined.select(
        folder_name(F.col("path")).alias("building_id"), file_name(F.col("path")).alias("filename"), good(suffix(F.col("path"))).alias("extension"), good(F.col("width")).alias("width"),
        good(F.col("height")).alias("height"), good(mode).alias("mode"), good(py_round(F.col("length") / F.lit(1048576.0), 3)).alias("size_mb"), view_of(file_name(F.col("path"))).alias("view_type"),
        F.when(bad, F.lit("cannot be decoded")).alias("error"),
    )


def pixels(found: DataFrame) -> DataFrame:
    """(path, y, x, c, value) with c in the order R, G, B (then alpha), from images(); decoded in slices of SLICE_VALUES, so no image becomes one array."""

    def run(batches):
        for batch in batches:
            for path, width, channels, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(data, np.uint8)
                order = np.array([2, 1, 0, 3] if channels >= 3 else [0, 1], np.int32)
                for at in range(0, len(values), SLICE_VALUES):
                    part = values[at : at + SLICE_VALUES]
                    i = np.arange(at, at + len(part))
                    y, x, c = i // (width * channels), i % (width * channels) // channels, order[i % channels]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), *(pa.array(v.astype(np.int32)) for v in (y, x, c, part))], names=["path", "y", "x", "c", "value"])

    return found.where("width > 0").select("path", "width", "channels", "data").mapInArrow(run, "path string, y int, x int, c int, value int")


def mask_pixels(found: DataFrame) -> DataFrame:
    """(image_id, y, x, value 0 or 255): grey level over 127. Grey is 0.299 R + 0.587 G + 0.114 B in 65,536ths, rounded half up."""
    level = F.sum(F.when(F.col("c") == 0, 19595).when(F.col("c") == 1, 38470).when(F.col("c") == 2, 7471).otherwise(0) * F.col("value"))
    grey = pixels(found).groupBy("path", "y", "x").agg(level.alias("rgb"), F.max("value").alias("one"), F.count(F.lit(1)).alias("n"))
    rounded = F.shiftright(F.col("rgb") + 32768, 16)
    return grey.select(F.col("path").alias("image_id"), "y", "x", F.when(F.when(F.col("n") == 1, F.col("one")).otherwise(rounded) > 127, 255).otherwise(0).alias("value"))


def image_mask_pairs(files: DataFrame) -> DataFrame:
    """(image_path, mask_path) where X.png has an X_mask.png beside it."""
    png = files.where(suffix(F.col("path")) == "png")
    masks = png.where(F.col("path").rlike(r"_mask\.png$")).select(F.col("path").alias("mask_path"), F.regexp_replace("path", r"_mask\.png$", ".png").alias("image_path"))
    return png.where(~F.col("path").rlike(r"_mask\.png$")).select(F.col("path").alias("image_path")).join(masks, "image_path")


def ini_settings(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, section, key, value) of INI files; what comes before the first section has section ''. A file is one group: they are small by nature."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "said"))
    head = F.regexp_extract("said", r"^\s*\[([^\]]*)\]\s*$", 1)
    section = F.last(F.when(F.col("said").rlike(r"^\s*\[[^\]]*\]\s*$"), head), ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    pairs = lines.withColumn("section", F.coalesce(section, F.lit(""))).where(F.col("said").rlike(r"^\s*[^\[;#=\s][^=]*="))
    return pairs.select("path", "line", "section", F.trim(F.regexp_extract("said", r"^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("said", r"^[^=]*=(.*)$", 1)).alias("value"))


def authority_ids(spark: SparkSession, ids: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(ids.items()), "parcel_id string, official_id string")
