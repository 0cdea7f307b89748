"""Counts and staging of files and records."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def view_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("view_type").agg(F.count(F.lit(1)).alias("images")).orderBy("view_type")


def images_by_building(images: DataFrame, buildings: DataFrame) -> DataFrame:
    """(building_id, image_count, images): the records in the order of their names; buildings without images have none."""
    names = [c for c in images.columns if c != "building_id"]
    some = images.groupBy("building_id").agg(F.sort_array(F.collect_list(F.struct("filename", *[c for c in names if c != "filename"]))).alias("__images"))
    kind = images.select(F.array(F.struct("filename", *[c for c in names if c != "filename"])).alias("x")).schema["x"].dataType
    full = F.coalesce("__images", F.array().cast(kind))
    return buildings.select("building_id").join(some, "building_id", "left").select("building_id", F.size(full).alias("image_count"), full.alias("images"))


def to_stage(source: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """What isn't staged yet."""
    return source.join(staged.select(key), key, "left_anti")


def staging_report(source: DataFrame, folder: str) -> DataFrame:
    """(building_id, source_images, prepared_images, image_directory): what was staged before counts as prepared."""
    n = source.groupBy("building_id").agg(F.count(F.lit(1)).cast("int").alias("source_images"))
    return n.select("building_id", "source_images", F.col("source_images").alias("prepared_images"), F.concat(F.lit(folder.rstrip("/") + "/"), "building_id", F.lit("/images")).alias("image_directory"))


def check_count(df: DataFrame, expected: int) -> int:
    """The number of rows; another one than expected is only warned about."""
    n = df.count()
    if n != expected:
        logging.getLogger(__name__).warning("%d records, %d expected", n, expected)
    return n


def mean_losses(batches: DataFrame) -> DataFrame:
    """(epoch, training_loss, validation_loss) from (epoch, split, loss), a row a batch; split is train or val. A split without batches has null."""
    mean = lambda split: F.avg(F.when(F.col("split") == split, F.col("loss")))
    return batches.groupBy("epoch").agg(mean("train").alias("training_loss"), mean("val").alias("validation_loss"))
