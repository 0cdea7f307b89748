"""Places in an order of all rows, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, by: Column, ties: list[Column], name: str = "position", runs: int = 256) -> DataFrame:
    """Adds a 0-based place in ascending order of by (a number, null first), then ties, which should make the order total.

    Rows are dealt to runs by approximate quantiles; each run is numbered by itself, after the rows of all runs before it.
    """
    rows = df.withColumn("__by", by)
    cuts = rows.agg(F.percentile_approx("__by", [k / runs for k in range(1, runs)], 10 * runs)).first()[0] or []
    bounds = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<double>")
    rows = rows.withColumn("__run", F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("__by"))), F.lit(-1)))
    counts = rows.groupBy("__run").agg(F.count(F.lit(1)).alias("__n"))  # `runs` rows at most
    before = counts.select(F.col("__run").alias("__r"), (F.sum("__n").over(Window.orderBy("__run")) - F.col("__n")).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__run").orderBy(F.col("__by").asc_nulls_first(), *ties))
    return rows.withColumn("__i", number).join(F.broadcast(before), F.col("__run") == F.col("__r")).withColumn(name, F.col("__before") + F.col("__i") - 1).drop("__by", "__run", "__r", "__n", "__before", "__i")


def train_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds position (in a seeded shuffle by an arithmetic hash of an integer key) and is_train for the first int(n * share) rows."""
    n = df.count()
    shuffled = F.pmod(F.col(key) * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))
    return with_position(df, shuffled, [F.col(key)]).withColumn("is_train", F.col("position") < F.lit(int(n * share)))
