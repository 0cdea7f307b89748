"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm._common import materialize


def _oriented(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for each node u that isn't the least of its component, v being the least; edges: (u, v) of any one type.

    Stars: in turn each node's larger neighbours, then its smaller ones, are tied to its least neighbour, until nothing
    changes (Kiveris et al., 2014). No step gathers the neighbours of a node; only minima are aggregated.
    """
    now, was = materialize(_oriented(edges), "edges"), None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == was or not mark[0]:
            return now
        was = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(_oriented(small), "stars")
