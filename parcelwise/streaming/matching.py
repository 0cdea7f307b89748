"""Footprints that arrive as a stream, matched batch by batch; the reference data (parcels) are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from parcelwise.operators.matching import match_parcels


def match_stream(buildings: DataFrame, parcels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's matches to path/batch=<number>; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        match_parcels(batch, parcels).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return buildings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
