"""Sinks: JSON lines for tables of any size, and single documents for viewers, which hold all rows by their nature."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a document's rows may come to; a larger one goes to JSON lines.
MOST_ROWS = 200_000


def write_records(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines, as many files as partitions."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def document(df: DataFrame, order: str, prefix: str = "", end: str = "", indent: int = 2) -> DataFrame:
    """One row `value`: all records as one JSON array, in the given order, indented by 0 (one line), 2 or 4; raises beyond MOST_ROWS rows."""
    n = df.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} rows are too many for one document; use write_records")
    names = [c for c in df.columns if c != order]
    rows = df.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__ord"), F.struct(*names).alias("r")))).alias("rows"))
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if indent else {})
    said = F.to_json(F.transform("rows", lambda x: x["r"]), options)
    if indent == 4:
        said = F.regexp_replace(said, r"(?m)^( +)", "$1$1")  # a string's own line breaks are escaped, so lines begin with nothing else
    return rows.select(F.concat(F.lit(prefix), said, F.lit(end)).alias("value"))


def write_document(df: DataFrame, path: str, order: str, prefix: str = "", end: str = "", indent: int = 2) -> None:
    document(df, order, prefix, end, indent).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_script(df: DataFrame, path: str, order: str, name: str = "window.ULPIN_PROPERTIES") -> None:
    """A script that assigns the records to a name."""
    write_document(df, path, order, f"{name} = ", ";")


def png_bytes(grey: np.ndarray) -> bytes:
    """A PNG file of one channel of bytes."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = grey.shape
    lines = np.hstack([np.zeros((height, 1), np.uint8), grey.astype(np.uint8)])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def mask_files(pixels: DataFrame) -> DataFrame:
    """(image_id, content): a PNG of each mask, from (image_id, y, x, value); set pixels are 255, missing ones 0. An image is one group, bounded by its size."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        grey = np.zeros((int(p.y.max()) + 1, int(p.x.max()) + 1), np.uint8)
        grey[p.y.to_numpy(), p.x.to_numpy()] = np.where(p.value.to_numpy() > 0, 255, 0)
        return pd.DataFrame({"image_id": [p.image_id.iloc[0]], "content": [png_bytes(grey)]})

    return pixels.groupBy("image_id").applyInPandas(run, f"image_id {pixels.schema['image_id'].dataType.simpleString()}, content binary")


def write_masks(pixels: DataFrame, folder: str) -> None:
    """folder/<image_id>.png for each mask, written by the tasks; a task that runs again replaces its own. The folder must be shared by all executors."""

    def write(rows) -> None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{at}/{r.image_id}.png") as out:
                out.write(r.content)

    mask_files(pixels).foreachPartition(write)
