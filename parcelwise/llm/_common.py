"""What the operators of this subpackage share: tables, the shared folder, Arrow batches, words."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of a text, for Spark's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python step holds at once; a longer text is one slice of its own.
SLICE_BYTES = 2 << 20
#: What Spark puts into one batch for Python at most; its own limit lets two tasks hold several hundred MB.
BATCH_BYTES = 8 << 20
_made: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as it lies in sf_dir, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode; elsewhere an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}/parcelwise-shared").rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all(spark: SparkSession) -> None:
    for path in list(_made):
        _made.discard(path)
        try:
            _remove(spark, path)
        except Exception:  # the session may be over
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: its lineage ends there, and a lost executor costs no recomputation.

    The files stay until the Python process ends, because results are lazy. Shuffle files of the finished step are let go.
    """
    spark = df.sparkSession
    if not _made:
        atexit.register(_remove_all, spark)
    path = f"{shared_dir(spark)}/parcelwise/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.add(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner find shuffle files that nothing refers to any more; else they fill the disk until a chance collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def rows_with(df: DataFrame, keys: DataFrame, on: str, most: int = 250_000) -> DataFrame:
    """df's rows whose value of `on` is in keys (written tables, one such column); keys, some 100 bytes each, go to all executors up to `most` rows, else both sides are shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, on, "left_semi")


def others(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of df but those that clash, in any case, with names."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in low]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most limit bytes of text in all, or one longer row."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to BATCH_BYTES, if it is higher: texts can be long, so rows alone don't bound a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = str(spark.conf.get(key, "64m")).lower().rstrip("b")
    now = int(said[:-1]) << {"k": 10, "m": 20, "g": 30}[said[-1]] if said[-1] in "kmg" else int(said)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], keep: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """df's columns (or those of keep) and the new fields, which make()(texts) works out from slices of the column text.

    make is called once a task; what it returns may have a `done`, called at the task's end. Columns of df whose names clash with the new ones are replaced.
    """
    new = [f.name for f in fields]
    kept = [c for c in others(df, new) if keep is None or c in keep]
    at = kept.index(text) if text in kept and isinstance(df.schema[text].dataType, T.StringType) else len(kept)
    src = df.select(*[col(c) for c in kept], *([col(text).cast("string").alias("__text")] if at == len(kept) else []))
    n = len(kept)

    def run(batches):
        work = make()
        try:
            for batch in batches:
                for part in slices(batch, at, limit):
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], *work(part.column(at))], names=[*kept, *new])
        finally:
            getattr(work, "done", lambda: None)()

    small_batches(df.sparkSession)
    return src.mapInArrow(run, T.StructType([*src.schema.fields[:n], *fields]))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and their n + 1 bounds (null: empty)."""
    texts = pc.fill_null(texts, "")
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    if not bounds[-1]:
        return np.zeros(0, np.uint8), bounds
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    first = int(np.frombuffer(texts.buffers()[1], kind)[texts.offset])
    return np.frombuffer(texts.buffers()[2], np.uint8)[first : first + int(bounds[-1])], bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
