"""Removal of passages that occur more than once, by refinement of q-gram buckets as in bucket-pointer refinement.

Every string of LENGTH bytes of the corpus is a suffix's start that has to meet its equals. Sorting all of them is too dear, so
each string belongs to its anchor: the place, among the starts of its q-grams, whose hash is least. Equal strings have their
anchors at the same offset, so the anchors' q-grams are the initial buckets, one for some 76 bytes, and only buckets with two
anchors go on. A bucket identifier of a string around an anchor is the q-gram's bucket refined by a hash of what lies further off;
buckets are refined from the widest context to single offsets:

1. the whole context of all offsets: two alike settle all strings of the anchor;
2. cells of CELL offsets: two alike settle the cell, and one whose common part is alone in its bucket settles it, too;
3. single offsets of the cells that are left.

One of those that a step settles alike goes on as a witness where its bucket has others that aren't settled yet.

Each step counts identifiers with a map-side aggregate and joins those that occur twice back, so no bucket is gathered in one
task, however hot, and the cost of later steps follows the edges of passages, not their lengths or numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm._common import col, materialize, mixed, others, slices, small_batches, text_key, utf8

LENGTH = 200
GRAM = 50
#: Starts of q-grams within a string.
STARTS = LENGTH - GRAM + 1
CELL = 16
_BASE = 0x9E3779B97F4A7C15
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, by doubling; places too near the end hold nothing useful."""
    h, out, have, n = _VALUE[data], None, 0, 1
    while True:
        if GRAM & n:
            out = h if out is None else _joined(out, have, h, n)
            have += n
        if 2 * n > GRAM:
            return mixed(out)
        h, n = _joined(h, n, h, n), 2 * n


def _joined(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    out = a * np.uint64(pow(_BASE, m, 1 << 64))
    if n < len(out):
        out[: len(out) - n] += b[n:]
    return out


def _least_starts(packed: np.ndarray) -> np.ndarray:
    """The least of STARTS values from each place on."""
    n, out = 1, packed
    while 2 * n <= STARTS:
        out = np.minimum(out, np.concatenate([out[n:], np.full(min(n, len(out)), np.iinfo(np.uint64).max, np.uint64)]))
        n *= 2
    rest = STARTS - n
    return np.minimum(out, np.concatenate([out[rest:], np.full(min(rest, len(out)), np.iinfo(np.uint64).max, np.uint64)]))


def anchors(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(text, anchor's place, least and greatest offset of its strings, q-gram's hash) for each anchor of texts over LENGTH bytes."""
    data, bounds = utf8(texts)
    size = np.diff(bounds)
    if not (size >= LENGTH).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    grams = _gram_hashes(data)
    place = np.arange(len(data), dtype=np.uint64)
    owner = (_least_starts((grams & np.uint64(0xFFFFFFFF00000000)) | place) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long = np.flatnonzero(size >= LENGTH)
    many = size[long] - LENGTH + 1
    starts = np.repeat(bounds[long] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    own = owner[starts]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.append(first[1:], len(own)) - 1
    at = own[first]
    doc = np.searchsorted(bounds, at, side="right") - 1
    return doc, at - bounds[doc], at - starts[last], at - starts[first], grams[at]


def _anchor_rows(docs: DataFrame, text: str) -> DataFrame:
    """(key, at, low, high, gram, wide): wide is a hash of the context of all offsets, null where the text ends before."""
    schema = "key binary, at int, low short, high short, gram long, wide long"

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                texts = pc.fill_null(part.column(0), "")
                doc, at, low, high, gram = anchors(texts)
                raw = [t.encode() for t in texts.to_pylist()]
                keys = [hashlib.md5(t, usedforsecurity=False).digest() for t in raw]
                wide = [xxhash.xxh3_64_intdigest(raw[d][p - STARTS + 1 : p + LENGTH]) if p >= STARTS - 1 and p + LENGTH <= len(raw[d]) else None for d, p in zip(doc.tolist(), at.tolist(), strict=True)]
                signed = pa.array([None if w is None else w - (1 << 64) if w >> 63 else w for w in wide], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()).take(pa.array(doc)), pa.array(at.astype(np.int32)), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16)), pa.array(gram.view(np.int64)), signed],
                    names=["key", "at", "low", "high", "gram", "wide"],
                )

    small_batches(docs.sparkSession)
    return docs.select(col(text).cast("string").alias("t")).where(F.octet_length("t") >= LENGTH).mapInArrow(run, schema)


def _twice(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The identifiers that two different places of different texts or one text have, with one of the places; equal texts count as one."""
    return materialize(rows.groupBy(*by).agg(F.min(_place()).alias("witness"), F.max(_place()).alias("b")).where("witness < b").select(*by, "witness"), name)


def _place() -> Column:
    return F.xxhash64("key", "at")


def repeated(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, spans): for each text with repeated strings, their starts as ranges (lo, hi), both inclusive, in any order.

    key: the first 16 bytes that stand for the text. All of a text that occurs in two rows is repeated.
    """
    rows = _anchor_rows(docs, text)
    some = materialize(rows.join(_twice(rows, ["gram"], "span-grams").drop("witness"), "gram"), "span-anchors")
    # 1: all offsets at once; one of those that are settled stays as a witness for others of its bucket
    wide = _twice(some.where("wide is not null"), ["gram", "wide"], "span-wide")
    some = materialize(some.join(wide, ["gram", "wide"], "left").withColumns({"hit": F.col("witness").isNotNull(), "witness": F.coalesce(F.col("witness") == _place(), F.lit(False))}), "span-1")
    span = lambda lo, hi: F.struct((F.col("at") - hi).cast("int").alias("lo"), (F.col("at") - lo).cast("int").alias("hi")).alias("span")
    found = [some.where("hit").select("key", span(F.col("low"), F.col("high")))]
    # the contexts that are left, cut out of their texts once
    open_grams = materialize(some.where("not hit").select("gram").distinct(), "span-open-grams")
    left = some.where("not hit or witness").join(open_grams, "gram", "left_semi").groupBy("key").agg(F.collect_set(F.struct("at", "low", "high", "gram", F.col("hit").alias("settled"))).alias("items"))
    texts = docs.select(text_key(col(text).cast("string")).alias("key"), col(text).cast("string").cast("binary").alias("raw")).join(left, "key")
    low_cell = lambda x: (x / CELL).cast("int")
    begin = lambda x: F.greatest(F.lit(0), x["at"] - F.least(low_cell(x["high"]) * CELL + (CELL - 1), F.lit(STARTS - 1)))
    cut = lambda x: F.struct(x["at"].alias("at"), x["low"].alias("low"), x["high"].alias("high"), x["gram"].alias("gram"), x["settled"].alias("settled"), begin(x).alias("begin"), F.substring(F.col("raw"), begin(x) + 1, x["at"] - low_cell(x["low"]) * CELL + LENGTH - begin(x)).alias("context"))
    contexts = materialize(texts.select("key", F.inline(F.transform("items", cut))), "span-contexts")
    # 2: cells of offsets
    part = lambda lo, hi: F.substring("context", F.col("at") - hi - F.col("begin") + 1, hi - lo + LENGTH)
    cells = contexts.select("*", F.explode(F.sequence(low_cell(F.col("low")), low_cell(F.col("high")))).alias("cell"))
    first, last = F.col("cell") * CELL, F.least(F.col("cell") * CELL + (CELL - 1), F.lit(STARTS - 1))
    inside = (F.col("at") - last >= F.col("begin")) & (F.col("at") - first + LENGTH <= F.col("begin") + F.length("context"))
    core = F.substring("context", F.col("at") - first - F.col("begin") + 1, LENGTH - (last - first))
    cells = cells.select("key", "at", "low", "high", "gram", "settled", "cell", F.when(inside, F.xxhash64(part(first, last))).alias("whole"), F.xxhash64(core).alias("core"))
    cells = materialize(cells, "span-cells")
    whole = _twice(cells.where("whole is not null"), ["gram", "cell", "whole"], "span-whole")
    common = _twice(cells, ["gram", "cell", "core"], "span-core").drop("witness")
    cells = cells.join(common, ["gram", "cell", "core"]).join(whole, ["gram", "cell", "whole"], "left")
    cells = materialize(cells.withColumns({"hit": F.col("witness").isNotNull(), "witness": F.coalesce(F.col("witness") == _place(), F.lit(False))}).drop("whole"), "span-2")
    lo, hi = F.greatest(F.col("low").cast("int"), first), F.least(F.col("high").cast("int"), last)
    found.append(cells.where("hit and not settled").select("key", span(lo, hi)))
    # 3: single offsets
    open_cells = materialize(cells.where("not hit and not settled").select("gram", "cell", "core").distinct(), "span-open-cells")
    singles = cells.where("not hit or witness").join(open_cells, ["gram", "cell", "core"], "left_semi").groupBy("key", "at").agg(F.collect_set(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("ranges"))
    ones = contexts.join(singles, ["key", "at"]).select("key", "at", "gram", "begin", "context", F.explode(F.flatten(F.transform("ranges", lambda r: F.sequence(r["lo"], r["hi"])))).alias("offset"))
    ones = materialize(ones.select("key", "at", "gram", "offset", F.xxhash64(part(F.col("offset"), F.col("offset"))).alias("one")).distinct(), "span-ones")
    pairs = _twice(ones, ["gram", "offset", "one"], "span-pairs").drop("witness")
    found.append(ones.join(pairs, ["gram", "offset", "one"]).select("key", span(F.col("offset"), F.col("offset"))))
    # whole texts that occur twice
    n = docs.select(text_key(col(text).cast("string")).alias("key"), F.octet_length(col(text).cast("string")).alias("n")).where(F.col("n") >= LENGTH)
    same = n.groupBy("key", "n").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    found.append(same.select("key", F.struct(F.lit(0).alias("lo"), (F.col("n") - LENGTH).cast("int").alias("hi")).alias("span")))
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return materialize(spans.groupBy("key").agg(F.collect_set("span").alias("spans")), "spans")


def _cut(raw: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """What is left, and the numbers of removed bytes and of runs of them."""
    order = np.argsort(spans[:, 0], kind="stable")
    lo, hi = spans[order, 0], np.maximum.accumulate(spans[order, 1] + LENGTH)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    begin, end = lo[new], hi[np.append(new[1:], len(hi)) - 1]
    keep = [raw[a:b] for a, b in zip(np.concatenate([[0], end]).tolist(), np.append(begin, len(raw)).tolist(), strict=True)]
    return b"".join(keep), int((end - begin).sum()), len(begin)


def remove_repeated(docs: DataFrame, text: str = "text", digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Removes from each text every byte of a 200-byte string that also starts elsewhere in the corpus, or in the same text.

    Gives docs' columns (or those of keep) with the text that is left: bytes that are no longer UTF-8 where a character was cut are
    dropped from it. With digests, adds n_bytes, n_removed, n_spans (runs of removed bytes) and kept_sha256 (of the bytes that are
    left) instead. Null counts as empty and stays null without digests; texts under 200 bytes stay whole. Rows with equal texts of
    200 bytes or more lose all of it. Columns with clashing names are replaced; an empty table gives an empty one.
    """
    spans = repeated(docs, text)
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())] if digests else []
    kept = [c for c in others(docs, [f.name for f in new]) if keep is None or c in keep]
    src = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(kept)], col(text).cast("string").alias("__text"), text_key(col(text).cast("string")).alias("__key"))
    joined = src.join(spans.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), "__key", "left").select(*[f"c{i}" for i in range(len(kept))], "__text", "__spans")
    n, at = len(kept), (kept.index(text) if text in kept and not digests else None)
    schema = T.StructType([*joined.schema.fields[:n], *new])
    if at is not None:
        schema.fields[at] = T.StructField(f"c{at}", T.StringType())

    def run(batches):
        for batch in batches:
            for part in slices(batch, n):
                out = []
                for t, s in zip(part.column(n).to_pylist(), part.column(n + 1), strict=True):
                    raw = (t or "").encode()
                    if s.is_valid and len(s):
                        v = s.values
                        out.append((*_cut(raw, np.stack([v.field(0).to_numpy(), v.field(1).to_numpy()], 1).astype(np.int64)), len(raw)))
                    else:
                        out.append((raw, 0, 0, len(raw)))
                columns = list(part.columns[:n])
                if digests:
                    columns += [pa.array([x[3] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in out], pa.string())]
                elif at is not None:
                    columns[at] = pa.array([None if t is None else x[0].decode(errors="ignore") for t, x in zip(part.column(n).to_pylist(), out, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    done = joined.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[f.name for f in new])
