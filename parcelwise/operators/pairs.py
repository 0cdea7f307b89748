"""Image pairs: nearest descriptors, ratio test, ranking, and geometric verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions.rounding import py_round

RATIO, LEAST_MATCHES = 0.75, 8
#: Descriptors of an image that are held at once.
CHUNK = 1024
#: Models that RANSAC fits at last among the points that its best one explains.
LOCAL_TRIES = 10


def image_pairs(images: DataFrame, image: str = "image") -> DataFrame:
    """(image_a, image_b) with a before b: a pair list, so its length is the square of the images' number by its nature."""
    a, b = images.select(F.col(image).alias("image_a")).distinct(), images.select(F.col(image).alias("image_b")).distinct()
    return a.join(b, F.col("image_a") < F.col("image_b"))


def _matrix(row: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and vectors of an image's descriptors."""
    vectors = row.values.field(1)
    return row.values.field(0).to_numpy(), vectors.flatten().to_numpy().reshape(len(vectors), -1)


def nearest_two(pairs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(image_a, image_b, kp_idx, n, d1, d2): each descriptor of a against all of b; n, the neighbours found, is 2 at most.

    Images come in chunks of about CHUNK descriptors, and each two chunks of a pair are one row, so no row grows with an image; what
    the chunks of b give for a descriptor is merged.
    """
    d = descriptors.select("image", "kp_idx", F.transform("descriptor", lambda x: x.cast("double")).alias("v"))
    sizes = descriptors.groupBy("image").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("__chunks"))
    every = d.join(sizes, "image").groupBy("image", F.pmod(F.xxhash64("kp_idx"), "__chunks").alias("chunk")).agg(F.collect_list(F.struct("kp_idx", "v")).alias("d"))
    side = lambda k: every.select(F.col("image").alias(f"image_{k}"), F.col("d").alias(k))
    both = pairs.select("image_a", "image_b").join(side("a"), "image_a").join(side("b"), "image_b").select("image_a", "image_b", "a", "b")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (index, a), (_, b) = _matrix(batch.column(2)[i]), _matrix(batch.column(3)[i])
                near = np.full((len(a), 2), np.inf)
                for at in range(0, len(a), 64):
                    off = np.sqrt(((a[at : at + 64, None, :] - b[None]) ** 2).sum(2))
                    near[at : at + 64, : min(2, len(b))] = np.sort(np.partition(off, min(1, len(b) - 1), 1)[:, :2], 1)
                n = len(a)
                one = [batch.column(k).take(pa.array(np.full(n, i))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*one, pa.array(index), pa.array(np.full(n, min(2, len(b)), np.int32)), pa.array(near[:, 0]), pa.array(near[:, 1], mask=np.full(n, len(b) < 2))], names=["image_a", "image_b", "kp_idx", "n", "d1", "d2"])

    kind, index = both.schema["image_a"].dataType.simpleString(), d.schema["kp_idx"].dataType.simpleString()
    near = both.mapInArrow(run, f"image_a {kind}, image_b {kind}, kp_idx {index}, n int, d1 double, d2 double")
    least = F.slice(F.sort_array(F.array_compact(F.flatten(F.collect_list(F.array("d1", "d2"))))), 1, 2)
    near = near.groupBy("image_a", "image_b", "kp_idx").agg(least.alias("two"))
    return near.select("image_a", "image_b", "kp_idx", F.size("two").alias("n"), F.get("two", F.lit(0)).alias("d1"), F.get("two", F.lit(1)).alias("d2"))


def ratio_matches(pairs: DataFrame, descriptors: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(image_a, image_b, keypoints_a, good_matches) of every pair: matches have two neighbours, the first nearer than ratio times the second.

    A pair with no descriptors on either side has (0, 0).
    """
    near = nearest_two(pairs, descriptors)
    good = F.count_if((F.col("n") == 2) & (F.col("d1") < ratio * F.col("d2")))
    found = near.groupBy("image_a", "image_b").agg(F.count(F.lit(1)).alias("k"), good.alias("g"))
    return pairs.join(found, ["image_a", "image_b"], "left").select("image_a", "image_b", F.coalesce("k", F.lit(0)).cast("int").alias("keypoints_a"), F.coalesce("g", F.lit(0)).cast("int").alias("good_matches"))


def top_pairs(pairs: DataFrame, by: str, most: int, ties: tuple[str, ...] = ("image_a", "image_b")) -> DataFrame:
    """The `most` best (a report's limit); ties keep the pairs' own order."""
    return pairs.orderBy(F.desc(by), *ties).limit(most)


def inlier_ratio(inliers: Column, raw: Column) -> Column:
    return F.when(raw == 0, F.lit(0.0)).otherwise(py_round(inliers.cast("double") / raw, 3))


def gated(pairs: DataFrame, least: int = LEAST_MATCHES) -> DataFrame:
    """Pairs with under `least` raw matches keep their row, with zeros; raw_matches stays."""
    few = F.col("raw_matches") < least
    out = pairs
    for kind in ("fundamental", "homography"):
        out = out.withColumn(f"{kind}_inliers", F.when(few, 0).otherwise(F.col(f"{kind}_inliers")).cast("int"))
        out = out.withColumn(f"{kind}_ratio", inlier_ratio(F.col(f"{kind}_inliers"), F.col("raw_matches")))
    return out


def _homogeneous(p: np.ndarray) -> np.ndarray:
    out = np.ones((len(p), 3))
    out[:, :2] = p
    return out


def _normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre, spread = p.mean(0), max(np.sqrt(((p - p.mean(0)) ** 2).sum(1)).mean(), 1e-12)
    s = np.sqrt(2) / spread
    t = np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])
    return _homogeneous(p) @ t.T, t


def _fundamental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (x, t), (y, u) = _normalised(a), _normalised(b)
    f = np.linalg.svd((y[:, :, None] * x[:, None, :]).reshape(len(a), 9))[2][-1].reshape(3, 3)
    w, s, v = np.linalg.svd(f)
    return u.T @ (w @ np.diag([s[0], s[1], 0]) @ v) @ t


def _off_lines(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = _homogeneous(a), _homogeneous(b)
    l2, l1 = x @ f.T, y @ f
    e = (y * l2).sum(1) ** 2
    return np.sqrt(np.maximum(e / np.maximum(l2[:, 0] ** 2 + l2[:, 1] ** 2, 1e-12), e / np.maximum(l1[:, 0] ** 2 + l1[:, 1] ** 2, 1e-12)))


def _homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (x, t), (y, u) = _normalised(a), _normalised(b)
    rows, n = np.zeros((2 * len(x), 9)), len(x)
    rows[:n, 3:6], rows[:n, 6:], rows[n:, :3], rows[n:, 6:] = -x, y[:, 1:2] * x, x, -y[:, :1] * x
    return np.linalg.inv(u) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ t


def _off_points(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = _homogeneous(a) @ h.T
    return np.sqrt(((z[:, :2] / np.where(np.abs(z[:, 2:]) < 1e-12, 1e-12, z[:, 2:]) - b) ** 2).sum(1))


def _consensus(a: np.ndarray, b: np.ndarray, fit, off, size: int, within: float, sure: float, seed: int) -> int:
    """How many points the best model of `size` of them explains; 0 where none can be fitted.

    The best has the least sum of squares off, each of at most `within` squared: the plain count would take a model that is bent by a
    point near by chance, if it reaches one more so. The last tries are among the points that the best explains, where chance ones are
    few: a bent model doesn't stay because the tries ended early.
    """
    rng, most, tries, done = np.random.default_rng(seed), 1000, 1000, 0
    least, best = len(a) * within**2, np.zeros(len(a), bool)

    def better(some: np.ndarray) -> bool:
        nonlocal least, best
        try:
            far = off(fit(a[some], b[some]), a, b)
        except np.linalg.LinAlgError:
            return False
        cost = np.fmin(far**2, within**2).sum()
        if cost >= least:
            return False
        least, best = cost, far <= within
        return True

    while done < tries:
        done += 1
        if better(rng.choice(len(a), size, replace=False)):
            share = best.mean() ** size
            tries = done if share >= 1 else min(most, int(np.log(1 - sure) / np.log(1 - share)) + 1) if share > 1e-9 else most
    explained = np.flatnonzero(best)
    if size < len(explained) < len(a):
        for _ in range(LOCAL_TRIES):
            better(rng.choice(explained, size, replace=False))
    return int(best.sum())


def verify_geometry(points: DataFrame, least: int = LEAST_MATCHES, seed: int = 42) -> DataFrame:
    """From matched points (image_a, image_b, xa, ya, xb, yb): raw_matches and the inliers and ratios of both models, by seeded RANSAC.

    A pair's matches are one group: they are bounded by the keypoints of an image.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["xa", "ya", "xb", "yb"])
        a, b = p[["xa", "ya"]].to_numpy(float), p[["xb", "yb"]].to_numpy(float)
        f = h = 0
        if len(p) >= least:
            f = _consensus(a, b, _fundamental, _off_lines, 8, 1.5, 0.99, seed)
            h = _consensus(a, b, _homography, _off_points, 4, 3.0, 0.995, seed)
        return pd.DataFrame({"image_a": [p.image_a.iloc[0]], "image_b": [p.image_b.iloc[0]], "raw_matches": [len(p)], "fundamental_inliers": [f], "homography_inliers": [h]})

    kind = points.schema["image_a"].dataType.simpleString()
    found = points.groupBy("image_a", "image_b").applyInPandas(run, f"image_a {kind}, image_b {kind}, raw_matches int, fundamental_inliers int, homography_inliers int")
    return gated(found, least)


def ranked(pairs: DataFrame, by: str) -> DataFrame:
    """Adds rank from 1, by descending `by`, then the pairs' order, within one list of pairs."""
    return pairs.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "image_a", "image_b")))
