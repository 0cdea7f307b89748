"""Near-duplicates by ProbMinHash.

A document is the set of its runs of five words, each weighing 1 + ln(times): a line that a text repeats counts for more than
once, but doesn't make two texts alike that share little else. Each different run sends, by its weight, exponential arrivals to the
REGISTERS of a signature, ordered in time and without hitting a register twice; it stops as soon as its next arrival is
later than all registers hold. Two documents agree in a register with the probability of their probability Jaccard
similarity. Signatures are cut into bands; documents that share a band are candidates, and their similarity is worked out
exactly from their texts before they are linked. Classes are the connected components of the links.

Equal texts are one node from the start. Each bucket's leader is the node whose buckets hold the most nodes, an unedited copy as a
rule and the same one in most bands; every node of a bucket meets its leader, so pairs are as many as nodes. Where a bucket's nodes
are then still in several classes, each of its runs is looked for in the other nodes of such buckets: a run that only one node has
can't be shared, so nodes with too many of those have no partner and go. What is left outside a bucket's largest class meets the
whole bucket, in blocks of bounded bytes that hold all runs: the weights on shared runs are summed for all pairs at once, and pairs
that they allow the threshold are verified on the spot, the most alike first and only while their classes differ, so a block gives at
most a spanning forest of its classes. Links are thus whole but for the chance of bands and registers, and no bucket is capped.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm._common import add_columns, col, materialize, mixed, rows_with, slices, small_batches, text_key, utf8
from parcelwise.llm._graph import components

RUN = 5
REGISTERS = 128
#: The chance that bands, and then registers, miss a pair just at the threshold.
MISS, SHORT = 1e-6, 1e-5
#: Bytes of the nodes of a block, and of what it meets at once; rows of a block that are held against the others at once.
BLOCK_BYTES, CHUNK_BYTES, STEP = 1 << 20, 4 << 20, 32
#: Runs of the others that are looked up at once.
HITS = 100_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    if n:
        x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 64-bit hash, times) of the different runs of five words, sorted; texts of one to four words are one run."""
    data, bounds = utf8(texts)
    n = len(data)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    before = np.concatenate([[False], word[:-1]]) if n else word
    start = np.flatnonzero(word & (~before | first[:n]))
    after = np.concatenate([word[1:], [False]]) if n else word
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
    h = mixed((sums[end] - sums[start]) * _powers(_BACK, n)[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(bounds, start, side="right") - 1
    count = np.bincount(doc, minlength=len(texts))
    at = np.arange(len(h)) - (np.cumsum(count) - count)[doc]  # place in the document
    left = count[doc] - at
    keep = np.flatnonzero((left >= RUN) | ((at == 0) & (left > 0)))
    run = h[keep]
    for k in range(1, RUN):
        inside = left[keep] > k
        run[inside] = mixed(run[inside] * np.uint64(_BASE) + h[keep[inside] + k])
    doc = doc[keep]
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])])) if len(run) else np.zeros(0, int)
    return doc[new], run[new], np.diff(np.append(new, len(run)))


def weight(times: np.ndarray) -> np.ndarray:
    return np.where(times > 0, 1 + np.log(np.maximum(times, 1)), 0.0)


def signatures(texts: pa.Array, m: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """The element in each of m registers (a power of 2) of each text, and the number of different runs."""
    doc, run, times = shingles(texts)
    n = len(texts)
    best, who = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    when, live, heavy = np.zeros(len(run)), np.arange(len(run)), weight(times)
    odd, add = mixed(run + np.uint64(1)) | np.uint64(1), mixed(run + np.uint64(2))
    for r in range(m):
        if not len(live):
            break
        e = run[live]
        u = ((mixed(e + np.uint64(_BASE * (r + 3) % (1 << 64))) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
        when[live] -= np.log(u) / (heavy[live] * (m - r))
        register = ((odd[live] * np.uint64(r) + add[live]) % np.uint64(m)).astype(np.int64)
        cell, t = doc[live] * m + register, when[live]
        np.minimum.at(best, cell, t)
        won = best[cell] == t
        who[cell[won]] = e[won]
        last = best.reshape(n, m).max(1)
        live = live[t < last[doc[live]]]
    return who.reshape(n, m), np.bincount(doc, minlength=n)


def band_rows(threshold: float) -> int:
    """Registers in a band: the most for which a pair at the threshold is missed by all bands with a probability under MISS."""
    return max((r for r in (1, 2, 4, 8, 16) if (1 - threshold**r) ** (REGISTERS // r) <= MISS), default=1)


def least_agreement(threshold: float) -> int:
    """Registers in which a pair at the threshold agrees at least, but with a probability of SHORT."""
    total = 0.0
    for k in range(REGISTERS + 1):
        total += math.comb(REGISTERS, k) * threshold**k * (1 - threshold) ** (REGISTERS - k)
        if total > SHORT:
            return k
    return REGISTERS


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two (sorted hashes, times): the sum, over shared elements, of their share of the whole where each is scaled to 1."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if a[1].max() == 1 and b[1].max() == 1:
        return len(both) / (len(a[0]) + len(b[0]) - len(both))
    only_a, only_b = np.delete(a[1], i), np.delete(b[1], j)
    x = np.concatenate([a[1][i], only_a, np.zeros(len(only_b), int)])
    y = np.concatenate([b[1][j], np.zeros(len(only_a), int), only_b])
    kinds, n = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
    shared = (kinds > 0).all(1)
    kinds = weight(kinds)
    k, kn = kinds[shared], n[shared]
    total = np.zeros(len(k))
    for (p, q), c in zip(kinds, n, strict=True):
        total += c * np.maximum(p / k[:, 0], q / k[:, 1])
    return float((kn / total).sum())


def at_most(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The most that similarity can be if shared runs have the shares p and q of two nodes' weights; just that if no run is repeated.

    Each shared run adds 1 / (1 / its share + the other's rest / its share there), at most what one run with all of p and q would add.
    """
    return p * q / np.maximum(p + q - p * q, 1e-9)


def _signed(docs: DataFrame, text: str, doc_id: str, threshold: float) -> DataFrame:
    """(doc_id, key, bands, signature) for each row."""
    rows = band_rows(threshold)
    bands = REGISTERS // rows

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            who, n = signatures(texts)
            keys = [hashlib.md5((t or "").encode(), usedforsecurity=False).digest() for t in texts.to_pylist()]
            band = np.zeros((len(texts), bands), np.uint64)
            for r in range(rows):
                band = mixed(band * np.uint64(_BASE) + who[:, r * bands : (r + 1) * bands])
            some = n > 0
            offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            signature = [x.tobytes() for x in (who & np.uint64(255)).astype(np.uint8)]
            return [pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[some].ravel().view(np.int64))), pa.array(signature, pa.binary())]

        return work

    src = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    return add_columns(src, "text", [T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())], make, ["doc_id"], 1 << 20)


def _members(nodes: DataFrame) -> DataFrame:
    """(bucket, key, n) of the buckets with n nodes, two or more."""
    each = nodes.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.xxhash64("band", "value").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(each.join(materialize(shared, "near-buckets"), "bucket"), "near-members")


def _leaders(members: DataFrame) -> DataFrame:
    """(a, b): each node with the leaders of its buckets, each pair once."""
    reach = members.groupBy("key").agg(F.sum("n").alias("reach"))
    lead = members.join(reach, "key").groupBy("bucket").agg(F.max(F.struct("reach", "key")).alias("most")).select("bucket", F.col("most.key").alias("b"))
    met = members.join(lead, "bucket").where("key != b").select(F.col("key").alias("a"), "b")
    return materialize(met.distinct(), "near-met")


def _alike(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that agree in so many registers."""
    own = nodes.select("key", "signature")
    sided = pairs.join(own.select(F.col("key").alias("a"), F.col("signature").alias("sa")), "a").join(own.select(F.col("key").alias("b"), F.col("signature").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array((x == y).sum(1) >= least)) for c in batch.columns[:2]], names=["a", "b"])

    return materialize(sided.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary"), "near-alike")


def _of(wanted: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(key, text) of the wanted keys (a written table), each once."""
    texts = docs.select(text_key(col(text).cast("string")).alias("key"), col(text).cast("string").alias("text"))
    return rows_with(texts, wanted, "key").dropDuplicates(["key"])


def _verified(pairs: DataFrame, docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """The pairs whose texts are at least so similar, as (u, v)."""
    wanted = materialize(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "near-wanted")
    texts = materialize(_of(wanted, docs, text), "near-texts")
    sided = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for batch in batches:
            for half in slices(batch, 2, 1 << 20):
                for part in slices(half, 3, 1 << 20):
                    said = pa.concat_arrays([part.column(2), part.column(3)]).dictionary_encode()
                    doc, hashes, times = shingles(said.dictionary)
                    cut = np.searchsorted(doc, np.arange(len(said.dictionary) + 1))
                    of = said.indices.to_numpy()
                    own = [(hashes[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]) for i in range(len(said.dictionary))]
                    n = part.num_rows
                    on = pa.array([similarity(own[of[i]], own[of[n + i]]) >= threshold for i in range(n)], pa.bool_())
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(on), part.column(1).filter(on)], names=["u", "v"])

    small_batches(docs.sparkSession)
    return materialize(sided.select("a", "b", "ta", "tb").mapInArrow(run, "u binary, v binary"), "near-links")


def _parted(members: DataFrame, root: DataFrame) -> DataFrame:
    """(bucket, key, class, main) of the buckets of three nodes or more in several classes, main being the largest; of buckets with the same nodes only one."""
    mine = members.where("n > 2").join(root.select(F.col("u").alias("key"), F.col("v").alias("class")), "key", "left").select("bucket", "key", F.coalesce("class", "key").alias("class"))
    mine = materialize(mine, "near-classed")
    per = mine.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"same{i}") for i in (0, 1)])
    parted = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("most"), *[F.bit_xor(f"same{i}").alias(f"same{i}") for i in (0, 1)]).where("most.n < n")
    parted = parted.groupBy("n", "same0", "same1").agg(F.min(F.struct("bucket", F.col("most.class").alias("main"))).alias("one")).select("one.*")
    return materialize(mine.join(materialize(parted, "near-parted"), "bucket"), "near-open")


def _runs(wanted: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(key, w, runs): the weight of each text's runs, and the different runs with their times as bytes."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            doc, run, times = shingles(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            total = np.concatenate([[0.0], np.cumsum(weight(times))])
            packed = [run[a:b].tobytes() + times[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            return [pa.array(total[cut[1:]] - total[cut[:-1]], pa.float64()), pa.array(packed, pa.binary())]

        return work

    fields = [T.StructField("w", T.DoubleType()), T.StructField("runs", T.BinaryType())]
    return materialize(add_columns(_of(wanted, docs, text), "text", fields, make, ["key"], 1 << 20), "near-runs")


def _unpacked(runs: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(runs) // 12
    return np.frombuffer(runs, np.uint64, n), np.frombuffer(runs, np.uint32, n, 8 * n).astype(int)


def _lone(runs: DataFrame) -> DataFrame:
    """(key, lone): the weight of a node's runs that no other node has."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                own = [_unpacked(x) for x in part.column(1).to_pylist()]
                if not own:
                    continue
                of = np.repeat(np.arange(len(own)), [len(h) for h, _ in own])
                hashes, times = (np.concatenate([x[i] for x in own]) for i in (0, 1))
                # of what several nodes here have, two rows tell as much as all
                order = np.argsort(hashes, kind="stable")
                hashes, of, times = hashes[order], of[order], times[order]
                third = np.concatenate([[False, False], hashes[2:] == hashes[:-2]])[: len(hashes)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[~third])), pa.array(hashes[~third].view(np.int64)), pa.array(weight(times[~third]), pa.float64())], names=["key", "run", "w"])

    each = runs.select("key", "runs").mapInArrow(run, "key binary, run long, w double")
    lone = each.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("w").alias("w")).where("n = 1")
    return lone.groupBy("key").agg(F.sum("w").alias("lone"))


class _Side:
    """The nodes of one list: keys, classes, runs, times, weights."""

    def __init__(self, nodes: pa.Array):
        self.keys, self.classes = nodes.field("key").to_pylist(), nodes.field("class").to_pylist()
        self.total = nodes.field("w").to_numpy(zero_copy_only=False)
        self.own = [_unpacked(x) for x in nodes.field("runs").to_pylist()]
        self.cut = np.cumsum([0, *[len(h) for h, _ in self.own]])
        self.runs, times = (np.concatenate([x[i] for x in self.own]) for i in (0, 1))
        self.of, self.weights, self.plain = np.repeat(np.arange(len(self.own)), np.diff(self.cut)), weight(times).astype(np.float32), bool((times == 1).all())


def _shared(x: _Side, rows: range, y: _Side) -> tuple[np.ndarray, np.ndarray]:
    """For each node of y and each of those rows of x: the shares of both weights that lie on runs of the other."""
    part = slice(x.cut[rows.start], x.cut[rows.stop])
    known, at = np.unique(x.runs[part], return_inverse=True)
    heavy = np.zeros((len(known), len(rows)), np.float32)
    heavy[at, x.of[part] - rows.start] = x.weights[part]
    place = np.minimum(np.searchsorted(known, y.runs), len(known) - 1)
    hit = np.flatnonzero(known[place] == y.runs)
    mine, theirs = np.zeros((len(y.keys), len(rows)), np.float32), np.zeros((len(y.keys), len(rows)), np.float32)
    for k in range(0, len(hit), HITS):
        some = hit[k : k + HITS]
        of, found = y.of[some], heavy[place[some]]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        mine[of[first]] += np.add.reduceat(found, first, axis=0)
        if not (x.plain and y.plain):
            theirs[of[first]] += np.add.reduceat((found > 0) * y.weights[some, None], first, axis=0)
    return mine / x.total[rows.start : rows.stop], (mine if x.plain and y.plain else theirs) / y.total[:, None]


def _linked(x: _Side, y: _Side, threshold: float) -> list[tuple[bytes, bytes]]:
    """Verified links between the nodes of two lists, of different classes: a spanning forest of what they connect."""
    names = {c: i for i, c in enumerate(dict.fromkeys([*x.classes, *y.classes]))}
    parent = list(range(len(names)))
    cx, cy = (np.array([names[c] for c in side.classes]) for side in (x, y))
    found = []
    for at in range(0, len(x.keys), STEP):
        rows = range(at, min(at + STEP, len(x.keys)))
        most = at_most(*_shared(x, rows, y))
        j, i = np.nonzero((most >= threshold - 1e-4) & (cy[:, None] != cx[rows.start : rows.stop]))
        found.append(np.stack([most[j, i], at + i, j], 1))
    found = np.concatenate(found)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []
    for _, i, j in found[np.argsort(-found[:, 0], kind="stable")].astype(int).tolist():
        a, b = root(cx[i]), root(cy[j])
        if a != b and similarity(x.own[i], y.own[j]) >= threshold:
            parent[a] = b
            links.append((x.keys[i], y.keys[j]))
    return links


def _across(parted: DataFrame, docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """Links (u, v) between the classes of parted buckets."""
    runs = _runs(materialize(parted.select("key").distinct(), "near-parted-keys"), docs, text)
    alone = materialize(_lone(runs), "near-lone")
    able = materialize(runs.join(alone, "key", "left").where(F.col("w") - F.coalesce("lone", F.lit(0.0)) >= F.col("w") * (threshold - 1e-9)).drop("lone"), "near-able")
    held = materialize(parted.join(able.select("key", F.octet_length("runs").alias("size")), "key"), "near-held")
    per = held.groupBy("bucket").agg(F.sum(F.col("size") + 256).alias("all"), F.sum(F.when(F.col("class") != F.col("main"), F.col("size") + 256)).alias("outside"), F.min("class").alias("low"), F.max("class").alias("high"))
    per = materialize(per.where("low != high and outside is not null").select("bucket", F.ceil(F.col("all") / CHUNK_BYTES).alias("chunks"), F.ceil(F.col("outside") / BLOCK_BYTES).alias("blocks")), "near-still")
    node = F.struct("key", "class", "w", "runs").alias("node")
    full = materialize(held.join(per, "bucket").join(able, "key").select("bucket", "key", "chunks", "blocks", (F.col("class") != F.col("main")).alias("out"), node), "near-full")
    spread = F.xxhash64("key", "bucket")
    whole = full.groupBy("bucket", F.pmod(spread, "chunks").alias("chunk")).agg(F.collect_list("node").alias("right"))
    blocks = full.where("out").groupBy("bucket", "chunks", F.pmod(F.xxhash64(F.lit(1), spread), "blocks").alias("block")).agg(F.collect_list("node").alias("left"))
    met = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).join(whole, ["bucket", "chunk"]).select("left", "right")

    def meet(batches):
        for batch in batches:
            links = [p for left, right in zip(batch.column(0), batch.column(1), strict=True) for p in _linked(_Side(left.values), _Side(right.values), threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.binary()) for i in (0, 1)], names=["u", "v"])

    return materialize(met.mapInArrow(meet, "u binary, v binary"), "near-across")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(doc_id, key, class): for each row the hash of its text and the key that stands for its class.

    Null and empty texts, and texts without words, are equal only to those of the same bytes (null counts as empty). Very long
    texts are taken whole.
    """
    signed = materialize(_signed(docs, text, doc_id, threshold), "near-signed")
    nodes = materialize(signed.where(F.size("bands") > 0).select("key", "bands", "signature").dropDuplicates(["key"]), "near-nodes")
    members = _members(nodes)
    root = components(_verified(_alike(_leaders(members), nodes, least_agreement(threshold)), docs, text, threshold))
    parted = _parted(members, root)
    if not parted.isEmpty():
        root = components(root.unionByName(_across(parted, docs, text, threshold)))
    return signed.select("doc_id", "key").join(root.select(F.col("u").alias("key"), F.col("v").alias("__root")), "key", "left").select("doc_id", "key", F.coalesce("__root", "key").alias("class"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """One row for each of docs: doc_id, class_id (the least doc_id of its class; null if it has none), class_size (rows) and kept.

    Exactly one row of each class is kept: the first by doc_id (null last), then by the text's hash; of rows with the same of
    both, any one. Texts without words are in a class with texts of the same bytes only. Other columns aren't looked at; an
    empty table gives an empty one.
    """
    found = materialize(classes(docs, text, doc_id, threshold), "near-classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    per = materialize(found.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(order).alias("first")), "near-sizes")
    out = found.join(per, "class").select("doc_id", "key", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))).alias("is_first"))
    again = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("class_size"))
    return out.withColumn("again", again).select("doc_id", "class_id", "class_size", (F.col("is_first") & (F.col("again") == 1)).alias("kept"), "key")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class, as near_duplicates keeps them; all columns stay as they are."""
    kept = near_duplicates(docs, text, doc_id, threshold).where("kept").select(F.col("doc_id").alias("__doc"), F.col("key").alias("__kept"))
    mine = docs.withColumn("__key", text_key(col(text).cast("string")))
    same: Column = (F.col("__key") == F.col("__kept")) & col(doc_id).eqNullSafe(F.col("__doc"))
    return mine.join(kept, same, "left_semi").dropDuplicates(["__key", doc_id]).drop("__key")
