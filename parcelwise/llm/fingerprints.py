"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

Each paragraph (a line, long ones in runs of PIECE characters) has a 64-bit digest. A digest is added to one cell in each third
of a subtable of CELLS cells; a cell holds a count and the sums (exclusive or) of digests and of their checks. The sketches of two
versions subtract cell by cell: what they share cancels, and peeling cells that hold one digest recovers the others. A sketch has
subtables, a power of 2, to the number of digests, and the larger of two folds to the size of the smaller, so building and peeling
take linear time. These sketches are what is returned and compared; only the digests of subtables in which peeling gets stuck are
sketched again, by other hashes and, as long as it takes, with twice as many subtables in the place of one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm._common import col, let, materialize, others

PIECE = 128
CELLS = 12
THIRD = CELLS // 3
#: Digests for each subtable (of both texts), and attempts for one that gets stuck, each with twice the subtables.
LOAD = 4
ATTEMPTS = 14
#: Chooses the cells of returned sketches, and of those built again (and from there on for each attempt).
SEED, AGAIN = 0, 100
#: Rows to a run of neighbours in ascending doc_id; quantiles of doc_id at most, between which runs are of equal width; runs ordered at once.
RUN, CELLS_AT_MOST, STRETCH = 2000, 4096, 1024
#: First ids of runs (some 100 bytes each) that go to all executors; more are joined by a shuffle.
GUESTS_AT_MOST = 250_000


def digests(text: Column) -> Column:
    """The different 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}"), F.lit(0)), lambda p: F.xxhash64(p)))


def _bits(cells: range) -> Column:
    return F.array(*[F.lit(1 << c) for c in cells])


def _power(n: Column) -> Column:
    return F.pow(F.lit(2.0), n).cast("int")


def _placed(key: Column, sign: Column, seed: Column) -> Column:
    """A digest with its check and its cells, as bits; the bits over them choose the subtable."""

    def place(p: Column) -> Column:
        bit = lambda k: F.get(_bits(range(THIRD * k, THIRD * k + THIRD)), F.shiftright(p, 4 * k).bitwiseAND(F.lit(THIRD - 1)).cast("int"))
        return F.struct(key.alias("k"), sign.alias("n"), F.xxhash64(key, F.lit(7)).alias("h"), F.shiftrightunsigned(p, 16).alias("p"), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).alias("at"))

    return let(F.xxhash64(seed, key), place)


def _merge(cell: Column, e: Column, sign: int) -> Column:
    n = cell["n"] + e["n"] if sign > 0 else cell["n"] - e["n"]
    return F.struct(n.alias("n"), cell["k"].bitwiseXOR(e["k"]).alias("k"), cell["h"].bitwiseXOR(e["h"]).alias("h"))


def _in(entries: Column, bit: Column) -> Column:
    return F.filter(entries, lambda e: e["at"].bitwiseAND(bit) != 0)


def _cells(entries: Column) -> Column:
    """The cells of a subtable that holds the entries, each by its sign: the subtraction of two sketches, if the second's signs are -1."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    return F.transform(_bits(range(CELLS)), lambda bit: F.aggregate(_in(entries, bit), empty, lambda x, e: _merge(x, e, 1)))


def _peel(cells: Column, seed: Column) -> Column:
    """How many digests came out of the subtable; null if peeling got stuck."""
    pure = lambda x: F.filter(x, lambda y: ((y["n"] == 1) | (y["n"] == -1)) & (F.xxhash64(y["k"], F.lit(7)) == y["h"]))
    left = lambda x: F.exists(x, lambda y: (y["n"] != 0) | (y["k"] != 0))
    start = F.struct(cells.alias("x"), F.lit(True).alias("on"), F.lit(0).alias("n"))

    def round_(a: Column, _: Column) -> Column:
        def take(found: Column) -> Column:
            rest = F.transform(a["x"], lambda y, c: F.aggregate(_in(found, F.get(_bits(range(CELLS)), c)), y, lambda z, e: _merge(z, e, -1)))
            return F.when(F.size(found) > 0, F.struct(rest.alias("x"), F.lit(True).alias("on"), (a["n"] + F.size(found)).alias("n"))).otherwise(F.struct(a["x"].alias("x"), F.lit(False).alias("on"), a["n"].alias("n")))

        found = F.transform(F.array_distinct(pure(a["x"])), lambda e: _placed(e["k"], e["n"], seed))
        return F.when(a["on"], let(found, take)).otherwise(a)

    return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS)), start, round_, lambda a: F.when(~left(a["x"]), a["n"]))


def _dealt(entries: Column, tables: Column, seed: Column, peel) -> Column:
    """peel(entries, seed) of each of so many subtables (a power of 2) that has entries.

    Entries are dealt in two steps of about the root of their number, so that very long texts don't take its square.
    """

    def deal(shape: Column) -> Column:
        def part(i: Column) -> Column:
            some = F.filter(entries, lambda e: F.pmod(e["p"], shape["coarse"]) == i)
            return let(some, lambda s: F.transform(F.sequence(F.lit(0), shape["fine"] - 1), lambda j: let(F.filter(s, lambda e: F.pmod(F.shiftrightunsigned(e["p"], 20), shape["fine"]) == j), lambda m: F.when(F.size(m) == 0, F.lit(0)).otherwise(peel(m)))))

        return F.flatten(F.transform(F.sequence(F.lit(0), shape["coarse"] - 1), part))

    coarse = _power(F.floor(F.log2(tables.cast("double")) / 2))
    return let(F.struct(coarse.alias("coarse"), (tables / coarse).cast("int").alias("fine")), deal)


def _total(counts: Column) -> Column:
    """The sum, null if one is null."""
    return F.aggregate(counts, F.lit(0), lambda n, x: n + x)


def _tables(digests: Column) -> Column:
    return _power(F.ceil(F.log2(F.greatest(F.lit(1.0), digests / F.lit(float(LOAD))))))


def sketch(keys: Column) -> Column:
    """The subtables, each its cells, of an array of different digests."""

    def build(entries: Column, tables: Column) -> Column:
        coarse = _power(F.floor(F.log2(tables.cast("double")) / 2))

        def deal(shape: Column) -> Column:
            # subtable q holds the digests with q = p modulo the number of subtables
            def part(i: Column) -> Column:
                some = F.filter(entries, lambda e: F.floor(F.pmod(e["p"], shape["all"]) / shape["fine"]) == i)
                return let(some, lambda s: F.transform(F.sequence(F.lit(0), shape["fine"] - 1), lambda j: let(F.filter(s, lambda e: F.pmod(e["p"], shape["fine"]) == j), _cells)))

            return F.flatten(F.transform(F.sequence(F.lit(0), shape["coarse"] - 1), part))

        return let(F.struct(tables.alias("all"), coarse.alias("coarse"), (tables / coarse).cast("int").alias("fine")), deal)

    return let(F.transform(keys, lambda k: _placed(k, F.lit(1), F.lit(SEED))), lambda e: build(e, _tables(2 * F.size(keys))))


def peeled(one: Column, other: Column) -> Column:
    """For each subtable of the smaller sketch, how many digests come out of the subtracted sketches; null where peeling gets stuck."""
    tables = F.least(F.size(one), F.size(other))

    def fold(x: Column, q: Column) -> Column:
        rest = F.filter(F.sequence(q, F.size(x) - 1, tables), lambda i: i != q)
        return F.aggregate(rest, F.get(x, q), lambda cells, i: F.zip_with(cells, F.get(x, i), lambda y, z: _merge(y, z, 1)))

    return F.transform(F.sequence(F.lit(0), tables - 1), lambda q: _peel(F.zip_with(fold(one, q), fold(other, q), lambda y, z: _merge(y, z, -1)), F.lit(SEED)))


def _again(one: Column, other: Column) -> Column:
    """How many digests are in one of two arrays of different digests only, by sketches of other hashes, sized to both arrays.

    A subtable in which peeling gets stuck is built again with 2, 4, 8 ... subtables in its place.
    """
    seed = F.lit(AGAIN)
    tables = _tables(F.size(one) + F.size(other))
    entries = F.concat(F.transform(one, lambda k: _placed(k, F.lit(1), seed)), F.transform(other, lambda k: _placed(k, F.lit(-1), seed)))

    def larger(m: Column) -> Column:
        def again(found: Column, r: Column) -> Column:
            moved = F.transform(m, lambda e: _placed(e["k"], e["n"], seed + r))
            return F.when(found.isNotNull(), found).otherwise(_total(let(moved, lambda x: _dealt(x, _power(r), seed + r, lambda y: _peel(_cells(y), seed + r)))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("int"), again)

    def table(m: Column) -> Column:
        return let(_peel(_cells(m), seed), lambda n: F.when(n.isNotNull(), n).otherwise(larger(m)))

    return let(entries, lambda e: _total(_dealt(e, tables, seed, table)))


def likeness(one: Column, other: Column, one_keys: Column, other_keys: Column) -> Column:
    """1 for the same paragraphs, 0 for none in common, from two sketches; two texts without any are alike.

    The sketches' digests (the keys) are looked at only where peeling gets stuck.
    """
    both = F.size(one_keys) + F.size(other_keys)

    def differ(found: Column) -> Column:
        stuck = lambda keys: F.filter(keys, lambda k: F.get(found, F.pmod(_placed(k, F.lit(1), F.lit(SEED))["p"], F.size(found)).cast("int")).isNull())
        rest = let(F.struct(stuck(one_keys).alias("a"), stuck(other_keys).alias("b")), lambda x: _again(x["a"], x["b"]))
        clear = _total(F.filter(found, lambda n: n.isNotNull()))
        return F.when(F.exists(found, lambda n: n.isNull()), clear + rest).otherwise(clear)

    return F.when(both == 0, F.lit(1.0)).otherwise(1 - let(peeled(one, other), differ) / both)


def fingerprint(subtables: Column) -> Column:
    """A sketch as text: for each cell count, sum of digests and of checks in hexadecimal, - between cells, / between subtables."""
    cell = lambda x: F.when((x["n"] == 0) & (x["k"] == 0), F.lit("")).otherwise(F.concat_ws(".", F.hex(x["n"].cast("long")), F.hex(x["k"]), F.hex(x["h"])))
    return F.array_join(F.transform(subtables, lambda cells: F.array_join(F.transform(cells, cell), "-")), "/")


def _position(value: Column, kind: T.DataType) -> Column:
    """A number that never falls as value rises, null for null: numbers and times by themselves, all else by its first six bytes as text."""
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return value.cast("timestamp").cast("double")
    head = F.rpad(F.hex(F.substring(value.cast("string").cast("binary"), 1, 6)), 12, "0")
    return F.when(value.isNotNull(), F.conv(head, 16, 10).cast("double"))


def _numbers(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _run(p: Column, cuts: list[float], parts: int) -> Column:
    """How many cuts p reaches, found among about the root of their number and then in one stretch; times parts, plus p's place between its two cuts in so many parts; -1 for null."""
    step = math.isqrt(len(cuts)) + 1
    chunks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads, stretches = _numbers([c[0] for c in chunks]), F.array(*[_numbers(c) for c in chunks])
    reached = lambda x: F.size(F.filter(x, lambda c: c <= p))
    cell = let(reached(heads), lambda k: F.when(k == 0, F.lit(0)).otherwise((k - 1) * step + reached(F.get(stretches, k - 1))))
    if parts > 1:
        low, high = F.get(_numbers(cuts), cell - 1), F.get(_numbers(cuts), cell)
        inside = F.floor((p - low) / (high - low) * parts)
        cell = cell * parts + F.coalesce(F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1)), F.lit(0))
    return F.when(p.isNull(), F.lit(-1)).otherwise(cell).cast("long")


def _before(runs: DataFrame) -> DataFrame:
    """(first, __to): each run's first id, and the run before it (before the first, the last): in order within stretches of runs, and of the stretches."""
    stretch = runs.withColumn("part", F.floor(F.col("run") / STRETCH))
    ends = stretch.groupBy("part").agg(F.max("run").alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("ended"), F.max("end").over(Window.partitionBy()).alias("last"))
    own = F.lag("run").over(Window.partitionBy("part").orderBy("run"))
    return stretch.withColumn("own", own).join(ends, "part").select("first", F.coalesce("own", "ended", "last").alias("__to"))


def next_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, next_text) for every row: the text of the next row by doc_id (null first, then equal ids by text), after the last the first.

    Rows are dealt by quantiles of doc_id, of any type that has an order, to runs of about RUN (rows of one id, or of ids with the same six first bytes, to
    the same run); each run also gets the first row of the next, so no ordering of all rows is needed, and each text is shuffled once.
    """
    d = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    p = _position(F.col("doc_id"), d.schema["doc_id"].dataType)
    runs = max(1, -(-docs.count() // RUN))
    cells = min(runs, CELLS_AT_MOST)
    found = d.agg(F.percentile_approx(p, [k / cells for k in range(cells + 1)], 10 * cells)).first()[0]
    run = _run(p, sorted(set(found or [0.0])), -(-runs // cells))
    firsts = materialize(d.groupBy(run.alias("run")).agg(F.min("doc_id").alias("first")), "neighbour-runs")
    guests = materialize(_before(firsts), "neighbour-guests")
    guests = F.broadcast(guests) if runs <= GUESTS_AT_MOST else guests
    rows = d.withColumns({"run": run, "guest": F.lit(0)})
    # the first run's head also follows the last run's end
    extra = d.join(guests, F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", F.col("__to").alias("run"), F.lit(1).alias("guest"))
    by = Window.partitionBy("run").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return rows.unionByName(extra).withColumn("next_text", F.lead("text").over(by)).where("guest = 0").select("doc_id", "text", "next_text")


def versions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited version, and their likeness.

    The edited version's last half is the start of the next document. Gives doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next, both from these sketches (and the next document's). A null text is an empty one; an only document is its own next one. Rows with
    equal ids follow one another by text, null ids come first, repeated rows stay. Other columns aren't looked at.
    """
    t = next_texts(docs, text, doc_id)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    # `inline` keeps each step from being worked out again in the next
    t = t.select("doc_id", F.inline(F.array(F.struct(n.cast("long").alias("n_chars"), F.col("text"), F.col("next_text"), F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited")))))
    t = t.select("doc_id", "n_chars", F.inline(F.array(F.struct(F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("new"), digests(F.col("next_text")).alias("next")))))
    sketches = F.struct(sketch(F.col("own")).alias("own_sketch"), sketch(F.col("new")).alias("new_sketch"), sketch(F.col("next")).alias("next_sketch"))
    t = t.select("doc_id", "n_chars", "edited_sha256", "own", "new", "next", F.inline(F.array(sketches)))
    near = lambda x: likeness(F.col("own_sketch"), F.col(f"{x}_sketch"), F.col("own"), F.col(x))
    return t.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own_sketch")).alias("fingerprint"), fingerprint(F.col("new_sketch")).alias("edited_fingerprint"),
        near("new").alias("near_edited"), near("next").alias("near_next"),
    )
