"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each document of a source shall be taken f = target / size of the source times: floor(f) times, and once more with the
fractional probability. Two documents at a time give each other words' worth of probability, a random one of the two
ways, until one is integral; the other goes on. Groups of about GROUP documents do so in one fold; what a group leaves
over, one document at most, meets the leavings of other groups of its source in the next round, so a source of n
documents takes log(n) / log(GROUP) rounds and its words come within one document of its target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm._common import WORD, col, let, materialize

GROUP = 48
WEIGHTS = (3, 1, 2)


def _uniform(*by: Column) -> Column:
    """In [0, 1), fixed by the values."""
    return F.shiftrightunsigned(F.xxhash64(*by), 11).cast("double") / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """For rows (source, source_size): adds target.

    Sources by code point, null last, weigh weights, again and again. Targets stop at most times the source's size and the
    excess is shared again by weight until none is above: the level at which sources fill up is found from running sums over
    the sources in the order in which they fill up. One row a source: the only ordering of all rows here.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    w = w.withColumns(
        {
            "full": F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(everything) * F.lit(float(share)),
        }
    )
    # the level for the sources from here on, if those before are full; the first that doesn't fill up sets it
    w = w.withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("full", "level"))).over(everything)["level"]
    return w.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))).select("source", "source_size", "target")


def _fold(items: Column) -> Column:
    """Items (r, s, m): random number, size, mass in (0, s). Gives the places that round up, the place left over and its mass."""
    start = F.struct(F.lit(-1).alias("c"), F.lit(0.0).alias("s"), F.lit(0.0).alias("m"), F.array().cast("array<int>").alias("up"))

    def step(a: Column, x: Column) -> Column:
        to_first, to_second = F.least(a["s"] - a["m"], x["m"]), F.least(a["m"], x["s"] - x["m"])
        first_gains = x["r"] * (to_first + to_second) < to_second  # so that neither gains in the mean
        first_full, first_empty = a["s"] - a["m"] <= x["m"], a["m"] <= x["s"] - x["m"]
        stays = F.when(first_gains, ~first_full).otherwise(~first_empty)

        def state(c: Column, s: Column, m: Column, up: Column) -> Column:
            return F.struct(c.alias("c"), s.alias("s"), m.alias("m"), up.alias("up"))

        m = F.when(first_gains, F.when(first_full, x["m"] - (a["s"] - a["m"])).otherwise(a["m"] + x["m"])).otherwise(F.when(first_empty, x["m"] + a["m"]).otherwise(a["m"] - (x["s"] - x["m"])))
        up = F.when(first_gains & first_full & (a["c"] >= 0), F.array_append(a["up"], a["c"])).when(~first_gains & ~first_empty, F.array_append(a["up"], x["i"])).otherwise(a["up"])
        return state(F.when(stays, a["c"]).otherwise(x["i"]), F.when(stays, a["s"]).otherwise(x["s"]), m, up)

    return F.aggregate(F.transform(items, lambda x, i: F.struct(i.alias("i"), x["r"].alias("r"), x["s"].alias("s"), x["m"].alias("m"))), start, step)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """One row for each of docs: doc_id, source, text_hash, size (words), source_size, target, copies (0, 1, 2 ...) and taken = copies * size.

    Reruns agree: all chance comes from hashes of the seed and the row. A null source is a source; a null text has size 0 and
    isn't taken. Rows with the same doc_id, source and text are numbered and rounded one by one. Very long texts are counted whole. Other
    columns of docs, whatever their names, aren't looked at. An empty table, or one without words, takes nothing.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), col(source).cast("string").alias("source"), F.xxhash64(col(text)).alias("text_hash"), F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # equal rows are counted and numbered, so that each has chances of its own
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")).select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("again"))
    rows = materialize(rows, "mix-rows")  # the only step that reads texts
    per_source = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    per = per_source.select(F.col("source").alias("__s"), "source_size", "target")
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(f)).withColumn("m", F.when(F.col("size") > 0, (f - F.floor(f)) * F.col("size")).otherwise(F.lit(0.0)))
    row = ["doc_id", "source", "text_hash", "again", "size", "source_size", "target", "base"]
    done = [rows.where("m <= 0").select(*row, F.lit(0).alias("more"))]
    open_rows, level = rows.where("m > 0").select(*row, "m"), 0
    while True:
        n = open_rows.groupBy("source").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("source", "__s")
        n = materialize(n, "mix-counts")
        if (n.agg(F.max("__n")).first()[0] or 0) <= 1:
            break
        salt = F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "text_hash", "again")
        group = F.pmod(salt, F.ceil(F.col("__n") / GROUP))
        item = F.struct(_uniform(F.lit(seed), F.lit(-1 - level), "doc_id", "text_hash", "again").alias("r"), F.col("size").cast("double").alias("s"), "m", *[c for c in row if c != "source"])
        grouped = open_rows.join(n, F.col("source").eqNullSafe(F.col("__s"))).groupBy("source", group.alias("__g")).agg(F.sort_array(F.collect_list(item)).alias("items"))
        folded = grouped.select("source", "items", _fold(F.col("items")).alias("f"))
        each = folded.select("source", "f", F.posexplode("items").alias("i", "x"))
        left = F.col("i") == F.col("f.c")
        out = each.select(
            *[F.col("source") if c == "source" else F.col(f"x.{c}").alias(c) for c in row],
            F.when(~left, F.array_contains("f.up", F.col("i")).cast("int")).when(F.col("f.m") <= 0, F.lit(0)).when(F.col("f.m") >= F.col("f.s"), F.lit(1)).alias("more"),
            F.col("f.m").alias("m"),
        )
        out = materialize(out, f"mix-{level}")
        done.append(out.where("more is not null").select(*row, "more"))
        open_rows, level = out.where("more is null").select(*row, "m"), level + 1
    last = _uniform(F.lit(seed), F.lit("last"), "doc_id", "text_hash", "again") * F.col("size") < F.col("m")
    done.append(open_rows.select(*row, last.cast("int").alias("more")))
    out = reduce(DataFrame.unionByName, done).withColumn("copies", F.when(F.col("size") > 0, F.col("base") + F.col("more")).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", "taken")


def apply_mix(docs: DataFrame, mixed: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs, each row as often as mixed says: rows that aren't taken go, rows that are taken twice come twice.

    Rows with the same doc_id, source and text share their decisions out among them, in any order.
    """
    both = lambda *of: [F.xxhash64(F.lit(i), *of).alias(f"__k{i}") for i in (0, 1)]
    per = mixed.groupBy(*both(F.col("doc_id"), F.col("source"), F.col("text_hash"))).agg(F.min("copies").alias("__base"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("__more"))
    mine = docs.select("*", *both(col(doc_id), col(source).cast("string"), F.xxhash64(col(text))))
    # the join's partitions serve the numbering of equal rows, too: texts are shuffled once
    found = mine.join(per, ["__k0", "__k1"]).withColumn("__i", F.row_number().over(Window.partitionBy("__k0", "__k1").orderBy("__base")))
    n = (F.col("__base") + F.when(F.col("__i") <= F.col("__more"), 1).otherwise(0)).cast("int")
    return found.where(n > 0).select(*[col(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(1), n)).alias("__one")).drop("__one")
