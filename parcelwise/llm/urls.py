"""URL filters: rules by host and path, and a character language-model ratio, with DataFrame functions only.

URLs that a rule accepts or rejects teach two variable-order Markov models of characters, with the counts of every n-gram and of
its own context; the tables grow with the input. A URL that no rule fits is scored by the mean, over its characters, of the
log-likelihood difference at the longest n-gram that the models know, and judged by the threshold that best parts the rules' URLs
in a share that the models don't learn from (the middle one of several).
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm._common import col, materialize, others, text_key

#: (host and path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ORDERS = 5
#: Counts under this don't make a context known.
LEAST = 2
SMOOTH = 0.5
#: One of so many of the rules' different URLs sets the threshold and teaches nothing.
HELD = 4
#: N-grams at more than 1 / HEAVY of all places (so fewer than HEAVY) are joined by broadcast, that no task gets all places of one.
HEAVY = 10_000
#: Differences are summed in whole units of 1 / UNIT: sums don't hang on the order.
UNIT = 1_000_000_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a host above it and the path's start, and its verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: len(x[0])):
        name, _, rest = r.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _places(texts: DataFrame) -> DataFrame:
    """A row for each character of the column `said` and for its end: `gram`, the ORDERS characters up to there (start marks before the text)."""
    marked = texts.withColumn("__t", F.concat(F.lit("\x02" * ORDERS), "said", F.lit("\x03"))).select("*", F.explode(F.sequence(F.lit(ORDERS + 1), F.length("__t"))).alias("__i"))
    return marked.withColumn("gram", F.substr(F.col("__t"), F.col("__i") - (ORDERS - 1), F.lit(ORDERS))).drop("__t", "__i", "said")


def _ends() -> Column:
    """The 1 to ORDERS last characters of `gram`."""
    return F.array(*[F.right("gram", F.lit(k)) for k in range(1, ORDERS + 1)])


def fit(labelled: DataFrame) -> DataFrame:
    """(gram, ratio) from rows (said, verdict): a row for each n-gram of up to ORDERS characters that is seen LEAST times."""
    counts = [F.sum(F.when(F.col("verdict") == v, F.col("__n")).otherwise(0)).alias(n) for v, n in (("allow", "a"), ("block", "r"))]
    full = _places(labelled.groupBy("said", "verdict").agg(F.count(F.lit(1)).alias("__n"))).groupBy("gram").agg(*counts)
    grams = full.select(F.explode(_ends()).alias("gram"), "a", "r").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    grams = materialize(grams.withColumn("before", F.left("gram", F.length("gram") - 1)), "url-grams")
    contexts = grams.groupBy("before").agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    size = float(len(string.printable))
    ratio = F.log((F.col("a") + SMOOTH) / (F.col("ca") + SMOOTH * size)) - F.log((F.col("r") + SMOOTH) / (F.col("cr") + SMOOTH * size))
    return materialize(grams.where(F.col("a") + F.col("r") >= LEAST).join(contexts, "before").select("gram", ratio.alias("ratio")), "url-model")


def score(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(key, ratio) for each different `said`, key its text_key: the mean difference, positive where it looks accepted; 0 where nothing is known.

    The different n-grams of the texts look theirs up first, one length after another, so that a short one meets only its
    extensions by a character; then places look up their n-gram's.
    """
    places = _places(texts.select("said", text_key(F.col("said")).alias("key")).dropDuplicates(["key"]))
    seen = materialize(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "url-seen")
    known = materialize(seen.select(F.explode(_ends()).alias("gram")).distinct().join(model, "gram", "left"), "url-known")
    told = known.where(F.length("gram") == 1).select("gram", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
    for k in range(2, ORDERS + 1):
        shorter = told.select(F.col("gram").alias("__end"), F.col("ratio").alias("__shorter"))
        longer = known.where(F.length("gram") == k).withColumn("__end", F.right("gram", F.lit(k - 1)))
        told = longer.join(shorter, "__end").select("gram", F.coalesce("ratio", "__shorter").alias("ratio"))
    told = materialize(seen.join(told, "gram").select("gram", "n", F.rint(F.col("ratio") * UNIT).cast("long").alias("units")), "url-told")
    heavy = F.col("n") * HEAVY > F.lit(told.agg(F.sum("n")).first()[0] or 0)
    frequent, rest = told.where(heavy).select("gram", "units"), told.where(~heavy).select("gram", "units")
    sums = [F.sum("units").alias("units"), F.count(F.lit(1)).alias("n")]
    near = places.join(F.broadcast(frequent), "gram").groupBy("key").agg(*sums)
    far = places.join(F.broadcast(frequent), "gram", "left_anti").join(rest, "gram").groupBy("key").agg(*sums)
    return near.unionByName(far).groupBy("key").agg((F.sum("units") / F.sum("n") / UNIT).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """From (ratio, verdict, n): the bound that gives the least sum of both error rates, from a histogram of fixed size."""
    bins = scored.groupBy(F.rint(F.greatest(F.least(F.col("ratio"), F.lit(8.0)), F.lit(-8.0)) * 100).cast("int").alias("b"), "verdict").agg(F.sum("n").alias("n")).collect()
    of = {v: {r["b"]: r["n"] for r in bins if r["verdict"] == v} for v in ("allow", "block")}
    if not of["allow"] or not of["block"]:
        return math.inf if of["block"] else -math.inf
    total = {v: sum(x.values()) for v, x in of.items()}
    wrong, lost, passed = {}, 0, total["block"]
    for b in range(-801, 802):
        wrong[b] = lost / total["allow"] + passed / total["block"]
        lost += of["allow"].get(b, 0)
        passed -= of["block"].get(b, 0)
    best = [b for b in wrong if wrong[b] <= min(wrong.values()) + 1e-12]
    return best[len(best) // 2] / 100 - 0.005


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and ratio (the models' mean difference) to pages' columns.

    A null url, or one without ://, has an empty host and path, fits no rule, and is judged by how the models take an empty text. Without any
    URL that a rule accepts, all others are blocked; without any that a rule rejects, all others are accepted. If the share that sets the threshold
    lacks either kind, all of the rules' URLs set it. Very long URLs are read whole. Repeated rows
    are judged alike and stay. Columns with clashing names are replaced; an empty table gives an empty one.
    """
    host, path = host_path(col(url).cast("string"))
    base = pages.select(*[col(c) for c in others(pages, ["host", "path", "rule", "verdict", "ratio", "said"])], host.alias("host"), path.alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "__by_rule": by_rule, "said": F.concat("host", "path")})
    texts = materialize(base.groupBy("said", F.col("__by_rule").alias("verdict")).agg(F.count(F.lit(1)).alias("n")), "url-texts")
    known = texts.where("verdict is not null").withColumn("key", text_key(F.col("said")))
    held = F.pmod(F.xxhash64("key"), F.lit(HELD)) == 0
    scored = materialize(score(texts, fit(known.where(~held).select("said", "verdict", "n"))), "url-scores")
    kinds = known.where(held).select("verdict").distinct().count()
    bound = threshold((known.where(held) if kinds == 2 else known).join(scored, "key"))
    verdict = F.coalesce("__by_rule", F.when(F.col("ratio") > F.lit(bound), F.lit("allow")).otherwise(F.lit("block")))
    scored = scored.withColumnRenamed("key", "__key")
    return base.withColumn("__key", text_key(F.col("said"))).join(scored, "__key", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0))).withColumn("verdict", verdict).drop("__by_rule", "__key", "said")
