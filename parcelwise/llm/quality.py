"""Quality rules as a short-circuit cascade, with DataFrame functions only.

The rules' verdict is a conjunction, so their order can't change it, only its price. On a sample each rule is timed, and it
shows which documents each rejects; the next rule is always the one that rejects most per cost of what those before it let pass.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm._common import col, let, materialize, others

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects where `fails` holds."""

    name: str
    fails: Column


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: windows sorted by a 64-bit hash, equal neighbours, then the union of their places."""

    def covered(windows: Column) -> Column:
        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["k"] == F.get(s, i - 1)["k"]) | (x["k"] == F.get(s, i + 1)["k"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

            def add(a: Column, p: Column) -> Column:
                return F.struct((p + 3).alias("end"), (a["n"] + F.least(F.lit(3), p + 3 - a["end"])).alias("n"))

            return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["p"])), start, add, lambda a: a["n"])

        return let(F.sort_array(windows), places)

    def of(h: Column) -> Column:
        windows = F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("k"), i.alias("p")))

        # most texts have no window twice: sorted numbers tell that without their places
        return F.when(F.size(F.array_distinct(F.transform(windows, lambda w: w["k"]))) == F.size(h) - 2, F.lit(0).cast("long")).otherwise(covered(windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < 4, F.lit(0).cast("long")).otherwise(of(h)))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (those with a word), all long, of the whole text."""
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    by_words = let(_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("again")))
    return (
        docs.select(
            *[col(c) for c in others(docs, [*names, "__w", "__l"])],
            F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            by_words.alias("__w"),
            by_lines.alias("__l"),
        )
        .withColumns({"n_words": F.col("__w.n"), "n_repeat_words": F.col("__w.again"), "n_lines": F.col("__l.n"), "n_dup_lines": F.col("__l.again")})
        .drop("__w", "__l")
    )


def default_rules(text: str = "text") -> list[Rule]:
    """Rules that hold for prose of any language."""
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("same_lines", F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        Rule("word_length", (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20)),
        Rule("few_letters", F.length(F.regexp_replace(t, r"\P{L}+", "")) * 2 < F.col("word_chars")),
        Rule("bullets", F.regexp_count(t, F.lit(r"(?dm)^[ \t]*[-•*·]")) * 10 > F.col("n_lines") * 9),
        Rule("ellipses", F.regexp_count(t, F.lit(r"(?dm)(…|\.\.\.)[ \t]*$")) * 10 > F.col("n_lines") * 3),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def measured(counted: DataFrame, rules: list[Rule], runs: int = 3) -> dict[str, float]:
    """Seconds that each rule takes over counted (a small table): the best of so many runs, less the best of those that read the same columns only."""

    def seconds(value: Column) -> float:
        began = time.perf_counter()
        counted.agg(F.sum(value)).collect()
        return time.perf_counter() - began

    # every run reads all columns, so what differs is the rule
    read = reduce(lambda a, c: a + F.length(F.coalesce(col(c).cast("string"), F.lit(""))), counted.columns, F.lit(0)).cast("long")
    idle = min(seconds(read) for _ in range(runs + 1))
    return {r.name: max(min(seconds(read + r.fails.cast("long")) for _ in range(runs)) - idle, 0.0) for r in rules}


def cascade_order(counted: DataFrame, rules: list[Rule], costs: dict[str, float] | None = None) -> list[str]:
    """The rules' names, best first: rejections among what is left, per cost (by default as measured) over counted, the sample. Ties keep the rules' order."""
    costs = measured(counted, rules) if costs is None else costs
    passed = counted.where(~base_failed())
    alike = passed.groupBy(*[F.coalesce(r.fails, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]).agg(F.count(F.lit(1)).alias("n")).collect()
    order, left = [], list(range(len(rules)))
    least = max([*costs.values(), 1e-3]) / 100  # differences under a hundredth of the dearest rule are noise
    while left:
        rejects = {i: sum(row["n"] for row in alike if row[f"r{i}"] and not any(row[f"r{k}"] for k in order)) for i in left}
        best = max(left, key=lambda i: (rejects[i] / (costs[rules[i].name] + least), -i))
        order.append(best)
        left.remove(best)
    return [rules[i].name for i in order]


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_docs: int = 1000) -> DataFrame:
    """Adds the counts of with_counts, base_failed, kept and failed_rule (the first rule of the cascade that rejects; `base`, or null).

    The order of rules comes from about sample_docs different texts and is timed, so of several rules that reject a document failed_rule may name
    another one in another run; kept and all counts are always the same. Very long texts are judged whole. Null and empty texts have counts of 0 and fail the base rules. Repeated rows are judged alike and stay. Columns with
    clashing names are replaced; an empty table gives an empty one.
    """
    rules = default_rules(text) if rules is None else rules
    texts = docs.select(col(text).cast("string").alias(text))
    step = max(1, (texts.agg(F.approx_count_distinct(F.xxhash64(col(text)))).first()[0] or 0) // max(1, sample_docs))
    some = texts.where(F.pmod(F.xxhash64(col(text)), F.lit(step)) == 0).distinct()
    order = cascade_order(materialize(with_counts(some, text).repartition(4), "quality-sample"), rules)
    by_name = {r.name: r for r in rules}
    failed = F.when(base_failed(), F.lit("base"))
    for name in order:
        failed = failed.when(by_name[name].fails, F.lit(name))
    counted = with_counts(docs.select(*[col(c) for c in others(docs, ["base_failed", "kept", "failed_rule"])]), text)
    return counted.withColumn("base_failed", base_failed()).withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())
