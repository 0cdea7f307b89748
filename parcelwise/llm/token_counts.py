"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of frequent pre-tokens and their numbers of tokens; tier two is a cache in each Python
worker, filled by encoding what tier one misses. No pre-token is ever shuffled: each task of the sample sends its most frequent ones
to the driver, which makes tier one of them.
"""

from __future__ import annotations

import json
import re
from collections import Counter as Bag

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm._common import add_columns, col

#: Letters and numbers of the plain characters; texts with others are left to the tokenizer's library.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿŒœ"
_NUMBERS = "0-9²³¹¼½¾"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xffŒœ–—‘’‚“”„•…€]*")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: What the tokenizer's file has to say for the tiers to hold (fixed values); texts of other tokenizers are left to the library.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The worker's cache starts again from the broadcast table beyond so many entries.
CACHE_ENTRIES = 400_000
#: Tasks that the sample is dealt to.
TASKS = 8


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: visible ones for themselves, others from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


class Lengths(dict):
    """Pre-token to number of tokens: the frequent ones from the start, others when first asked for."""

    def __init__(self, tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.frequent, self.model, self.letters = frequent, tokenizer.model, _byte_letters()

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode()))))
        if len(self) >= CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
        self[piece] = n
        return n


class Counter:
    """Counts the tokens of whole texts as tokenizers' encode(text, add_special_tokens=False) does."""

    def __init__(self, path: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        splits = [x["pattern"].get("Regex") for x in (said["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.known = steps == _NORMALIZERS and splits == [_SPLIT]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lengths = Lengths(self.tokenizer, frequent)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.known or any(s in text for s in self.special) or not _PLAIN.fullmatch(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, _PIECE.findall(text.lower())))


_counters: dict[tuple, Counter] = {}


def _counter(path: str, shared) -> Counter:
    """One for each worker process, so that its cache serves all tasks of a query."""
    key = (path, shared.id if hasattr(shared, "id") else id(shared))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(path, shared.value)
    return _counters[key]


def frequent_pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", sample_docs: int = 2000, entries: int = 65_536) -> dict[str, int]:
    """The most frequent pre-tokens of about sample_docs documents, with their numbers of tokens; entries bounds the table.

    The table only saves time: counts are the same with any table, or none. The driver holds TASKS tables at most.
    """
    from tokenizers import Tokenizer

    said = docs.select(col(text).cast("string").alias("t"))
    step = max(1, (said.agg(F.approx_count_distinct(F.xxhash64("t"))).first()[0] or 0) // max(1, sample_docs))
    some = said.where(F.pmod(F.xxhash64("t"), F.lit(step)) == 0).distinct()  # equal texts count once
    some = some.repartition(TASKS)  # of texts: so many tasks send a table at most

    def pieces(batches):
        bag = Bag()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and _PLAIN.fullmatch(t):
                    bag.update(_PIECE.findall(t.lower()))
        top = bag.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    total = Bag()
    for piece, n in some.mapInArrow(pieces, "piece string, n long").collect():
        total[piece] += n
    top = sorted(((n, p) for p, n in total.items() if n > 1), key=lambda x: (-x[0], x[1]))[:entries]
    lengths = Lengths(Tokenizer.from_file(tokenizer_path), {})
    return {p: lengths[p] for _, p in top}


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 2048, keep: list[str] | None = None, sample_docs: int = 2000) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to docs' columns (or to those of keep).

    Null and empty texts have 0 of both. Repeated rows stay. Columns with clashing names are replaced. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, tokenizer_path, text, sample_docs))

    def make():
        count = _counter(tokenizer_path, shared)

        def work(texts: pa.Array) -> list[pa.Array]:
            n = [count(t) for t in texts.to_pylist()]
            return [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return add_columns(docs, text, fields, make, keep)
