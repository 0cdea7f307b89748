"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

Subwords are runs of 2 to 4 bytes of lower-cased words with a space on either side, hashed to BUCKETS rows of an embedding.
A text's mean embedding goes through a linear layer; both are learned in numpy on a bounded sample. A held-out part of the
sample sets the softmax's temperature and the bounds under which a prediction is rejected: of the score, and of the share of
subwords that were seen in training. Because all is linear, prediction adds up one row of logits for each subword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm._common import add_columns, col, mixed, utf8

BUCKETS = 1 << 14
#: Subwords are known by so many finer buckets, that few unknown ones pass as known.
SEEN = 1 << 20
DIM = 16
RUNS = (2, 3, 4)
UNKNOWN = "und"
#: Bytes of text in a step of prediction: each byte takes some hundred bytes there.
STEP = 1 << 20
#: ASCII letters and all bytes of other characters stay; what is left parts words.
_BYTE = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """For texts: the fine bucket of each subword (its bucket is what is left of it modulo BUCKETS), the number of its text, and whether each text has a letter."""
    said = [t or "" for t in texts.to_pylist()]
    has = [any(map(str.isalpha, t)) for t in said]
    data, bounds = utf8(pa.array([f" {t.lower()} " for t in said], pa.large_string()))
    b = _BYTE[data]
    word = np.repeat(np.arange(len(said), dtype=np.int32), np.diff(bounds))
    ids, of = [], []
    for n in RUNS:
        if len(b) < n:
            continue
        m = len(b) - n + 1
        key = np.zeros(m, np.uint64)
        good = word[:m] == word[n - 1 :]
        for k in range(n):
            key = (key << np.uint64(8)) | b[k : m + k]
            if 0 < k < n - 1:
                good &= b[k : m + k] != 32
        good &= (b[:m] != 32) | (b[n - 1 :] != 32)
        ids.append((mixed(key[good] + (np.uint64(n) << np.uint64(40))) % np.uint64(SEEN)).astype(np.int32))
        of.append(word[:m][good])
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(of) if of else np.zeros(0, np.int32), has


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: logits of each subword
    bias: np.ndarray
    seen: np.ndarray  # SEEN: whether training had the subword
    temperature: float = 1.0
    least_score: float = 0.0
    least_seen: float = 0.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, share of subwords that training saw, and whether there is a letter."""
        ids, of, has = subwords(texts)
        n = np.bincount(of, minlength=len(texts)).astype(float)
        known = np.bincount(of, self.seen[ids], len(texts))
        ids %= BUCKETS
        total = np.stack([np.bincount(of, self.table[ids, k], len(texts)) for k in range(len(self.langs))], 1) if self.langs else np.zeros((len(texts), 0))
        return total / np.maximum(n, 1)[:, None] + self.bias, known / np.maximum(n, 1), np.array(has, bool)

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and whether each prediction is rejected."""
        if not len(texts):
            return [], np.zeros(0), np.zeros(0, bool)
        logits, known, has = self.logits(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        p = self.scores(logits)
        best = p.argmax(1)
        score = np.where(has, p[np.arange(len(p)), best], 0.0)
        return [self.langs[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)], score, ~has | (score < self.least_score) | (known < self.least_seen)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's different buckets and their shares."""
    out = []
    for t in texts:
        ids, n = np.unique(subwords(pa.array([t], pa.string()))[0] % BUCKETS, return_counts=True)
        out.append((ids, n / max(n.sum(), 1)))
    return out


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 6, rate: float = 4.0, batch: int = 16, lose: float = 0.001) -> Model:
    """Learns from labelled texts; a fifth of them calibrates. lose: the share of right predictions that the bounds may reject.

    What an unlearned language looks like is told by the learned ones, each held against the subwords of all others: the bound on
    known subwords lies between their share there and the share of texts in learned languages, and never rejects more than `lose`.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(SEEN, bool))
    rng = np.random.default_rng(seed)
    bags, y = _bags(texts), np.array([names.index(x) for x in langs])
    order = rng.permutation(len(bags))
    held, learn = order[: len(bags) // 5], order[len(bags) // 5 :]
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    weight = len(y) / (len(names) * np.bincount(y, minlength=len(names)))  # rare languages count as much
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(learn)
        for at in range(0, len(learn), batch):
            rows = learn[at : at + batch]
            ids = np.concatenate([bags[i][0] for i in rows])
            share = np.concatenate([bags[i][1] for i in rows])
            of = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
            mean = np.zeros((len(rows), DIM))
            np.add.at(mean, of, emb[ids] * share[:, None])
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None] / len(rows)
            back = p @ out.T
            out -= step * 0.2 * mean.T @ p
            bias -= step * 0.02 * p.sum(0)
            np.add.at(emb, ids, -step * 20 * share[:, None] * back[of])
    of_lang = [np.unique(subwords(pa.array([texts[i] for i in learn if y[i] == k], pa.large_string()))[0]) for k in range(len(names))]
    langs_with = np.zeros(SEEN, np.int32)
    for ids in of_lang:
        langs_with[ids] += 1
    model = Model(names, emb @ out, bias, langs_with > 0)
    if len(held):
        logits, known, has = model.logits(pa.array([texts[i] for i in held], pa.string()))
        logits, known, right = logits[has], known[has], y[held][has]

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model.scores(logits)[np.arange(len(right)), right], 1e-12)).mean()

        if len(right):
            model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
            p = model.scores(logits)
            hit = p.argmax(1) == right
            if hit.any():
                model.least_score = min(float(np.quantile(p.max(1)[hit], lose)) * 0.7, 0.5)
                model.least_seen = float(np.quantile(known[hit], lose)) * 0.95
                strange = []
                for k, ids in enumerate(of_lang if len(names) > 1 else []):
                    others = langs_with > 0
                    others[ids[langs_with[ids] == 1]] = False
                    some = [texts[i] for i in held if y[i] == k]
                    if some:
                        at, of, has = subwords(pa.array(some, pa.large_string()))
                        strange.append((np.bincount(of, others[at], len(some)) / np.maximum(np.bincount(of, minlength=len(some)), 1))[has])
                if strange and (top := float(np.quantile(np.concatenate(strange), 0.95))) < model.least_seen:
                    model.least_seen = (top + model.least_seen) / 2
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = 2000, longest: int = 65_536) -> Model:
    """Trains on sample_docs different labelled texts at most, as many of each language, or on 20 of each if languages are many.

    Of a longer text, training takes the first `longest` characters. Texts are chosen by their hashes, so reruns agree, and repeated rows
    count once. The driver holds the sample and a number for each language.
    """
    rows = docs.select(F.substring(col(text).cast("string"), 1, longest).alias("t"), col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t")).alias("n")).collect()}
    if not counts:
        return train([], [])
    each = max(20, sample_docs // len(counts))
    chance = F.xxhash64("t", F.lit("train"))
    step = F.element_at(F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, max(1, int(n / each / 1.5)))]), F.col("l"))
    some = rows.where(F.pmod(chance, step) == 0).dropDuplicates(["l", "t"])
    some = some.withColumn("i", F.row_number().over(Window.partitionBy("l").orderBy(chance, "t"))).where(F.col("i") <= each)
    found = sorted((r["t"], r["l"]) for r in some.collect())
    return train([t for t, _ in found], [x for _, x in found])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected to docs' columns (or to those of keep).

    Whole texts count, very long ones too. Null texts and those without a letter are `und` with score 0, and rejected; so is everything if no language was learned.
    Repeated rows stay and get the same; columns with clashing names are replaced; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            langs, score, rejected = own.predict(texts)
            return [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return add_columns(docs, text, fields, make, keep, STEP)


def held_out(doc_id) -> object:
    """Whether a document is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows whose language is rejected; all columns stay as they are."""
    marked = docs.select(*[col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)])
    at = f"__{docs.columns.index(text)}"
    out = identify(marked, model, at).where("not rejected")
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


