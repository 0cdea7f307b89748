"""Brute force, round trips and held-out accuracy, and the odd cases that every operator has to take."""

import collections
import hashlib
import math
import random
import re

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import fingerprints, html_text, language, mixing, near_duplicates, passages, pieces, quality, token_counts, urls

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefghilmnoprstué") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


LONG = prose(30_000)
#: Null ids, null and empty texts, one very long, ties, repeated rows, white space, other scripts, special strings.
ODD = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "日本語 😀 é ▁x"), (7, "x <|endoftext|> y"), (8, "#" * 500), (8, "ß" * 300), (9, prose(80)), (10, "A\x0bB C\x00")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if t and len(t) < 99 else None, None if i is None else f"s{i % 3}", 0, "own", -1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_tokens int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


OPERATORS = {
    "tokens": lambda d: token_counts.count_tokens(d, WORD_BPE),
    "language": lambda d: language.identify(d, language.fit(d)),
    "mixing": mixing.mix,
    "apply_mix": lambda d: mixing.apply_mix(d, mixing.mix(d)),
    "quality": quality.judge,
    "passages": passages.remove_repeated,
    "passage_digests": lambda d: passages.remove_repeated(d, digests=True),
    "urls": lambda d: urls.filter_urls(d, "text"),
    "near": near_duplicates.near_duplicates,
    "keep_one": near_duplicates.keep_one,
    "pieces": lambda d: pieces.encode_pieces(d, PIECES),
    "fingerprints": fingerprints.versions,
    "html": lambda d: html_text.extract(d, "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, odd, name):
    out = OPERATORS[name](odd.limit(0))
    assert out.collect() == [] and out.columns


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"apply_mix", "keep_one"}))
def test_odd_rows_keep_their_number(odd, name):
    out = OPERATORS[name](odd)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(i for i, _ in ODD)


def test_token_counts(odd, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    for df in (odd, documents):
        got = bag(token_counts.count_tokens(df, WORD_BPE, keep=["doc_id"]).collect())
        want = []
        for i, t in texts_of(df):
            n = len(tok.encode(t or "", add_special_tokens=False).ids)
            want.append((i, len((t or "").encode()), n, n > 2048))
        assert got == bag(want)


def test_any_frequent_table_counts_alike():
    texts = ["The cat's 12 hats!", "don't", prose(50)]
    assert [token_counts.Counter(WORD_BPE, {"the": 1})(t) for t in texts] == [token_counts.Counter(WORD_BPE, {})(t) for t in texts]


def test_pieces(odd, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (odd, documents):
        got = bag(pieces.encode_pieces(df, PIECES, keep=["doc_id"], digests=True).collect())
        want = []
        for i, t in texts_of(df):
            ids = lib.encode(t or "", num_threads=1)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((lib.decode(ids) if ids else "").encode()).hexdigest()))
        assert got == bag(want)


def test_pieces_of_random_texts():
    table = pieces.PrefixTable(PIECES)
    some = list(table.ids)
    for k in range(3000):
        t = "".join(RNG.choice("abcdeuu  ▁.%%'09\né日😀") for _ in range(RNG.randint(0, 30))) if k % 2 else "".join(RNG.choice(some) for _ in range(RNG.randint(1, 5)))
        assert table.encode(t)[1] == table.library.encode(t), repr(t)


def test_mixing(spark):
    rows = [(k, "s0" if k % 3 else f"s{k % 6}" if k % 5 else None, prose(RNG.randint(0, 60))) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mixing.mix(df).collect()
    assert bag((r.doc_id, r.copies) for r in got) == bag((r.doc_id, r.copies) for r in mixing.mix(df.repartition(3)).collect())
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.taken == r.copies * r.size <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(size[r.source] == r.source_size for r in got)
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, want, free = 1.5 * sum(size.values()), {}, list(names)
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 2 * size[s]
        left, free = left - sum(2 * size[s] for s in over), [s for s in free if s not in over]
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert {s: pytest.approx(t) for s, t in want.items()} == target
    assert all(abs(taken[s] - target[s]) <= 60 for s in names)


def test_mixing_of_equal_rows(spark):
    df = spark.createDataFrame([(1, "a", "x y z")] * 500 + [(2, "b", "u")] * 100, "doc_id long, source string, text string")
    mixed = mixing.mix(df).cache()
    got = collections.Counter()
    for r in mixed.collect():
        got[r.source] += r.taken
    targets = {r.source: r.target for r in mixed.collect()}
    assert all(abs(got[s] - targets[s]) <= 3 for s in targets) and mixed.count() == 600
    assert mixing.apply_mix(df, mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_mix_is_applied(odd):
    mixed = mixing.mix(odd)
    assert bag((r.doc_id, r.text) for r in mixing.apply_mix(odd, mixed).collect()).total() == mixed.agg(F.sum("copies")).first()[0]


def _counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(runs)
    again = {j for i, r in enumerate(runs) if n[r] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality(odd, documents):
    for df in (odd, documents):
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        got = quality.judge(df).collect()
        assert bag((r.doc_id, *[r[c] for c in names], r.base_failed) for r in got) == bag((i, *(c := _counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in texts_of(df))
        assert all(not r.kept for r in got if r.base_failed)


def test_order_goes_by_measured_cost_and_what_is_left(spark):
    rows = [(prose(60) + (" ###" * 9 if k % 2 else "") + " x" * (k % 3 == 0),) for k in range(300)]
    counted = quality.with_counts(spark.createDataFrame(rows, "text string").repartition(2)).cache()
    slow = F.aggregate(F.sequence(F.lit(1), F.lit(20_000)), F.length("text").cast("long"), lambda a, x: F.pmod(F.xxhash64(a, x), F.lit(1_000_003)))
    odd = F.col("n_symbols") > 5
    rules = [quality.Rule("slow", odd & (slow >= 0)), quality.Rule("quick", odd), quality.Rule("third", F.col("n_words") % 3 == 1)]
    assert quality.measured(counted, rules)["slow"] > 3 * quality.measured(counted, rules)["quick"]
    order = quality.cascade_order(counted, rules)
    assert order.index("quick") < order.index("slow") and order[-1] == "slow"  # it rejects nothing that is left
    assert quality.cascade_order(counted, rules, {"slow": 0.1, "quick": 5.0, "third": 9.0})[0] == "slow"


def test_order_of_rules_doesnt_matter(documents):
    rules = quality.default_rules()
    kept = lambda r: bag((x.doc_id, x.kept) for x in quality.judge(documents, rules=r).select("doc_id", "kept").collect())
    assert kept(rules) == kept(rules[::-1])


def _removed(texts):
    n = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        on = bytearray(len(t))
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                on[i : i + 200] = b"\1" * 200
        out.append((len(t), sum(on), sum(1 for i in range(len(t)) if on[i] and (not i or not on[i - 1])), hashlib.sha256(bytes(x for x, o in zip(t, on) if not o)).hexdigest()))
    return out


def test_passages(spark):
    base = prose(700)
    rows = [(k, prose(RNG.randint(0, 30)) + base[(a := RNG.randint(0, 2500)) : a + RNG.randint(120, 700)] + prose(RNG.randint(0, 30))) for k in range(70)]
    rows += [(100, None), (101, ""), (102, "a" * 199), (103, "b" * 200), (104, "c" * 201), (105, "ab" * 300), (106, base), (107, base), (107, base), (None, base[:300]), (108, "é" * 250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = passages.remove_repeated(df, digests=True, keep=["doc_id"]).collect()
    want = _removed([(t or "").encode() for _, t in rows])
    assert bag(got) == bag((i, *w) for (i, _), w in zip(rows, want, strict=True))
    plain = {r.doc_id: r.text for r in passages.remove_repeated(df).collect()}
    assert plain[100] is None and plain[101] == "" and plain[106] == "" and plain[102] == "a" * 199


def _classes(texts, threshold=0.8):
    runs = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else {} for t in texts]
    own = [{k: 1 + math.log(v) for k, v in r.items()} for r in runs]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or ""):
                parent[root(i)] = root(j)
            elif own[i].keys() & own[j].keys():
                every = own[i].keys() | own[j].keys()
                s = sum(1 / sum(max(own[i].get(y, 0) / own[i][x], own[j].get(y, 0) / own[j][x]) for y in every) for x in own[i].keys() & own[j].keys())
                if s >= threshold:
                    parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_near_duplicates(spark, threshold):
    rows = []
    for k in range(12):
        words = prose(RNG.randint(60, 150)).split() * RNG.choice([1, 1, 1, 2])
        for c in range(RNG.randint(1, 6)):
            edited = list(words)
            for _ in range(RNG.randint(0, 5 if threshold > 0.5 else 14)):
                edited[RNG.randrange(len(edited))] = RNG.choice(VOCABULARY)
            rows.append((100 * k + c, " ".join(edited)))
    rows += [(2000, prose(3)), (2001, None), (2002, ""), (2003, " "), (2004, rows[0][1]), (2004, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates.near_duplicates(df, threshold=threshold).collect()
    root = _classes([t for _, t in rows], threshold)
    least = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    assert bag((r.doc_id, r.class_id) for r in got) == bag((i, least[q]) for (i, _), q in zip(rows, root))
    kept = collections.Counter(r.class_id for r in got if r.kept)
    assert set(kept) == {r.class_id for r in got} and max(kept.values()) == 1
    if threshold != 0.8:
        return
    one = near_duplicates.keep_one(df).collect()
    assert len(one) == len(kept) and bag((r.doc_id,) for r in one) == bag((r.doc_id,) for r in got if r.kept)


def test_near_duplicates_of_one_template(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(400):
        edited = list(base)
        for _ in range(rng.choice([4, 8, 12, 14, 16, 18])):
            edited[rng.randrange(len(edited))] = f"w{rng.randrange(5000)}"
        rows.append((i, " ".join(edited)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if want[i] != want[j] and len(runs[i] & runs[j]) >= 0.8 * len(runs[i] | runs[j]):
                one, other = sorted((want[i], want[j]))
                want = [one if c == other else c for c in want]
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))


def test_blocks_link_as_all_pairs_do():
    rng = random.Random(11)
    base = [prose(40, rng).split() for _ in range(3)]
    texts = []
    for k in range(90):
        words = list(base[k % 3]) * rng.choice([1, 1, 2])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(" ".join(words))
    doc, runs, times = near_duplicates.shingles(pa.array(texts))
    own = [(runs[doc == i], times[doc == i]) for i in range(len(texts))]
    nodes = pa.array([{"key": b"%d" % i, "class": b"%d" % i, "w": float(near_duplicates.weight(t).sum()), "runs": h.tobytes() + t.astype("uint32").tobytes()} for i, (h, t) in enumerate(own)], pa.struct([("key", pa.binary()), ("class", pa.binary()), ("w", pa.float64()), ("runs", pa.binary())]))
    side = near_duplicates._Side(nodes)
    p, q = near_duplicates._shared(side, range(10, 20), side)
    most = near_duplicates.at_most(p, q)
    exact = [[near_duplicates.similarity(own[i], own[j]) for i in range(10, 20)] for j in range(len(own))]
    assert all(m >= e - 1e-4 and (m == pytest.approx(e, abs=1e-4) or (own[j][1] > 1).any() or (own[10 + i][1] > 1).any()) for j in range(len(own)) for i, (m, e) in enumerate(zip(most[j], exact[j])))
    links = near_duplicates._linked(side, side, 0.8)
    want, got = list(range(len(texts))), list(range(len(texts)))
    for i, j in [(i, j) for i in range(len(own)) for j in range(i) if near_duplicates.similarity(own[i], own[j]) >= 0.8]:
        want = [want[j] if c == want[i] else c for c in want]
    for i, j in [(int(a), int(b)) for a, b in links]:
        got = [got[j] if c == got[i] else c for c in got]
    same = lambda x: [x.index(c) for c in x]
    assert same(got) == same(want) and len(links) == len(texts) - len(set(want))


def test_signatures_estimate_similarity():
    words = prose(300).split()
    texts = [" ".join(words), " ".join(words[:40] + ["x"] + words[41:]), " ".join(words[:150]) + " " + prose(150)]
    who, _ = near_duplicates.signatures(pa.array(texts))
    doc, runs, times = near_duplicates.shingles(pa.array(texts))
    own = [(runs[doc == i], times[doc == i]) for i in range(3)]
    for j in (1, 2):
        assert (who[0] == who[j]).mean() == pytest.approx(near_duplicates.similarity(own[0], own[j]), abs=0.15)


def test_fingerprints(odd, documents):
    cut = lambda t: set(re.findall(r"[^\n]{1,128}", t))
    like = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
    for df in (odd, documents):
        got = sorted(fingerprints.versions(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256))
        rows = sorted(((i, t or "") for i, t in texts_of(df)), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        want = []
        for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
            half = len(a) // 2
            e = a[: len(a) - half] + b[:half]
            want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), like(cut(a), cut(e)), like(cut(a), cut(b))))
        want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [w[:3] for w in want]
        assert [x for r in got for x in (r.near_edited, r.near_next)] == pytest.approx([x for w in want for x in w[3:]])


def test_neighbours_of_any_ids(spark):
    for ids, kind in ((list(range(6000)) + [10**12], "long"), ([f"id-{k:05d}" for k in range(300)] + ["", "é", None], "string"), ([k / 7 for k in range(50)], "double")):
        order = sorted(ids, key=lambda i: (i is not None, i if i is not None else 0) if kind != "string" else (i is not None, (i or "").encode()))
        df = spark.createDataFrame([(i, f"t{i}") for i in ids], f"doc_id {kind}, text string").repartition(3)
        got = {r.doc_id: r.next_text for r in fingerprints.next_texts(df).collect()}
        assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}
    cuts, n = [float(x) for x in range(0, 1000, 10)], 4
    rows = spark.range(1000).select("id", fingerprints._run(F.col("id").cast("double"), cuts, n).alias("run")).orderBy("id").collect()
    assert [r.run for r in rows] == sorted(r.run for r in rows) and max(collections.Counter(r.run for r in rows).values()) <= 10


def test_returned_fingerprints_peel(spark):
    # read back from the returned text, the sketches alone tell what differs, for any number of paragraphs
    rng = random.Random(8)
    rows = [(i, "\n".join(prose(4, rng) for _ in range(n))) for i, n in enumerate([0, 1, 5, 40, 300, 300, 1200, 1200, 1200])]
    got = sorted(fingerprints.versions(spark.createDataFrame(rows, "doc_id long, text string")).collect())

    def read(said):
        whole = lambda x: x - (1 << 64) if x >> 63 else x
        return [[tuple(whole(int(v, 16)) for v in cell.split(".")) if cell else (0, 0, 0) for cell in part.split("-")] for part in said.split("/")]

    assert [len(read(r.fingerprint)) for r in got] == [1, 1, 4, 32, 256, 256, 1024, 1024, 1024]
    kind = "array<array<struct<n int, k long, h long>>>"
    pairs = spark.createDataFrame([(r.doc_id, read(r.fingerprint), read(r.edited_fingerprint)) for r in got], f"doc_id long, a {kind}, b {kind}")
    for (_, found), (i, a), (_, b), r in zip(sorted(pairs.select("doc_id", fingerprints.peeled(F.col("a"), F.col("b"))).collect()), rows, rows[1:] + rows[:1], got, strict=True):
        half = len(a) // 2
        one, two = set(a.split("\n")) - {""}, set((a[: len(a) - half] + b[:half]).split("\n")) - {""}
        n = len(one ^ two)
        known = [x for x in found if x is not None]
        assert len(known) >= 0.9 * len(found) - 1 and sum(known) >= 0.7 * n - 8
        assert sum(known) == n or len(known) < len(found)
        assert r.near_edited == pytest.approx(1 - n / (len(one) + len(two)) if one or two else 1.0)


def test_language(documents):
    held = documents.withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(held.where("not held_out"))
    got = language.identify(held.where("held_out"), model).collect()
    right = [r.lang_pred == r.lang for r in got if r.lang]
    assert sum(right) >= 0.9 * len(right) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.05 * len(got)
    langs, score, rejected = model.predict(pa.array([None, "", "123 !?", "the"], pa.string()))
    assert langs[:3] == ["und"] * 3 and list(score[:3]) == [0, 0, 0] and list(rejected[:3]) == [True] * 3


def test_language_sample_is_bounded_and_rejects_what_it_never_saw(spark, documents):
    many = spark.range(5000).select(F.lit("the same words here").alias("text"), F.lit("en").alias("lang")).unionByName(documents.select("text", "lang"))
    held = {}
    train, language.train = language.train, lambda texts, langs: held.update(n=len(texts), langs=set(langs)) or train(texts[:50], langs[:50])
    try:
        language.fit(many.unionByName(spark.createDataFrame([("x" * 70_000, f"l{k}") for k in range(3)], "text string, lang string")), sample_docs=100)
    finally:
        language.train = train
    assert held["n"] <= 7 * 20 and held["langs"] >= {"en", "l0", "l1", "l2"}
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null")
    rows = [(r.text, r.lang) for r in some.collect()]
    known = [r for r in rows if r[1] != "fr"]
    model = language.train([t for t, _ in known[::2]], [x for _, x in known[::2]])
    rejected = lambda some: model.predict(pa.array([t for t, _ in some]))[2].mean()
    assert rejected([r for r in rows if r[1] == "fr"]) >= 0.8 and rejected(known[1::2]) <= 0.05


RULED = [
    ("http://a.com/x", "a.com", "/x", "com/", "allow"),
    ("https://b.EXAMPLE.com/en/7?q#z", "b.example.com", "/en/7", "example.com/en/", "block"),
    ("https://www.example.com/en/7", "www.example.com", "/en/7", "www.example.com/en/", "allow"),
    ("ftp://notexample.com/en/7", "notexample.com", "/en/7", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/Es/1", "x.net", "/Es/1", None, None),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://a.com?x=/y", "a.com", "", None, None),
    ("a.com/x", "", "", None, None),
    (None, "", "", None, None),
]


def test_urls(spark):
    got = urls.filter_urls(spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(RULED)], "page_id long, url string, host string")).collect()
    for r in got:
        _, host, path, rule, verdict = RULED[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict


def test_url_models_tell_what_rules_teach(spark):
    rows = [(f"http://{prose(1)}{k}.{'com/news/' if k % 2 else 'net/es/'}{k}",) for k in range(400)] + [("http://q.org/news/5",), ("http://q.org/es/5",)]
    got = {r.url: r for r in urls.filter_urls(spark.createDataFrame(rows, "url string")).collect()}
    assert got["http://q.org/news/5"].ratio > got["http://q.org/es/5"].ratio
    assert got["http://q.org/news/5"].verdict == "allow" and got["http://q.org/es/5"].verdict == "block"


def test_url_models_keep_every_ngram(spark):
    # more 5-grams than any fixed table's cells; each keeps its own ratio, an unknown one backs off
    rng = random.Random(5)
    taught = [("".join(rng.choice("abcdefghij") for _ in range(30)), rng.choice(["allow", "block"])) for _ in range(3000)]
    counts = {v: collections.Counter() for v in ("allow", "block")}
    for said, v in taught:
        t = "\x02" * 5 + said + "\x03"
        counts[v].update(t[i - k : i + 1] for i in range(5, len(t)) for k in range(5))
    before = {v: collections.Counter() for v in counts}
    for v, c in counts.items():
        for g, n in c.items():
            before[v][g[:-1]] += n
    known = {g for g in counts["allow"] | counts["block"] if counts["allow"][g] + counts["block"][g] >= 2}
    ratio = lambda g: math.log((counts["allow"][g] + 0.5) / (before["allow"][g[:-1]] + 50)) - math.log((counts["block"][g] + 0.5) / (before["block"][g[:-1]] + 50))
    model = urls.fit(spark.createDataFrame(taught, "said string, verdict string"))
    got = {r.gram: r.ratio for r in model.collect()}
    assert got.keys() == known and sum(len(g) == 5 for g in known) > 1 << 14
    assert all(got[g] == pytest.approx(ratio(g), abs=1e-9) for g in known)
    asked = [t for t, _ in taught[:50]] + ["zzz", "", "abcxyz012", "a" * 300]
    scored = {bytes(r.key): r.ratio for r in urls.score(spark.createDataFrame([(t,) for t in asked], "said string"), model).collect()}
    for said in asked:
        t = "\x02" * 5 + said + "\x03"
        each = [next((ratio(t[i - k : i + 1]) for k in (4, 3, 2, 1, 0) if t[i - k : i + 1] in known), 0.0) for i in range(5, len(t))]
        assert scored[hashlib.md5(said.encode()).digest()] == pytest.approx(sum(each) / len(each), abs=1e-8)


def test_html_pages(spark):
    import html as h

    def truth(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        return " ".join(h.unescape(re.sub("<[^>]*>", " ", inner)).split())

    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if "</article>" in r.html]
    got = html_text.extract_all([p for _, p in rows], html_text.labeller())
    assert sum(g == truth(p) for g, (_, p) in zip(got, rows, strict=True)) >= 0.95 * len(rows)


def test_html_of_other_makes():
    rng = random.Random(77)
    right = n = 0
    for _ in range(60):
        page = html_text.example(rng)
        if page:
            keep = html_text.labeller().label([[b[:3] for b in page]])[0]
            right += sum(k == b[3] for k, b in zip(keep, page, strict=True))
            n += len(page)
    assert right >= 0.97 * n
    assert html_text.extract_all([None, "", "<", "<p", "<script>x"], html_text.labeller())[:2] == ["", ""]
    assert [b[1] for b in html_text.blocks("<p>a&amp;b <b>c</b>d\n\n e<br>f<style>x</style><!-- y --><p title='>'>g")] == ["a&b cd e", "f", "g"]


def test_html_nested_pages_take_linear_memory():
    import tracemalloc

    tracemalloc.start()
    found = html_text.blocks("<div class=a>x" * 20_000 + "</p></b>" * 20_000)
    assert len(found) == 20_000 and tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    path = html_text.blocks("<div class='b c'><p>x</p></div><p>y")
    assert path[0][0] & path[1][0] == path[1][0] != path[0][0]


def test_html_without_article():
    words = lambda n: " ".join(VOCABULARY[:n])
    page = f"<body><nav><ul><li><a href=/>home</a><li><a href=/b>news</a></ul></nav><div class='content'><h1>{words(5)}</h1><p>{words(60)}.</p><p>{words(40)}.</p></div><footer>&copy; all rights</footer>"
    assert html_text.main_text(page, html_text.labeller()) == f"{words(5)} {words(60)}. {words(40)}."


def test_html_drops_no_text_after_or_in_other_elements():
    said = lambda page: " ".join(b[1] for b in html_text.blocks(page))
    for tag in ('<svg class="i"/>', "<math/>", "<svg>", "<object data=x>", "<canvas>", "<iframe src=x>", "<template>"):
        assert said(f"<article><p>one</p>{tag}<p>two</p><p>three</p></article>") == "one two three"
    for tag in ("math", "noscript", "object", "canvas", "xmp"):
        assert said(f"<p>one <{tag}>two</{tag}> three</p>") == "one two three"
    assert said("<p>a<svg><text>b</text></svg>c<style>d</style><iframe>e</iframe>f<script>g") == "acf"
    assert [b[1] for b in html_text.blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here")] == ["so x=2 here"]
