"""SentencePiece encoding by a prefix table, and decoding.

A merge-type vocabulary determines, for each prefix of a text, the last token of its encoding. The table of these tokens is
filled from left to right: an automaton finds the tokens that end at a position, and the one that is compatible with the
last token before it is the prefix's own. Ids then come from the end backwards. Tokens never cross from a letter to the
mark of a space, so texts are encoded word by word, and words are cached.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parcelwise.llm._common import add_columns

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words in each of the two generations of a worker's cache: when one is full, the one before goes.
CACHE_WORDS = 150_000
#: Compatible and incompatible pairs in a worker's cache.
CACHE_PAIRS = 400_000


class PrefixTable:
    """Encodes as the library does without begin and end ids; model is a merge-type model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        at: dict[float, int] = {}
        for p in self.ids:
            if len(p) > 1:
                at[self.score[p]] = at.get(self.score[p], 0) + 1
        #: Pieces of equal scores merge by place, not by rank: words that hold one of them take the queue of merges.
        self.tied = {p for p in self.ids if len(p) > 1 and at[self.score[p]] > 1}
        if crossing := [p for p in self.ids if SPACE in p.lstrip(SPACE)]:
            raise ValueError(f"pieces that go over a space aren't supported: {crossing[:3]}")
        #: How a piece was last merged; a piece that its own text doesn't encode to can't occur.
        self.split: dict[str, tuple[str, str] | None] = {}
        whole = []
        for p in self.ids:
            parts, last = self.merged(p)
            if len(parts) == 1:
                whole.append(p)
                self.split[p] = last
        self.pieces = {self.ids[p]: p for p in whole}
        self.chars = {p for p in self.ids if len(p) == 1}
        #: All tied pieces are runs of spaces as a rule; then one look tells whether a word holds any.
        self.tie = SPACE * 2 if all(p.startswith(SPACE * 2) for p in self.tied) else None
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            self.automaton.add_word(p, (self.ids[p], len(p)))
        self.automaton.make_automaton()
        self.words: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.older: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces by the queue of merges, best score first, then leftmost; and the last merge."""
        part: list[str | None] = list(word)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(part) and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, part[i], part[j]))

        for i in range(len(part)):
            offer(i)
        last = None
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            last, part[i], part[j], after[i] = (a, b), a + b, None, after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p is not None], last

    def compatible(self, first: int, second: int) -> bool:
        """Whether a token followed by another stays so: undoing merges at the seam, latest first, no merge over it may come before one that it undoes."""
        a, b = self.pieces[first], self.pieces[second]
        x, y, worst, on_right = a, b, float("inf"), False
        while True:
            over = self.score.get(x + y)
            if over is not None and (-over < worst or on_right and -over == worst):  # of equal merges the left one comes first
                out = False
                break
            sx, sy = self.split.get(x), self.split.get(y)
            if sx is None and sy is None:
                out = True
                break
            rx, ry = -self.score[x] if sx else float("-inf"), -self.score[y] if sy else float("-inf")
            if rx > ry:
                x, worst, on_right = sx[1], rx, False
            else:
                y, worst, on_right = sy[0], ry, True
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[first << 20 | second] = out
        return out

    def by_prefixes(self, word: str) -> list[int]:
        """The ids of a word of characters that the vocabulary has: last[i] is the last token of the first i characters."""
        n = len(word)
        last, begin, pairs = [-1] * (n + 1), [0] * (n + 1), self.pairs
        for at, (token, size) in self.automaton.iter(word):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get(before << 20 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[end], begin[end] = token, start
        out, end = [], n
        while end:
            out.append(last[end])
            end = begin[end]
        out.reverse()
        return out

    def word(self, word: str) -> tuple[int, ...]:
        if self.chars.issuperset(word):
            return tuple(self._known(word))
        out: list[int] = []
        for known, run in groupby(word, self.chars.__contains__):
            out += self._known("".join(run)) if known else [self.bytes[b] for b in "".join(run).encode()]
        return tuple(out)  # no merge goes over a character that isn't in the vocabulary

    def _known(self, run: str) -> list[int]:
        if self.tie in run if self.tie else any(p in run for p in self.tied):
            return [self.ids[p] for p in self.merged(run)[0]]
        return self.by_prefixes(run)

    def encode(self, text: str | None) -> tuple[str, list[int]]:
        """The ids in decimal, joined by commas, and the ids."""
        if not text:
            return "", []
        words, found = self.words, []
        for w in _WORDS.findall(SPACE + text.replace(" ", SPACE)):
            got = words.get(w)
            if got is None:
                got = self.older.get(w)
                if got is None:
                    ids = self.word(w)
                    got = (",".join(map(str, ids)), ids)
                if len(words) >= CACHE_WORDS:
                    self.older, self.words = words, {}
                    words = self.words
                if len(w) <= 64:
                    words[w] = got
            found.append(got)
        return ",".join([s for s, _ in found]), list(chain.from_iterable([ids for _, ids in found]))

    def forget(self) -> None:
        """Lets the words go: idle workers live on, beside whatever runs next."""
        self.words, self.older = {}, {}

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


_tables: dict[str, PrefixTable] = {}


def _table(path: str) -> PrefixTable:
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Adds ids (array<int>) and decoded (string) to docs' columns; with digests, n_tokens, ids_sha256 and decoded_sha256 instead.

    Null and empty texts have no ids and decode to an empty text. Repeated rows stay; columns with clashing names are replaced.
    """

    def make():
        tab = _table(model_path)

        def work(texts: pa.Array) -> list[pa.Array]:
            n, ids, out = [], [], []
            for t in texts.to_pylist():
                said, found = tab.encode(t)
                back = tab.decode(found)
                if digests:
                    n.append(len(found))
                    ids.append(hashlib.sha256(said.encode()).hexdigest())
                    out.append(hashlib.sha256(back.encode()).hexdigest())
                else:
                    ids.append(found)
                    out.append(back)
            if digests:
                return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())]
            return [pa.array(ids, pa.list_(pa.int32())), pa.array(out, pa.string())]

        work.done = tab.forget
        return work

    if digests:
        fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return add_columns(docs, text, fields, make, keep)
