"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks (leaves of text between block-level tags) with their tag paths. Each block is a vector: hashed
tokens of the path (tags, classes, ids), hashed words, and a few measures. A bidirectional LSTM reads the page's vectors in
order, so each block is judged in the context of the whole document; blocks over one half are the main text. The network
and its training (back-propagation through time, Adam) are numpy; it learns from pages that `example` makes by a seed.
"""

from __future__ import annotations

import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parcelwise.llm._common import add_columns

PATH, WORDS, MEASURES, HIDDEN = 160, 48, 6, 20
WIDTH = PATH + WORDS + MEASURES
#: Elements whose content is never text: without an end tag, to the page's end; only up to an end tag; those that can close themselves.
_RAW = ("script", "style")
_SKIPPED = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("template", "textarea", "iframe", "title", "svg")}
_EMPTY = {"svg", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mover", "mrow", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "q", "s", "samp", "semantics", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An open element of the first kind ends where one of the second begins.
_ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}, "h1": None, "h2": None, "h3": None}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(_RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")


def blocks(page: str | None) -> list[tuple[int, str, int]]:
    """Each block's path, text with white space as one space, and the number of its characters within links.

    The path is the set of the buckets of its tags' and names' tokens, as bits: each open element adds its own to those of the one
    around it, so time and memory are linear in the page, however deep it nests.
    """
    out: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    said: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(said).split())
        if text:
            out.append((stack[-1][1] if stack else 0, text, min(linked, len(text))))
        said.clear()
        linked = 0

    def leave(i: int) -> None:
        for t, _ in stack[i:]:
            opened[t] -= 1
        del stack[i:]

    page = page or ""
    unclosed: set[str] = set()
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"] or m["cdata"]
        if text:
            text = html.unescape(text) if m["text"] else text
            said.append(text)
            if opened.get("a"):
                linked += len(text)
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        start = not (m["end"] or m["end2"])
        if start and tag in _EMPTY and (m["attr"] or m["attr2"] or "").endswith("/"):
            continue
        if start and tag in _SKIPPED and tag not in unclosed:
            end = _SKIPPED[tag].search(page, at)
            if end:
                at = end.end()
                continue
            unclosed.add(tag)
        if tag not in _INLINE:
            close()
        if m["end"] or m["end2"]:
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if any(t not in _INLINE for t, _ in stack[i:]):
                    close()
                leave(i)
            continue
        if tag in _VOID:
            continue
        if tag not in _INLINE:
            for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                ends = _ENDS.get(stack[i][0], ())
                if ends is None or tag in ends:
                    leave(i)
                    break
                if stack[i][0] not in _INLINE:
                    break
        attr = m["attr"] or m["attr2"] or ""
        names = {p for v in _NAMES.findall(attr) for p in _PART.findall(v.lower())} if "=" in attr else ()
        path = stack[-1][1] if stack else 0
        for token in (tag, *(f".{p}" for p in names)):
            path |= 1 << _bucket(token, PATH)
        stack.append((tag, path))
        opened[tag] = opened.get(tag, 0) + 1
    close()
    return out


_buckets: dict[str, int] = {}


def _bucket(token: str, of: int) -> int:
    got = _buckets.get(token)
    if got is None:
        if len(_buckets) > 500_000:
            _buckets.clear()
        got = _buckets[token] = zlib.crc32(token.encode())
    return got % of


def vectors(found: list[tuple[int, str, int]]) -> np.ndarray:
    x = np.zeros((len(found), WIDTH), np.float32)
    paths = np.frombuffer(b"".join(path.to_bytes(PATH // 8, "little") for path, _, _ in found), np.uint8).reshape(len(found), -1)
    x[:, :PATH] = np.unpackbits(paths, axis=1, bitorder="little")
    for i, (_, text, linked) in enumerate(found):
        words = text.lower().split()
        n = np.bincount([PATH + _bucket(w, WORDS) for w in words], minlength=PATH + WORDS)[PATH:]
        x[i, PATH : PATH + WORDS] = n / max(len(words), 1)
        x[i, PATH + WORDS :] = (min(np.log1p(len(text)) / 8, 2), linked / len(text), len(words) < 4, text[-1] in ".!?\"”", i / len(found), (len(found) - i) / len(found))
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network; w: its arrays by name (f and b: forward and backward)."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": r.normal(0, 0.15, (WIDTH, 4 * HIDDEN)), f"h{d}": r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.w |= {"o": r.normal(0, 0.2, (2 * HIDDEN, 1)), "z": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, learn: bool) -> tuple[np.ndarray, list]:
        """x: pages x blocks x WIDTH; mask: 1 where there is a block. To learn, each step's state is kept."""
        n, steps, _ = x.shape
        a = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs, kept = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = a[:, t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[:, t, None]
            c2 = f * c + i * g
            u = np.tanh(c2)
            if learn:
                kept.append((t, h, c, i, f, o, g, u, m))
            h, c = m * (o * u) + (1 - m) * h, m * c2 + (1 - m) * c
            hs[:, t] = h
        return hs, kept

    def forward(self, x: np.ndarray, mask: np.ndarray, learn: bool = False) -> tuple[np.ndarray, tuple]:
        (hf, kf), (hb, kb) = self._pass(x, mask, "f", learn), self._pass(x, mask, "b", learn)
        both = np.concatenate([hf, hb], 2)
        return _sigmoid((both @ self.w["o"])[:, :, 0] + self.w["z"]), (both, kf, kb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (both, kf, kb) = self.forward(x, mask, learn=True)
        dz = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        g = {"o": np.einsum("nth,nto->ho", both, dz), "z": dz.sum((0, 1))}
        dboth = dz @ self.w["o"].T
        for d, kept, dh_all in (("f", kf, dboth[:, :, :HIDDEN]), ("b", kb, dboth[:, :, HIDDEN:])):
            wh = self.w[f"h{d}"]
            gh, da = np.zeros_like(wh), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for t, h, c, i, f, o, q, u, m in reversed(kept):
                dh = dh + dh_all[:, t]
                on, on_c = dh * m, dc * m
                dc2 = on_c + on * o * (1 - u * u)
                a = np.concatenate([dc2 * q * i * (1 - i), dc2 * c * f * (1 - f), on * u * o * (1 - o), dc2 * i * (1 - q * q)], 1)
                da[:, t] = a
                gh += h.T @ a
                dh, dc = dh * (1 - m) + a @ wh.T, dc * (1 - m) + dc2 * f
            g |= {f"h{d}": gh, f"x{d}": np.einsum("nti,ntj->ij", x, da, optimize=True), f"c{d}": da.sum((0, 1))}
        return g

    def label(self, pages: list[list]) -> list[np.ndarray]:
        """For each page's blocks: whether each is main text. Pages of like length go together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            now = order[-max(1, min(128, 4000 // longest)) :]
            del order[len(order) - len(now) :]
            x, mask = _padded([vectors(pages[i]) for i in now])
            p, _ = self.forward(x, mask)
            for k, i in enumerate(now):
                out[i] = p[k, : len(pages[i])] > 0.5
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(rows), max(map(len, rows)), WIDTH), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, 1
    return x, mask


def example(rng: random.Random) -> list[tuple[int, str, int, bool]]:
    """The blocks of a made-up page, each with whether it is main text."""
    syllables = [a + b for a in "b c d f g l m n p r s t th st v w sch qu é ñ ü".split() for b in "a e i o u en er on ing es é ä".split()]
    mark = "\x00"

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(max(n, 1)))

    def prose(main: bool, low: int, high: int) -> str:
        text = words(rng.randint(low, high))
        text = (text[:1].upper() + text[1:] + rng.choice([".", ".", ".", "!", "?", ""])) if rng.random() < 0.8 else text
        if rng.random() < 0.2:
            text = f"<{(t := rng.choice(['b', 'i', 'em', 'strong', 'span', 'a href=x']))}>" + text + (f"</{t.split()[0]}>" if rng.random() < 0.7 else "")
        return (mark if main else "") + text

    def named(tags: list[str], names: list[str], inner: str) -> str:
        tag = rng.choice(tags)
        name = rng.choice(names + [""] * (tag not in ("div", "section", "ul", "span", "p")))
        attr = f' {rng.choice(["class", "id", "class"])}="{name}{rng.choice(["", "-box", " wide", "-1", "_inner"])}"' if name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1)}">{words(rng.randint(1, 3))}</a></li>' for _ in range(n)) + "</ul>"

    def junk() -> str:
        said = lambda: rng.choice([links(rng.randint(2, 8)), f"<p>{prose(False, 2, 60)}</p>", prose(False, 1, 60), f"<p>{prose(False, 2, 30)}</p><p>{prose(False, 2, 60)}</p>", f"<h3>{words(2)}</h3>{links(3)}", f"<span>{words(3)}</span> <a href=x>{words(2)}</a>"])
        kinds = [
            lambda: named(["nav", "div", "ul", "nav"], ["nav", "menu", "navbar", "breadcrumb", "topnav", "navigation"], links(rng.randint(2, 9))),
            lambda: named(["header", "div"], ["header", "site-header", "masthead", "banner", "top"], said()),
            lambda: named(["footer", "div", "footer"], ["footer", "site-footer", "copyright", "bottom", "legal"], rng.choice(["&copy; ", "© 2024 ", "", "&middot; "]) + said()),
            lambda: named(["aside", "div"], ["sidebar", "side", "related", "widget", "recommended", "more", "aside", "popular"], said()),
            lambda: named(["div", "section", "ins", "aside"], ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "sponsored"], said()),
            lambda: named(["div", "section"], ["cookie", "cookie-notice", "consent", "notice", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe"], said() + rng.choice(["", "<button>OK</button>"])),
            lambda: named(["section", "div", "ol"], ["comments", "comment", "replies", "discussion", "comment-list", "respond"], "".join(f'<{(t := rng.choice(["div", "article", "li"]))} class="comment"><p>{prose(False, 3, 60)}</p></{t}>' for _ in range(rng.randint(1, 4)))),
            lambda: f"<form>{rng.choice([words(2), f'<label>{words(2)}</label><input name=q>', f'<p>{prose(False, 2, 20)}</p>'])}<button>{words(1)}</button></form>",
            lambda: named(["div", "ul"], ["share", "social", "tags", "meta", "byline", "author", "pagination", "toolbar"], said()),
        ]
        return rng.choice(kinds)()

    def main_block() -> str:
        r = rng.random()
        if r < 0.72:
            return f"<p>{prose(True, 1, 90)}" + rng.choice(["</p>", "</p>", "</p>", "", f"<br><p>{prose(True, 1, 60)}</p>"])
        if r < 0.8:
            return f"<h{(k := rng.randint(2, 4))}>{mark}{words(rng.randint(1, 8))}</h{k}>"
        if r < 0.87:
            return rng.choice(["<ul>", "<ol>"]) + "".join(f"<li>{prose(True, 1, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if r < 0.92:
            return f"<blockquote>{prose(True, 4, 40)}</blockquote>"
        if r < 0.95:
            return "<table>" + "".join(f"<tr><td>{mark}{words(2)}</td><td>{mark}{words(2)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if r < 0.97:
            return f"<pre>{mark}{words(9)}</pre>"
        return f"<div>{prose(True, 4, 60)}</div>"

    inner = [f"<h1>{mark}{words(rng.randint(1, 14))}</h1>"] * (rng.random() < 0.9)
    for _ in range(rng.choice([1, 2, 4, 8, 14])):
        inner.append(main_block())
        if rng.random() < 0.05:
            inner.append(junk())
    box = rng.choice(["<article>%s</article>"] * 5 + ["<main>%s</main>", "<main><article>%s</article></main>", '<div class="content">%s</div>', '<div id="main">%s</div>', '<div class="post-content">%s</div>', '<section class="article-body">%s</section>', '<div class="entry"><article class="post">%s</article></div>', '<div id="content"><div class="story">%s</div></div>'])
    before, after = [junk() for _ in range(rng.randint(0, 4))], [junk() for _ in range(rng.randint(0, 4))]
    page = "".join(before) + box % "".join(inner) + "".join(after)
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(["page", "wrapper", "container", "layout", "site"])}">{page}</div>'
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{page}" + rng.choice(["</body></html>", ""])
    if rng.random() < 0.02:
        page = ""
    return [(path, text.replace(mark, ""), linked, mark in text) for path, text, linked in blocks(page) if text.replace(mark, "").strip()]


def train(pages: int = 3000, epochs: int = 6, batch: int = 24, rate: float = 0.006, seed: int = 11) -> Labeller:
    rng = random.Random(seed)
    made = [p for p in (example(rng) for _ in range(pages)) if p]
    made.sort(key=len)
    groups = []
    for at in range(0, len(made), batch):
        some = made[at : at + batch]
        x, mask = _padded([vectors([b[:3] for b in p]) for p in some])
        y = np.zeros(mask.shape, np.float32)
        for k, p in enumerate(some):
            y[k, : len(p)] = [b[3] for b in p]
        groups.append((x, mask, y))
    net = Labeller()
    first, second, step = {k: 0 * v for k, v in net.w.items()}, {k: 0 * v for k, v in net.w.items()}, 0
    for epoch in range(epochs):
        rng.shuffle(groups)
        for x, mask, y in groups:
            step += 1
            now = rate * (0.3 if epoch >= epochs - 2 else 1)
            for k, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.w[k] = (net.w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


_trained: list[Labeller] = []


def labeller() -> Labeller:
    """The network with its standard training, done once a process: it hangs on fixed seeds alone."""
    if not _trained:
        _trained.append(train())
    return _trained[0]


def main_text(page: str | None, net: Labeller) -> str:
    return extract_all([page], net)[0]


def extract_all(pages: list[str | None], net: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    return [" ".join(b[1] for b, on in zip(f, keep, strict=True) if on) for f, keep in zip(found, net.label(found), strict=True)]


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None, net: Labeller | None = None) -> DataFrame:
    """Adds text (main text) and n_chars (its code points) to pages' columns (or to those of keep).

    Null and empty pages, and pages without main text, have an empty text. Repeated rows stay; columns with clashing names are
    replaced; an empty table gives an empty one. Each page is read whole, whatever its length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(net or labeller())

    def make():
        own = shared.value

        def work(found: pa.Array) -> list[pa.Array]:
            text = extract_all(found.to_pylist(), own)
            return [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]

        return work

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return add_columns(pages, page, fields, make, keep)
