"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes its leaf blocks in order: runs of text between block-level tags, with their open ancestors.  Features are the
ancestors' tags and class words, the block's own tag, bins of length, link share and punctuation.  A two-label chain (main or
other), trained by stochastic gradient on the exact log-likelihood (forward-backward), is decoded by Viterbi.

Training pages: `sample` pages (those with the smallest hash of their id) are labelled by their own mark-up: blocks inside
<article> but in no boilerplate element are main.  So that the model does not hang on that one tag, each page is also shown
with other containers and with sidebars, notices, forms, menus and comments put in, all made from the page's own words.

Extraction is a map over pages: nothing is shuffled, and a task holds one batch.

Defined cases: a null or empty page has the empty text; unclosed and stray tags are tolerated; scripts, styles, comments and
templates are never text; character references are decoded once; without any trainable page the starting rule decides; a
column of the pages that has the result's name is replaced by it; repeated rows and ids are read row by row.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SAMPLE = 240
EPOCHS = 6
#: Elements that begin and end blocks, that hold no text of the page, and that never close.
BLOCK = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
SILENT = frozenset("script style template noscript svg math iframe object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open one of their kind, and those that it may lie in without being kept open.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
LOOSE = frozenset("p dt dd td th".split())
#: Elements and class words of boilerplate, for labelling training pages.
BOILER_TAGS = frozenset("nav header footer aside form title button select label".split())
BOILER_WORDS = frozenset("ad ads advert banner comment comments cookie footer header login menu modal nav newsletter notice promo related share sidebar social subscribe widget".split())


class Path(NamedTuple):
    """What a block's ancestors say: names of tags and class words, the block's own tag, the depth, and training labels.

    An element shares its parent's names if it adds none, so deep nesting costs no copies of the ancestors.
    """

    names: frozenset = frozenset()
    own: str = ""
    depth: int = 0
    main: bool = False
    other: bool = False

    @lru_cache(maxsize=1 << 14)
    def child(self, tag: str, words: tuple, label: str | None) -> "Path":
        shown = tag not in ("html", "body")
        new = {f"class {w}" for w in words}
        if shown:
            new.add(f"in {tag}")
        return Path(
            self.names if self.names.issuperset(new) else self.names | new,
            tag if shown and tag in BLOCK else self.own,
            min(self.depth + shown, 6),
            self.main or tag == "article" or label == "main",
            self.other or label == "other" or tag in BOILER_TAGS or not BOILER_WORDS.isdisjoint(words),
        )


ROOT = Path()


class Blocks(HTMLParser):
    """Collects (path, text, linked characters) of each leaf block, in time linear in the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, Path]] = []
        self.holders: list[int] = []  # places of block elements in the stack
        self.open: Counter = Counter()
        self.silent = 0
        self.found: list[tuple] = []
        self.parts: list[str] = []
        self.linked = 0

    @property
    def path(self) -> Path:
        return self.stack[-1][1] if self.stack else ROOT

    def _end_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((self.path, text, self.linked))
        self.parts, self.linked = [], 0

    def _end_like(self, tag):
        """Closes the nearest open element of this tag, unless another holder lies between."""
        for i in reversed(self.holders):
            own = self.stack[i][0]
            if own == tag:
                return self._close(i)
            if own not in LOOSE:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK:
            self._end_block()
            if tag in SELF_ENDING and self.open[tag]:
                self._end_like(tag)
        if tag in VOID:
            return
        words, label = (), None
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words += tuple(value.lower().replace("-", " ").replace("_", " ").split())
            elif name == "data-label":
                label = value
        if tag in BLOCK:
            self.holders.append(len(self.stack))
        self.stack.append((tag, self.path.child(tag, words, label)))
        self.open[tag] += 1
        self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, i):
        for tag, _ in self.stack[i:]:
            self.open[tag] -= 1
            self.silent -= tag in SILENT
        del self.stack[i:]
        while self.holders and self.holders[-1] >= i:
            self.holders.pop()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._end_block()
        if self.open[tag]:
            i = len(self.stack) - 1
            while self.stack[i][0] != tag:
                i -= 1
            self._close(i)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())


def blocks(html: str | None) -> list[tuple]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser._end_block()
    return parser.found


def path_features(path: Path) -> tuple[str, ...]:
    return tuple(sorted(path.names | {f"own {path.own}", f"depth {path.depth}"}))


def text_features(text: str, linked: int) -> tuple[str, ...]:
    n = text.count(" ") + 1
    stops = sum(map(text.count, ".,;:!?"))
    return f"words {n.bit_length()}", f"links {round(4 * min(linked / max(len(text), 1), 1))}", f"stops {min(stops, 8).bit_length()}", "ends" if text[-1] in ".!?\"'" else "open", "bias"


class Chain:
    """Two labels, 0 other and 1 main; weights by feature and by pair of neighbouring labels."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((2, 2))
        self.first = np.zeros(2)
        self._paths: dict[tuple, np.ndarray] = {}

    def _score(self, names) -> np.ndarray:
        return sum((self.weights[f] for f in names if f in self.weights), np.zeros(2))

    def scores(self, found: list[tuple]) -> np.ndarray:
        out = np.zeros((len(found), 2))
        for i, (path, text, linked) in enumerate(found):
            if path not in self._paths:
                if len(self._paths) > 50_000:
                    self._paths.clear()
                self._paths[path] = self._score(path_features(path))
            out[i] = self._paths[path] + self._score(text_features(text, linked))
        return out

    def decode(self, found: list[tuple]) -> list[int]:
        """The best labelling, by Viterbi."""
        if not found:
            return []
        s = self.scores(found).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = s[0][0] + self.first[0], s[0][1] + self.first[1]
        back = []
        for x, y in s[1:]:
            back.append((0 if a + m00 >= b + m10 else 1, 0 if a + m01 >= b + m11 else 1))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[tuple], list[int]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> "Chain":
        """Stochastic gradient (with per-weight steps) on the log-likelihood."""
        feats = [[path_features(p) + text_features(t, n) for p, t, n in found] for found, _ in pages]
        square: dict = {}

        def step(key, weight, gradient):
            square[key] = square.get(key, 1e-8) + gradient * gradient
            weight -= rate * (gradient + decay * weight) / np.sqrt(square[key])

        order = np.random.default_rng(7)
        for _ in range(epochs):
            for k in order.permutation(len(pages)):
                labels = pages[k][1]
                if not labels:
                    continue
                s = np.array([self._score(f) for f in feats[k]])
                n = len(s)
                alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
                alpha[0] = s[0] + self.first
                for i in range(1, n):
                    alpha[i] = np.logaddexp(alpha[i - 1, 0] + self.moves[0], alpha[i - 1, 1] + self.moves[1]) + s[i]
                for i in range(n - 2, -1, -1):
                    z = beta[i + 1] + s[i + 1]
                    beta[i] = np.logaddexp(self.moves[:, 0] + z[0], self.moves[:, 1] + z[1])
                whole = np.logaddexp(*alpha[-1])
                node = np.exp(alpha + beta - whole)
                pair = np.exp(alpha[:-1, :, None] + self.moves + (s + beta)[1:, None, :] - whole).sum(axis=0)
                node[np.arange(n), labels] -= 1
                np.subtract.at(pair, (labels[:-1], labels[1:]), 1)
                total: dict[str, np.ndarray] = {}
                for names, g in zip(feats[k], node):
                    for f in names:
                        total[f] = total[f] + g if f in total else g.copy()
                for f, g in total.items():
                    step(f, self.weights.setdefault(f, np.zeros(2)), g)
                step("moves", self.moves, pair)
                step("first", self.first, node[0])
        return self


def marked(path: Path) -> int:
    """The label of a block in a training page: inside an article or a labelled container, and in no boilerplate."""
    return int(path.main and not path.other)


def variants(html: str, seed: int):
    """A page as it is and in other dress, for training."""
    yield html
    if "<article>" not in html:
        return
    words = " ".join(t for _, t, _ in blocks(html)).split()
    rng = np.random.default_rng(seed)

    def talk(low, high):
        n, at = int(rng.integers(low, high)), int(rng.integers(0, max(len(words) - high, 1)))
        return " ".join(words[at : at + n]).replace("&", "&amp;").replace("<", "&lt;")

    for kind in rng.permutation(4)[:2]:
        new = html
        if kind in (0, 2):
            tag, name = [("div", "content"), ("main", ""), ("div", "post body"), ("section", "story")][int(rng.integers(4))]
            new = new.replace("<article>", f'<{tag} class="{name}" data-label="main">', 1).replace("</article>", f"</{tag}>", 1)
        end = new.rfind("</p>") + 4
        if kind in (1, 2):
            tag, name = [("section", "comments"), ("div", "comment list"), ("ol", "comments")][int(rng.integers(3))]
            new = new[:end] + f'<{tag} class="{name}" id="comments"><h3>{talk(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{talk(3, 60)}</p></div>' for _ in range(int(rng.integers(1, 5)))) + f"</{tag}>" + new[end:]
        if kind in (1, 3):
            start = new.find("<p>")
            new = new[:start] + f'<div class="ad">{talk(3, 20)}</div>' + new[start:]
        if kind in (0, 3):
            body = new.find("<body>") + 6
            extra = [f'<header><div class="logo">{talk(1, 4)}</div></header>', f'<aside class="sidebar"><h2>{talk(1, 4)}</h2><ul>' + "".join(f'<li><a href="/x">{talk(2, 9)}</a></li>' for _ in range(4)) + f"</ul><p>{talk(8, 50)}</p></aside>", f'<div class="cookie notice"><p>{talk(8, 40)}</p><button>{talk(1, 3)}</button></div>', f'<form class="newsletter"><label>{talk(2, 8)}</label><p>{talk(4, 20)}</p><input type="text"><button>{talk(1, 2)}</button></form>', f'<div class="related widget"><p>{talk(5, 30)}</p></div>']
            chosen = "".join(extra[i] for i in rng.permutation(5)[:3])
            at = body if rng.random() < 0.5 else max(new.find("<footer>"), body)
            new = new[:at] + chosen + new[at:]
        yield new


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Chain:
    """A chain trained on at most `sample` pages, which come to the driver."""
    h = F.xxhash64(id_col)
    chosen = cut(pages.where(F.col(html_col).isNotNull()).select(h.alias("_h")).orderBy("_h").limit(sample))  # keys alone are sorted
    chosen = F.broadcast(chosen.distinct())  # `sample` numbers at most
    rows = pages.where(F.col(html_col).isNotNull()).select(h.alias("_h"), F.col(html_col).alias("html")).join(chosen, "_h").limit(sample).collect()
    rows = sorted((r["_h"], r["html"]) for r in rows)
    shown = []
    for key, page in rows:
        for html in variants(page, key & 0xFFFFFFFF):
            found = blocks(html)
            labels = [marked(p) for p, _, _ in found]
            if any(labels):
                shown.append((found, labels))
    chain = Chain()
    if shown:
        return chain.train(shown)
    chain.weights = {"in article": np.array([0.0, 2.0]), "in main": np.array([0.0, 2.0]), "bias": np.array([1.0, 0.0])}
    chain.weights |= {f"in {t}": np.array([4.0, 0.0]) for t in BOILER_TAGS} | {f"class {w}": np.array([4.0, 0.0]) for w in BOILER_WORDS}
    return chain


def main_text(pages: DataFrame, chain: Chain, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """`pages` with `out_col`, the main blocks joined by line ends; a column of that name is replaced, the others pass through."""
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("string")
    def extract(htmls: pd.Series) -> pd.Series:
        out = []
        for html in htmls:
            found = blocks(html)
            out.append("\n".join(text for (_, text, _), main in zip(found, shared.value.decode(found)) if main))
        return pd.Series(out, dtype=object)

    return pages.withColumn(out_col, extract(html_col))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    from .common import table

    pages = table(spark, sf_dir, "pages")
    return main_text(pages, train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLE_SQL: dict[str, str] = {}
