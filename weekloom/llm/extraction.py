"""Main text of web pages.

A page is cut into flat text blocks. Each block has its number of words and its link density,
those of the block before and the block after, and marks of the element it stands in. A decision
tree, grown from a small table of labelled blocks, says which blocks are the article.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and the words of attributes that tell what an element holds.
BLOCK = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main "
    "menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th "
    "thead title tr ul video audio".split()) - {"br"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title textarea template svg math iframe object canvas video audio noframes xmp".split())
MAIN_ELEMENTS = frozenset("article main".split())
OTHER_ELEMENTS = frozenset(
    "nav header footer aside form button select menu dialog noscript fieldset search datalist label".split())
MAIN_ROLES = frozenset("main article".split())
OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tooltip".split())
MAIN_WORDS = frozenset("article content main post entry story".split())
REMARK_WORDS = frozenset("comment comments reply replies disqus advert advertisement sponsored promo related".split())
OTHER_WORDS = REMARK_WORDS | frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advertising banner cookie cookies "
    "consent gdpr notice notification alert sponsor newsletter subscribe subscription signup share sharing social "
    "breadcrumb breadcrumbs pagination pager popup modal overlay form login search widget copyright legal disclaimer "
    "toolbar tags recommended trending feedback rating poll".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements whose end tag may be left out before the next one of their kind.
REPEATED = frozenset("li dt dd td th tr option".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

NEUTRAL, WEAK, STRONG, OTHER, TITLED = range(5)  # TITLED: a header inside the article
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "other", "heading",
            "paragraph", "main_in_page")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    place: int
    heading: bool
    paragraph: bool


def kind_of(name: str, attributes: str, parent: int) -> int:
    """What an element holds, by its name, roles and words of class and id; else as its parent."""
    main, other = name in MAIN_ELEMENTS, name in OTHER_ELEMENTS
    weak = False
    if attributes and name not in ("html", "body"):
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                words = {w.lower() for w in WORD.findall(value)}
                other |= bool(words & (REMARK_WORDS if main else OTHER_WORDS))
                weak |= bool(words & MAIN_WORDS)
            elif key == "role":
                main |= value.lower() in MAIN_ROLES
                other |= value.lower() in OTHER_ROLES
            elif key == "itemprop":
                main |= value.lower() == "articlebody"
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                other = True
            elif key == "style":
                other |= "display:none" in value.replace(" ", "").lower()
    if other:
        return TITLED if name in ("header", "hgroup") and parent in (STRONG, TITLED) else OTHER
    if main:
        return STRONG
    return WEAK if weak and parent in (NEUTRAL, WEAK) else parent


def text_blocks(page: str) -> list[Block]:
    """The text blocks of a page in their order, with references decoded and white space squeezed."""
    found: list[Block] = []
    stack: list[tuple[str, int]] = []
    counts: Counter[str] = Counter()
    parts: list[str] = []
    linked, at = 0, 0

    def place() -> int:
        return stack[-1][1] if stack else NEUTRAL

    def pop() -> str:
        name = stack.pop()[0]
        counts[name] -= 1
        return name

    def flush() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                heading = any(counts[h] for h in HEADINGS)
                found.append(Block(" ".join(words), len(words), min(linked, len(words)), place(), heading, counts["p"] > 0))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = references.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if counts["a"]:
                linked += len(piece.split())

    while (m := TAG.search(page, at)) is not None:
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        block = name in BLOCK or "-" in name
        if m[1]:
            if block:
                flush()
            if not counts[name]:
                continue
            if block:
                while pop() != name:
                    pass
            else:  # the end of an inline element does not end blocks
                while stack and stack[-1][0] not in BLOCK and pop() != name:
                    pass
            continue
        if name in UNSEEN:
            if block:
                flush()
            if not m[3].endswith("/") or name in ("script", "style"):
                end = closing(name).search(page, at)
                at = end.end() if end else len(page)
            continue
        if block:
            flush()
            if counts["p"]:
                while pop() != "p":
                    pass
            elif stack and name in REPEATED and stack[-1][0] == name:
                pop()
        elif name == "br":
            parts.append(" ")
        if name == "a" and counts["a"]:
            while pop() != "a":
                pass
        if name not in VOID:
            stack.append((name, kind_of(name, m[3], place())))
            counts[name] += 1
    add(page[at:])
    flush()
    return found


@cache
def closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def features(blocks: list[Block]) -> np.ndarray:
    """Rows of FEATURES, in the order of the blocks."""
    out = np.zeros((len(blocks), len(FEATURES)))
    if not blocks:
        return out
    words = np.array([b.words for b in blocks], dtype=float)
    links = np.array([b.linked for b in blocks]) / words
    places = np.array([b.place for b in blocks])
    heading = np.array([b.heading for b in blocks])
    place = np.where(places == TITLED, np.where(heading, STRONG, OTHER), places)
    out[:, 0], out[:, 1] = words, links
    out[1:, 2], out[1:, 3] = words[:-1], links[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], links[1:]
    out[:, 6] = np.select([place == STRONG, place == WEAK], [2, 1], 0)
    out[:, 7] = place == OTHER
    out[:, 8], out[:, 9] = heading, [b.paragraph for b in blocks]
    out[:, 10] = (place == STRONG).any()
    return out


# The labelled table, as layouts: K marks a kept text, B and D dropped ones, each with its words.
# K and B come in several lengths; D is text that only its length and links give away.
LAYOUTS = (
    "<nav><ul><li><a href=x>B1</a><li><a href=x>B2</a></ul></nav><div class=ad>B8</div><article><h1>K6</h1><p>K40<p>K2<p>K1"
    "</article><footer>B9</footer>",
    "<header><h1>B3</h1><p>B12</p></header><main><h1>K5</h1><p>K1<p>K30</p><aside><p>B25</p></aside><p>K3<p>K60</main><p>B4</p>",
    "<div class=cookie-notice><p>B30</p></div><article><header><h1>K7</h1><p>B5</p></header><p>K20<p><a href=x>K4</a><p>K9"
    "<section class=comments><h2>B1</h2><p>B18</p><p>B45</p></section></article><p>B22</p><p>B2</p>",
    "<div>B3</div><div itemprop=articleBody>K80<p>K2<ul><li>K6<li><a href=x>K3</a></ul></div><div>B15</div><div>B50</div>",
    "<article><p>K12<form><p>B16</p><label>B2</label></form><table><tr><td>K1<td>K3</table></article><h2>B3</h2><p>B70</p>",
    "<h1>B2</h1><main role=main><p>K4</p><div class=share><a href=x>B1</a></div><blockquote>K15</blockquote></main>",
    "<div class=menu><a href=x>B1</a><a href=x>B1</a></div><h1>K6</h1><p>K35</p><p>K4</p><p>K50</p><div class=footer>B10</div>",
    "<div class=sidebar><p>B40</p><p>B12</p></div><h1>K6</h1><p>K35</p><p>K4</p><p>K50</p><footer><p>B20</p><p>B30</p></footer>",
    "<header>B20</header><div>K45</div><div>K60</div><form>B30</form><div>K18</div><div class=comments><div>B40</div><div>B9</div></div>",
    "<ul><li><a href=x>D2</a><li><a href=x>D1</a><li><a href=x>D3</a></ul><h1>K8</h1><p>K25</p><p>K2</p><p>K28</p>"
    "<ul><li><a href=x>D6</a><li><a href=x>D5</a></ul><p>D4</p>",
    "<table><tr><td><a href=x>D1</a><td><a href=x>D2</a></tr></table><div>K45</div><div>K60</div><div>K18</div><div>D5</div>",
    "<div>D2 <a href=x>D4</a></div><h2>K4</h2><p>K14 <a href=x>K2</a> K20</p><p>K33</p><p><a href=x>B5</a></p><div>D3</div>",
    "<div id=content><ul><li><a href=x>B3</a></ul><h1>K5</h1><p>K30</p><p>K2</p><p>K41</p><div><a href=x>B4</a> D1</div></div>"
    "<div>D6</div>",
    "<div class=post><h2><a href=x>K6</a></h2><p>K50</p><p>K5</p></div><div class=sidebar><p>B30</p><p>B12</p></div>",
    "<div>D1</div><div><a href=x>D3</a></div><div>K90</div><div>K3</div><div>K70</div><div>D2</div><div><a href=x>B7</a></div>",
    "<article><h1>K5</h1><p>K3<p>K50<p>K2</article>",
    "<article>K1</article>",
    "<article><p>K9</p><p>K1</p></article><footer>B6</footer>",
    "<nav><a href=x>B3</a></nav><main><p>K7</p><p>K2</p><ul><li><a href=x>K1</a><li><a href=x>K12</a></ul></main>",
    "<main><h2>K1</h2><p><a href=x>K8</a></p></main><div>B40</div>",
    "<article><p>K30</p><p><a href=x>K6</a></p></article><article><h2>K2</h2><p>K4</p></article><p>B14</p>",
    "<div>B30</div><article><div>K2</div><div>K6</div><div>K1</div></article>",
    "<h1>K6</h1><p>K35</p><p>K50</p><ul><li><a href=x>D2</a><li><a href=x>D2</a><li><a href=x>D1</a></ul><div class=footer>B30</div>",
    "<ul><li><a href=x>D2</a><li><a href=x>D1</a><li><a href=x>D2</a></ul><div>K40</div><div>K3</div><div>K50</div><p><a href=x>D2</a></p>"
    "<footer>B40</footer>",
    "<div><a href=x>D1</a></div><div>K50</div><div><a href=x>D1</a></div><div>K60</div><div><a href=x>D3</a></div>",
    "K55",
    "<p>K24</p><p>K1</p><p>K30</p>",
    "<div><a href=x>B2</a> <a href=x>B3</a> D1</div><div>D4</div>",
)
SCALES = (1, 2, 5)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (kept or not) of the blocks of all layouts, at several lengths of text."""
    rows, labels = [], []
    for layout in LAYOUTS:
        for scale in SCALES:
            page = re.sub(r"\b([KBD])(\d+)\b", lambda m: " ".join([m[1]] * int(m[2]) * (1 if m[1] == "D" else scale)), layout)
            blocks = text_blocks(page)
            rows.append(features(blocks))
            labels += [b.text[0] == "K" for b in blocks]
    return np.concatenate(rows), np.array(labels)


class Tree(NamedTuple):
    """Nodes by number: the feature asked (-1 in a leaf), its threshold, children and answer."""

    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    kept: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), dtype=np.int64)
        while (asked := self.feature[node]).max(initial=-1) >= 0:
            value = rows[np.arange(len(rows)), np.maximum(asked, 0)]
            child = np.where(value <= self.threshold[node], self.below[node], self.above[node])
            node = np.where(asked < 0, node, child)
        return self.kept[node]


def grown(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 2) -> Tree:
    """A tree of binary splits, each the one with the least Gini impurity."""
    nodes: list[list] = []

    def grow(chosen: np.ndarray, left: int) -> int:
        number, y = len(nodes), labels[chosen]
        nodes.append([-1, 0.0, 0, 0, bool(y.mean() >= 0.5)])
        best = None
        if left and 0 < y.sum() < len(y):
            for f in range(rows.shape[1]):
                order = np.argsort(rows[chosen, f], kind="stable")
                x, kept = rows[chosen, f][order], np.cumsum(y[order])
                n = np.arange(1, len(x))
                a, b = kept[:-1] / n, (kept[-1] - kept[:-1]) / (len(x) - n)
                impurity = n * a * (1 - a) + (len(x) - n) * b * (1 - b)
                allowed = (x[1:] > x[:-1]) & (n >= least) & (len(x) - n >= least)
                if allowed.any():
                    at = int(np.argmin(np.where(allowed, impurity, np.inf)))
                    if best is None or impurity[at] < best[0] - 1e-12:
                        best = (impurity[at], f, (x[at] + x[at + 1]) / 2)
        if best is not None:
            _, f, threshold = best
            low = rows[chosen, f] <= threshold
            nodes[number][:2] = f, threshold
            nodes[number][2] = grow(chosen[low], left - 1)
            nodes[number][3] = grow(chosen[~low], left - 1)
        return number

    grow(np.arange(len(rows)), depth)
    return Tree(*(np.array(column) for column in zip(*nodes)))


def article(page: str | None, tree: Tree) -> str:
    """The kept blocks of one page, joined by line feeds."""
    blocks = text_blocks(page or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, kept in zip(blocks, tree.predict(features(blocks))) if kept)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
              tree: Tree | None = None, size: int = 1 << 22) -> DataFrame:
    """Per page: its key, its url, ``text`` (blocks of the article, joined by line feeds) and ``n_chars``.

    ``tree`` is a classifier of blocks; without one it is grown from the labelled layouts. Pages
    are read where they lie: there is no shuffle, and a task holds about ``size`` characters of
    pages, or one page. A null or empty page has the empty text, as has a page without article.
    Broken markup never fails: open tags end with the page, unknown end tags are passed over.
    Repeated rows each give a row; null keys and urls stay null; other columns are ignored; an
    empty table gives no rows.
    """
    tree = tree or grown(*labelled())
    frame = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held, texts = 0, 0, []
            for row in range(batch.num_rows):
                page = batch.column(2)[row].as_py()
                texts.append(article(page, tree))
                held += len(page or "")
                if held >= size or row == batch.num_rows - 1:
                    part = batch.slice(low, row + 1 - low)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                        ["key", "url", "text", "n_chars"])
                    low, held, texts = row + 1, 0, []

    schema = frame.drop("html").schema.add("text", "string").add("n_chars", "long")
    return frame.mapInArrow(scan, schema).withColumnRenamed("key", key).withColumnRenamed("url", url)
