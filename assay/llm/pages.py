"""Main text of HTML pages: the maximum-scoring run of words and tags.

Method: a page is a sequence of tags and texts. A word scores by the block it stands in: the log odds that words under an element
of that name, class, id and role lie inside the article of a labelled page, lowered by what classes and furniture around it have against them. A tag
scores negative, by how much more often its name stands outside. One linear scan finds the contiguous run of the
highest total. Inside the run, blocks whose words score under `DROP` (an advert or reader comments within the article) are left out. Pages that
mark their article (`article`, or `main`) are the labelled ones.

All names and classes are features; they are hashed to `SLOTS` weights, so the model's size is fixed. Without labelled words an element has the
prior of its name: content, or furniture for those in FURNITURE. NEVER holds elements whose text no reader sees.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by
one space; inline elements do not part words, `br` and blocks do.

Cases: null or empty html, and pages without words in a positive run, give an empty text; unclosed and
crossing elements close with the element around them; truncated tags, comments and scripts end with the page, an open quote with its tag;
repeated rows and null ids are kept; an empty table gives no rows; extra columns are ignored by the query.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Weights of the model; features are hashed to them.
SLOTS = 1 << 18
#: Score of a word under which its block is left out of a run.
DROP = -1.0
#: Most that an element's features add up to, either way.
MOST = 4.0
NEVER = frozenset("script style noscript template head title iframe object svg canvas".split())
FURNITURE = frozenset("nav header footer aside form button select option textarea input label dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))
#: Attributes of so many characters are not remembered.
LONG = 1000

#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % SLOTS


@lru_cache(maxsize=1 << 15)
def _features(name: str, attributes: str) -> tuple[int, ...]:
    """Slots of an element: of its name, and of each class, id and role, digits apart. The name's is -1 - slot for furniture, which speaks against all that it encloses."""
    named = [w for x in _NAMES.findall(attributes) for w in (x[1] or x[2] or x[3]).split()] if "=" in attributes else []
    return (-1 - _slot(name) if name in FURNITURE else _slot(name), *{_slot("." + _DIGITS.sub("0", w.lower())) for w in named})


def tokens(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Places of all markup in order: first and last character, name ("" for comments and the like, and for RAW elements, which go to their end), whether it closes, attributes.

    Every character is looked at a fixed number of times. A `>` within a quoted value does not end its tag; a quote that the page never closes is none; a tag, comment or RAW
    element that is not closed ends with the page; a `<` that begins no markup is text.
    """
    n, at, never = len(html), 0, set()

    def find(what: str, start: int) -> int:
        """As str.find; what was once not found is not looked for again."""
        if what in never:
            return -1
        got = html.find(what, start)
        if got < 0:
            never.add(what)
        return got

    def tag_end(start: int) -> int:
        at = start
        while m := _STOP.search(html, at):
            if m.group() == ">":
                return m.end()
            close = find(m.group()[-1], m.end())
            at = m.end() if close < 0 else close + 1
        return n

    while (first := html.find("<", at)) >= 0:
        name = _NAME.match(html, first)
        if html.startswith("<!--", first):
            close = find("-->", first + 4)
            at = n if close < 0 else close + 3
            yield first, at, "", False, ""
        elif name:
            at, word, closing = tag_end(name.end()), name[1].lower(), html[first + 1] == "/"
            attributes = html[name.end() : at].removesuffix(">")
            if word in RAW and not closing:
                close = _END[word].search(html, at)
                at = tag_end(close.end()) if close else n
                word = ""
            yield first, at, word, closing, attributes
        elif html[first + 1 : first + 2] in ("!", "?", "/"):
            close = find(">", first)
            at = n if close < 0 else close + 1
            yield first, at, "", False, ""
        else:
            at = first + 1


class Page:
    """A page's tags and texts: (tag's name or "", text, number of the enclosing block); blocks: their features, parents, and whether never shown or in an article."""

    def __init__(self, html: str):
        self.parts: list[tuple[str, str, int]] = []
        self.features, self.parent, self.never, self.inside = [(_slot("body"),)], [0], [False], [False]
        # open elements: name, block, and place of the nearest one that is not inline
        stack: list[tuple[str, int, int]] = [("", 0, 0)]
        open_: Counter[str] = Counter()
        at = 0

        def close(i: int) -> None:
            open_.subtract(name for name, _, _ in stack[i:])
            del stack[i:]

        for first, last, name, closing, attributes in tokens(html):
            if first > at:
                self.parts.append(("", html[at:first], stack[-1][1]))
            at = last
            if not name:
                continue
            if closing:
                if open_[name] > 0:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
                self.parts.append((name, "", stack[-1][1]))
                continue
            if name in ("p", "li") and stack[stack[-1][2]][0] == name:
                close(stack[-1][2])
            block = stack[-1][1]
            if name not in INLINE and name not in VOID:
                up, block = block, len(self.parent)
                self.features.append(_features(name, attributes) if len(attributes) < LONG else _features.__wrapped__(name, attributes))
                self.parent.append(up)
                self.never.append(self.never[up] or name in NEVER)
                self.inside.append(self.inside[up] or name in ARTICLE)
            self.parts.append((name, "", block))
            if name not in VOID and not attributes.endswith("/"):
                stack.append((name, block, stack[-1][2] if name in INLINE else len(stack)))
                open_[name] += 1
        if at < len(html):
            self.parts.append(("", html[at:], stack[-1][1]))


class Weights:
    """Log odds by slot, from counts of labelled words (and tags) inside and outside articles."""

    def __init__(self, inside: np.ndarray, outside: np.ndarray):
        yes, no = np.ones(SLOTS), np.ones(SLOTS)
        names = [_slot(n) for n in FURNITURE]
        blocks = [_slot(n) for n in "body div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption article main".split()]
        yes[blocks] = 3.0
        no[names] = 20.0
        odds = np.log((inside + yes) / (outside + no))
        self.words = np.clip(odds, -MOST, MOST)
        seen = inside + outside > 0
        self.tags = np.where(seen, np.minimum(odds, 0.0) - 0.1, -2.0)

    def tag(self, name: str) -> float:
        return 0.0 if name in INLINE else float(self.tags[_slot("<" + name)])

    def blocks(self, page: Page) -> list[float]:
        """The score of a word in each block."""
        out, against = [], []
        for features, up in zip(page.features, page.parent, strict=True):
            named = sum(self.words[s] for s in features[1:])
            first = features[0]
            name = self.words[first if first >= 0 else -1 - first]
            held = against[up] if out else 0.0
            out.append(max(-MOST, min(MOST, float(name + named))) + held)
            against.append(max(-MOST, min(held, float(named + (name if first < 0 else 0.0)))))
        return out


def extract(html: str, weights: Weights) -> str:
    """The main text of a page."""
    page = Page(html)
    words = weights.blocks(page)
    tags: dict[str, float] = {}
    best, start, score = (0.0, 0, 0), 0, 0.0
    for i, (name, text, block) in enumerate(page.parts):
        if name:
            if name not in tags:
                tags[name] = weights.tag(name)
            score += tags[name]
        elif page.never[block]:
            continue
        else:
            score += len(text.split()) * words[block]
        if score <= 0:
            start, score = i + 1, 0.0
        elif score > best[0]:
            best = (score, start, i + 1)
    blocks, now = [], []
    for name, text, block in page.parts[best[1] : best[2]]:
        if name and name not in INLINE:
            blocks.append("".join(now))
            now = []
        elif text and not page.never[block] and words[block] > DROP:
            now.append(text)
    blocks.append("".join(now))
    done = (" ".join(unescape(b).split()) for b in blocks)
    return " ".join(b for b in done if b)


def weights(pages: DataFrame, html: str = "html") -> Weights:
    """The model, from all pages that mark their article. A word counts for its block's features, and for the classes and furniture around it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if not text or not re.search(r"<(?:article|main)\b", text, re.I):
                    continue
                page = Page(text)
                held = np.zeros(len(page.parent), np.int64)
                for name, body, block in page.parts:
                    if name:
                        total[int(not page.inside[block]), _slot("<" + name)] += 1
                    elif not page.never[block]:
                        held[block] += len(body.split())
                around = [frozenset(s for i, s in enumerate(page.features[0]) if i or s < 0)]  # what speaks for all that a block encloses
                for k in range(1, len(page.parent)):
                    up, own = around[page.parent[k]], {s for i, s in enumerate(page.features[k]) if i or s < 0}
                    around.append(up if own <= up else up | own)
                for block in np.flatnonzero(held):
                    side, k = int(not page.inside[block]), int(block)
                    slots = around[page.parent[k]].union(page.features[k])
                    total[side, [s if s >= 0 else -1 - s for s in slots]] += held[block]
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at), "inside": pa.array(total[0, at]), "outside": pa.array(total[1, at])})

    counts = pages.select(html).mapInArrow(count, "slot long, inside long, outside long").groupBy("slot").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    inside, outside = np.zeros(SLOTS), np.zeros(SLOTS)
    for r in counts.toLocalIterator():  # a row for each slot at most
        inside[r.slot], outside[r.slot] = r.inside, r.outside
    return Weights(inside, outside)


def main_texts(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """The rows with `text`, the page's main text, in place of its html."""
    shared = pages.sparkSession.sparkContext.broadcast(weights(pages, html))
    rest = [c for c in pages.columns if c not in (html, "text")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(page or "", shared.value) for page in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(texts, pa.string())], [*rest, "text"])

    narrow = pages.select(*rest, html)
    return narrow.mapInArrow(read, "".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}, " for c in rest) + "text string")


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
