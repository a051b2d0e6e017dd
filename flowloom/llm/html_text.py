"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of tags and words. Every word has a weight by the kind of element it
stands in, every tag one by its name; words of plain blocks score positive, tags and words
of page furniture negative. One linear scan finds the contiguous stretch with the largest
sum, which is the content region; furniture inside it (an advert in the middle of an
article) is left out of the text.

Furniture is named by tags and by words of class, id and role, and so is all that stands in
it. Two things overrule the names. The counted odds: a name under which most words of the
labelled pages are content (a form round every page) marks no furniture anywhere. And
``article`` and ``main``: those with the fewest furniture elements round them are content
for all that they inherit, so a wrapper loses no article, and a comment or teaser marked as
an article stays where it is. What stands inside the content is left out by its own name
only; as its label says nothing about it, it is not counted for the names.

The weights are log odds of lying inside the content, counted over all labelled pages and
smoothed with a prior. Labelled are pages with exactly one ``article`` or ``main``
element: what is inside is content. Pages without that mark are scored with the weights
learned from the others, and by the prior alone if there are none. On a page with the mark
the odds are certain: words inside score above zero whatever element they stand in, so that
links, lists and tables at the edges of an article stay, and all outside scores below; a
mark inside furniture must hold most of the words for that.

Tags are found by a scanner that only moves forward, so a page costs what it is long,
closed tags and quotes or not.

Text: character references decoded, white space inside a block turned into one space,
blocks joined in page order by one space. Inline tags do not part words, block tags and
line breaks do. Scripts, styles, comments, templates, titles and drawings are never text; the
text of formulas (without their source in another notation) and of embedded objects is.

Defined cases: null and empty pages, and pages in which nothing scores above zero, give
the empty text; unclosed comments and scripts reach to the end of the page, an unclosed
drawing or formula source to the next block tag, and a self-closed one is empty; the head
needs no end tag, as nothing in it but what is named above has text; text without any markup
is one block of content; a tag that never ends is text. Repeated rows are extracted one by
one, an empty table gives an empty result, and further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import whole_texts

# fixed values: element names and the words in class, id and role that mark furniture
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("base head link meta".split())
MATH = frozenset(
    "maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
LEAF = frozenset("br h1 h2 h3 h4 h5 h6 hr p".split())  # blocks that hold no other blocks
INLINE = frozenset("a abbr b cite code em i img q s small span strong sub sup time u wbr".split())
FURNITURE_TAGS = frozenset("aside button dialog fieldset footer form header menu nav select".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice overlay "
    "pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip "
    "social sponsor sponsored subscribe toolbar widget".split()
)
# class names such as has-sidebar and overflow-hidden say how an element stands, not what it is
STATE_WORDS = frozenset("has no not overflow with without".split())
FURNITURE_STEMS = ("advert", "comment", "cookie", "navig", "newsletter", "sidebar", "sponsor")
PRIOR_ROWS = 50.0
# weights of a word or tag of a page with an article or main element, inside and outside of it
_INSIDE, _OUTSIDE = 1.0, -2.0
_PRIOR = {"text": 0.85, "link": 0.5, "furniture": 0.02, "inline": 0.6, "block": 0.35, "container": 0.2}

_BREAKOUT = "|".join(sorted(BLOCK | {"math"}, key=lambda name: (-len(name), name)))
_RAW = frozenset("script style template noscript title textarea iframe".split())
_DRAWINGS = frozenset("svg annotation annotation-xml".split())
_START = re.compile(r"<(?:(?P<comment>!--)|(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
_MARKUP_END = re.compile("[>\"']")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_DRAWING_END = {name: re.compile(rf"</{name}\s*>|(?=</?(?:{_BREAKOUT})\b)", re.I) for name in _DRAWINGS}
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


class _Scanner:
    """Tags of a page, in one pass that never goes back.

    A quoted attribute value may hold ``>``. Once quotes turn out not to be closed, and
    once no ``>`` is left, that holds for the rest of the page, so neither is looked for
    again and a page costs what it is long.
    """

    def __init__(self, page: str):
        self.page = page
        self.quotes = self.tags = True

    def _end(self, at: int) -> int:
        """Position after the ``>`` of a tag whose attributes begin at ``at``, or -1."""
        if not self.tags:
            return -1
        page, start = self.page, at
        while self.quotes:
            found = _MARKUP_END.search(page, at)
            if found is None:
                break
            at = found.end()
            if found[0] == ">":
                return at
            before = found.start() - 1
            while before > start and page[before].isspace():
                before -= 1
            if page[before] != "=":
                continue
            closed = page.find(found[0], at)
            if closed < 0:
                break
            at = closed + 1
        self.quotes = False
        end = page.find(">", start)
        self.tags = end >= 0
        return end + 1 if self.tags else -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, kind, is an end tag, attributes); kind is a tag's name, or ``#raw``,
        ``#drawing`` or ``#other`` for what has no text."""
        page, at = self.page, 0
        while (found := _START.search(page, at)) is not None:
            start, after = found.span()
            at = after
            if found["comment"]:
                close = _COMMENT_END.search(page, after)
                at = close.end() if close else len(page)
                yield start, at, "#other", False, ""
                continue
            end = self._end(after)
            if end < 0:
                continue
            name, closing = (found["name"] or "").lower(), bool(found["end"])
            at = end
            if name in _RAW and not closing:
                close = _RAW_END[name].search(page, end)
                at = close.end() if close else len(page)
                yield start, at, "#raw", False, ""
            elif name in _DRAWINGS and not closing:
                if page[end - 2] != "/":
                    close = _DRAWING_END[name].search(page, end)
                    at = close.end() if close else len(page)
                yield start, at, "#drawing", False, ""
            else:
                yield start, at, name or "#other", closing, page[after : end - 1]


def furniture_names(name: str, attributes: str, in_content: bool) -> frozenset[str]:
    """What marks an element as furniture: its tag, words of its names, ``hidden``."""
    if name in ("body", "html", "article", "main"):
        return frozenset()
    found = {name} if name in FURNITURE_TAGS else set()
    if attributes:
        for value in _NAMES.findall(attributes):
            for token in value.strip("\"'").split():
                words = {w.lower() for w in _PARTS.findall(token)}
                if not words & STATE_WORDS:
                    found |= words & FURNITURE_WORDS
                    found.update(stem for stem in FURNITURE_STEMS if any(w.startswith(stem) for w in words))
        if _HIDDEN.search(attributes):
            found.add("hidden")
    return frozenset(found - {"header"} if in_content else found)


def elements(page: str, harmless: frozenset[str] = frozenset(), names: Counter | None = None) -> list[tuple[str, str, int, bool]]:
    """(feature, text, words, inside article or main) in page order; tags have no text.

    Features: ``w:text``, ``w:h``, ``w:li`` ... for words by their block, ``w:link`` for
    words of links, ``w:furniture``; ``t:name`` for tags. A tag that ends a block is
    marked by a line end as its text. ``harmless`` names mark no furniture; ``names``
    collects the words below each furniture name outside the content, by whether they are
    inside it."""
    return _parsed(page, harmless, names)[0]


def _parsed(page: str, harmless: frozenset[str], names: Counter | None = None) -> tuple[list[tuple[str, str, int, bool]], bool]:
    """The elements, and whether the content stands in furniture."""
    out, depth = _elements(page, harmless, names, 0)
    if depth:
        if names is not None:
            names.clear()
        out, _ = _elements(page, harmless, names, depth)
    return out, depth > 0


def _is_marked(sequence: list[tuple[str, str, int, bool]], in_furniture: bool) -> bool:
    """Whether the page says itself what its content is. A mark that stands in furniture
    counts if no more words are outside of it than inside, else it may be a teaser."""
    inside, outside = (sum(n for f, _, n, content in sequence if f != "w:furniture" and content is side) for side in (True, False))
    return inside > 0 and (not in_furniture or inside >= outside)


def _elements(page: str, harmless: frozenset[str], names: Counter | None, reset: int) -> tuple[list[tuple[str, str, int, bool]], int]:
    """The elements, if ``article`` and ``main`` below at most ``reset`` pieces of furniture
    are content, and the least number of pieces above one of them."""
    out: list[tuple[str, str, int, bool]] = []
    stack: list[tuple[str, int, bool, frozenset[str]]] = []  # name, furniture above and here, content, names outside the content
    standing: Counter = Counter()  # open elements by name
    block, link, least = "text", False, None

    def words(raw: str) -> None:
        text = html.unescape(raw)
        count = len(text.split())
        _, furniture, content, marks = stack[-1] if stack else ("", 0, False, frozenset())
        kind = "furniture" if furniture else "link" if link else block
        out.append((f"w:{kind}", text, count, content))
        if names is not None:
            for mark in marks:
                names[mark, content] += count

    last = 0
    for begin, end, name, closing, attributes in _Scanner(page):
        if begin > last:
            words(page[last:begin])
        last = end
        content = bool(stack) and stack[-1][2]
        if name[0] == "#":
            if name != "#other":
                out.append(("t:drawing", "", 0, content) if name == "#drawing" else ("t:raw", "\n", 0, content))
            continue
        if name == "a":
            link = not closing
        if name in BLOCK:
            link = False
            if closing:
                if name in LEAF:
                    block = "text"
                elif standing[name]:
                    while True:
                        gone = stack.pop()[0]
                        standing[gone] -= 1
                        if gone == name:
                            break
                    block = "text"
                inside = content and (name in LEAF or bool(stack) and stack[-1][2])
            else:
                _, furniture, _, marks = stack[-1] if stack else ("", 0, False, frozenset())
                inside = content
                block = "h" if name[0] == "h" and name[1:].isdigit() else name if name in ("li", "td", "th", "dd", "dt", "pre") else "text"
                if name not in LEAF:
                    standing[name] += 1
                    if name in ("article", "main"):
                        if not content:
                            least = furniture if least is None else min(least, furniture)
                            furniture = 0 if furniture <= reset else furniture
                        stack.append((name, furniture, True, marks))
                    else:
                        found = furniture_names(name, attributes, content)
                        stack.append((name, furniture + bool(found - harmless), content, marks if content else marks | found))
            out.append((f"t:{name}", "\n", 0, inside))
        else:
            kind = name if name in INLINE else "head" if name in HEAD else "math" if name in MATH else "other"
            out.append((f"t:{kind}", "", 0, content))
    if last < len(page):
        words(page[last:])
    return out, least or 0


def _marks(page: str) -> int:
    return len(re.findall(r"<(?:article|main)[\s>]", page, re.I))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    inside, every = Counter(), Counter()
    for batch in batches:
        for page in batch["html"]:
            if page and _marks(page) == 1:
                names: Counter = Counter()
                for feature, _, count, content in elements(page, names=names):
                    size = count if feature[0] == "w" else 1
                    every[feature] += size
                    if content:
                        inside[feature] += size
                for (name, content), count in names.items():
                    every[f"f:{name}"] += count
                    inside[f"f:{name}"] += count * content
    yield pd.DataFrame([(f, float(inside[f]), float(n)) for f, n in every.items()], columns=["feature", "inside", "total"])


def _prior(feature: str) -> float:
    kind, name = feature.split(":", 1)
    if kind == "f":
        return _PRIOR["furniture"]
    if kind == "w":
        return _PRIOR.get(name, _PRIOR["text"])
    if name in INLINE or name in LEAF or name in ("math", "drawing"):
        return _PRIOR["inline"]
    return _PRIOR["block"] if name in ("li", "td", "tr", "th", "blockquote", "pre", "dd", "dt") else _PRIOR["container"]


def weight(feature: str, inside: float = 0.0, total: float = 0.0) -> float:
    """Log odds of the content, words of plain blocks above zero, all else below; kept in
    narrow bounds, so that a short paragraph outweighs an advert's tags before it. The odds
    of a furniture name have no bounds: above zero its words are those of plain blocks."""
    prior = _prior(feature)
    odds = float(np.log((inside + PRIOR_ROWS * prior) / (total - inside + PRIOR_ROWS * (1 - prior))))
    if feature[0] == "f":
        return odds
    if feature in ("w:furniture", "w:link"):
        return min(max(odds, -0.3), -0.2)
    return min(max(odds, 0.3), 2.0) if feature[0] == "w" else min(max(odds, -1.0), -0.1)


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights by feature, counted over all labelled pages; a few dozen rows are collected."""
    parts = whole_texts(pages).select(F.col(html_col).cast("string").alias("html")).mapInPandas(_counted, "feature string, inside double, total double")
    rows = parts.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("total").alias("total")).collect()
    return {r["feature"]: weight(r["feature"], r["inside"], r["total"]) for r in rows}


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    harmless = frozenset(name[2:] for name, value in weights.items() if name[0] == "f" and value > 0)
    sequence, in_furniture = _parsed(page, harmless)
    marked = _is_marked(sequence, in_furniture)
    if in_furniture and not marked:
        sequence, _ = _elements(page, harmless, None, 0)
    best = total = 0.0
    start = first = end = 0
    for i, (feature, _, count, content) in enumerate(sequence):
        if marked:
            # the page says itself where its content begins and ends
            value = _OUTSIDE if not content else _INSIDE if feature[0] == "w" and feature != "w:furniture" else 0.0
        else:
            value = weights.get(feature)
            if value is None:
                value = weights[feature] = weight(feature)
        total += value * count if feature[0] == "w" else value
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, end = total, start, i + 1
    kept = [text for feature, text, _, _ in sequence[first:end] if feature != "w:furniture"]
    return " ".join("".join(kept).split())


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id>, <url>, text, n_chars`` for every row of ``pages``."""
    weights = learn_weights(pages, html_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = dict(weights)
        for batch in batches:
            texts = [main_text(page, own) for page in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    source = whole_texts(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = source.mapInPandas(run, "page_id long, url string, text string, n_chars long")
    return rows.withColumnsRenamed({"page_id": id_col, "url": url_col})
