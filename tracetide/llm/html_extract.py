"""Main text of web pages: the contiguous part of a page with the highest sum of scores.

A page is a row of tags and runs of words. Words score above zero, tags below, and words in links or under side names
(tags like nav, parts of class names like menu) lower; one linear scan finds the best contiguous region. All weights are
log-odds counted over labelled pages, those whose own markup names one article; a side name that encloses articles there
is no side matter. Side blocks inside the region are left out only where their own score is below zero. Every labelled
page is also counted with its article markup hidden, so pages without it get weights of their own.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.common import chunks, table

#: Labelled pages that weights are counted on, and the longest of them; picked by a hash of the id.
SAMPLE_PAGES = 2000
SAMPLE_CHARS = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object", "canvas"}
_SIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr",
}
_SIDE_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "popup", "promo", "promotion", "related", "respond", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
_PAGE = {"html", "body", "article", "main"}


#: First parts of a class name that only speak of side matter elsewhere: has-sidebar, no-menu.
_ABOUT = {"has", "with", "without", "no", "not", "is", "hide", "show"}
#: An element with this share of a page's words is the page itself, whatever its class; tags that never hold one are left out.
_WRAPS = 0.9
_NEVER_WRAP = {"nav", "footer", "aside", "menu", "button", "head"}
#: Article markup is believed where it holds this share of the words outside side matter.
_TRUSTED = 0.5


@dataclass(frozen=True)
class Event:
    """A tag (words = 0) or a run of words.

    `zone` of words is content, outer, plain, link or side; that of a tag is side or empty. `side` are the side names above
    it, each with the place of the outermost element of that name among the events.
    """

    name: str
    words: int
    zone: str
    text: str
    breaks: bool
    side: tuple[tuple[str, int], ...] = ()


def _side_name(tag: str, attributes: str) -> str:
    """The side name of an element: its tag, or a part of its class, id or role; empty without one."""
    if tag in _SIDE:
        return tag
    if tag in _PAGE or "=" not in attributes:
        return ""
    for values in _NAMED.findall(attributes):
        for name in "".join(values).split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if parts and parts[0] not in _ABOUT:
                for p in parts:
                    if p in _SIDE_NAMES:
                        return p
    return ""


@dataclass
class _Element:
    """An element with a side name: the one above it, where it opens, and how many words come before it and up to its end."""

    name: str
    tag: str
    above: _Element | None
    origin: int
    first: int
    last: int = -1
    side: tuple[tuple[str, int], ...] = ()


def events(page: str, marked: bool = True) -> list[Event]:
    """Tags and word runs of a page in order, in time linear in the page.

    `marked`: use article and main elements where the page has them and they hold most of its words.
    """
    # name, words, text, breaks, side element, raw content, place of the article around it or -1, in a link
    found: list[tuple[str, int, str, bool, _Element | None, bool, int, bool]] = []
    stack: list[tuple[str, _Element | None]] = []
    under: list[_Element] = []
    named: list[_Element] = []
    opened: dict[str, int] = {}
    inner = link = words = articles = 0
    article = -1
    at = 0

    def run(text: str) -> None:
        nonlocal words
        text = html.unescape(text) if "&" in text else text
        n = len(text.split())
        if n or (text and found):
            words += n
            found.append(("", n, text, False, under[-1] if under else None, False, article, link > 0))

    def shut(tag: str) -> None:
        """Close the last open element of this name and all inside it; nothing if none is open."""
        nonlocal inner, link, article
        if not opened.get(tag):
            return
        while True:
            name, element = stack.pop()
            opened[name] -= 1
            inner -= name in ("article", "main")
            link -= name == "a"
            article = article if inner else -1
            if element is not None:
                under.pop()
                element.last = words
            if name == tag:
                return

    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            run(page[at:])
            break
        match = _TOKEN.match(page, begin)
        if match is None:  # a bare < is text
            stop = page.find("<", begin + 1)
            stop = len(page) if stop < 0 else stop
            run(page[at:stop])
            at = stop
            continue
        if begin > at:
            run(page[at:begin])
        at = match.end()
        tag = match["tag"]
        if tag is None or not match["end"]:  # comment, declaration, or a tag that the page breaks off in
            continue
        tag = tag.lower()
        element, edge = under[-1] if under else None, False
        if match["close"]:
            shut(tag)
            edge = True
        elif tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            edge = True
        elif tag not in _VOID and not match["attributes"].endswith("/"):
            name = _side_name(tag, match["attributes"])
            if name == "header" and tag == "header" and inner:
                name = "article header"
            if name:
                element = _Element(name, tag, element, len(found), words)
                under.append(element)
                named.append(element)
            stack.append((tag, element if name else None))
            opened[tag] = opened.get(tag, 0) + 1
            if tag in ("article", "main"):
                article, articles = article if inner else len(found), articles + (not inner)
                inner += 1
            link += tag == "a"
        found.append((tag, 0, " " if tag in ("br", "wbr") else "", tag not in _INLINE, element, edge and tag in _RAW, article, link > 0))
    for element in under:
        element.last = words

    # names of the elements around, but for those that are the page itself; there are no more than side names
    for element in named:
        element.side = element.above.side if element.above else ()
        wraps = element.last - element.first >= _WRAPS * words and element.tag not in _NEVER_WRAP
        if not wraps and element.name not in dict(element.side):
            element.side += ((element.name, element.origin),)

    def open_text(element: _Element | None, inside: int) -> bool:
        """Not in side matter; side names around a page's only article say nothing against it."""
        return not element or all(articles == 1 and origin < inside for _, origin in element.side)

    plain = sum(n for _, n, _, _, e, _, i, _ in found if n and open_text(e, i))
    held = sum(n for _, n, _, _, e, _, i, _ in found if n and i >= 0 and open_text(e, i))
    trusted = marked and held > 0 and held >= _TRUSTED * plain
    out = []
    for name, n, text, breaks, element, raw, inside, linked in found:
        names = element.side if element else ()
        if names and trusted and articles == 1:
            names = tuple(x for x in names if x[1] > inside)
        if names or raw:
            zone = "side"
        elif name:
            zone = ""
        elif trusted:
            zone = "content" if inside >= 0 else "outer"
        else:
            zone = "link" if linked else "plain"
        out.append(Event(name, n, zone, text, breaks, names))
    return out


@dataclass(frozen=True)
class Weights:
    """Scores of a word by zone and of a tag by name; `tag` is that of names not seen."""

    words: dict[str, float]
    tags: dict[str, float]
    tag: float

    def side(self, event: Event) -> float:
        """The lowest score of the side names around."""
        return min((self.words[f"side:{name}"] for name, _ in event.side), default=_SIDE_RANGE[0])

    def of(self, event: Event) -> float:
        if event.words:
            return event.words * (self.side(event) if event.zone == "side" else self.words[event.zone])
        if event.zone == "side" and not self.shown(event):
            return 0.0
        return self.tags.get(event.name, self.tag) if event.name else 0.0

    def shown(self, event: Event) -> bool:
        """Whether words under side names count as text; those of other zones do, but for what lies outside a named article."""
        return self.side(event) > 0 if event.zone == "side" else event.zone != "outer"


#: Counts that stand in for pages not seen: zone -> (inside, outside). Side names have those of `side`.
_PRIOR = {"content": (50, 1), "outer": (1, 50), "plain": (50, 10), "link": (5, 10)}
_SIDE_PRIOR = {"side": (1, 10), "side:article header": (10, 1), "side:form": (1, 3)}
_RANGE = {"content": (0.5, 3.0), "outer": (-3.0, -1.0), "plain": (0.5, 3.0), "link": (-1.0, 0.3)}
#: Side matter is left out of the region by its sign alone: its words count for little, so that it does not part a text.
_SIDE_RANGE = (-0.05, 3.0)
_TAG_RANGE = (-1.0, -0.05)


def weigh(counts: dict[tuple[str, str], tuple[int, int]]) -> Weights:
    """Weights from counts of (kind, name) -> (inside, outside) the article: log-odds within the range of their kind."""

    def odds(inside: float, outside: float, low: float, high: float) -> float:
        return min(high, max(low, math.log(inside / outside)))

    words = {}
    for zone, (a, b) in _PRIOR.items():
        x, y = counts.get(("word", zone), (0, 0))
        words[zone] = odds(x + a, y + b, *_RANGE[zone])
    names = {"article header", *_SIDE, *_SIDE_NAMES}
    for zone in sorted({f"side:{n}" for n in names}):
        a, b = _SIDE_PRIOR.get(zone, _SIDE_PRIOR["side"])
        x, y = counts.get(("word", zone), (0, 0))
        words[zone] = odds(x + a, y + b, *_SIDE_RANGE)
    tags = {n: odds(x + 1, y + 2, *_TAG_RANGE) for (kind, n), (x, y) in counts.items() if kind == "tag"}
    return Weights(words, tags, odds(1, 2, *_TAG_RANGE))


def label_counts(page: str) -> Counter[tuple[str, str, bool]]:
    """(kind, name, inside) counts of one labelled page: once with its article markup and once with that hidden.

    A side name tells by the elements that hold the whole article, or stand outside of it; side matter within an article
    says nothing of its name. A page whose article markup does not hold most of its words counts for nothing.
    """
    out: Counter[tuple[str, str, bool]] = Counter()
    shown = events(page)
    if not any(e.zone in ("content", "outer") for e in shown):
        return out
    hidden = events(page, marked=False)
    depth, begin = 0, 0
    inside = []
    for k, e in enumerate(hidden):
        if e.name == "article":  # opening and closing tags alternate on a page with one article
            depth, begin = depth + 1, k if depth == 0 else begin
        inside.append(depth == 1 and e.name != "article")
    for row in (hidden, shown):
        for e, within in zip(row, inside, strict=True):
            if e.words and e.side:
                for name, origin in e.side if row is hidden else ():
                    if not within or origin < begin:
                        out["word", f"side:{name}", within] += e.words
            elif e.words:
                out["word", e.zone, within] += e.words
            elif e.name and not e.zone and row is hidden and e.name != "article":
                out["tag", e.name, within] += 1
    return out


def best_region(row: list[Event], weights: Weights) -> tuple[int, int]:
    """First and one past the last event of the part with the highest sum above zero; (0, 0) if there is none."""
    best = total = 0.0
    begin = 0
    found = (0, 0)
    for k, event in enumerate(row):
        if total <= 0:
            total, begin = 0.0, k
        total += weights.of(event)
        if total > best:
            best, found = total, (begin, k + 1)
    return found


def extract(page: str | None, weights: Weights) -> str:
    """The main text: blocks of the best region, white space inside a block made one space, two line breaks between."""
    if not page:
        return ""
    row = events(page)
    begin, end = best_region(row, weights)
    blocks, block = [], []
    for e in row[begin:end]:
        if e.breaks:
            blocks.append("".join(block))
            block = []
        elif weights.shown(e):
            block.append(e.text)
    blocks.append("".join(block))
    clean = (" ".join(b.split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from a bounded sample of pages with exactly one article element."""
    one = F.regexp_count(F.lower("html"), F.lit(r"<article[\s>]")) == 1
    one = one & (F.regexp_count(F.lower("html"), F.lit(r"</article\s*>")) == 1) & (F.length("html") <= SAMPLE_CHARS)
    # ids alone are ranked, and every labelled page below the cut is read
    ids = pages.where(one).select(F.xxhash64("page_id", "url").alias("rank")).orderBy("rank").limit(sample_pages)
    cut = ids.agg(F.max("rank")).first()[0]
    if cut is None:
        return weigh({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, str, bool]] = Counter()
        for batch in chunks(batches, 0):
            for page in batch.column(0).to_pylist():
                total += label_counts(page)
        rows = [(*k, n) for k, n in sorted(total.items())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "name", "inside", "n"])

    sample = pages.where(one & (F.xxhash64("page_id", "url") <= cut)).select(F.col("html").cast("string"))
    rows = sample.mapInArrow(count, "kind string, name string, inside boolean, n long")
    sums = rows.groupBy("kind", "name").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b")
    )
    # tag names are free text, so only the most frequent ones are kept apart; the rest share the weight of unseen names
    top = sums.orderBy(F.desc(F.col("a") + F.col("b")), "kind", "name").limit(500).collect()
    return weigh({(r["kind"], r["name"]): (r["a"], r["b"]) for r in top})


def extracted(pages: DataFrame, weights: Weights, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep` of `pages` with text and n_chars.

    Null or empty html, or a page without words, gives empty text. Equal rows give equal results, an empty table gives an
    empty one; columns of `pages` that are not kept may have any names. The time for a page is linear in its length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in chunks(batches, len(keep)):
            texts = [extract(p, own) for p in batch.column(len(keep)).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "text", "n_chars"])

    slim = pages.select(*keep, F.col("html").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(work, f"{fields}, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, train(pages))
