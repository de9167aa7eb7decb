"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between the edges of block elements. Each block has the path
of its block elements from the root (with their classes; inline elements leave no trace). Blocks in
zones that are never article text (menus, headers, footers, asides, forms, scripts, styles, and
elements whose class, id or role says advert, notice, comment and the like) are out. For the other
paths the blocks' text length and punctuation are summed up, links count against them:

    ratio(path)       = text outside links / blocks
    punctuation(path) = punctuation marks / blocks
    score(path)       = ratio * log(1 + punctuation) * (1 - share of text in links)

Scores are smoothed along the page over neighbouring blocks, fused with the unsmoothed ones and cut
at a share of their mean weighted by text. The paths above it are content, wherever they stand. What
stands under the same element as one of them (up to the article or main element, if there is one)
belongs to the same text, so headings and one-word paragraphs stay; of the body as such an element
only its own children, unless it has most of the content. Paths that are mostly links are out.

References are decoded, white space inside a block becomes one space, blocks are joined by one
line break. Defined cases: a null or empty page, and one without text outside the zones, has the
text ''; broken markup is read as browsers do: unclosed elements end with what closes around them,
a paragraph ends where the next block begins, stray end tags and a tag cut off by the end of the
page are ignored. Equal rows give equal
results; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Score cut as a share of the mean score, and the weights of a block and its neighbours.
CUT = 0.2
#: Paths with a greater share of their text in links are link lists.
LINKED = 0.5
KERNEL = (0.25, 0.5, 0.25)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|</?[a-zA-Z][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?"
)
_MARKS = re.compile(r"[.,;:!?…。，；：！？]")

# Kinds of HTML elements.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style noscript template iframe textarea title xmp noembed".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q"
    " rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
OUTSIDE = frozenset(
    "head nav header footer aside form button select dialog menu svg canvas object audio video map"
    " fieldset script style noscript template iframe textarea title xmp noembed".split()
)
#: Words of a class, id or role that mark an element as no article text.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments"
    " consent contentinfo cookie cookies dialog disclaimer discuss disqus footer gdpr header login"
    " masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup"
    " promo promoted promotion recommended related replies reply respond search share sharing"
    " sidebar signup social sponsor sponsored subscribe tags teaser toc toolbar widget widgets"
    .split()
)
ARTICLE = frozenset("article main".split())
WHOLE = frozenset("html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end when one of the same set begins.
ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "body": ("head",),
}
STOPS = frozenset("ul ol dl table tbody thead tfoot article main section body html".split())


class _Element:
    __slots__ = ("tag", "name", "zone", "article")

    def __init__(self, tag: str, name: str, zone: int, article: bool):
        self.tag, self.name, self.zone, self.article = tag, name, zone, article


def _words(attributes: dict[str, str]) -> set[str]:
    named = " ".join(attributes.get(a, "") for a in ("class", "id", "role"))
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return (
        "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
        or "display:none" in style or "visibility:hidden" in style
    )


#: Zones: none, a header inside an article (of which headings stay), out.
_IN, _HEAD, _OUT = 0, 1, 2


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _opened(tag: str, raw: str, above: _Element) -> _Element:
    attributes = _attributes(raw)
    words = _words(attributes)
    if words & {"has", "with", "without", "no"}:  # says what stands inside, not what this is
        words = set()
    article = above.article or tag in ARTICLE or attributes.get("role") in ARTICLE
    zone = above.zone
    top = tag in ("html", "body") or (tag in ARTICLE and not above.article)
    if above.article and (tag == "header" or "header" in words) and tag not in HEADINGS:
        zone = max(zone, _HEAD)
    elif tag in OUTSIDE or _hidden(attributes) or (
        not top and tag not in HEADINGS and words & OUTSIDE_WORDS
    ):
        zone = _OUT
    elif zone == _HEAD and tag in HEADINGS:
        zone = _IN
    label = re.sub(r"\d+", "", attributes.get("class", "")).split()
    name = ".".join([tag, *sorted(label)])
    if attributes.get("role") in ARTICLE:
        name = "main:" + name
    return _Element(tag, name, zone, article)


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """``(path, text, letters in links)`` of the blocks outside the zones, in page order."""
    root = _Element("", "", _IN, False)
    stack = [root]
    parts: list[str] = []
    linked: list[str] = []
    links = 0
    at, end = 0, len(page)

    def settle():
        text = " ".join(html.unescape("".join(parts)).split())
        in_links = len(" ".join(html.unescape("".join(linked)).split()))
        parts.clear()
        linked.clear()
        if text and stack[-1].zone == _IN:
            yield tuple(e.name for e in stack[1:]), text, in_links

    def say(text: str) -> None:
        if stack[-1].zone == _IN:
            parts.append(text)
            if links:
                linked.append(text)

    hidden_inline = 0
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            if not hidden_inline:
                say(page[at:])
            break
        if found.start() > at and not hidden_inline:
            say(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        closing = bool(found["end"] or found["end2"])
        raw = found["attrs"] or found["attrs2"] or ""
        if tag in RAW and not closing:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                say(" ")
            elif tag == "span" and hidden_inline and not closing:
                hidden_inline += 1
            elif tag == "span" and hidden_inline:
                hidden_inline -= 1
            elif tag == "span" and raw and not closing and _hidden(_attributes(raw)):
                hidden_inline = 1
            continue
        yield from settle()
        links = hidden_inline = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        if stack[-1].tag == "p" or (stack[-1].tag in HEADINGS and tag in HEADINGS):
            stack.pop()
        ended = ENDED_BY.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ended:
                del stack[i:]
                break
            if stack[i].tag in STOPS:
                break
        if not raw.rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append(_opened(tag, raw, stack[-1]))
    yield from settle()


def path_scores(found: list[tuple[tuple[str, ...], str, int]]) -> list[float]:
    """Fused score per block: that of its path, and the same smoothed along the page."""
    size, marks, in_links, count = (defaultdict(int) for _ in range(4))
    for path, text, linked in found:
        size[path] += len(text)
        marks[path] += len(_MARKS.findall(text))
        in_links[path] += linked
        count[path] += 1
    score = {
        p: (size[p] - in_links[p]) / n * math.log1p(marks[p] / n) * (1 - in_links[p] / size[p])
        for p, n in count.items()
    }
    own = [score[p] for p, _, _ in found]
    wide = [own[0], *own, own[-1]]
    smooth = [
        sum(w * x for w, x in zip(KERNEL, wide[i : i + 3], strict=True)) for i in range(len(own))
    ]
    return [(a + b) / 2 for a, b in zip(own, smooth, strict=True)]


def _container(path: tuple[str, ...]) -> tuple[str, ...]:
    for i, name in enumerate(path):
        if name.split(".")[0] in ARTICLE or name.startswith("main:"):
            return path[: i + 1]
    return path[:-1]


def main_text(page: str | None) -> str:
    found = list(blocks(page or ""))
    if not found:
        return ""
    scores = path_scores(found)
    total = sum(len(text) for _, text, _ in found)
    mean = sum(s * len(text) for s, (_, text, _) in zip(scores, found, strict=True)) / total
    size, in_links = defaultdict(int), defaultdict(int)
    for path, text, linked in found:
        size[path] += len(text)
        in_links[path] += linked
    lists = {path for path, n in size.items() if in_links[path] > LINKED * n}
    content, weight = set(), defaultdict(float)
    for s, (path, text, linked) in zip(scores, found, strict=True):
        if s >= CUT * mean and (path not in lists or len(lists) == len(size)):
            content.add(path)
            weight[_container(path)] += len(text) - linked
    if not content:  # all text outside link lists lacks marks
        return "\n".join(text for path, text, _ in found if path not in lists)
    heaviest = max(weight, key=weight.get)

    def beside(path: tuple[str, ...]) -> bool:
        if path in lists:
            return False
        for n in range(1, len(path) + 1):
            if path[:n] in weight and (
                path[:n] == heaviest or n >= len(path) - 1
                or path[n - 1].split(".")[0] not in WHOLE
            ):
                return True
        return False

    kept = {path: path in content or beside(path) for path in size}
    return "\n".join(text for path, text, _ in found if kept[path])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def page_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(_read, "page_id bigint, url string, text string, n_chars bigint")
