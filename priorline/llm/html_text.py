"""Main text of web pages by tag-path ratios.

A page is cut into blocks (the text between two block-level tags), each with its root-to-leaf path of
block-level tags with their class and id. Over all blocks of a path, text length and punctuation outside links
are summed and divided by the number of blocks; both ratios, smoothed over the page's order by a Gaussian
kernel, are multiplied. A path with an element whose class, id or role says what articles don't have
(navigation, advert, comments and such) counts UNLIKELY times its ratio, one within an article or main element
LIKELY times: names tip the scales where lengths are near each other, but where such a path has the page's text, it
is the text. Paths above a part of the scores' standard deviation are content. The smallest element that holds
nearly all content is the article: its blocks are kept in page order, short ones as headings and list items
too, but for unlikely paths below the threshold; so are content paths elsewhere that are as strong as the
article's. A path that names make unlikely never stands beside an article without such names, so comments go
however long they are; where a page has one article or main element, nothing outside is as strong. Sections beside
the article that open with a heading of its own kind and have text under it belong to it. What by its tag alone is no article
text (scripts, styles, forms, nav, footer, aside) is dropped while the page is cut, as are hidden elements; a form around
an article, or around most of the page, is not: only its controls go.

Defined cases: null html is empty, and an empty page gives an empty text; markup that breaks off is
dropped; tags that are never closed end with their parents; very long pages are read once from left to
right; rows that repeat stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as html_entities
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import release_memory

# Fixed values of HTML: elements that start a block, that have no content, whose content is no markup, and
# which open elements a start tag ends.
BLOCKS = frozenset(
    "address article aside blockquote body br_ button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup "
    "option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes template svg math".split())
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
SCOPES = frozenset("table ul ol dl article section div main body html td th blockquote".split())
#: Elements that are never article text, and words in class, id or role that tell of what is none.
NEVER = frozenset(
    "nav header footer aside form button select option optgroup fieldset legend dialog head menu object iframe noscript label input "
    "textarea canvas audio video datalist".split()
)
UNLIKELY_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead topbar foot footer footnav sidebar aside widget widgets related recommended recommendations cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing "
    "social comment comments commentlist disqus reply replies responses discussion form search pagination pager paging toolbar copyright "
    "skip hidden contentinfo complementary".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Kernel width in blocks; part of the standard deviation; share of content text in the article element.
SIGMA, PART, SHARE = 1.0, 0.25, 0.9
#: A form with this part of a page's length is around the page; so much of a section's text may be links.
AROUND, LINKED = 0.5, 0.3
#: What a path's ratio is multiplied by where a name on it tells of no article, and where the tags tell of one.
UNLIKELY, LIKELY = 0.02, 4.0
#: What counts as punctuation where a path has none; a path elsewhere is kept from this part of the best score on.
LEAST_MARKS, AS_STRONG = 0.1, 0.5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ARTICLE = re.compile(r"<(?:article|main|h1)\b", re.I)
_FORM_END = re.compile(r"</form\b", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def _is_hidden(attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _names(attributes: str) -> tuple[str, ...]:
    """The class names, id and role of a start tag."""
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            found += "".join(values).split()
    return tuple(found)


@lru_cache(maxsize=4096)
def _unlikely(names: tuple[str, ...]) -> bool:
    for token in names:
        parts = {w.lower() for w in _WORDS.findall(token)}
        if parts & UNLIKELY_WORDS and not parts & {"no", "has", "with", "without"}:
            return True
    return False


def _is_around(page: str, at: int) -> bool:
    """Whether the form that starts before ``at`` is around an article, or around most of the page."""
    end = _FORM_END.search(page, at)
    stop = end.start() if end else len(page)
    return stop - at >= AROUND * len(page) or _ARTICLE.search(page, at, stop) is not None


class _Element:
    """An open element: its tag, number and names, and whether it or one around it is no article text, or unlikely to be."""

    __slots__ = ("tag", "number", "names", "aside", "unlikely")

    def __init__(self, tag: str, number: int, names: tuple[str, ...], aside: bool, unlikely: bool) -> None:
        self.tag, self.number, self.names, self.aside, self.unlikely = tag, number, names, aside, unlikely


class _Block:
    __slots__ = ("path", "chain", "text", "links", "weight")

    def __init__(self, stack: list[_Element], text: str, links: int) -> None:
        around = [x for x in stack if x.tag in BLOCKS]
        self.path = tuple((x.tag, x.names) for x in around)
        self.chain = tuple(x.number for x in around)
        self.text, self.links = text, links
        self.weight = (UNLIKELY if stack and stack[-1].unlikely else 1.0) * (LIKELY if any(x.tag in ("article", "main") for x in around) else 1.0)


def blocks_of(page: str) -> list[_Block]:
    """The page's blocks in order, without those that have no text or that by a tag around them are no article text."""
    stack: list[_Element] = []
    found: list[_Block] = []
    parts: list[str] = []
    linked = 0
    number = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_entities.unescape("".join(parts)).split())
            if text and not (stack and stack[-1].aside):
                found.append(_Block(stack, text, linked))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        if any(x.tag in BLOCKS or x.aside for x in stack[depth:]):
            close_block()
        del stack[depth:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        raw = page[at : m.start()] if m else page[at:]
        if raw:
            parts.append(raw)
            if any(x.tag == "a" for x in stack):
                linked += len(raw)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[6] or "").lower()
        if not tag:
            continue
        if m[1] or m[5]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if depth is not None:
                pop_to(depth)
            elif tag == "p":
                close_block()
            continue
        attributes = m[3] or m[7] or ""
        if tag in RAW:
            if tag == "noscript" or not attributes.endswith("/"):
                end = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else n
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            if tag in ENDS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in ENDS[tag]:
                        pop_to(k)
                        break
                    if stack[k].tag in SCOPES and stack[k].tag not in ("td", "th"):
                        break
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == "p":
                        pop_to(k)
                        break
                    if stack[k].tag in SCOPES:
                        break
            close_block()
        if tag in VOID:
            continue
        inside = bool(stack) and stack[-1].aside
        names = _names(attributes) if attributes else ()
        never = tag in NEVER and not (tag == "form" and not inside and _is_around(page, at))
        aside = inside or never or bool(attributes and _is_hidden(attributes))
        if tag in HEADINGS and inside and any(x.tag == "article" for x in stack) and [x.tag for x in stack if x.tag in NEVER] == ["header"]:
            aside = False  # a heading in the header of an article
        if aside and not inside:
            close_block()
        if not attributes.endswith("/") or tag in BLOCKS:
            number += 1
            whole = tag in ("html", "body", "main", "article")  # what these say of themselves concerns the page
            whole = whole or (tag == "form" and not aside)
            unlikely = (bool(stack) and stack[-1].unlikely) or (not whole and _unlikely(names))
            stack.append(_Element(tag, number, names, aside, unlikely))
    close_block()
    return found


def _smooth(values: list[float]) -> list[float]:
    reach = int(3 * SIGMA)
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(values[i + k], kernel[k + reach]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def path_scores(blocks: list[_Block]) -> dict[tuple, float]:
    """For each path the mean over its blocks of smoothed text ratio times smoothed punctuation ratio, weighed."""
    sums: dict[tuple, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        s[0] += max(0, len(b.text) - b.links)
        s[1] += len(_PUNCTUATION.findall(b.text)) if b.links < len(b.text) else 0
        s[2] += 1
    lengths = _smooth([b.weight * sums[b.path][0] / sums[b.path][2] for b in blocks])
    marks = _smooth([sums[b.path][1] / sums[b.path][2] for b in blocks])
    scores: dict[tuple, list[float]] = {}
    for b, x, y in zip(blocks, lengths, marks, strict=True):
        own = b.weight * sums[b.path][0] / sums[b.path][2]
        # A path can gain no more by its neighbours than its own length: smoothing closes gaps in an article, and
        # lifts nothing short beside it.
        scores.setdefault(b.path, []).append(min(x, 2 * own) * (y + LEAST_MARKS))
    return {p: sum(v) / len(v) for p, v in scores.items()}


def main_text(page: str) -> str:
    """The article's blocks, joined by two line feeds; empty if there are none."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    scores = path_scores(blocks)
    each = [scores[b.path] for b in blocks]
    mean = sum(each) / len(each)
    threshold = PART * math.sqrt(sum((x - mean) ** 2 for x in each) / len(each))
    strong = [b for b in blocks if scores[b.path] >= threshold and scores[b.path] > 0]
    # The article: the innermost element with SHARE of what all content paths weigh.
    weight: dict[int, float] = {}
    total = 0.0
    for b in strong:
        size = b.weight * max(1, len(b.text) - b.links)
        total += size
        for number in b.chain[:-1] or b.chain:  # a block's own element is no article
            weight[number] = weight.get(number, 0) + size
    inner = max((k for k, w in weight.items() if w >= SHARE * total), default=None)
    best = max((scores[b.path] for b in strong), default=0.0)
    plain = any(b.weight >= 1 for b in strong)
    alone = _only_article(blocks)
    more = _sections_beside(blocks, inner) if inner is not None else set()
    kept = []
    for b in blocks:
        score = scores[b.path]
        if alone is not None and alone not in b.chain:
            continue
        if inner is None and b.links >= len(b.text):  # no element holds the text: what is a link alone is a menu's
            continue
        inside = inner is None or inner in b.chain
        as_strong = score > 0 and score >= AS_STRONG * best
        if b.weight >= 1:
            if inside or as_strong or more.intersection(b.chain):
                kept.append(b.text)
        elif not plain and ((inside and score >= threshold) or as_strong):
            kept.append(b.text)
    return "\n\n".join(kept)


def _only_article(blocks: list[_Block]) -> int | None:
    """The page's only article element, or else its only main element, if it has text that no name makes unlikely."""
    for tag in ("article", "main"):
        found = {next(n for n, (t, _) in zip(b.chain, b.path, strict=True) if t == tag): b for b in blocks if any(t == tag for t, _ in b.path)}
        if len(found) == 1:
            number = next(iter(found))
            if any(number in b.chain and b.weight >= 1 for b in blocks):
                return number
            return None
        if found:
            return None
    return None


def _sections_beside(blocks: list[_Block], inner: int) -> set[int]:
    """Elements of the same parent as ``inner`` and of its kind that open with the same kind of heading and have text."""
    within = [b for b in blocks if inner in b.chain]
    depth = within[0].chain.index(inner)
    kind, parent = within[0].path[depth][0], within[0].chain[:depth]
    heading = within[0].path[-1][0]
    if heading not in HEADINGS or not parent:
        return set()
    sections: dict[int, list[_Block]] = {}
    for b in blocks:
        if len(b.chain) > depth and b.chain[:depth] == parent and b.chain[depth] != inner and b.path[depth][0] == kind:
            sections.setdefault(b.chain[depth], []).append(b)
    out = set()
    for number, own in sections.items():
        text = sum(len(b.text) for b in own[1:])
        marks = any(_PUNCTUATION.search(b.text) for b in own[1:])
        if own[0].path[-1][0] == heading and all(b.weight >= 1 for b in own) and text and marks and sum(b.links for b in own[1:]) <= LINKED * text:
            out.add(number)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])
        release_memory()

    ids = F.col("page_id").cast("long").alias("page_id")
    return pages.select(ids, F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
