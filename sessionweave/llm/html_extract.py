"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags, with the end tags that HTML lets pages leave out.  Pass one decides blocks by link
density, length and stop-word density: mostly linked text is boilerplate, enough words with enough stop words and few links are
text, the rest is ambiguous.  In pass two an ambiguous block inherits the label of its nearest decided neighbour; of two that are
as near, text wins.  Stop words are words of at most three letters: in any language that writes spaces the function words are
among the shortest, so no list of a language is needed.

Containers that the page itself marks as menus, headers, footers, sidebars, notices, adverts, forms or reader comments (by tag,
role or a whole name in its class or id) are left out, and their blocks are nobody's neighbours.  Such a mark is firm for tags, roles
and comments, and weak for forms and names, which pages also put around everything.  What is searched is the first of these
that holds a block decided as text: the marked articles (article, main); all blocks outside marked containers; articles within
weakly marked containers; what lies in one weakly marked container only.  Where none does, the first that holds any text.  Within an
article nothing is boilerplate but marked containers; with a decided article, nothing outside it is text.

Defined results: null html counts as empty; a page without text gives the empty string; text after an unclosed comment,
script or style is lost to it, as in browsers; a null page_id or url stays null; repeated rows are pages of their own; an empty
table gives no rows; other columns are ignored; no length is capped, and time is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrowtools import lean, slices, small_batches
from .common import table

# fixed values: tags that begin a block, that close an open p, whose content is not the page's text, that have no content
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSE_P = BLOCK_TAGS - frozenset("body head html legend option optgroup tbody td tfoot th thead tr".split())
RAW_TAGS = frozenset("canvas embed iframe noscript object script select style svg template textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an open tag of the first kind ends where one of the second begins, within the innermost container of the third
IMPLIED_ENDS = [("li", "li", "ul ol menu"), ("dd dt", "dd dt", "dl"), ("option", "option optgroup", "select"), ("td th", "td th tr tbody thead tfoot", "table"), ("tr", "tr tbody thead tfoot", "table"), ("thead tbody tfoot", "tbody thead tfoot", "table")]
FIRM_TAGS = frozenset("aside button dialog footer head menu nav search".split())
FIRM_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: names of containers, and words that may follow them in a name
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
WEAK_NAMES = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
TRAILERS = frozenset("area bar block body bottom box button buttons container content form group icons inner item items left link links list main outer panel placement right row section slot thread top unit wrap wrapper".split())
NOT_A_CONTAINER = frozenset("a b blockquote dd dt em figcaption figure font h1 h2 h3 h4 h5 h6 i li p pre small span strong td th tr u".split())
NEGATIONS = frozenset("has hide is no non not with without".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*)>?""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")

TEXT, BOILER, UNSURE = 1, -1, 0
LEAST_WORDS, STOP_LETTERS, LEAST_STOPS, MOST_LINKED, FEW_LINKED = 10, 3, 0.15, 0.5, 0.33
FIRM, WEAK = 1, 2


class Block:
    """Text of a block, how many of its characters are linked, the marked containers and the article around it."""

    __slots__ = ("text", "linked", "firm", "weak", "area", "label")

    def __init__(self, text: str, linked: int, firm: int, weak: int, area: Area | None):
        self.text, self.linked, self.firm, self.weak, self.area, self.label = text, linked, firm, weak, area, UNSURE


class Area:
    """An article or main part: the marked containers around it."""

    __slots__ = ("firm", "weak")

    def __init__(self, firm: int, weak: int):
        self.firm, self.weak = firm, weak


def mark_of_name(name: str, tag: str) -> int:
    """What a single name of a class or id says: a comment container is firm, one of the other kinds weak, else 0.

    A name is a container's if its last word is one (site-footer) or its first, followed by words for places and shapes only
    (sidebar-left); on paragraphs, figures, list items and the like only a name of that one word counts."""
    words = [w.lower() for w in _NAME.findall(name)]
    if not words or words[0] in NEGATIONS:
        return 0
    if tag in NOT_A_CONTAINER and len(words) > 1:
        return 0
    for names, mark in ((COMMENT_NAMES, FIRM), (WEAK_NAMES, WEAK)):
        if words[-1] in names or (words[0] in names and all(w in TRAILERS or w in names or w.isdigit() for w in words[1:])):
            return mark
    return 0


def _mark(tag: str, attributes: str, in_area: bool) -> int:
    if tag in FIRM_TAGS or (tag == "header" and not in_area):
        return FIRM
    out = WEAK if tag == "form" else 0
    if "=" in attributes and tag not in ("html", "body"):
        for name, a, b, c in _ATTR.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "role" and value.strip().lower() in FIRM_ROLES:
                return FIRM
            if name in ("class", "id"):
                for word in value.split():
                    got = mark_of_name(word, tag)
                    if got == FIRM or (got == WEAK and tag not in ("article", "main")):
                        out = got if got == FIRM else out or got
                if out == FIRM:
                    return FIRM
    return out


class _Open:
    """An open element: its tag, the marked containers down to it, its article, and whether it only holds back inline text."""

    __slots__ = ("tag", "firm", "weak", "area", "inline")

    def __init__(self, tag: str, firm: int, weak: int, area: Area | None, inline: bool):
        self.tag, self.firm, self.weak, self.area, self.inline = tag, firm, weak, area, inline


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    stack = [_Open("", 0, 0, None, False)]
    depth: dict[str, list[int]] = defaultdict(list)  # places of each tag in the stack
    parts: list[str] = []
    linked, link, at = 0, False, 0
    ends = {begin: [(old.split(), scope.split()) for old, new, scope in IMPLIED_ENDS if begin in new.split()] for _, new, _ in IMPLIED_ENDS for begin in new.split()}
    raw_end: dict[str, re.Pattern] = {}

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, linked, top.firm, top.weak, top.area))
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].inline:
            text = html.unescape(text)
            parts.append(text)
            if link:
                linked += len("".join(text.split()))

    def last(tags: list[str]) -> int:
        return max((depth[t][-1] for t in tags if depth[t]), default=0)

    def pop_to(k: int) -> None:
        if any(not e.inline for e in stack[k:]):
            close()
        while len(stack) > k:
            depth[stack.pop().tag].pop()

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            link = not m[1]
        block = tag in BLOCK_TAGS
        if block:
            close()
        if m[1]:
            k = last([tag])
            # an end tag has no effect beyond the table cell, or for inline tags the block, it stands in
            if k and k > (0 if tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else last(["td", "th"])):
                pop_to(k)
            continue
        if tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS:
            if not m[0].endswith("/>") or tag not in ("svg", "canvas", "embed", "object", "iframe"):
                end = raw_end.setdefault(tag, re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I)).search(page, at)
                at = end.end() if end else n
            continue
        if tag in CLOSE_P and depth["p"] and depth["p"][-1] > last(["td", "th"]):
            pop_to(depth["p"][-1])
        for old, scope in ends.get(tag, ()):
            if (k := last(old)) > last(scope):
                pop_to(k)
        top = stack[-1]
        mark = _mark(tag, m[3], top.area is not None)
        if not block and not mark and not top.inline:
            continue
        area = top.area
        if tag in ("article", "main") and mark != FIRM and (area is None or top.weak > area.weak):
            area = Area(top.firm, top.weak)
        depth[tag].append(len(stack))
        stack.append(_Open(tag, top.firm + (mark == FIRM), top.weak + (mark == WEAK), area, not block))
    close()
    return out


def first_pass(b: Block) -> int:
    """Label by link density, length and stop-word density.  Within an article links make nothing boilerplate."""
    density = 0.0 if b.area else b.linked / max(1, len("".join(b.text.split())))
    if density > MOST_LINKED:
        return BOILER
    words = _LETTERS.findall(b.text)
    if len(words) >= LEAST_WORDS and density <= FEW_LINKED and sum(len(w) <= STOP_LETTERS for w in words) >= LEAST_STOPS * len(words):
        return TEXT
    return UNSURE


def second_pass(found: list[Block]) -> list[bool]:
    """Which blocks are text: ambiguous ones inherit from the nearest decided one; without any, they are text."""
    n = len(found)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for order in (range(n), range(n - 1, -1, -1)):
        last: int | None = None
        for i in order:
            if found[i].label != UNSURE:
                last = i
            elif last is not None:
                near[i].append((abs(i - last), -found[last].label))
    return [b.label == TEXT or (b.label == UNSURE and (not near[i] or -min(near[i])[1] == TEXT)) for i, b in enumerate(found)]


def candidates(found: list[Block]) -> Iterator[list[Block]]:
    """Sets of blocks that may hold the main text, the best marked first."""
    inside = [b for b in found if b.area and b.firm == b.area.firm and b.weak == b.area.weak]
    yield [b for b in inside if b.area.firm == b.area.weak == 0]
    yield [b for b in found if b.firm == b.weak == 0]
    yield [b for b in inside if b.area.firm == 0]
    yield [b for b in found if b.firm == 0 and b.weak <= 1]


def extract(page: str) -> str:
    found = blocks(page)
    for b in found:
        b.label = first_pass(b)
    sets = list(candidates(found))
    main = next((s for s in sets if any(b.label == TEXT for b in s)), None) or next((s for s in sets if s), [])
    return "\n".join(b.text for b, keep in zip(main, second_pass(main), strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages(page_id, url, html)."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                texts = [extract(h or "") for h in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(lean(run), f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
