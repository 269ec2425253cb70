"""The main text of a page by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides what its own signs decide: blocks of navigation,
adverts and the like by their container, lists of links by link density, prose by its length and its density of stop words.
Short blocks and those between the thresholds stay open; the second pass gives each the label of the nearest decided neighbour.
After Pomikálek, "Removing Boilerplate and Duplicate Content from Web Corpora" (2011), with the containers of HTML 5.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.llm.common import text_bytes, unused

LONG_CHARS, STOP_LOW, LINKS_HIGH = 140, 0.12, 0.5

STOP_WORDS = frozenset(
    "the of and to in a is that it for was on as with be by at this are from or an not have but which you were "
    "le la les de des du et en un une que qui est pour dans pas sur au aux plus ce il elle ne se son sa par avec "
    "der die das und ist nicht ein eine zu den dem mit von auf für im sich als auch an es werden aus bei nach "
    "el los las y que se del al lo por con para una no su es como más pero o sus".split()
)

#: What is in them is text up to the closing tag, or to the page's end without one.
RAW = "script|style|textarea|title|iframe|noframes|noembed|xmp"
#: What is in them is left out, too, if they are closed; svg and math may close themselves.
EMBEDDED = "svg|math|noscript|template|object|canvas|audio|video"
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article aside blockquote body button dd details dialog div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header html label li main menu nav ol p search section select span table td th tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their start ends one of the same kind that is open right above.
ENDS_ITSELF = frozenset("p li dd dt td th tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav aside footer menu dialog select button fieldset search datalist".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay disclaimer comment comments "
    "commentlist disqus respond reply replies share sharing social related recommended recommendations widget widgets toolbar pagination pager login".split()
)
HEADER_NAMES = frozenset("header topbar".split())
#: What of these names holds an article is a list of other ones.
TEASER_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion related recommended recommendations widget widgets".split())
#: In a name, these say what a part has or lacks or how it is switched, not what it is: has-sidebar, no-nav, related-on.
NO_SIGNS = frozenset("has with without no on off enabled disabled open closed".split())
#: How firmly a part is set apart: by names that an article's wrapper may have, by others, or as it isn't shown.
BY_NAME, FIRMLY, HIDDEN = 1, 2, 3
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies".split())

_NODE = re.compile(
    rf"(?P<skip><!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z))"
    rf"|<(?P<embedded>{EMBEDDED})(?=[\s/>])(?P<inside>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in EMBEDDED.split("|")}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Block:
    __slots__ = ("apart", "chars", "form", "heading", "link_chars", "main", "text", "words")

    def __init__(self, text: str, link_chars: int, apart: bool, main: int, heading: bool, form: int) -> None:
        self.form = form
        self.text, self.chars, self.link_chars, self.apart, self.main, self.heading = text, len(text), link_chars, apart, main, heading
        self.words = text.split(" ")


def _named(tag: str, attribute: str, value: str, main: int) -> int:
    """How firmly the names of a class or an id set a part apart."""
    if attribute == "id" and tag in HEADINGS:  # an anchor's name, after the heading's words
        return 0
    wanted = APART_NAMES if main else APART_NAMES | HEADER_NAMES
    if tag in ("article", "main") or attribute == "id" and tag == "section" and main:
        wanted = COMMENT_NAMES
    names: set[str] = set()
    for token in value.split():
        parts = {x.lower() for x in _NAME.findall(token)}
        if not parts & NO_SIGNS and (attribute == "class" or tag != "section" or parts <= APART_NAMES | HEADER_NAMES):
            names |= parts | {token.lower()}
    return FIRMLY if names & wanted & (COMMENT_NAMES | TEASER_NAMES) else BY_NAME if names & wanted else 0


def _signs(tag: str, more: str, main: int) -> tuple[int, bool]:
    """(apart, main) that a tag starts, by itself. Forms are left to :func:`labels`."""
    apart, begins = FIRMLY if tag in APART or tag == "header" and not main else 0, tag in ("article", "main")
    if more and "=" in more or "hidden" in more:
        for m in _ATTRIBUTE.finditer(more):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                if value.lower() in APART_ROLES and not (tag == "form" and value.lower() == "form"):
                    apart = max(apart, FIRMLY)
                begins |= value.lower() in ("main", "article")
            elif name == "itemprop":
                begins |= value == "articleBody"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                apart = HIDDEN
            elif name in ("class", "id") and tag not in ("html", "body"):
                apart = max(apart, _named(tag, name, value, main))
    return apart, begins


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, with character references decoded and white space as single spaces."""
    found: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # open containers: tag, apart, numbers of the main part and the form it is in
    apart, main, mains, form, forms, link, heading = 0, 0, 0, 0, 0, 0, False
    open_tags: Counter = Counter()
    parts: list[str] = []
    link_chars = 0

    def close() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append(Block(text, min(link_chars, len(text)), bool(apart), main, heading, form))
            parts.clear()
        link_chars = 0

    at, unclosed = 0, set()
    while m := _NODE.match(html, at):
        at = m.end()
        if (text := m["text"]) is not None:
            parts.append(text)
            if link:
                link_chars += len(text.strip())
            continue
        if m["skip"] is not None:
            if (m["raw"] or "").lower() in ("textarea", "iframe", "title"):
                close()
            continue
        if m["embedded"]:
            name = m["embedded"].lower()
            if name not in unclosed and not (name in ("svg", "math") and m["inside"].endswith("/")):
                if closed := _CLOSED[name].search(html, at):
                    at = closed.end()
                else:  # nor is any later one
                    unclosed.add(name)
            continue
        tag = (m["tag"] or m["tag2"]).lower()
        ends = (m["end"] if m["tag"] else m["end2"]) == "/"
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            link = 0 if ends else 1
            continue
        if tag in BLOCK or tag == "button":
            close()
            heading = tag in HEADINGS and not ends
            link = 0 if tag not in ("p", "div", "li") or ends else link
        if tag not in CONTAINER or tag in VOID:
            continue
        if ends:
            if open_tags[tag]:
                while True:
                    ended = stack.pop()[0]
                    open_tags[ended] -= 1
                    if ended == tag:
                        break
                if tag not in BLOCK:
                    close() if (stack[-1][1] if stack else 0) != apart else None
                apart, main, form = stack[-1][1:] if stack else (0, 0, 0)
            continue
        if tag in ENDS_ITSELF and stack and stack[-1][0] == tag:
            open_tags[stack.pop()[0]] -= 1
            apart, main, form = stack[-1][1:] if stack else (0, 0, 0)
        own, begins = _signs(tag, m["more"] or "", main)
        if own and not apart and tag not in BLOCK:
            close()
        if begins and not main:
            mains += 1
            main = mains
            # an article starts afresh in a wrapper that is set apart by its name; the page's main part in any that is shown
            if apart == BY_NAME or apart == FIRMLY and tag != "article":
                apart = 0
        if tag == "form" and not form:
            forms += 1
            form = forms
        apart = max(apart, own)
        stack.append((tag, apart, main, form))
        open_tags[tag] += 1
    close()
    return found


def labels(page: list[Block]) -> list[bool]:
    """For each block, whether it is main text."""
    stops = [sum(w.lower().strip(".,;:!?\"'()") in STOP_WORDS for w in b.words) / len(b.words) if b.chars >= LONG_CHARS and not b.apart else 0 for b in page]
    prose = [b.chars >= LONG_CHARS and not b.heading and s >= STOP_LOW and not b.apart and b.link_chars / b.chars <= LINKS_HIGH for b, s in zip(page, stops)]
    # a form around the page's text isn't set apart: one of several paragraphs, or of all that there are
    held = Counter(b.form for b, is_prose in zip(page, prose) if is_prose)
    for b in page:
        b.apart |= bool(b.form) and held[b.form] < 2 and not (held[b.form] and len(held) == 1)
    first = [False if b.apart or b.link_chars / b.chars > LINKS_HIGH else True if is_prose else None for b, is_prose in zip(page, prose)]
    has_main = any(b.main for b in page)
    out: list[bool] = []
    for b, label, before, after in zip(page, first, _decided(page, first), reversed(list(_decided(page[::-1], first[::-1])))):
        if label is None:
            label = _neighbour(b, before, after)
            if label is None:  # nothing near it is decided
                label = bool(b.main) or not has_main
        out.append(label)
    return out


def _decided(page: list[Block], first: list[bool | None]) -> Iterator[tuple[int, bool] | None]:
    """For each block, the nearest decided one before it in the same part of the page: (characters between, label). What is
    set apart by its container says nothing about what is outside it."""
    near: tuple[int, bool] | None = None
    part = None
    for b, label in zip(page, first):
        if b.main != part:
            near, part = None, b.main
        yield near
        if label is not None and not b.apart:
            near = 0, label
        elif near is not None:
            near = near[0] + b.chars, near[1]


def _neighbour(b: Block, before: tuple[int, bool] | None, after: tuple[int, bool] | None) -> bool | None:
    """The label of the nearest decided neighbour. A heading goes with what follows it; what stands between two different
    labels at the same distance is text."""
    if b.heading and after:
        return after[1]
    if before and after:
        return before[1] if before[0] < after[0] else after[1] if after[0] < before[0] else before[1] or after[1]
    return before[1] if before else after[1] if after else None


def main_text(html: str) -> str:
    """Main-text blocks, joined in the page's order by line breaks."""
    page = blocks(html)
    return "\n".join(b.text for b, kept in zip(page, labels(page)) if kept)


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(*keep, text, n_chars) for every row of ``pages``, repeated rows included, in linear time for pages of any length.

    Null or empty html gives an empty text; an empty table an empty one. Kept columns must not be named ``text`` or
    ``n_chars`` (in any case): they are refused. Other columns are not read.
    """
    if clash := [c for c in keep if c.lower() in ("text", "n_chars")]:
        raise ValueError(f"the result has columns of its own named {clash}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py().decode("utf-8", "replace")) for h in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])

    html = unused("_html", pages)
    rows = pages.select(text_bytes(html_col).alias(html), *keep)
    schema = rows.drop(html).withColumn("text", F.lit("")).schema
    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
