"""Main text of web pages by line-block distribution.

Markup is stripped so that every block of text is a line; a stripped menu, header or footer leaves a
gap of ``WINDOW`` empty lines, which no window bridges. Other stripped blocks (adverts, forms, ...) may stand
within the text: any number of them in a row leaves one empty line. Scripts, pictures, controls and other elements
within a line leave nothing. The text lengths of ``WINDOW`` following lines are summed at
every line. Text surges where the sums leave zero and dives where they return to it; the text from
the first surge that reaches the threshold to the last dive is kept. Lines made of links add no length (within a
marked article only those of lists and tables), but stay where they stand between lines that are kept; when the page marks an article, lines outside it count one in ``OUTSIDE`` of their characters.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
THRESHOLD = 80
#: Characters that count as one in lines outside the article of a page that marks one.
OUTSIDE = 4

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul caption".split()
)
#: Their content is code or a control, not text; it ends at their own end tag only. They don't end a line.
RAW = frozenset("script style noscript template textarea iframe object svg canvas select head title".split())
CHROME = frozenset("nav footer aside form menu dialog button".split())
FRAME = frozenset(("nav", "header", "footer"))
MAIN = frozenset(("article", "main"))
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer comment comments disqus replies reply cookie cookies consent notice "
    "notices notification alert popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended widget toolbar masthead topbar skip pagination pager copyright".split()
)
#: After one of these words these only say where or how: ad-container, but not ad-hoc.
PLACES = frozenset(
    "area bar block body bottom box button buttons container content count footer form frame group header holder icon icons "
    "inner item items label left link links list main message module outer panel post posts region right row section "
    "slot space stories tabs thread title toggle top unit wrap wrapper zone".split()
)
WRAPPERS = frozenset("has with no without".split())
#: Within an article a line of links is text (a linked title, say) unless it is one of these.
CELLS = frozenset(("li", "td", "th", "dd", "dt", "option"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SPACE = re.compile(r"\s+")


def is_chrome(tag: str, attributes: str, in_main: bool) -> bool:
    """True for menus, headers, footers, sidebars, notices, adverts, forms and reader comments."""
    if tag in CHROME or tag == "header" and not in_main:
        return True
    if not attributes or tag in MAIN or tag in ("body", "html"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in CHROME_ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id"):
            if any(names_chrome([w for w in re.split(r"[^a-z]+", part) if w], in_main) for part in value.split()):
                return True
    return False


def names_chrome(words: list[str], in_main: bool) -> bool:
    """True for a class name, cut into its words, that ends in a word for such elements, or has one before mere places."""
    if not words or WRAPPERS.intersection(words):
        return False
    known = CHROME_WORDS if in_main else CHROME_WORDS | {"header"}
    while len(words) > 1 and words[-1] in PLACES and words[-1] not in known:
        words = words[:-1]
    return words[-1] in known


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, length that counts) of every line, with the gaps that stripped elements leave."""
    out: list[tuple[str, int]] = []
    outside: list[int] = []  # the lines outside articles, which weigh less once one has opened
    has_main = False
    parts: list[str] = []
    block = ""  # the element whose line is open
    linked = 0  # characters of the open line inside links
    main = link = 0
    skipped, depth = "", 0  # the stripped element that is open, and how many of its kind
    at = 0

    def close_line() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            if not main:
                outside.append(len(out))
            out.append((text, len(text) if 2 * linked < len(text) or main and block not in CELLS else 0))
        linked = 0

    while at < len(page):
        found = TOKEN.search(page, at)
        start = found.start() if found else len(page)
        if start > at and not skipped:
            parts.append(page[at:start])
            linked += (start - at) * (link > 0)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        ends = bool(found[1])
        if skipped:
            if tag in MAIN and not ends and skipped not in RAW or skipped in ("p", "li") and tag in BLOCKS:
                skipped, depth = "", 0  # it was never closed
            else:
                depth += (tag == skipped) * (-1 if ends else 1)
                if depth == 0:
                    skipped = ""
                continue
        if tag in BLOCKS:
            close_line()
            block = "" if ends else tag
        if tag in MAIN:
            has_main |= not ends
            main = max(0, main + (-1 if ends else 1))
        elif tag == "a":
            link = 0 if ends else 1
        elif tag == "br":
            parts.append(" ")
        if ends or tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
        elif is_chrome(tag, found[3], main > 0):
            if tag in BLOCKS:
                close_line()
                if tag in FRAME:
                    out += [("", 0)] * WINDOW
                elif out and out[-1][0]:
                    out.append(("", 0))
            skipped, depth = tag, 1
    close_line()
    if has_main:
        for i in outside:
            text, length = out[i]
            out[i] = text, -(-length // OUTSIDE)
    return out


def main_text(page: str) -> str:
    lines = lines_of(page)
    upto = [0, *accumulate(length for _, length in lines)]
    sums = [upto[min(i + WINDOW, len(lines))] - upto[i] for i in range(len(lines))]
    most = max(sums, default=0)
    if not most:
        return ""
    regions, start = [], None  # from a surge to the next dive
    for i, total in enumerate([*sums, 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            regions.append((start, i))
            start = None
    strong = [(a, b) for a, b in regions if max(sums[a:b]) >= min(THRESHOLD, most)]
    counted = [i for i in range(strong[0][0], strong[-1][1]) if lines[i][1]]
    return "\n".join(text for text, _ in lines[counted[0] : counted[-1] + 1] if text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    A null, empty or textless page gives an empty text. Character references are decoded, white space
    inside a block becomes one space, blocks are joined by a line feed. Elements that are never closed
    end with the page. Repeated rows give a row each; other columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
