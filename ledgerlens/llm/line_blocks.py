"""Main text of a page by the distribution of text over its lines.

Markup is stripped to lines: a block element's text is a line, and every piece of furniture (menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts, styles) leaves a gap of empty lines. A line's length is that of its text
outside of links; a copyright line that is no paragraph has none. Lengths are summed over WINDOW successive lines at every line. The page's own
distribution sets the bar: with half of the text in lines of LEVEL ** 2 characters or more, a window must hold LEVEL characters a
line. The first window that reaches it is the surge, the last one the dive, and everything between them that is no furniture is kept,
short stretches included. So menus, footers and link lists that no tag and no class tells go where they stand before the surge or
behind the dive. Marked content is never cut: lines of article and main elements, and paragraphs and headings that adjoin.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from ledgerlens.llm.common import texts

WINDOW = 3

#: Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea iframe object svg math canvas audio video select button noframes title".split())
FURNITURE = frozenset("nav header footer aside form menu dialog head search".split())
CONTENT = frozenset(("article", "main"))
#: Words of class, id and role values that mark furniture.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|header|masthead|"
    r"menu\w*|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|share\w*|sharing|sidebar\w*|"
    r"signup|skip|social|sponsor\w*|subscribe|subscription|toolbar|topbar|widget\w*|contentinfo|complementary|alert|dialog|search)(?=$|[\s_-])"
)
#: A token that speaks of furniture elsewhere (has-sidebar), names a page builder's box, or an article's own heading.
UNMARKED = re.compile(r"(?:has|with|without|no|not|hide|show)[_-].*|elementor\S*|\S*widget[_-]+(?:container|wrap\w*)|(?:entry|post|article|content|story|page)[_-]+header|\S*[_-]header[_-]+(?:text|title)")
#: A class does not make furniture of an element that holds more than this share of the page's text, in runs of so many characters.
MOST, DENSE_RUN = 0.5, 40
#: Elements whose lines are content however short, where they adjoin it; a list item is that in an ordered list only.
PARAGRAPHS = frozenset("p blockquote pre figcaption caption td th dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COPYRIGHT = re.compile(r"©|\(c\)\s*\d{4}|copyright\b|all rights reserved", re.IGNORECASE)
READERS = re.compile(r"comment|disqus|repl|respond")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:$|[\s=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
TAG = re.compile(r"""(<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*>)""", re.DOTALL)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: HTML's white space and the no-break space.
SPACE = re.compile(r"\s+")


def furniture_marks(marks: str) -> bool:
    """Whether a class, id or role value, in lower case, names furniture."""
    return bool(MARKED.search(marks)) and any(MARKED.search(token) and not UNMARKED.fullmatch(token) for token in marks.split())


class Line(NamedTuple):
    """A block's text, its length outside of links, the element it stands in, and whether that is inside an article or main one."""

    text: str = ""
    length: int = 0
    element: str = ""
    content: bool = False


GAP = Line()


def layout_lines(page: str) -> list[Line]:
    """The page's lines; a gap is WINDOW empty ones. An element that only its class marks, but that holds most of the text in
    dense runs, is read after all."""
    parts, read = TAG.split(page), set()
    while True:
        lines, skipped = _lines(parts, read)
        total = sum(len(line.text) for line in lines) + sum(chars for chars, _, _ in skipped.values())
        more = {at for at, (chars, runs, by_class) in skipped.items() if by_class and chars > MOST * total and chars >= DENSE_RUN * runs}
        if not more:
            return lines
        read |= more


def _lines(parts: list[str], read: set[int]) -> tuple[list[Line], dict[int, list[int]]]:
    """The lines, and for each skipped element, by the place of its tag: characters, runs of text, whether only its class marks it."""
    passed: dict[int, list[int]] = {}
    opened_at = 0
    lines: list[Line] = []
    held: list[str] = []
    content = 0
    element, ordered = "", False  # the block the text stands in; whether the last list is an ordered one
    link, linked = False, 0  # inside a link; characters of the line that were
    skipping, depth = "", 0  # the furniture element we are in, and how many of its name are open
    reader = False  # the furniture is reader comments, in which article elements are comments

    def end_line(gap: bool = False) -> None:
        nonlocal link, linked
        text = SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            own = 0 if element not in PARAGRAPHS and COPYRIGHT.match(text) else max(0, len(text) - linked)
            lines.append(Line(text, own, element, content > 0))
        link, linked = False, 0
        if gap and lines and lines[-1].text:
            lines.extend([GAP] * WINDOW)

    at = 0
    while at < len(parts):
        if at % 2 == 0:
            if not skipping:
                held.append(parts[at])
                if link:
                    linked += len(SPACE.sub(" ", html.unescape(parts[at])))
            elif size := len(parts[at].strip()):
                passed[opened_at][0] += size
                passed[opened_at][1] += 1
            at += 1
            continue
        tag = parts[at]
        at += 1
        if tag[1] in "!?":
            continue
        name, closing = NAME.match(tag)[1].lower(), tag[1] == "/"
        if skipping:
            if name in ("script", "style", "textarea", "title") and not closing and not tag.endswith("/>"):
                at = _raw_end(parts, at, name)  # what is inside is no markup
                continue
            if name == skipping and not tag.endswith("/>"):
                depth += -1 if closing else 1
            if depth and not (skipping not in RAW and (name in CONTENT or name == "body") and not closing and not reader):
                continue
            opened = depth > 0  # left open: the page goes on with its content
            skipping = ""
            if not opened:
                continue
        if not closing and name not in VOID and not tag.endswith("/>"):
            marks = " ".join(found.strip("\"'") for found in MARKS.findall(tag)).lower() if "=" in tag else ""
            hidden = name not in CONTENT and bool(HIDDEN.search(tag))
            by_class = name not in ("html", "body") and name not in CONTENT and furniture_marks(marks) and at - 1 not in read
            # A header inside an article without further marks is the article's own heading.
            by_name = name in FURNITURE and not (name == "header" and content)
            if name in RAW or hidden or by_class or by_name:
                end_line(gap=name not in RAW)
                skipping, depth, reader = name, 1, bool(READERS.search(marks))
                opened_at = at - 1
                passed[opened_at] = [0, 0, by_class and not (name in RAW or hidden or by_name or reader)]
                if name in RAW:
                    at = _raw_end(parts, at, name)
                    skipping = ""
                continue
        if name in CONTENT:
            end_line(gap=True)
            content = max(0, content + (-1 if closing else 1))
            element = ""
        elif name in BLOCKS:
            end_line()
            if name in ("ol", "ul"):
                ordered = name == "ol" and not closing
            element = "" if closing else "p" if name == "li" and ordered else name
        elif name == "a":
            link = not closing
        elif name == "br":
            held.append(" ")
    end_line()
    return lines, passed


def _raw_end(parts: list[str], at: int, name: str) -> int:
    """Behind the end tag of a raw element; an element without one is empty."""
    depth = 1
    for place in range(at | 1, len(parts), 2):
        tag = parts[place].lower()
        if re.match(rf"</{name}[\s/>]", tag):
            depth -= 1
            if not depth:
                return place + 1
        elif name not in ("script", "style", "textarea", "title") and re.match(rf"<{name}[\s>]", tag):
            depth += 1
    return at


def bar_of(lengths: list[int]) -> float:
    """The characters a line that a window must hold: the square root of the line length at which half of the text is reached."""
    rest = sum(lengths) / 2
    for length in sorted(lengths, reverse=True):
        rest -= length
        if rest <= 0:
            return length**0.5
    return 0.0


def between_surge_and_dive(lengths: list[int], bar: float, window: int = WINDOW) -> tuple[int, int]:
    """(first line of the first window whose sum reaches `bar`, line behind the last of the last one); the fullest window always
    does."""
    sums, total = [], sum(lengths[:window])
    for at in range(len(lengths)):
        sums.append(total)
        total += (lengths[at + window] if at + window < len(lengths) else 0) - lengths[at]
    bar = min(bar, max(sums, default=0))
    reached = [at for at, total in enumerate(sums) if total >= bar]
    return (reached[0], min(reached[-1] + window, len(lengths))) if reached else (0, 0)


def main_lines(lines: list[Line]) -> tuple[int, int]:
    """(first line, line behind the last) of the main text."""
    lengths = [line.length for line in lines]
    if not any(lengths):  # nothing but links: no line is better than another
        lengths = [len(line.text) for line in lines]
    level = bar_of(lengths)
    start, end = between_surge_and_dive(lengths, WINDOW * level)
    paragraph = [line.length > 0 and line.element in PARAGRAPHS and 2 * line.length >= len(line.text) for line in lines]
    heading = [line.length > 0 and line.element in HEADINGS for line in lines]
    # The windows at both ends reach over lines that are none of the text.
    while start < end and lengths[start] < max(level, 1) and not (paragraph[start] or heading[start]):
        start += 1
    while end > start and lengths[end - 1] < max(level, 1) and not paragraph[end - 1]:
        end -= 1
    # Paragraphs and headings that adjoin, over gaps as well.
    at = start
    while at > 0 and (paragraph[at - 1] or heading[at - 1] or not lines[at - 1].text):
        at -= 1
        start = at if lines[at].text else start
    at = end
    while at < len(lines) and (paragraph[at] or heading[at] or not lines[at].text):
        at += 1
        end = at if paragraph[at - 1] else end
    content = [at for at, line in enumerate(lines) if line.content]
    return (min(start, content[0]), max(end, content[-1] + 1)) if content else (start, end)


def main_text(page: str | None) -> str:
    """The main text, its blocks joined by a line feed; "" for a null, empty or textless page."""
    if not page:
        return ""
    lines = layout_lines(page)
    start, end = main_lines(lines)
    return "\n".join(line.text for line in lines[start:end] if line.text)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per page. Other columns are left out; nulls in page_id and url stay null, repeated rows stay
    repeated."""

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(page_id, url, main_text(page)) for page_id, url, page in texts([batch], ["page_id", "url", "html"], 200)]
            ids, urls, found = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
            arrays = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
