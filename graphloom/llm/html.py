"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block of the page. Each line has a length; the sum over a sliding window of
lines is the block distribution. Where it surges over a threshold lies main text; it ends where it dives to zero
on either side, and the lines between are kept. The distribution decides on every page.

Markup only sets lengths: lines inside elements that are never main text (menus, headers, footers, sidebars,
forms, scripts, reader comments, hidden ones, or such class, id or role names) have none. If the page names its
main part (`article`, `main` or such a role), lines outside it have none either, and those inside have SURGE more,
so that each of them surges, however short. On such pages every region is kept. On other pages the greatest
region tells the main part: the element that holds it. All other regions and short lines of that element stay, so
an advert or menu inside it ends nothing, and so does the heading before it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_columns

#: Lines of a sliding window, and the sum of characters that marks a surge.
WINDOW, SURGE = 3, 120

# HTML element names by their part in a page.
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
_AWAY = frozenset("nav header footer aside form button select option label fieldset dialog menu head object canvas audio video map datalist".split()) | _RAW
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul caption".split()
)
_MAIN = frozenset(("article", "main"))
_HOLDS = frozenset("body center details div html section td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the greatest region's characters that the element holding it has at least.
HELD = 0.8
#: Words in class, id and role names that mark what is not main text.
_SURE_WORDS = (
    r"ads?|adsense|adbox|adslot|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promos?|promotions?|nav(?:bar|igation)?|menus?|breadcrumbs?|side-?bars?|footers?|site-?header|page-?header|mast-?head|"
    r"comments?|comment-?list|replies|disqus|cookies?|consent|gdpr|pop-?ups?|modal|newsletter|subscribe|subscription|pagination|pager|"
    r"toolbar|skip-?link|copyright|complementary|contentinfo|search-?form|dialog|alertdialog|toc"
)
#: Such words that also name parts of texts.
_MAYBE_WORDS = r"discussion|related|search|share|sharing|social|alert|notices?|login|signup|respond|recommend(?:ed|ations?)?|widgets?"


def _part(words: str) -> re.Pattern[str]:
    return re.compile(rf"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?:{words})(?:$|[\s_-])", re.I)


_SURE, _NAMES = _part(_SURE_WORDS), _part(f"{_SURE_WORDS}|{_MAYBE_WORDS}")
_WHOLE = re.compile(rf"(?:^|\s)(?:{_MAYBE_WORDS})(?:$|\s)", re.I)
#: Controls of forms.
_CONTROLS = frozenset("form button select input textarea".split())
#: A quoted value ends at a quote before white space, `/` or `>`; any other quote is a character of the tag.
_QUOTED = r"=\s*+\"[^\"]*+\"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:{_QUOTED}|[^>])*+)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"(?=[\s/]|\Z)|'([^']*)'(?=[\s/]|\Z)|(\S*)))?")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    away: bool
    main: bool
    node: int = 0


@dataclass
class Node:
    """A block element; 0 is the page. Numbers follow the page, so an element's descendants are `n` to `last`."""

    name: str
    mark: str
    parent: int
    last: int


def lines(page: str) -> list[Line]:
    """The lines of `parse`."""
    return parse(page)[0]


def _marked(name: str, attributes: dict[str, str], inside: bool) -> bool | None:
    """Whether class, id and role names mark an element as not main text; None: if its content is like that.

    Words that also name parts of texts mark an element as a whole class or role name, or if its content is of
    links or controls. `inside` a named main part, ids of sections mark nothing, as those of headings anywhere:
    they are slugs of titles.
    """
    kinds = " ".join(attributes.get(k, "") for k in ("class", "role"))
    slug = name in _HEADINGS or inside and (name == "section" or "section" in kinds.split())
    marks = kinds if slug else kinds + " " + attributes.get("id", "")
    if not marks.strip() or not _NAMES.search(marks):
        return False
    return True if _SURE.search(marks) or _WHOLE.search(kinds) else None


def parse(page: str) -> tuple[list[Line], list[Node]]:
    """The page's blocks in order, and its block elements. A tag cut off at the end is dropped; unknown tags are inline.

    A named main part ends the marks that names, or a form, of the elements around it set.
    """
    out: list[Line] = []
    parts: list[str] = []
    nodes = [Node("", "", 0, 0)]
    empty: list[tuple[int, int]] = []  # lines of elements found to be of links or controls
    stack: list[list] = []  # element, away, main, innermost block element, whether a main part may end the mark
    opened: Counter[str] = Counter()  # open elements by name: tags that close nothing cost no search
    away = main = links = controls = 0
    at = 0
    judged: list[tuple[int, int, int]] = []  # open elements whose content decides: place in the stack, first line, controls
    linked: list[str] = []  # those of the parts that are links
    sums = [(0, 0)]  # characters of lines so far that aren't away, and of links among them

    def flush() -> None:
        if parts:
            text, link = (_SPACE.sub(" ", html.unescape("".join(x))).strip() for x in (parts, linked))
            parts.clear()
            linked.clear()
            if text:
                out.append(Line(text, away > 0, main > 0, stack[-1][3] if stack else 0))
                sums.append((sums[-1][0] + len(text) * (away == 0), sums[-1][1] + len(link) * (away == 0)))

    def close(i: int) -> None:
        """Ends the open elements from place `i` on."""
        nonlocal away, main, links
        for name, a, k, _, _ in stack[i:]:
            opened[name] -= 1
            away -= a
            main -= k
            links -= name == "a"
        del stack[i:]
        while judged and judged[-1][0] >= i:
            _, lo, before = judged.pop()
            size, link = (sums[-1][k] - sums[lo][k] for k in (0, 1))
            if 2 * link > size or controls > before and size < SURGE:
                empty.append((lo, len(out)))

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            parts.append(rest if "<" not in rest else re.sub(r"</?[a-zA-Z][^>]*\Z", "", rest))
            if links:
                linked.append(parts[-1])
            break
        parts.append(page[at : m.start()])
        if links:
            linked.append(parts[-1])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and m[0].endswith("]]>"):
                parts.append(html.escape(m[0][9:-3]))
            continue
        name = m[2].lower()
        if name in _BLOCK or name in _AWAY:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            # an end tag closes up to its element, if it is open and no sectioning element stands between
            for i in range(len(stack) - 1 if opened[name] else -1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        controls += name in _CONTROLS
        if name in _VOID or m[3].endswith("/") and name not in _BLOCK:
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(m[3])}
        is_main = name in _MAIN or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")) is not None
        by_name = _marked(name, attributes, main > 0) if name not in ("html", "body") and not is_main else False
        is_away = name in _AWAY and not (name == "header" and main) or hidden or by_name is True
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            # these close an open one of their kind; its marks go with it
            for i in range(len(stack) - 1 if opened[name] else -1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in _BLOCK and stack[i][0] not in ("p",):
                    break
        node = stack[-1][3] if stack else 0
        if name in _BLOCK:
            nodes.append(Node(name, attributes.get("class", ""), node, len(nodes)))
            node = len(nodes) - 1
        if is_main and not main and away:
            for x in stack:
                if x[1] and x[4]:
                    x[1] = False
                    away -= 1
        opened[name] += 1
        stack.append([name, is_away, is_main, node, is_away and not hidden and (by_name is True and name not in _AWAY or name == "form")])
        links += name == "a"
        if by_name is None and not is_away:
            judged.append((len(stack) - 1, len(out), controls))
        away += is_away
        main += is_main
    flush()
    close(0)
    done = 0
    for lo, hi in sorted(empty):
        for x in out[max(lo, done) : hi]:
            x.away = True
        done = max(done, hi)
    for x in reversed(nodes):
        nodes[x.parent].last = max(nodes[x.parent].last, x.last)
    return out, nodes


def lengths_of(found: list[Line], surge: int = SURGE) -> list[int]:
    """Length of each line, as its marks set it."""
    if any(x.main and not x.away for x in found):
        return [len(x.text) + surge if x.main and not x.away else 0 for x in found]
    return [0 if x.away else len(x.text) for x in found]


def distribution(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Sum of the lengths of each line and the `window` - 1 behind it."""
    return [sum(lengths[i : i + window]) for i in range(len(lengths))]


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First line of each region and the line behind its last, in order.

    A region holds a line with text at which the distribution surges over `surge`. It reaches to the points on
    both sides where the distribution dives to zero: its ends are lines with text beyond which `window` lines,
    or all there are, have none.
    """
    sums = distribution(lengths, window)
    out: list[tuple[int, int]] = []
    i, n = 0, len(lengths)
    while i < n:
        if not lengths[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:  # `sums` is zero where a gap of `window` lines begins
            j += 1
        if any(lengths[k] and sums[k] >= surge for k in range(i, j)):
            out.append((i, j))
        i = j
    return out


def between(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """The greatest of `regions`, the first of equal ones. Without a surge, all lines with text are the region."""
    found = regions(lengths, window, surge)
    if found:
        return max(found, key=lambda r: sum(lengths[r[0] : r[1]]))
    full = [k for k, x in enumerate(lengths) if x]
    return (full[0], full[-1] + 1) if full else (0, 0)


def holder(found: list[Line], nodes: list[Node], spans: list[tuple[int, int]], lo: int, hi: int) -> int:
    """The element that holds the region [lo, hi) of `spans`.

    It is the innermost one with HELD of the region's characters that can hold several blocks and has several
    lines. Where another region lies in a sibling of its kind (name and class), both are sections of the parent.
    """
    weight, texts = [0] * len(nodes), [0] * len(nodes)
    for k, x in enumerate(found):
        if not x.away:
            texts[x.node] += 1
            weight[x.node] += len(x.text) if lo <= k < hi else 0
    for n in range(len(nodes) - 1, 0, -1):
        texts[nodes[n].parent] += texts[n]
        weight[nodes[n].parent] += weight[n]
    at = max(n for n in range(len(nodes)) if weight[n] >= HELD * weight[0])

    def up(n: int) -> int:
        while n and (nodes[n].name not in _HOLDS or texts[n] < 2):
            n = nodes[n].parent
        return n

    at = up(at)
    others = sorted({x.node for i, j in spans if (i, j) != (lo, hi) for x in found[i:j] if not x.away})
    while at and nodes[at].name not in ("body", "html"):
        own = nodes[at]
        alike = [k for k in range(own.parent + 1, nodes[own.parent].last + 1) if k != at and (nodes[k].name, nodes[k].mark, nodes[k].parent) == (own.name, own.mark, own.parent)]
        if not any(bisect_left(others, k) < bisect_right(others, nodes[k].last) for k in alike):
            break
        at = up(own.parent)
    return at


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text: blocks in page order joined by an empty line; empty for null and for pages without main text."""
    found, nodes = parse(page or "")
    lengths = lengths_of(found, surge)
    spans = regions(lengths, window, surge)
    if any(x.main and not x.away for x in found):
        kept = {k for lo, hi in spans for k in range(lo, hi)}
    else:
        kept = _held(found, nodes, lengths, spans, between(lengths, window, surge))
    return "\n\n".join(x.text for k, x in enumerate(found) if k in kept and lengths[k])


def _held(found: list[Line], nodes: list[Node], lengths: list[int], spans: list[tuple[int, int]], greatest: tuple[int, int]) -> set[int]:
    """The lines of the greatest region and of the element that holds it."""
    lo, hi = greatest
    kept = set(range(lo, hi))
    if spans:
        at = holder(found, nodes, spans, lo, hi)
        inside = [k for k, x in enumerate(found) if at <= x.node <= nodes[at].last]
        if nodes[at].name in ("", "html", "body"):
            # parts of the page itself may be anything: those of a region, what lies between, and blocks of the page's own
            inside = [k for k in inside if spans[0][0] <= k < spans[-1][1] or not _in_part(found[k].node, at, nodes)]
        kept.update(inside)
        # a heading right before what is kept, and the lines between
        first = k = min(i for i in kept if lengths[i])
        while k and lengths[k - 1]:
            k -= 1
            if nodes[found[k].node].name in _HEADINGS:
                first = k
                if nodes[found[k].node].name == "h1":
                    break
        kept.update(range(first, lo))
    return kept


def _in_part(node: int, of: int, nodes: list[Node]) -> bool:
    """Whether an element inside `of` lies in another one that can hold several blocks."""
    while node != of:
        if nodes[node].name in _HOLDS and nodes[node].name not in ("html", "body"):
            return True
        node = nodes[node].parent
    return False


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html); n_chars counts code points.

    Null and empty html, and pages without main text, give an empty text and 0. Repeated rows give repeated
    results, an empty table an empty one; null ids and addresses stay null, other columns aren't read. Of equally
    great regions the first one counts.
    """

    def compute(cols: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h) for h in cols["html"]]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_columns(pages.select(F.col("page_id"), "url", "html"), compute, "text string, n_chars long", ("page_id", "url"))
