"""Main text of web pages by line-block distribution.

Markup is stripped first: a page becomes a list of lines, one per block element, with the
characters of each that count as text. What lies in elements or classes that are no article
text (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles)
leaves empty lines. The lengths are summed over sliding windows of lines. A surge is where a
sum rises over the threshold, a dive where it falls back to nothing; the text between the two is
kept, and so is the text beside it in the same element. Where a page marks its article, that is
the element of all text in it.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planes.llm.common import slices

# Lines in a window.
WINDOW = 3
# Characters in a window that make a surge, or half of the page's fullest window if that is less.
SURGE = 80
# Empty lines that an element leaves that is no article text, and around a marked article: more
# than a window.
GAP = WINDOW + 1

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody "
    "tfoot thead tr ul".split()
)
ASIDE = frozenset("nav header footer aside form head menu dialog button select search fieldset dir label input datalist audio video canvas map".split())
# Blocks that hold text themselves; the element that holds several of them is their container.
TEXT = frozenset("address blockquote caption center dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr legend li ol p pre summary ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar tablist".split())
# Words in a class or id that tell what is no article text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead topbar footer bottombar copyright sidebar "
    "sidebars rail aside widget widgets related recommended recommendations share sharing social comment comments commentlist "
    "disqus replies reply respond discussion search searchbox toolbar pagination pager paging skip toc outbrain taboola "
    "disclaimer paywall form".split()
)
# Of these, words that are also what an article may be about: alone they tell, and beside
# words of place and form, but not beside others.
AMBIGUOUS = frozenset(
    "alert comment copyright disclaimer discussion form header menu menus navigation notice notices promotion rail related reply "
    "respond search share sharing skip social".split()
)
# Words of place and form in a class or id.
PLAIN = frozenset(
    "site page main top bottom left right upper lower inner outer box bar block container wrapper wrap list section area links link "
    "items item panel unit slot row col column group id btn button buttons text title js module mobile desktop sticky fixed float "
    "primary secondary global local content body first last small large big user reader readers contact email mail input field "
    "fields icon icons strip card cards tile tiles trail zone region holder frame layer entry post posts story article articles".split()
)
# Beside one of these words, "header" is an article's own.
OWN = frozenset("article post entry content story main".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']+|"[^"]*"|'[^']*')*+|[^<>]*)>)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _told(token: str) -> set[str]:
    """The words of one class or id by which it names what is no article text.

    A compound is what its last word says: a reader-sidebar is a sidebar, a form-factor no form.
    Words before the last tell only if nothing but words of place and form goes with them.
    """
    words = [x.lower() for x in WORD.findall(token)]
    told = {x for x in words if x in NAMES}
    others = [x for x in words if x not in NAMES and x not in PLAIN]
    if others and (words[-1] not in NAMES or words[-1] in AMBIGUOUS):
        return set()
    return told


def is_aside(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no article text."""
    if name in ASIDE:
        return not (name == "header" and in_article)
    if not attributes or attributes.isspace() or name in ("html", "body", "main", "article") and "class" not in attributes:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value.lower()):
            return name not in ("html", "body")
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for one in value.split():
                parts = {x.lower() for x in WORD.findall(one)}
                told = _told(one)
                if told and not (parts & OWN and told <= {"header", "banner"}) and not (name == "article" and not told & {"comment", "comments", "ad", "ads", "advert", "promo", "sponsored", "related"}):
                    return True
    return False


def lines_of(html: str) -> tuple[list[tuple[str, int]], list[int]]:
    """Lines of text with the characters that count, and the number of each line's container, 0
    the body, -1 for empty lines. A marked article is the container of all that lies in it."""
    page: list[tuple[str, int]] = []
    containers: list[int] = []
    inside: list[int] = []  # lines in a marked article
    heads: set[int] = set()  # lines that are headings
    linked_items: list[int] = []  # lines that are items of a link and nothing else
    stack: list[tuple[str, bool, bool, int]] = []  # name, no article text, marks an article, number
    number = 0
    aside = marked = links = headings = 0
    text: list[str] = []
    linked = 0

    def end_line() -> None:
        nonlocal linked
        if text:
            line = " ".join(unescape("".join(text)).split())
            text.clear()
            if line:
                # A list item that is a link and nothing else belongs to a menu.
                counts = 0 if linked >= len(line) and any(x[0] == "li" for x in stack) else len(line)
                if headings:
                    heads.add(len(page))
                if not counts:
                    linked_items.append(len(page))
                if marked:
                    inside.append(len(page))
                page.append((line, counts))
                own = (n for name, _, is_marked, n in (stack if marked else reversed(stack)) if is_marked or not marked and name in BLOCK and name not in TEXT)
                containers.append(next(own, 0))
        linked = 0

    def gap() -> None:
        page.extend([("", 0)] * GAP)
        containers.extend([-1] * GAP)

    def pop(to: int) -> None:
        nonlocal aside, marked, links, headings
        while len(stack) > to:
            name, was_aside, was_marked, _ = stack.pop()
            aside -= was_aside
            marked -= was_marked
            if was_marked:
                gap()
            links -= name == "a"
            headings -= name in HEADING

    at = 0
    while True:
        m = TAG.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece and not aside and not (headings == 0 and any(x[0] == "header" for x in stack)):
            text.append(piece)
            if links:
                linked += len(" ".join(unescape(piece).split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            end_line()
        elif name in ("br", "td", "th"):
            text.append(" ") if not aside else None
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        if name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK or name in ("p", "li", "tr"):
            # A paragraph ends where the next block begins; an item or row at the next of its kind.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "tr", "dd", "dt", "option"):
                    pop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        no_text = is_aside(name, m[3], marked > 0)
        is_marked = name in ("article", "main") and not no_text
        number += 1
        stack.append((name, no_text, is_marked, 0 if name in ("html", "body") else number))
        if no_text and not aside or is_marked:
            gap()
        aside += no_text
        marked += is_marked
        links += name == "a"
        headings += name in HEADING
    end_line()
    # Links one below the other amid an article's text, or below a heading, are its own list.
    marked_lines = set(inside)
    counting = [i for i in inside if page[i][1]]
    headed = -1
    for i in linked_items:
        if headed != i - 1:
            headed = i if i - 1 in heads and i - 1 in marked_lines and page[i - 1][1] else -1
        elif headed >= 0:
            headed = i
        if i in marked_lines and counting and counting[0] < i and (i < counting[-1] or headed == i):
            page[i] = (page[i][0], len(page[i][0]))
    return page, containers


def between(lines: list[tuple[str, int]], surge: int, containers: list[int], window: int = WINDOW) -> list[str]:
    """The lines from each surge to the next dive, without empty ones and those that don't
    count; and lines that share a container with these, in the body those between two of them."""
    sums = [0] * (len(lines) + window)
    run = 0
    for i in range(len(lines) - 1, -1, -1):
        run += lines[i][1] - (lines[i + window][1] if i + window < len(lines) else 0)
        sums[i] = run
    surge = min(surge, max(sums) // 2)
    kept, inside = [], False
    for i, (line, counts) in enumerate(lines):
        inside = sums[i] > 0 if inside else sums[i] > surge
        if inside and counts:
            kept.append(i)
    if kept:
        surged, own = set(kept), {containers[i] for i in kept} - {0}
        body = [i for i in kept if containers[i] == 0]
        kept = [
            i for i, (_, counts) in enumerate(lines)
            if counts and (i in surged or containers[i] in own or body and containers[i] == 0 and body[0] < i < body[-1])
        ]
    return [lines[i][0] for i in kept]


def main_text(html: str) -> str:
    page, containers = lines_of(html)
    return "\n\n".join(between(page, SURGE, containers))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars (code points) of every page.

    Blocks come in page order, joined by two line breaks; white space inside a block is one
    space and character references are decoded. Null and empty pages and pages without text
    give the empty string. Repeated rows are each extracted, null ids and urls are kept, an
    empty table gives no rows. Other columns are not read.
    """
    rows = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    fields = [rows.schema[c] for c in keep]

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                [*keep, "text", "n_chars"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string", "n_chars long"])
    return rows.mapInArrow(run, schema)
