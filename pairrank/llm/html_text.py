"""Main text of web pages by line-block distribution.

Markup is stripped to lines: every block-level tag ends a line, and elements that never
hold main text (scripts, menus, footers, adverts, comments, told by tag, role, class or
id) leave blank lines. A form, or a box only named so, goes if its lines look like it. Text lengths are summed over a sliding window of ``WINDOW`` lines.
Where the sums rise from zero is a surge, where they fall back to zero a dive, and what
lies between is an area. An area is a candidate if its peak is high enough for the page
and it is not mostly links. Article and main elements, whose ends count as blank lines,
are evidence: they win unless the candidates outside them hold ``EVIDENCE`` times their text.
Short areas between or next to what is chosen, as a title in a box of its own, are kept too.

Pages are independent: one pass in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.functions.text import quoted
from pairrank.llm.expressions import columns_of

WINDOW = 3
# An area outside an article needs a window with this many characters, and with this share of the page's best.
SURGE, SHARE = 80, 0.2
LINKED = 0.6
# So many times the text of an article (or main element) outweighs it.
EVIDENCE = 4
# So many lines in a row that are links alone are a list of links, judged for itself outside articles.
LINK_LINES = 3
# So many in a row are one if each is this short.
SHORT_LINKS, SHORT_LINK = 2, 25
# A line about rights with at most so many characters, and no longer text after it, closes the page.
CLOSING = 2 * SURGE

# HTML's own element names by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split())
BOXES = frozenset("aside body div fieldset footer form header html main nav section table".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer iframe input label map menu nav noscript object optgroup option "
    "script select style svg template textarea title video xmp".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words in a class or id that name something other than main text.
NAMES = frozenset(
    "ad ads adsense adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist comments "
    "consent cookie cookies copyright discussion disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
# Those of them whose boxes go however much text they hold, unless the page has little else.
SURE = frozenset(
    "ad ads adsense adv advert advertisement advertising adverts breadcrumb breadcrumbs commentlist comments consent cookie cookies "
    "disqus gdpr login menu menus nav navbar navigation newsletter pager pagination popup reply replies respond signup sponsor "
    "sponsored subscribe".split())
# Those whose boxes, sections apart, go if the name is a class; as an id it may be that of a chapter.
CLASSED = frozenset("alert comment discussion notice notices reactions responses".split())
# Elements of forms that may stand in running text.
CONTROLS = frozenset(["button", "label"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLES = frozenset(["h1", "h2"])
# A word after one of these says what a box stands beside: with-sidebar.
BESIDE = frozenset("with has no without".split())
CONTAINERS = frozenset(["article", "main"])
# A start tag of these ends an open one of the same name.
SELF_CLOSING = frozenset("p li dt dd option tr td th".split())

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_NOT_SHOWN = re.compile(r"""\bstyle\s*=\s*["']?[^"']*display\s*:\s*none""", re.I)
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b).*[0-9]{4}|.*\ball rights reserved\b", re.I)
# What running text ends with before an element that belongs to it, and goes on with after it.
_GOES_ON = re.compile(r"[\w,;(\[“‘«\-]\s*$"), re.compile(r"\s*(?:[,.;:!?)\]”’»]|(?![A-Z])[^\W_])")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Tag:
    name: str
    attributes: str
    start: int
    end: int
    closes: bool
    partner: int | None = None


@dataclass(slots=True)
class Line:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    inside: bool = False
    box: int = -1
    container: int = -1
    nest: int = -1
    title: bool = False
    # Texts of elements with doubtful names within the line, by the part they come before.
    doubtful: list[tuple[int, str]] = field(default_factory=list)

    def text(self) -> str:
        """The line's text. An element with a doubtful name belongs to it in the middle of a sentence."""
        parts = self.parts
        if self.doubtful:
            # The last part that is not blank before each place, and the next one after it.
            before, after = [""], [""]
            for part in parts:
                before.append(part if part.strip() else before[-1])
            for part in reversed(parts):
                after.append(part if part.strip() else after[-1])
            pieces: dict[int, str] = {}
            for k, piece in self.doubtful:
                sides = html.unescape(before[k]), html.unescape(after[len(parts) - k])
                if _GOES_ON[0].search(sides[0]) and _GOES_ON[1].match(sides[1]):
                    pieces[k] = pieces.get(k, "") + piece
            parts = [text for k, part in enumerate([*parts, ""]) for text in (pieces.get(k, ""), part)]
        return " ".join(html.unescape("".join(parts)).split())


@dataclass(slots=True)
class Container:
    """An article or main element: the one around it, and whether it lies in an article or is one."""

    parent: int
    article: bool


@dataclass(slots=True)
class Area:
    lines: list[int]
    peak: int
    size: int
    linked: int
    container: int


@dataclass(slots=True)
class Nest:
    """An element that holds blocks: the one around it, and its first and last line."""

    parent: int
    first: int
    last: int


@dataclass(slots=True)
class Box:
    """A form or named element: the box around it, whether its name is sure, and what its lines hold."""

    parent: int
    sure: bool
    section: bool
    holds_container: bool
    size: int = 0
    linked: int = 0
    longest: int = 0


def tags_of(page: str) -> list[Tag]:
    """All tags in page order; comments and declarations are tags without a name."""
    found, at = [], 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            found.append(Tag("", "", at, end, False))
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            found.append(Tag("", "", at, end, False))
        elif re.match(r"/?[a-zA-Z]", page[at + 1 : at + 3]):
            match = _TAG.match(page, at)
            if match:
                name, attributes, end = match[1].lower(), match[2], match.end()
            else:  # a quote that is never closed
                end = page.find(">", at) + 1
                if not end:
                    break
                name, _, attributes = page[at + 1 : end - 1].lstrip("/").partition(" ")
                name = name.lower()
            closes = page[at + 1] == "/"
            found.append(Tag(name, attributes, at, end, closes))
            if name in RAW and not closes:
                match = re.compile(rf"</{name}\b", re.I).search(page, end)
                end = match.start() if match else len(page)
        else:
            end = at + 1
        at = end
    return found


def pair_up(tags: list[Tag]) -> None:
    """Give each start tag the position of its end tag, where it has one."""
    opened: dict[str, list[int]] = {}
    for i, tag in enumerate(tags):
        if not tag.name or tag.name in VOID:
            continue
        waiting = opened.setdefault(tag.name, [])
        if tag.closes:
            if waiting:
                tags[waiting.pop()].partner = i
        else:
            if tag.name in SELF_CLOSING and waiting:
                tags[waiting[-1]].partner = i
                waiting.pop()
            waiting.append(i)


def named_otherwise(tag: Tag, inside: bool) -> str | None:
    """Whether tag, role, class or id say that the element is no main text: "always", "sure", "maybe" or None."""
    if tag.name in DROPPED:
        return "always"
    if tag.name == "header":
        return None if inside else "always"
    if tag.name == "form":
        return "maybe"
    if _HIDDEN.search(_QUOTED.sub("", tag.attributes)) or _NOT_SHOWN.search(tag.attributes):
        return "sure"
    if tag.name in CONTAINERS and "comment" not in tag.attributes.lower() or tag.name in ("html", "body") or tag.name in HEADINGS:
        return None
    found, classes = set(), set()
    for key, *values in _ATTRIBUTE.findall(tag.attributes):
        value = "".join(values)
        if key.lower() == "role":
            if {w.lower() for w in _WORD.findall(value)} & ROLES:
                return "sure"
            continue
        for token in value.split():
            words = [w.lower() for w in _WORD.findall(token)]
            named = [w for before, w in zip(["", *words], words) if before not in BESIDE]
            found.update(named)
            classes.update(named if key.lower() == "class" else ())
    if tag.name != "section" and classes & CLASSED or found & SURE or tag.name in CONTAINERS and found & NAMES | found & {"comment"}:
        return "sure"
    return "maybe" if found & NAMES or classes & CLASSED or (not inside and "header" in found) else None


def lines_of(page: str) -> tuple[list[Line], list[Container], list[Box], list[Nest]]:
    """The page as lines, its article and main elements, the boxes that may have to go, and how it is nested."""
    tags = tags_of(page)
    pair_up(tags)
    containers = [i for i, t in enumerate(tags) if t.name in CONTAINERS and not t.closes]
    breaks = [i for i, t in enumerate(tags) if t.name in BREAKS]
    solid = [i for i, t in enumerate(tags) if t.name in BREAKS or (t.name in DROPPED and t.name not in CONTROLS)]
    lines, depth, link = [Line()], 0, 0
    boxes: list[Box] = []
    box, ends = -1, {}
    held: list[Container] = []
    open_containers: list[int] = []
    nests: list[Nest] = []
    nest, nest_ends = -1, {}

    def new(blanks: int = 0) -> None:
        lines.extend(Line() for _ in range(blanks))
        lines.append(Line(inside=depth > 0, box=box, container=open_containers[-1] if open_containers else -1, nest=nest))

    def inline(first: int, last: int | None) -> str | None:
        """The text of an element that holds no block; None for others."""
        if last is None or not tags[last].closes or (tags[first].name in DROPPED and tags[first].name not in CONTROLS):
            return None
        inner = after(solid, first)
        if inner is not None and inner < last:
            return None
        held_tags = tags[first : last + 1]
        return "".join(page[t.end : u.start] for t, u in zip(held_tags, held_tags[1:]))

    def after(places: list[int], i: int) -> int | None:
        k = bisect_right(places, i)
        return places[k] if k < len(places) else None

    at, i = 0, 0
    while i < len(tags):
        tag = tags[i]
        if tag.start > at:
            piece = page[at : tag.start]
            lines[-1].parts.append(piece)
            lines[-1].linked += len(piece) if link else 0
        at, here, i = tag.end, i, i + 1
        if not tag.name:
            continue
        kind = None if tag.closes or tag.name in VOID else named_otherwise(tag, depth > 0)
        if kind and kind != "always" and tag.name in BREAKS and tag.partner is not None and tags[tag.partner].closes:
            # Judged by its lines, once they are known.
            inner = after(containers, here)
            boxes.append(Box(box, kind == "sure", tag.name == "section" and depth > 0, inner is not None and inner < tag.partner))
            ends[tag.partner], box = box, len(boxes) - 1
        elif kind and tag.name not in BREAKS and (piece := inline(here, tag.partner)) is not None:
            lines[-1].doubtful.append((len(lines[-1].parts), piece))
            at, i = tags[tag.partner].end, tag.partner + 1
            continue
        elif kind:
            nested = after(containers, i - 1)
            end = tag.partner
            if end is None:
                # Never closed: a footer, or raw text, takes the rest; others end where an article or another block starts.
                end = len(tags) if tag.name in ("footer", "script", "style") else nested if nested is not None else after(breaks, i - 1)
                end = len(tags) if end is None else end
                closed = False
            else:
                closed = tags[end].closes
                if nested is not None and nested < end and kind != "always":
                    continue  # it only wraps the article
            if end >= len(tags):
                at, i = len(page), len(tags)
            elif closed:
                at, i = tags[end].end, end + 1
            else:
                at, i = tags[end].start, end
            if tag.name in BREAKS or tag.name in RAW:
                new(WINDOW)
            continue
        if here in ends:
            box = ends[here]
        if here in nest_ends:
            nests[nest_ends[here]].last = len(lines) - 1
            nest = nests[nest_ends[here]].parent
        elif tag.name in BOXES | CONTAINERS and not tag.closes and tag.partner is not None and tags[tag.partner].closes:
            nests.append(Nest(nest, len(lines), 1 << 60))
            nest = nest_ends[tag.partner] = len(nests) - 1
        if tag.name == "a":
            link = 0 if tag.closes else 1
        if tag.name in CONTAINERS:
            depth = max(0, depth - 1) if tag.closes else depth + 1
            if not tag.closes:
                around = open_containers[-1] if open_containers else -1
                held.append(Container(around, tag.name == "article" or (around >= 0 and held[around].article)))
                open_containers.append(len(held) - 1)
            elif open_containers:
                open_containers.pop()
            new(WINDOW)
        elif tag.name in BREAKS:
            new(1 if tag.name in BOXES else 0)
            lines[-1].title = tag.name in TITLES and not tag.closes
    if at < len(page):
        lines[-1].parts.append(page[at:])
    return lines, held, boxes, nests


def without_boxes(lines: list[Line], boxes: list[Box], lengths: list[int]) -> set[int]:
    """The boxes that are no main text.

    A box goes if it is surely named, or is short or mostly links, and neither wraps an
    article nor holds most of the text of a page without one elsewhere. A section of an
    article goes by a doubtful name only if it is mostly links.
    """
    page, labelled = sum(lengths), 0
    for line, n in zip(lines, lengths):
        labelled += n if line.inside and line.box < 0 else 0
        if line.box >= 0:
            held = boxes[line.box]
            held.size, held.linked, held.longest = held.size + n, held.linked + min(n, line.linked), max(held.longest, n)
    for held in reversed(boxes):
        if held.parent >= 0:
            outer = boxes[held.parent]
            outer.size, outer.linked, outer.longest = outer.size + held.size, outer.linked + held.linked, max(outer.longest, held.longest)
    gone = set()
    for i, held in enumerate(boxes):
        links = held.linked >= LINKED * held.size
        dominant = not labelled and not links and held.longest >= SURGE and 2 * held.size > page
        wraps = held.holds_container and not (held.sure and labelled)
        looks = links or (held.longest < SURGE and not held.section)
        if held.parent in gone or not (wraps or dominant) and (held.sure or looks):
            gone.add(i)
    return gone


def closing_lines(lines: list[Line], texts: list[str]) -> list[int]:
    """The lines about rights, outside articles, that close the page."""
    found = []
    for i in range(len(lines) - 1, -1, -1):
        if lines[i].inside or len(texts[i]) > CLOSING:
            break
        if _RIGHTS.match(texts[i]):
            found.append(i)
    return found


def areas_of(lines: list[Line], lengths: list[int], containers: list[Container]) -> list[Area]:
    """The areas with text. An area runs from a surge, the first window with text, to the dive, the next one without."""
    sums, window = [], sum(lengths[:WINDOW])
    for i in range(len(lines)):
        sums.append(window)
        window += (lengths[i + WINDOW] if i + WINDOW < len(lines) else 0) - lengths[i]
    areas, part, lists = [], [], link_lists(lines, lengths, containers)
    for i, s in enumerate([*sums, 0]):
        # Windows look ahead, so an area may begin with blank lines. Containers end at blank lines, boxes may not.
        cut = part and (not s or (lengths[i] and (lines[i].container != lines[part[-1]].container or (i in lists) != (part[-1] in lists))))
        if cut:
            first = part[0]
            peak = max(sum(lengths[j : min(j + WINDOW, part[-1] + 1)]) for j in range(first, part[-1] + 1))
            areas.append(Area(part, peak, sum(lengths[j] for j in part), sum(min(lengths[j], lines[j].linked) for j in part), lines[first].container))
            part = []
        if s and lengths[i]:
            part.append(i)
    return areas


def link_lists(lines: list[Line], lengths: list[int], containers: list[Container]) -> set[int]:
    """The lines outside articles that lie in a run of lines of which each is a link: of three, or of two short ones."""
    found, run = set(), []
    for i, line in enumerate([*lines, None]):
        if line is not None and not lengths[i]:
            continue
        linked = line is not None and line.linked >= lengths[i] and not (line.container >= 0 and containers[line.container].article)
        if linked:
            run.append(i)
            continue
        if len(run) >= LINK_LINES or (len(run) >= SHORT_LINKS and all(lengths[k] <= SHORT_LINK for k in run)):
            found.update(run)
        run = []
    return found


def chosen(areas: list[Area], containers: list[Container]) -> set[int]:
    """The positions of the areas that are main text."""

    def in_article(a: Area) -> bool:
        return a.container >= 0 and containers[a.container].article

    # The outermost article of each.
    outer = [c.parent if c.parent >= 0 and containers[c.parent].article else i for i, c in enumerate(containers)]
    for i, c in enumerate(outer):
        outer[i] = c if c == i else outer[c]
    # In an article a link or two are part of the text, a list of links is not.
    unlinked = [i for i, a in enumerate(areas) if a.linked < LINKED * a.size or (in_article(a) and len(a.lines) < LINK_LINES)]
    best = max((areas[i].peak for i in unlinked if not in_article(areas[i]) or areas[i].linked < LINKED * areas[i].size), default=0)
    high = [i for i in unlinked if areas[i].peak >= max(min(SURGE, best), SHARE * best) and areas[i].linked < LINKED * areas[i].size]

    articles: dict[int, int] = {}
    linking = {outer[a.container] for a in areas if in_article(a) and a.linked}
    for i in unlinked:
        if in_article(areas[i]):
            top = outer[areas[i].container]
            articles[top] = articles.get(top, 0) + areas[i].size
    most = max(articles.values(), default=0)
    outside = [i for i in high if not in_article(areas[i])]
    rest = sum(areas[i].size for i in outside)
    if most and most * EVIDENCE >= rest:
        # A short article besides the largest counts if it links to nothing, as teasers do.
        tops = {top for top, size in articles.items() if size >= SHARE * most or (top not in linking and size >= SURGE)}
        won = {i for i in unlinked if in_article(areas[i]) and outer[areas[i].container] in tops}
        around = {containers[outer[areas[i].container]].parent for i in won}
        # Text beside an article within its main element belongs to it if it is high enough.
        return won | {i for i in outside if areas[i].container >= 0 and areas[i].container in around}
    in_main = [i for i in outside if areas[i].container >= 0]
    held = sum(areas[i].size for i in in_main)
    if held and held * EVIDENCE >= rest - held:
        return set(in_main)
    return set(outside)


def neighbours(areas: list[Area], kept: set[int], lines: list[Line], nests: list[Nest], containers: list[Container]) -> set[int]:
    """The short areas that belong to the kept ones.

    They are not mostly links, are in the same article or main element (if any), and lie
    between kept areas or next to them, in the element that holds the kept area or in one
    beside it; before the text all such in a row, after it one beside and all in the same
    element. A title right before a text without one belongs to it wherever it is nested.
    """

    def holder(a: Area) -> int:
        nest = lines[a.lines[0]].nest
        while nest >= 0 and nests[nest].last < a.lines[-1]:
            nest = nests[nest].parent
        return nest

    def lies_in(a: Area, nest: int) -> bool:
        return nest < 0 or (nests[nest].first <= a.lines[0] and a.lines[-1] <= nests[nest].last)

    def beside(k: int, main: int) -> bool:
        a, m = areas[k], areas[main]
        nest = holders[main]
        return a.linked < LINKED * a.size and a.container == m.container and lies_in(a, nests[nest].parent if nest >= 0 else -1)

    def wraps(outer: int, inner: int) -> bool:
        while inner >= 0 and inner != outer:
            inner = containers[inner].parent
        return inner == outer

    found, order = set(), sorted(kept)
    holders = {k: holder(areas[k]) for k in order}
    for x, y in zip(order, order[1:]):
        found.update(k for k in range(x + 1, y) if beside(k, x) or beside(k, y))
    if order:
        first, last = order[0], order[-1]
        k = first - 1
        while k >= 0 and beside(k, first):
            found.add(k)
            k -= 1
        titled = any(lines[i].title for a in [*range(k + 1, first), *order] for i in areas[a].lines)
        if k >= 0 and not titled and areas[k].linked < LINKED * areas[k].size and wraps(areas[k].container, areas[first].container):
            if any(lines[i].title for i in areas[k].lines):
                found.add(k)
        k = last + 1
        while k < len(areas) and beside(k, last):
            found.add(k)
            if not lies_in(areas[k], holders[last]):
                break
            k += 1
    return found


def main_text(page: str | None) -> str:
    """The main text of a page; empty for none."""
    if not page:
        return ""
    lines, containers, boxes, nests = lines_of(page)
    texts = [line.text() for line in lines]
    lengths = [len(t) for t in texts]
    if boxes:
        gone = without_boxes(lines, boxes, lengths)
        texts = ["" if line.box in gone else t for line, t in zip(lines, texts)]
        lengths = [len(t) for t in texts]
    for i in closing_lines(lines, texts):
        texts[i], lengths[i] = "", 0
    areas = areas_of(lines, lengths, containers)
    kept = chosen(areas, containers)
    kept |= neighbours(areas, kept, lines, nests, containers)
    return " ".join(texts[i] for k, area in enumerate(areas) if k in kept for i in area.lines)


def extracted(page: Column) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return extract(page)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and ``n_chars``, its code points.

    Blocks come in page order, joined by one space; white space within a block becomes one
    space and character references are decoded. A null or empty page, or one without main
    text, has an empty text. Repeated rows are extracted each for itself. Input columns
    named text or n_chars are replaced.
    """
    own = columns_of(pages, "text", "n_chars")
    found = pages.select(*own, extracted(quoted(html)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
