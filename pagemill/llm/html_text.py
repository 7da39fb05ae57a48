"""Main text of pages by line-block distribution: strip markup, sum text lengths over sliding windows of
lines, locate where the sums surge and where they dive, and keep the text between.

A line is the text of one block. Markup is stripped with what never is article text (scripts, styles, menus,
forms, adverts, reader comments and the like, known by tag, role, class or id), and such text leaves a
line of length 0. A class or id inside ``article`` or ``main`` counts as a whole or as a compound (``ad-slot``, ``post-comments``), elsewhere by each of its words; it
doesn't count on a heading, as the id of a section that begins with a heading, nor on an element that holds over half
of the text of its ``article`` or ``main``, or of a page whose text is in neither. Link text has length 0.
A surge is a window of ``width`` lines longer than ``threshold`` (or a quarter of the page's longest window,
if that is less) and a dive is a window of length 0: the text between is a region. Removed elements separate no
regions, and regions with texts in the same container are joined, with all of that container from its first text to its
last; those of more link text than other text are dropped, except the longest. All ``article`` elements, then all ``main`` elements, take the place of the regions if
their text is half as long at least as that of the later ones and of the longest region; so teasers don't.
Of an ``article`` or ``main`` every line stays that is in no removed element, links too.

Defined results: null, empty and text-free pages give an empty text; any input is read to its end, unclosed
tags end with their parents (script and style with the page, head at the first tag or text that can't be in it); repeated rows and null ids are rows like any other; an empty table gives an
empty result; extra columns pass through and lose to the added names.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare

WIDTH, THRESHOLD = 3, 86

# fixed values: elements whose content is no text, elements that are no article text, block elements, void elements
RAW = set("script style noscript template svg math iframe object canvas audio video textarea select title head".split())
AWAY = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "fieldset", "header"}
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul
caption button""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "note"}
HINTS = set("""ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promoted promotion banner cookie
cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login popup modal overlay share sharing
social related recommended recommendations trending breadcrumb breadcrumbs pagination pager nav navbar navigation menu topbar toolbar
masthead header footer sidebar sidebars aside widget widgets comment comments discussion disqus respond reply replies copyright colophon
skip toc""".split())
READERS = {"comment", "comments", "disqus", "respond", "reply", "replies"}  # hints that hold with a heading too
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# what adverts, share links, subscriptions and readers' comments end with in a compound name, and what a name that begins with a hint goes on with
STRONG = set("""ad ads advert adverts advertisement advertising adsense sponsor sponsors sponsored promo newsletter comments disqus popup signup
subscribe subscription cookie cookies share sharing sidebar breadcrumb breadcrumbs pagination""".split())
BOXES = set("""area articles bar block box button buttons card container content form group icon icons inner item items link links list message
panel posts section slot stories unit wrap wrapper zone""".split())
OWN = {"article", "post", "entry", "story", "content"}  # whose header is a part of the text
# an element that goes always, one that a class or id hints at, one that only an id hints at
HARD, HINT, ID_HINT = 1, 2, 3
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "select"}
# elements that hold blocks of their own (rather than one text's parts)
HOLDERS = {"html", "body", "div", "section", "td", "center", "article", "main", "form", "fieldset", "details", "dialog", "aside"}
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
# HTML elements that end an unclosed svg or math, and elements inside those that hold HTML again
BREAKOUT = set("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p
pre ruby s small span strong strike sub sup table tt u ul var article section main aside header footer nav figure""".split())
HTML_AGAIN = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"""
    r"""|<(/?)([a-z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S | re.I)
# elements whose content is no markup, with what ends them: the end tag, or (group 1) a tag that shows it is missing
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in ("script", "style")} | {
    t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>|(<{t}(?=[\s/>])|</?(?:head|body|html)(?=[\s/>]))", re.I) for t in ("title", "textarea", "iframe")}
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def compound(name: str) -> str | None:
    """The hint in a class or id of several words: at its begin, with nothing but hints and boxes after it, or a strong one at its end."""
    words = [w.lower() for w in WORDS.findall(name)] if ":" not in name else []
    if len(words) < 2 or words[0] in ("with", "has", "no"):
        return None
    if words[0] in HINTS and words[0] != "header" and all(w in HINTS or w in BOXES for w in words[1:]):
        return words[0]
    return words[-1] if words[-1] in STRONG else None


def unwanted(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element is no article text by its own tag, role, class, id or style; inside an article or main, a
    class or id hints at that as a whole, or as a compound of hints."""
    if tag in AWAY:
        return HARD
    if not attributes or tag in ("html", "body"):
        return 0
    found = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
        if name in ("class", "id"):
            whole = value.lower().split()
            if "hidden" in whole:
                found = HINT
                continue
            if tag in HEADINGS or found == HINT:
                continue
            if inside:
                hints = HINTS.intersection(whole) or {h for h in map(compound, value.split()) if h}
            else:
                words = [w.lower() for w in WORDS.findall(value)]
                hints = {w for before, w in zip(["", *words], words, strict=False)
                         if w in HINTS and before not in ("with", "has", "no") and not (w == "header" and before in OWN)}
            if hints:
                found = ID_HINT if name == "id" and not hints & READERS else HINT
    return found


class Skipped:
    """The open elements from one on whose content is no text; it ends with its end tag, its parent, or a tag that can't be in it."""

    def __init__(self):
        self.tags: list[str] = []
        self.count: Counter = Counter()

    def open(self, tag):
        self.tags.append(tag)
        self.count[tag] += 1

    def clear(self):
        self.tags.clear()
        self.count.clear()

    def at_head(self) -> bool:
        return self.tags[:1] == ["head"] and (len(self.tags) == 1 or self.tags[1:] == ["title"])

    def holds(self, tag: str, closing: bool, selfclosed: bool, opened: Counter) -> bool:
        """Whether a tag belongs to the skipped element (which is kept up to date); if not, that element has ended."""
        foreign = self.tags[0] in ("svg", "math")
        if closing:
            if self.count[tag]:
                while True:
                    last = self.tags.pop()
                    self.count[last] -= 1
                    if last == tag:
                        return True
            if not opened[tag]:
                return True  # closes nothing
        elif not (tag not in HEAD if self.at_head() else foreign and tag in BREAKOUT and not any(self.count[t] for t in HTML_AGAIN)):
            if tag not in VOID and not (foreign and selfclosed):
                self.open(tag)
            return True
        self.clear()
        return False


class Element:
    __slots__ = ("tag", "bad", "core", "first", "title", "named", "above", "holder", "home", "headed", "to")

    def __init__(self, tag, bad, first, above):
        self.tag, self.bad, self.first, self.to = tag, bad, first, first
        self.above = above.holder if above else None  # the holder of blocks that it lies in
        self.holder = self if tag in HOLDERS else self.above
        self.home = above and (above if above.named else above.home)  # the article or main that it lies in
        self.headed = False  # begins with a heading
        self.core = False  # holds an article
        self.title = False  # holds a heading of the first rank
        self.named = tag in ("article", "main") and not bad


class Page(NamedTuple):
    lines: list[str]
    lengths: np.ndarray  # without links, white space and removed elements
    linked: np.ndarray  # lengths of link text, the same way
    holders: list[Element | None]
    removed: np.ndarray  # whether a line is in a removed element
    within: dict[str, np.ndarray]  # whether it is in an article, and in a main


def lines_of(html: str) -> Page:
    texts: list[list[str]] = [[]]
    plain: list[int] = [0]
    linked: list[int] = [0]
    holders: list[Element | None] = [None]
    stack: list[Element] = []
    away: list[Element] = []  # unwanted elements
    core: list[tuple[int, int, str]] = []
    link = 0
    skipped = Skipped()
    opened: Counter = Counter()  # open elements by tag, outside the skipped one
    endless: set[str] = set()  # raw elements with no end tag from here on

    def cut():
        nonlocal link
        if texts[-1]:
            texts.append([])
            plain.append(0)
            linked.append(0)
            holders.append(None)

    def close(e: Element):
        opened[e.tag] -= 1
        e.to = len(texts) - (not texts[-1])
        if e.bad and not e.core and not (e.tag == "header" and e.title and e.home):
            if not (e.bad == ID_HINT and e.tag == "section" and e.headed):  # the id of a heading's section
                away.append(e)
        elif e.named:
            core.append((e.first, e.to, e.tag))
            for x in stack:
                x.core = True

    at = 0
    while at < len(html):
        m = TOKEN.search(html, at)
        start = m.start() if m else len(html)
        if start > at:
            if skipped.tags == ["head"] and html[at:start].strip():
                skipped.clear()
            if not skipped.tags:
                add(texts[-1], linked if link else plain, html[at:start])
                if holders[-1] is None and stack:
                    holders[-1] = stack[-1].holder
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        selfclosed = attributes.endswith("/")
        if not closing and tag in ENDS and not (selfclosed and skipped.tags[:1] in (["svg"], ["math"])):
            end = None if tag in endless else ENDS[tag].search(html, at)
            if end is None and tag in ("script", "style"):
                break
            if end is not None and not (tag not in ("script", "style") and end[1]):
                at = end.end()
                continue
            if end is None:
                endless.add(tag)
        if skipped.tags and skipped.holds(tag, closing, selfclosed, opened):
            continue
        if closing:
            if tag == "a":
                link = 0
            if tag in BLOCK:
                cut()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        if stack[-1].tag in BLOCK or stack[-1].bad:
                            cut()
                        close(stack.pop())
                    break
            else:
                opened[tag] = max(0, opened[tag] - 1)
            continue
        if tag in RAW:
            if not (selfclosed and (tag in ("svg", "math") or re.search(r"""(?:^|[\s"'])/$""", attributes))):
                skipped.open(tag)
            continue
        if tag in BLOCK:
            cut()
            ends = CLOSES.get(tag, set()) | ({"p"} if tag not in ("td", "th", "tr") else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ends:
                    while len(stack) > k:
                        close(stack.pop())
                elif stack[k].tag in BLOCK and stack[k].tag != "p":
                    break
        if tag == "br":
            texts[-1].append(" ")
        if tag == "h1":
            for x in stack:
                x.title = True
        if tag in HEADINGS:
            for x in reversed(stack):
                if x.headed or x.first < len(texts) - 1:
                    break
                x.headed = True
        if tag in VOID:
            continue
        if tag == "a":
            link = 1
        bad = unwanted(tag, attributes, bool(stack) and (stack[-1].named or stack[-1].home is not None))
        if bad:
            cut()
        if tag in BLOCK or bad:
            link = 0 if tag in BLOCK else link
            stack.append(Element(tag, bad, len(texts) - 1, stack[-1] if stack else None))
        opened[tag] += 1
    while stack:
        close(stack.pop())
    lines = [" ".join(unescape("".join(t)).split()) for t in texts]
    removed = np.zeros(len(lines), bool)
    within = {kind: np.zeros(len(lines), bool) for kind in ("article", "main")}
    for first, to, kind in core:
        within[kind][first:to] = True
    lengths = np.array(plain)
    always = [e.bad == HARD and (e.tag in AWAY or not e.title) for e in away]
    for e, hard in zip(away, always, strict=True):
        if hard:
            removed[e.first : e.to] = True
    held = np.concatenate([[0], np.cumsum(np.where(removed, 0, lengths))])  # before each line
    named = np.concatenate([[0], np.cumsum(np.where(removed | ~(within["article"] | within["main"]), 0, lengths))])
    for e, hard in zip(away, always, strict=True):
        if not hard:
            size = held[e.to] - held[e.first]
            around = held[e.home.to] - held[e.home.first] if e.home else held[-1]
            if 2 * size > around and (e.home or e.title or not named[-1]):
                continue  # a class on the wrapper of the whole text
            removed[e.first : e.to] = True
    lengths[removed] = 0
    return Page(lines, lengths, np.where(removed, 0, linked), holders, removed, within)


def add(texts: list[str], lengths: list[int], text: str) -> None:
    if text.strip():
        texts.append(text)
        lengths[-1] += len("".join(text.split()))
    elif texts:
        texts.append(" ")


def regions(lengths: list[int], width: int, threshold: float) -> list[tuple[int, int]]:
    """Lines from each surge to the dive that follows, by sums over ``width`` lines."""
    n = len(lengths)
    sums = [sum(lengths[i : i + width]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if sums[i] > threshold and lengths[i]:
            end = i
            while end < n and sums[end]:
                end += 1
            out.append((i, end))
            i = end
        else:
            i += 1
    # the window that surges begins before the long line: take the shorter lines right before it, headings mostly
    grown = []
    for a, b in out:
        while a > (grown[-1][1] if grown else 0) and lengths[a - 1]:
            a -= 1
        grown.append((a, b))
    return grown


def main_text(html: str | None, width: int = WIDTH, threshold: int = THRESHOLD) -> str:
    if not html:
        return ""
    page = lines_of(html)
    kept = chosen(page, *located(page, width, threshold))
    return "\n".join(x for x, ok in zip(page.lines, kept, strict=True) if ok and x)


def located(page: Page, width: int, threshold: int) -> tuple[np.ndarray, int]:
    """The lines of the joined regions, and the text length of the longest of them."""
    at = np.flatnonzero(~page.removed)  # removed elements separate nothing
    lengths, linked = page.lengths[at].tolist(), page.linked[at].tolist()
    holders = [page.holders[i] for i in at]
    kept = np.zeros(len(page.lines), bool)
    surge = min(threshold, max((sum(lengths[i : i + width]) for i in range(len(lengths))), default=0) / 4)
    group: dict[Element | None, int] = {}  # the regions by the holders of their texts
    found = regions(lengths, width, surge)
    joined = list(range(len(found)))

    def top(k: int) -> int:
        while joined[k] != k:
            joined[k] = k = joined[joined[k]]
        return k

    for k, (a, b) in enumerate(found):
        texts: Counter = Counter()
        for i in range(a, b):
            texts[holders[i]] += lengths[i]
        most = max(texts.values())
        for h, n in texts.items():
            if n > surge or n == most:
                joined[top(k)] = joined[k] = top(group.setdefault(h, k))
    owners: dict[Element | None, int | None] = {h: top(k) for h, k in group.items()}

    def owner(h: Element | None) -> int | None:
        """The joined regions that hold texts right in a holder or in one around it, other than the body."""
        path = []
        while h not in owners and h is not None:
            path.append(h)
            h = h.above
        of = owners.get(h) if not path or h is not None and h.tag not in ("html", "body") else None
        owners.update((x, of) for x in path)
        return of

    of = [owner(h) for h in holders]
    for k, (a, b) in enumerate(found):
        of[a:b] = [top(k)] * (b - a)
    first, last = {}, {}
    for i, n in enumerate(of):
        if n is not None and lengths[i]:
            first.setdefault(n, i)
            last[n] = i
    total, links = Counter(), Counter()
    for i, n in enumerate(of):
        if n is not None and first[n] <= i <= last[n]:
            total[n] += lengths[i]
            links[n] += linked[i]
    longest = max(total.values(), default=0)
    for i, n in enumerate(of):
        if n is not None and first[n] <= i <= last[n] and (links[n] <= total[n] or total[n] == longest):
            kept[at[i]] = True
    return kept, longest


def chosen(page: Page, kept: np.ndarray, longest: int) -> np.ndarray:
    """The lines of all articles, of main, or ``kept`` ones of the regions: the first of these with half of the text at least that a later one has."""
    named = [page.within[kind] & ~page.removed for kind in ("article", "main")]
    named = [lines if any(page.lines[i] for i in np.flatnonzero(lines)) else None for lines in named]
    sizes = [0 if lines is None else int(page.lengths[lines].sum()) for lines in named]
    for k, lines in enumerate(named):
        if lines is not None and 2 * sizes[k] >= max(longest, *sizes[k + 1 :], 0):
            return lines
    return kept


def extract(pages: DataFrame, *, html: str = "html", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars`` (code points)."""
    prepare(pages.sparkSession)
    rows = pages.select(*[c for c in pages.columns if c not in (html, "text", "n_chars")], F.col(html).alias("__html"))

    def run(batches):
        for batch in batches:
            k = batch.num_columns - 1
            texts = [main_text(x.as_py(), width, threshold) for x in batch.column(k)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string()), sizes],
                                             names=[*batch.schema.names[:k], "text", "n_chars"])

    return rows.mapInArrow(lean(run), rows.drop("__html").schema.add("text", "string").add("n_chars", "long"))
