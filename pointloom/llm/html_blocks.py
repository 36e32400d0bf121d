"""Main text of HTML pages by two passes over their blocks.

Block-level elements cut a page into blocks.  The first pass decides what is clear: blocks under an
element that says what it is (navigation, footer, form, advert, comments, by tag, role or class) are
bad, blocks of links are bad, long blocks with the stop words of running text are good.  The second
pass gives each block still open, mostly short ones, the label of its nearest decided neighbour; a
heading takes that of what follows.  Where a page marks its article (``main``, ``article``), blocks
outside it are bad, and inside only links and marked elements are.

The good blocks in page order are the text: character references decoded, white space (line breaks
too) turned into one space, blocks joined by a line feed.

Each row stands alone: one pass, no exchange, and time in proportion to the page.  A null or empty page
has an empty text; repeated rows and null ids or urls are kept; long pages are read whole; extra
columns are not read; an empty table gives an empty result.  Broken markup is read as browsers do:
unclosed elements end with what holds them, stray end tags count for nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all an and are as at be been but by can for from had has have he her his if in into is it its not of on or our she so that the their there they this to was we were which who will with you "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für hat im ist mit nach nicht noch oder sich sie sind und von vor war wie zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella ese esta este fue ha hay las lo los más muy no para pero por sin sobre su sus también uno y ya".split()
)
#: Element names of the HTML standard by what they mean here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
UNSEEN = frozenset("noscript template svg canvas object audio video select datalist button".split())
NO_CONTENT = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FRAMES = frozenset("nav footer aside dialog menu fieldset legend".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id that mark what isn't the article, and those of its readers' comments.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar widget related recommended menu nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social toolbar pagination pager disclaimer paywall search".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies respond reactions".split())
#: With these a class name describes a layout or the article's own heading, and marks nothing.
LAYOUT = frozenset("has with no layout".split())
OWN_HEADER = frozenset("article post entry content story".split())
AD_LABELS = frozenset(("advertisement", "advertisements", "anzeige", "werbung", "publicité", "publicidad", "sponsored"))

#: An opening or closing tag, a comment or a declaration; a quote matters only after an equals sign.
TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>?|/(?![a-zA-Z])[^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))|(?<=\s)(hidden)(?=[\s/=]|\Z)""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LETTERS = re.compile(r"[^\W\d_]+")

#: What an element says about the blocks in it.
NOTHING, ARTICLE, SOFT, HARD, NEVER = range(5)


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass: characters of a block, shares of its characters or words."""

    short: int = 70
    links: float = 0.5
    stop_good: float = 0.25
    stop_bad: float = 0.05
    #: A page with a smaller share of stop words is in a language without a list; length and links decide.
    listed: float = 0.05
    #: A marked element without an article in it that holds a larger share of the page's text is the page.
    most: float = 0.6


@dataclass
class Block:
    text: str
    element: int
    heading: str | None
    links: float
    stop: float = 0.0
    label: bool | None = None
    #: Its own text decided, not what an element says: only such labels are inherited.
    by_text: bool = False


def mark(name: str, attributes: str) -> int:
    """What an element's name, role, class and id say."""
    role, words = "", set()
    for m in ATTRIBUTE.finditer(attributes):
        if m[5]:
            return NEVER
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role":
            role = value.strip().lower()
        elif key == "style":
            if "display:none" in re.sub(r"\s", "", value).lower():
                return NEVER
        elif name not in ("html", "body"):
            for token in value.split():
                parts = {p.lower() for p in PART.findall(token)}
                if parts & COMMENTS:
                    return HARD
                if not parts & LAYOUT:
                    words |= parts - {"header"} if parts & OWN_HEADER else parts
    if role in ("main", "article"):
        return ARTICLE
    if name in FRAMES or role in FRAME_ROLES:
        return HARD
    if words & MARKS:
        return SOFT
    if name in ("main", "article"):
        return ARTICLE
    return SOFT if name in ("form", "header") else NOTHING


class Page:
    """Blocks of one page, and its elements: parent, mark and characters of text in them."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.names, self.parents, self.marks, self.sizes = ["#page"], [-1], [NOTHING], [0]
        self._stack, self._open = [0], Counter()
        self._unseen, self._link = 0, None
        self._runs: list[str] = []
        self._link_chars = 0
        self._parse(html)

    def _text(self, run: str) -> None:
        if self._unseen or not run:
            return
        run = unescape(run) if "&" in run else run
        self._runs.append(run)
        if self._link is not None:
            self._link_chars += sum(map(len, run.split()))

    def _flush(self) -> None:
        if not self._runs:
            return
        words = "".join(self._runs).split()
        if words:
            text, at = " ".join(words), self._stack[-1]
            chars = len(text) - len(words) + 1
            heading = next((self.names[e] for e in self._stack[:-4:-1] if self.names[e] in HEADINGS), None)
            self.blocks.append(Block(text, at, heading, self._link_chars / chars))
            self.sizes[at] += len(text)
        self._runs, self._link_chars = [], 0

    def _pop(self) -> None:
        e = self._stack.pop()
        self._open[self.names[e]] -= 1
        self._unseen -= self.marks[e] == NEVER
        if self._link is not None and len(self._stack) < self._link:
            self._link = None

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text(" ")
            return
        if name == "a":
            self._link = len(self._stack)
            return
        says = NEVER if name in UNSEEN else mark(name, attributes) if attributes or name in BLOCKS else NOTHING
        if name not in BLOCKS and says != NEVER:
            return
        if name in BLOCKS:
            self._flush()
            if self.names[self._stack[-1]] == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option") and self.names[self._stack[-1]] == name:
                self._pop()
        if name in NO_CONTENT:
            return
        self.names.append(name)
        self.parents.append(self._stack[-1])
        self.marks.append(says)
        self.sizes.append(0)
        self._stack.append(len(self.names) - 1)
        self._open[name] += 1
        self._unseen += says == NEVER

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = None
        elif name == "br":
            self._text(" ")
        elif self._open[name] > 0:
            if name in BLOCKS:
                self._flush()
            while self.names[self._stack[-1]] != name:
                self._pop()
            self._pop()
        elif name in BLOCKS:
            self._flush()

    def _parse(self, html: str) -> None:
        at = 0
        while m := TAG.search(html, at):
            self._text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
            elif name in RAW:
                end = RAW_END[name].search(html, at)
                at = end.start() if end else len(html)
            else:
                self._start(name, m[3])
        self._text(html[at:])
        self._flush()


def article_of(page: Page, rules: Rules) -> tuple[list[bool], list[bool], bool]:
    """For each element whether its blocks are bad by what it says, whether they lie in the article,
    and whether the page has a marked article at all."""
    n, parents, marks = len(page.names), page.parents, page.marks
    holds, inside = list(page.sizes), [False] * n
    for e in range(n - 1, 0, -1):
        holds[parents[e]] += holds[e]
    framed = [False] * n
    for e in range(1, n):
        framed[e] = framed[parents[e]] or marks[e] == HARD or (marks[e] == SOFT and page.names[e] != "form")
    mains = [e for e in range(1, n) if page.names[e] == "main" and not framed[e] and marks[e] == ARTICLE]
    roots = mains or [e for e in range(1, n) if marks[e] == ARTICLE and not framed[e] and holds[e]]
    if not roots:  # an article inside of something marked: what was marked holds more than it says
        roots = [e for e in range(1, n) if marks[e] == ARTICLE and holds[e] > rules.most * max(1, holds[0])][:1]
    above = set()
    for e in roots:
        inside[e] = True
        while e >= 0 and e not in above:
            above.add(e)
            e = parents[e]
    bad = [False] * n
    for e in range(1, n):
        inside[e] = inside[e] or inside[parents[e]]
        own = marks[e] == HARD or marks[e] == SOFT
        if marks[e] == SOFT:
            # the article's own header, and marks that hold the whole page, say nothing
            own = not (page.names[e] == "header" and inside[e]) and (bool(roots) or holds[e] <= rules.most * holds[0])
        bad[e] = bad[parents[e]] or (own and e not in above)
    return bad, inside, bool(roots)


def first_pass(page: Page, rules: Rules) -> tuple[list[bool], list[bool], bool]:
    """Labels every block that is clear: True good, False bad, None open."""
    bad, inside, marked = article_of(page, rules)
    hits = total = 0
    for b in page.blocks:
        words = LETTERS.findall(b.text.lower())
        stop = sum(w in STOP_WORDS for w in words)
        b.stop = stop / len(words) if words else 0.0
        hits, total = hits + stop, total + len(words)
    listed = hits >= rules.listed * max(1, total)
    for b in page.blocks:
        long, own = len(b.text) >= rules.short, inside[b.element]
        if bad[b.element] or b.text.lower().strip(" :.-") in AD_LABELS:
            b.label = False
        elif marked and not own:
            b.label = None if b.heading == "h1" else False
        elif b.links > rules.links:
            b.label = None if b.heading and own else False
        elif long and (b.stop >= rules.stop_good or not listed):
            b.label = not ("©" in b.text and len(b.text) < 3 * rules.short and not own)
        elif not own and (long and b.stop < rules.stop_bad or "©" in b.text):
            b.label = False
        b.by_text = b.label is not None and not bad[b.element] and (own or not marked)
    return bad, inside, marked


def second_pass(page: Page, inside: list[bool]) -> None:
    """Gives open blocks the label of the nearest one that its text decided (good, where a good and a bad
    one are equally near, or where nothing is decided).  In the article, links decide about headings only."""
    blocks = page.blocks
    n = len(blocks)

    def nearest(order: range, counts) -> list[tuple[int, bool] | None]:
        out, last = [None] * n, None
        for i in order:
            out[i] = last
            if counts(blocks[i]):
                last = (i, blocks[i].label)
        return out

    decided = lambda b: b.by_text
    before, after = nearest(range(n), decided), nearest(range(n - 1, -1, -1), decided)
    found = []
    for i, b in enumerate(blocks):
        if b.label is not None:
            found.append(b.label)
        elif inside[b.element]:
            follows = after[i] if b.heading and b.heading != "h1" else None
            found.append(not (follows and not follows[1] and inside[blocks[follows[0]].element]))
        else:
            near = [x for x in ((after[i],) if b.heading and after[i] else (before[i], after[i])) if x]
            least = min((abs(x[0] - i) for x in near), default=0)
            found.append(not near or any(x[1] for x in near if abs(x[0] - i) == least))
    for b, label in zip(blocks, found):
        b.label = label


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    _, inside, _ = first_pass(page, rules)
    second_pass(page, inside)
    return "\n".join(b.text for b in page.blocks if b.label)


def extracted(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py(), rules) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
