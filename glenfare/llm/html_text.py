"""HTML extraction (operator 7): two-pass block rules.

A page is cut into blocks at block-level tags.  First pass: a block inside
boilerplate containers, or mostly links, is bad; one that is long enough and
has the stop-word density of prose is good; the rest is ambiguous.  Second pass:
an ambiguous block takes the label that its nearest decided neighbours agree
on; where they differ the nearer one counts, and at equal distance bad does.  The
edges of the page count as bad.  Inside an article (or main) element only good
blocks and its own edges, which are good, are neighbours, so a share bar does not
take the paragraph beside it along.

Class words about a page's layout (sidebar, menu and the like) can stand on a
wrapper around the article: where no other article or main element is to be seen, one inside such a
wrapper is good all the same.  A page without articles whose words are hardly ever stop words is in a
language that STOP_WORDS does not serve: there, long blocks with few links are good.

A page is one row and needs no other, so this is one map over the table.

Raw text (scripts, styles and the like) ends at its own end tag alone, whatever
looks like a tag in its code.  A head ends at its end tag, at text or at the first
tag that cannot stand in one, an option at the next tag, as their end tags may be
left out; other skipped elements without an end tag skip nothing.

Edge cases: null or empty html gives an empty text; unclosed or stray tags,
comments and scripts end with the page; references are decoded once; repeated
rows each get their answer; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glenfare.llm.common import ship, small_batches, table

#: Parameters of the first pass.
MAX_LINK_DENSITY, MIN_STOP_DENSITY, MIN_WORDS = 0.4, 0.12, 10
#: A page with a smaller share of stop words is in another language; there, characters that count as MIN_WORDS words.
MAX_FOREIGN, MIN_CHARS = 0.02, 60

#: Frequent function words of the languages served.
STOP_WORDS = frozenset("""
a an and are as at be but by for from had has have he her his i in is it its not of on or she so that the their them
they this to was we were what which who will with you
au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes moi ne nous on ou par
pas pour qu que qui sa se ses son sur ta te tu un une vos vous
aber als am auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer es für
hat ich ihr im ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wenn wie wir zu
zum zur
al como con cuando del desde el ella entre era eran es esta este ha hay la las lo los más mi muy nada ni no nos para
pero por que se ser si sin sobre son su sus también te todo un una uno y ya
""".split())
#: Elements whose content is never text of the article.
SKIPPED = frozenset("script style noscript template title svg math iframe object textarea select option button "
                    "audio video canvas map".split())
#: Elements without markup inside, and the tags that can stand in a head.
RAW = frozenset("script style title textarea iframe".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset("""
address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td
tfoot th thead tr ul
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class or id that mark boilerplate, and roles that do.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|footer|gdpr|"
                   r"masthead|menu|modal|nav\w*|newsletter|notices?|pager|pagination|popup|promo\w*|related|reply|replies|"
                   r"respond|share|sharing|sidebar|side-bar|skip|social|sponsor\w*|subscribe|tags|toolbar|widget\w*)"
                   r"(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())

#: Class words about a page's layout, which can also stand on a wrapper around its article.
LAYOUT = re.compile(r"(?:banner|cookies?|consent|disclaimer|footer|gdpr|masthead|menu|modal|nav\w*|notices?|pager|pagination|popup|"
                    r"share|sharing|sidebar|side-bar|skip|social|subscribe|tags|toolbar|widget\w*)\Z", re.I)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
                 r"|<[/a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in SKIPPED}


def marked(tag: str, attributes: str) -> bool | str:
    """The start tag opens boilerplate, by its name, class, id, role or because it is hidden; "layout"
    where only class words about the page's layout say so."""
    if tag in BOILERPLATE:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    found: bool | str = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and (words := MARKS.findall(value)):
            if not all(LAYOUT.match(w.strip(" \t\n\r\f_-")) for w in words):
                return True
            found = "layout"
        if name == "role" and value.lower() in ROLES or name == "hidden" or \
                name == "aria-hidden" and value.lower() == "true" or \
                name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return found


class Blocks:
    """The blocks of a page: [text, characters of link text, bad, inside an article].

    ``open_layout``: an article or main element is good though class words of layout
    mark a wrapper around it.  ``wrapped`` tells that there is one."""

    def __init__(self, html: str, open_layout: bool = False):
        self.open_layout, self.wrapped = open_layout, False
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, bool | str, list]] = []  # open elements: name, boilerplate, what it suspends
        self.open: Counter[str] = Counter()  # how many of each name
        self.layout = 0  # open elements that are bad by layout words
        self.bad = self.article = self.links = self.articles = 0
        at, next_at, skip, head = 0, 0, None, False
        unclosed: set[str] = set()  # names without a further end tag
        while m := TAG.search(html, next_at):
            tag, end, next_at = (m[2] or "").lower(), m[1] == "/", m.end()
            starts = bool(tag) and not end and not m[3].endswith("/")
            if starts and tag in RAW:  # up to its own end tag
                closed = END[tag].search(html, next_at)
                next_at = closed.end() if closed else len(html)
            if skip == "option" and tag:
                skip, at = None, m.start()
            if skip:
                if end and tag == skip:
                    skip, at = None, next_at
                continue
            between = html[at:m.start()]
            at = next_at
            if head and (between.strip() or tag and not end and tag not in IN_HEAD):
                head = False
            if not head:
                self.text(between)
            if tag == "head":
                head = not end
            elif not tag or starts and tag in RAW:
                continue
            elif end:
                self.close(tag)
            elif tag not in SKIPPED:
                self.open_tag(tag, m[3])
            elif starts and tag not in unclosed:
                if tag == "option" or END[tag].search(html, next_at):
                    skip = tag
                else:
                    unclosed.add(tag)
        rest = html[at:]
        if not skip and (not head or rest.strip()):
            self.text(rest)
        self.flush()

    def text(self, s: str) -> None:
        if s:
            self.parts.append(s)
            if self.links:
                self.linked += len(s)

    def flush(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            if "&" in text:
                text = unescape(text)
            text = SPACE.sub(" ", text).strip()
            if text:
                self.blocks.append((text, self.linked, self.bad > 0, self.articles if self.article else 0))
        self.parts, self.linked = [], 0

    def open_tag(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            if self.links:  # links do not hold blocks open
                self.links = 0
            if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and self.stack and self.stack[-1][0] == tag:
                self.pop()
        if tag in VOID:
            return
        bad = marked(tag, attributes)
        if tag == "header" and not self.article:
            bad = True
        if tag in BLOCKS or bad:
            if bad and tag not in BLOCKS:
                self.flush()
            held = []
            if tag in ("article", "main"):
                if self.layout and self.layout == self.bad:
                    self.wrapped = True
                    if self.open_layout:
                        held, self.bad, self.layout = [self.bad, self.layout], 0, 0
                self.articles += self.article == 0
                self.article += 1
            self.stack.append((tag, bad, held))
            self.open[tag] += 1
            self.bad += bool(bad)
            self.layout += bad == "layout"
        elif tag == "a":
            self.links = 1

    def pop(self) -> None:
        tag, bad, held = self.stack.pop()
        self.open[tag] -= 1
        self.bad -= bool(bad)
        self.layout -= bad == "layout"
        if held:
            self.bad, self.layout = held
        if tag in ("article", "main"):
            self.article -= 1

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
            return
        if self.open[tag]:
            self.flush()
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()
        elif tag in BLOCKS:
            self.flush()


def first_label(text: str, linked: int, bad: bool) -> bool | None:
    """First pass: True (good), False (bad) or None (ambiguous)."""
    if bad or linked > MAX_LINK_DENSITY * len(text):
        return False
    words = text.lower().split()
    if len(words) >= MIN_WORDS and len([1 for w in words if w in STOP_WORDS]) >= MIN_STOP_DENSITY * len(words):
        return True
    return None


def nearest(labels: list[bool | None], articles: list[int]) -> list[tuple[int, bool]]:
    """For each block the distance and label of the nearest decided one before it."""
    out, distance, label, inside = [], 0, False, 0
    for own, article in zip(labels, articles):
        if article != inside:  # over an article's edge
            distance, label, inside = 0, bool(article), article
        distance += 1
        out.append((distance, label))
        if own or own is False and not article:
            distance, label = 0, own
    return out


def decided(labels: list[bool | None], articles: list[int]) -> list[bool]:
    """Second pass over the blocks of a page, in page order."""
    down = nearest(labels, articles)
    up = nearest(labels[::-1], articles[::-1])[::-1]
    return [own if own is not None else a == b and a or (b and d2 < d1) or (a and d1 < d2)
            for own, (d1, a), (d2, b) in zip(labels, down, up)]


def unserved(blocks: list[tuple], labels: list[bool | None]) -> list[bool | None]:
    """Labels of a page without articles in a language that STOP_WORDS does not serve: there, blocks
    that are long enough (by words, or by characters where a script has no spaces) are good."""
    text = [w for b, own in zip(blocks, labels) if own is None for w in b[0].lower().split()]
    if True in labels or any(b[3] for b in blocks) or sum(w in STOP_WORDS for w in text) > MAX_FOREIGN * len(text):
        return labels
    return [True if own is None and (len(b[0].split()) >= MIN_WORDS or len(b[0]) >= MIN_CHARS) else own
            for b, own in zip(blocks, labels)]


def main_text(html: str | None) -> str:
    """The article's blocks, one on each line."""
    page = Blocks(html or "")
    if page.wrapped and not any(article and not bad for _, _, bad, article in page.blocks):
        page = Blocks(html or "", open_layout=True)  # else there is no article to be seen
    blocks = page.blocks
    labels = unserved(blocks, [first_label(*b[:3]) for b in blocks])
    keep = decided(labels, [b[3] for b in blocks])
    return "\n".join(b[0] for b, good in zip(blocks, keep) if good)


def extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(
            texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    ship(__name__)
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")) \
        .mapInArrow(extract_rows, "page_id bigint, url string, text string, n_chars bigint")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": op7_html_text}
