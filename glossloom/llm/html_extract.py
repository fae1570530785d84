"""Main text of web pages.

The standard library's parser streams over a page, in time linear in its
length. Text between block borders is a line; it knows how many tags came with
it, how much of it is links, and the element it stands in. Elements that never
hold article text (menus, footers, asides, forms, scripts, dialogs; page
headers outside an article) are left out with all that is in them, and so are
those whose class, id or role names nothing but a menu, advert, notice, comment
and the like: `comment-list` or `ad slot-2` do, `social-history` or
`banner-bearers` do not. A heading's or paragraph's id never counts, as it as a
rule repeats the text. An element that also holds the page's heading or main
part stays.

Of the lines left, the ratio of text to tags is smoothed by a Gaussian and
clustered by a threshold, the deviation of the smoothed ratios: lines above are
certain content. The content region is the smallest element that holds nearly
all of the certain text and every main heading; what it leaves out may only be
containers of another kind than itself, such as a side column. An article or
main element is not cut further. All lines of the region belong to the text,
however short and linked; but a region that is neither article nor main gives
the lines of links up that come before its first certain line or heading, or
after its last certain one.

Malformed markup is read as browsers do: a comment, declaration or tag that is
not closed goes on to the end; `<![...]>` is a comment. Should the parser still
fail, the page is what is left without anything between < and >.

Results: null and empty html give the empty string; a page without certain
content gives all lines left. White space is what str.split() takes for it.
Each row gives one row; null ids and urls stay null. Other columns are left out.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("nav footer aside form script style noscript template iframe object svg canvas audio video select textarea button label fieldset dialog menu head title datalist map".split())
#: Words of class, id and role that name what is no article text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay dialog comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox searchform widget widgets pagination pager skip contentinfo complementary copyright".split()
)
#: Words that stand beside those and say nothing of the text.
NEUTRAL = frozenset(
    "area article articles author bar block blocks body bottom box btn button buttons card cards col collapse column container content count desktop div element feed fixed form foot global group head header heading hidden holder icons id inline inner is item items js layout left link links list lists main message messages mobile module outer page panel placeholder policy post posts primary reader readers region right row secondary section sections short site slot stack sticky stories story text thread title top unit user users view wrap wrapper zone".split()
)
#: What a page's header is called, and may be called besides.
_HEADERS, _OF_PAGE = frozenset("header siteheader pageheader".split()), frozenset("bar container fixed global inner layout main page row site sticky top wrap wrapper".split())
_PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dd dt td th figcaption caption".split())
_CUT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: Only these can be the content region.
REGIONS = frozenset("body main article section div td table center html".split())
#: Share of the certain text that a smaller region must hold.
SHARE = 0.85
SIGMA = 1.0

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_VALUE = re.compile(r"[>=]")
_NO_SPACE = re.compile(r"\S")
_COMMENT_END = re.compile(r"--!?>")
_MARKUP = re.compile(r"<[^>]*>?")


def _names_boilerplate(value: str, header: bool) -> bool:
    """Does one of the names in value say that this is no article text?"""
    for name in value.split():
        words = {w.lower() for w in _CUT.split(name) if w}
        if words & NAMES and words <= NAMES | NEUTRAL or header and words & _HEADERS and words <= _HEADERS | _OF_PAGE:
            return True
    return False


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.named = [-1], ["#root"], [False]
        self.kind = [("#root", None)]  # tag and class
        self.out = [False]  # inside an element that never holds article text
        self.stack, self.open = [0], {}
        self.lines: list[tuple[str, int, int, int, bool]] = []  # text, tags, characters of links, element, in a main heading
        self.text: list[str] = []
        self.tags = self.link_chars = 0

    # Unfinished markup goes on to the end of the page; the parser would look for its end again and again.

    def parse_starttag(self, i):
        raw = self.rawdata
        end = self._tag_end(i + 1)
        if end < 0:
            return len(raw)
        name = _TAG.match(raw, i + 1)
        self.lasttag = tag = name[0].lower()
        attrs = [(k.lower(), unescape(v.strip("\"'"))) for k, v in _ATTRIBUTE.findall(raw, name.end(), end - 1)]
        if raw[end - 2] == "/":
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return end

    def _tag_end(self, at: int) -> int:
        """Behind the > that closes the tag; those in quoted values do not."""
        raw = self.rawdata
        while (m := _VALUE.search(raw, at)) is not None:
            at = m.end()
            if m[0] == ">":
                return at
            value = _NO_SPACE.search(raw, at)
            if value is not None and value[0] in "\"'" and value.start() < self.last[value[0]]:
                at = raw.index(value[0], value.end()) + 1
        return -1

    def parse_endtag(self, i):
        return super().parse_endtag(i) if i < self.last[">"] else len(self.rawdata)

    def parse_comment(self, i, report=True):
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i):
        return self.rawdata.index(">", i) + 1 if i < self.last[">"] else len(self.rawdata)

    parse_pi = parse_bogus_comment = lambda self, i, report=True: _Page.parse_html_declaration(self, i)

    def read(self, html: str) -> None:
        self.last = {c: html.rfind(c) for c in "\"'>"}
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError, IndexError):
            self.__init__()
            self.text = [unescape(_MARKUP.sub(" ", html))]
        self.flush()

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text and not self.out[self.stack[-1]]:
            self.lines.append((text, self.tags, self.link_chars, self.stack[-1], "h1" in self.open))
            self.tags = 0
        elif text:
            self.tags = 0
        self.text, self.link_chars = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
            if tag not in VOID:
                # what HTML closes by itself
                top = self.tag[self.stack[-1]]
                if top == "p" and tag not in INLINE or top == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    self.pop()
        self.tags += 1
        if tag in VOID:
            return
        up = self.stack[-1]
        inside = "article" in self.open or "main" in self.open
        self.parent.append(up)
        self.tag.append(tag)
        self.out.append(self.out[up] or tag in NEVER or tag == "header" and not inside)
        self.named.append(tag not in ("html", "body", "main", "h1") and any(_names_boilerplate(v, not inside) for k, v in attrs if v and (k in ("class", "role") or k == "id" and tag not in _PLAIN)))
        self.kind.append((tag, next((v for k, v in attrs if k == "class"), None)))
        self.stack.append(len(self.tag) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self):
        tag = self.tag[self.stack.pop()]
        if self.open[tag] == 1:
            del self.open[tag]
        else:
            self.open[tag] -= 1

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag in self.open:
            while self.tag[self.stack[-1]] != tag:
                self.pop()
            self.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        self.text.append(data)
        if "a" in self.open:
            self.link_chars += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def main_text(html: str | None) -> str:
    page = _Page()
    page.read(html or "")
    n = len(page.tag)
    # an element named like an advert that holds the heading or the main part is no advert
    size = [0] * n
    for text, _, _, e, _ in page.lines:
        size[e] += len(text)
    for e in range(n - 1, 0, -1):
        size[page.parent[e]] += size[e]
    holds = [tag in ("h1", "main") for tag in page.tag]
    if articles := [e for e in range(n) if page.tag[e] == "article" and not page.named[e]]:
        holds[max(articles, key=size.__getitem__)] = True
    for e in range(n - 1, 0, -1):
        holds[page.parent[e]] |= holds[e]
    gone = [False] * n
    for e in range(1, n):
        gone[e] = gone[page.parent[e]] or page.named[e] and not holds[e]
    lines = [x for x in page.lines if not gone[x[3]]]
    if not lines:
        return ""
    ratios = smoothed(np.array([len(text) / max(1, tags) for text, tags, *_ in lines]))
    certain = ratios >= min(ratios.std(), ratios.max())
    links = np.array([2 * chars > len(text) for text, _, chars, *_ in lines])
    weight, heads = [0] * n, [0] * n
    for (text, _, _, e, head), sure, link in zip(lines, certain, links, strict=True):
        weight[e] += len(text) * bool(sure and not link)
        heads[e] += head
    own = list(weight)
    for e in range(n - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
        heads[page.parent[e]] += heads[e]
    below: dict[int, list[int]] = {}
    for e in range(1, n):
        if weight[e] or heads[e]:
            below.setdefault(page.parent[e], []).append(e)
    region = 0
    while region in below and page.tag[region] not in ("article", "main"):
        down = max(below[region], key=weight.__getitem__)
        beside = [e for e in below[region] if e != down and weight[e]]
        if page.tag[down] not in REGIONS or weight[0] == 0 or weight[down] < SHARE * weight[0] or heads[down] < heads[region]:
            break
        # certain text right in the region, or in an element of the same kind, is a part of the article
        if own[region] or any(page.tag[e] not in REGIONS or page.kind[e] == page.kind[down] for e in beside):
            break
        region = down
    inside = [False] * n
    inside[region] = True
    for e in range(region + 1, n):
        inside[e] = inside[page.parent[e]]
    at = [i for i, line in enumerate(lines) if inside[line[3]]]
    if page.tag[region] not in ("article", "main") and weight[0]:
        firm = [i for i in at if lines[i][4] or certain[i] and not links[i]]
        at = [i for i in at if firm[0] <= i <= firm[-1] or not links[i]] if firm else at
    return " ".join(lines[i][0] for i in at)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each row: page_id, url, text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_pydict({"page_id": part["page_id"], "url": part["url"], "text": pa.array([main_text(h) for h in part["html"].to_pylist()], pa.string())})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def digest(extracted: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
