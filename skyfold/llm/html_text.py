"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one for each block. A line knows its characters, the tags met in it, the
share of its text in links, and the containers around it. The ratios of text to tags are smoothed over neighbouring lines with a Gaussian kernel, and the lines are
parted into two clusters by a threshold that two-means finds on the logarithm of the ratio. The region is the container in which the lines of the upper cluster lie, with all its lines.
Marks of an article multiply the ratios of the lines in it, so that text without marks has to be denser to win. Containers that never hold an article (menus, adverts, forms, comments
and so on) have a ratio of zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers that hold no article text.
DROPPED = frozenset("script style noscript template nav footer aside form button select textarea option iframe object svg canvas dialog menu head title".split())
RAW = frozenset(("script", "style"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand in a head; any other ends it, as its end tag is optional.
IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template head".split())
#: Start tags that close an open paragraph, list item or cell.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hide an open item or cell from a start tag, those that an inline end tag does not reach beyond, and those whose text is not shown.
SHIELDS = frozenset("ul ol dl table select div article section nav".split())
WALLS = frozenset("article main body nav footer".split())
UNSEEN = frozenset("script style noscript template head title".split())
#: Containers that may be the region.
REGIONS = frozenset("html body main article section div center details table tbody tr td".split())
HIDDEN = re.compile(r"display\s*:\s*none")
#: Weight of a line's ratio without marks, in a marked region, and in a marked article.
WEIGHTS = (1.0, 4.0, 16.0)
#: Share of the weighted text above the threshold that the region holds, where it is marked and where not; links in a row that are a menu.
MARKED_HOLDS, HOLDS, MENU = 0.5, 0.8, 3
#: Words of class, id and role that mark what is no article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adsby\w*|advert\w*|adbox|banner|sponsor\w*|promo\w*|teasers?|trending|outbrain|taboola|disclaimer|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|sidebar\w*|side|aside|widget\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter|subscribe|signup|login|share\w*|sharing|social\w*|related|recommend\w*|comments?(?:list|area|box|section|thread|form|body|text)?|replies|reply|disqus|respond|responses?|reactions?|pagination|pager|search\w*|copyright|legal|skip|toolbar|tags?cloud|complementary|contentinfo|navigation|dialog)(?:$|[\s_-])",
    re.I,
)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article(?:body)?|post(?:-?(?:body|content))?|entry(?:-?content)?|story(?:-?body)?|main-?content|content-?(?:body|main))(?:$|[\s_-])", re.I)
#: Tokens that mark a whole region in which an article lies, the article's own heading, and tokens that say what stands beside.
REGION = frozenset("content main".split())
OWN_HEAD = re.compile(r"(?:article|entry|post|story)[_-]?(?:header|head|title)", re.I)
BESIDE = re.compile(r"(?:has|no|with|without)[_-]", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _role(tag: str, names: list[str]) -> tuple[bool, int]:
    """Whether class names, ids and roles mark what is no article, and whether they mark an article (2) or a region around one (1).

    A token that speaks of both, such as post-comments, marks no article; an element with an article's token of its own is one.
    """
    noise = article = region = False
    for token in names:
        if OWN_HEAD.fullmatch(token) or BESIDE.match(token):
            continue
        if NOISE.search(token):
            noise = True
        elif ARTICLE.search(token):
            article = True
        elif token.lower() in REGION:
            region = True
    if tag in ("html", "body", "main"):
        noise = article = region = False
    noise = noise and not article
    if tag == "article" and not noise:
        article = True
    return noise, 2 if article else 1 if tag == "main" or region and not noise else 0


class Lines(HTMLParser):
    """Collects the lines of a page from parser events, and the containers that they lie in.

    No markup raises, and each event takes the same time at any depth: open elements of a tag are found by their places on the stack.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, no article, container before
        self.places: dict[str, list[int]] = {}
        self.out: list[tuple[str, int, int, int, bool]] = []  # text (empty: a line that is no article), tags, link characters, container, heading
        self.above, self.level = [0], [0]  # of each container: the one around it, and its mark
        self.inside = 0
        self.text: list[str] = []
        self.tags = self.link = self.links = self.noise = self.marked = 0
        self.heading = self.hidden = False

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.out.append((line, self.tags, self.link, self.inside, self.heading))
            self.text.clear()
        elif self.hidden:
            self.out.append(("", self.tags, 0, self.inside, False))
        self.tags = self.link = 0
        self.hidden = False

    def _last(self, tags: tuple[str, ...] | frozenset) -> int:
        """Place of the innermost open element among ``tags``, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _pop(self, i: int) -> None:
        for tag, noise, before in reversed(self.stack[i:]):
            self.places[tag].pop()
            self.noise -= noise
            self.marked -= before >= 0 and self.level[self.inside] > 0
            self.links -= tag == "a"
            if before >= 0:
                self.inside = before
        del self.stack[i:]

    def _leave_head(self) -> None:
        """End an open head, whatever is open in it."""
        if self.places.get("head"):
            self.flush()
            self._pop(self.places["head"][0])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" or tag not in IN_HEAD and self.stack and self.stack[-1][0] == "head":
            self._leave_head()
        if tag in BLOCKS:
            self.flush()
            if self.stack and self.stack[-1][0] == "p":
                self._pop(len(self.stack) - 1)
            if tag in CLOSES:
                at = self._last(CLOSES[tag])
                if at > self._last(SHIELDS):
                    self._pop(at)
            self.heading = tag in HEADINGS
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        marked, level = _role(tag, [x for k, v in attrs if v and k in ("class", "id", "role", "itemprop") for x in v.split()])
        noise = marked or tag in DROPPED or (tag == "header" and not self.marked) or any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and HIDDEN.search(v)) for k, v in attrs)
        if noise and not self.noise:
            self.flush()
        before = -1
        if tag in REGIONS or level:
            before = self.inside
            self.above.append(before)
            self.level.append(level)
            self.inside = len(self.above) - 1
            self.marked += level > 0
        self.noise += noise
        self.links += tag == "a"
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, noise, before))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag and tag not in ("p", "div", "article", "main", "section", "span", "b", "i", "a"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        places = self.places.get(tag)
        if not places:
            return
        at = places[-1]
        if tag not in BLOCKS and at < self._last(WALLS):
            return
        if tag in BLOCKS or any(noise or before >= 0 for _, noise, before in self.stack[at:]):
            self.flush()
        self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.noise and self.stack and self.stack[-1][0] == "head" and data.strip():
            self._leave_head()
        if not self.noise:
            self.text.append(data)
            if self.links:
                self.link += len(data.strip())
        elif not self.hidden and self.stack[-1][0] not in UNSEEN:
            self.hidden = bool(data.strip())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` is no markup of a page and ends at the next ``>``."""
        return self.parse_bogus_comment(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment without an end goes to the end of the page."""
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.index(">", i) + 1
        end = self.rawdata.find("-->", i + 4)
        return end + 3 if end >= 0 else len(self.rawdata)


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian mean over neighbouring lines; at the ends the kernel is cut and scaled."""
    if len(values) < 2:
        return values
    r = min(int(3 * sigma + 0.5), len(values) - 1)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(values, kernel, "full")[r : r + len(values)] / np.convolve(np.ones(len(values)), kernel, "full")[r : r + len(values)]


def threshold(ratios: np.ndarray) -> float:
    """The border of two clusters of smoothed ratios, by two-means on their logarithms; 0 where there is one cluster only."""
    x = np.log1p(ratios)
    low, high = x.min(), x.max()
    if high - low < 0.5:
        return 0.0
    for _ in range(30):
        border = (low + high) / 2
        new = x[x <= border].mean(), x[x > border].mean()
        if new == (low, high):
            break
        low, high = new
    return float(np.expm1((low + high) / 2))


def region(lines: list[tuple[str, int, int, int, bool]], chosen: np.ndarray, above: list[int], level: list[int]) -> int:
    """The container of the chosen lines: a marked article or else a marked region that holds ``MARKED_HOLDS`` of their text, if there is one, else the innermost container that holds ``HOLDS`` of it."""
    mass = np.zeros(len(above))
    np.add.at(mass, [x[3] for x in lines], [len(x[0]) * c for x, c in zip(lines, chosen)])
    for c in range(len(above) - 1, 0, -1):
        mass[above[c]] += mass[c]
    for wanted in (2, 1):
        held = [c for c in range(len(above)) if level[c] == wanted and mass[c] >= MARKED_HOLDS * mass[0]]
        if held:
            return held[0]
    at = 0
    for c in range(1, len(above)):  # inner containers come after those around them
        if above[c] == at and mass[c] >= HOLDS * mass[0]:
            at = c
    return at


def content(lines: list[tuple[str, int, int, int, bool]], above: list[int], level: list[int], sigma: float = 1.0) -> list[str]:
    """The lines of the content region, in page order.

    The ratios, times the weight of the marks around them, are smoothed and parted by a threshold; the region is where the lines above it lie. In a marked region
    only runs of links go; elsewhere the region reaches from its first to its last line above the threshold, with the headings right before.
    """
    if not any(x[0] for x in lines):
        return []
    mark = list(level)
    for c in range(1, len(above)):
        mark[c] = max(mark[c], mark[above[c]])
    size = np.array([len(x[0]) for x in lines], float)
    link = np.minimum(1, np.array([x[2] for x in lines]) / np.maximum(size, 1))
    weight = np.array([WEIGHTS[mark[x[3]]] for x in lines])
    ratio = smoothed(weight * size * (1 - link) / np.maximum(1, [x[1] for x in lines]), sigma)
    chosen = (ratio >= threshold(ratio)) & (size > 0)
    home = region(lines, chosen * weight, above, level)
    within = [c == home for c in range(len(above))]
    for c in range(home + 1, len(above)):
        within[c] = within[c] or within[above[c]]
    own = np.array([within[x[3]] for x in lines]) & (size > 0)
    if level[home]:
        keep = own & ~_menus(own, link, size)
    else:
        rich = np.flatnonzero(own & chosen & (link < 0.5))
        if not len(rich):
            return []
        first = int(rich[0])
        while first and lines[first - 1][4] and size[first - 1]:
            first -= 1
        at = np.arange(len(lines))
        keep = (own & (link < 0.5) & (at >= first) & (at <= rich[-1])) | ((at >= first) & (at < rich[0]))
        keep |= own & np.array([mark[x[3]] == 2 for x in lines])
    return [x[0] for x, k in zip(lines, keep) if k]


def _menus(own: np.ndarray, link: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``MENU`` and more short lines that are nothing but links."""
    pure = own & (link >= 0.9) & (size <= 200)
    edge = np.flatnonzero(np.diff(np.r_[False, pure, False].astype(np.int8)))
    out = np.zeros(len(own), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        out[a:b] = b - a >= MENU
    return out


_TAG_START = re.compile(r"<[a-zA-Z/!?]")
#: Numbers with zeros in front, and those of more digits than any character has.
_ZEROS = re.compile(r"(&#[xX]?)0{5,}(?=[0-9a-fA-F])")
_LONG_REF = re.compile(r"&#(?:0*+[1-9][0-9]{7,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,});?")


def sound(html: str) -> str:
    """The page without a tag that it ends in, and without numbers that stand for no character."""
    cut_at = _TAG_START.search(html, html.rfind(">") + 1)
    if cut_at and not html.startswith("<!--", cut_at.start()):
        html = html[: cut_at.start()]
    return _LONG_REF.sub("\ufffd", _ZEROS.sub(r"\g<1>0", html)) if "&#" in html else html


def parsed(html: str | None) -> Lines:
    """The lines of one page; a page that ends inside a tag loses that tag only."""
    page = Lines()
    if html:
        page.feed(sound(html))
        page.close()
        page.flush()
    return page


def extract(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page."""
    page = parsed(html)
    return "\n".join(content(page.out, page.above, page.level, sigma))


def main_text(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of ``pages`` (page_id, url, html; others are ignored).

    A null or empty page, or one without content, has an empty text. Repeated rows give repeated results, an empty table an empty one.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html"))
            texts = [extract(html[i].as_py(), sigma) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(of, f"page_id {kind}, url string, text string, n_chars long")


#: A comment, an end or start tag, or a declaration; each alternative goes to the end of the page at worst and succeeds there, so a page is cut in one pass.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=[\s>]|\Z)|(?P<broken>[\"'].*)))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
#: Elements whose content is no text of the page, up to their end tag; without one, scripts and styles go to the end of the page, the others have no content.
_SKIPPED = frozenset("script style noscript template".split())
_LINKING = frozenset("a area link".split())


@dataclass
class Plain:
    """What one pass over a page finds: visible text (one line for each block), targets of links as written, title, language."""

    text: str = ""
    links: list[str] = field(default_factory=list)
    title: str = ""
    language: str = ""


def _attribute(attrs: str, name: str) -> str | None:
    for m in _ATTR.finditer(attrs):
        if m[1].lower() == name:
            return unescape(m[2] or m[3] or m[4] or "")
    return None


def plain(html: str | None) -> Plain:
    """Text (a line for each block, and after each line break), links, title and language of a page in one pass.

    A head goes up to its end tag or the first thing that may not stand in it. Comments, scripts and styles that are not closed go to the end of the page, as does an attribute whose quote is not closed.
    """
    out = Plain()
    if not html:
        return out
    html = html.replace("\n", " ")
    if "&#" in html:
        html = _LONG_REF.sub("\ufffd", _ZEROS.sub(r"\g<1>0", html))
    pieces: list[str] = []
    at, in_head, title = 0, False, -1
    ends: dict[str, int] = {}  # where the next end tag of an element is
    low = ""

    def end_of(tag: str) -> int:
        """Place of the next end tag, or the end of the page; looked for once for each end tag that there is."""
        nonlocal low
        if ends.get(tag, -1) < at:
            low = low or html.lower()
            found = low.find(f"</{tag}", at)
            ends[tag] = found if found >= 0 else len(html)
        return ends[tag]

    while True:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else len(html)
        if stop > at:
            chunk = html[at:stop]
            if title >= 0:
                out.title += chunk
            elif in_head and chunk.strip():
                in_head = False
            if title < 0 and not in_head:
                pieces.append(chunk)
        if not m:
            break
        at = m.end()
        tag, closing = (m["name"] or "").lower(), bool(m["end"])
        if not tag:
            if m[0].startswith("<!--") and not in_head:
                pieces.append(" ")
            continue
        attrs = m["attrs"]
        if title >= 0:
            if tag == "title" and closing:
                title = -1
            else:
                out.title += m[0]
            continue
        if not closing:
            if tag in _LINKING and "=" in attrs:
                href = _attribute(attrs, "href")
                if href is not None:
                    out.links.append(href)
            elif tag == "html" and not out.language:
                lang = re.match(r"[A-Za-z-]+", _attribute(attrs, "lang") or "")
                out.language = lang[0] if lang else ""
        if tag == "head":
            in_head = not closing
            continue
        if in_head and (tag not in IN_HEAD or tag in BLOCKS):
            in_head = closing and tag not in ("body", "html", "br")
        if tag == "title" and not closing and not out.title:
            if end_of(tag) < len(html):
                title = at
            continue
        if tag in _SKIPPED and not closing:
            if end_of(tag) < len(html) or tag in RAW:
                if not in_head:
                    pieces.append(" ")
                at = ends[tag]
            continue
        if not in_head and (tag in BLOCKS or tag == "br"):
            pieces.append("\n")
    out.text = "\n".join(x for x in (" ".join(line.split()) for line in unescape("".join(pieces)).split("\n")) if x)
    out.title = " ".join(unescape(out.title).split())
    return out


def plain_text(html: str | None) -> str:
    """All visible text of a page, one line for each block, without markup, scripts and styles."""
    return plain(html).text
