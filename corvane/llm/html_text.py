"""Operator 6: main text of HTML pages.

The parser's events become lines: runs of text between block-level tags, with the
number of characters and tags each takes. Each line has the logarithm of its text-to-tag
ratio; these are smoothed with a Gaussian, and the threshold halfway between the means of what is
under and over it clusters the lines into content and the rest.

Clusters choose the regions. The element that holds the lines (those whose own ratio is over the threshold) of every heavy cluster (a tenth of the
content's text, or the heaviest) is the region, with all its short lines; if it stands inside ``article`` or ``main``,
that element is. A lone line is no region, and a heading beside it belongs to it. Lighter
clusters elsewhere are kept as they are, unless ``article`` or ``main`` says what the text is.

Structure only trims. Lines inside navigation, footers, asides, forms, notices, adverts and
reader comments go; so does a page's header outside ``article`` and ``main``. A class or an id trims an element only
unless that holds a ``main``, or the page's heading (most of the content, where there is none) and much of the content: a
name may tell of a page's layout. Outside ``article`` and
``main`` a list that is nothing but links and has no content line goes too.

Cases: a null or empty page gives an empty text; markup that never closes is read to
the end, an open comment is one; a head that is left open ends with the first thing that no head can hold; a
page without any content line gives its untrimmed lines; rows are independent, so ties and repeated rows, also of a null
``page_id``, give equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import table

#: Elements of HTML, by what they mean here.
SILENT = frozenset("script style noscript template svg math iframe object embed canvas audio video title select option textarea button map datalist".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
REGIONS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2".split())
#: Parts of names. Any place in a name; only a whole name or its end; a page's header; readers' words; the beginnings that deny.
ANYWHERE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr newsletter breadcrumb breadcrumbs sidebar widget widgets popup modal navbar share sharing social".split())
AT_END = frozenset(
    "promo promos promotion banner nav navigation menu side aside footer foot masthead topbar notice notices notification notifications alert alerts overlay toast subscribe subscription signup login related recommended recommendations pagination pager toolbar copyright paywall".split()
)
TOGETHER = frozenset("related-posts related-articles related-links related-stories related-content skip-link menu-item nav-links nav-list footer-links".split())
HEADERS = frozenset("header site-header page-header topbar masthead".split())
READERS = frozenset("comment comments commentlist disqus replies respond reactions".split())
DENYING = frozenset("has with no without is not hide show".split())
SPLIT = regex.compile(r"[-_]+")
SPACES = regex.compile(r"\s+")
SIGMA, RADIUS, HEAVY = 1.0, 2, 0.1
PLAIN, HEADER, NAMED, COMMENTS, ALWAYS = range(5)


def kind_of_name(name: str) -> int:
    """What a class or an id says about its element."""
    if name in HEADERS:
        return HEADER
    if name in READERS:
        return COMMENTS
    if name in AT_END or name in ANYWHERE or name in TOGETHER:
        return NAMED
    parts = SPLIT.split(name)
    if len(parts) < 2 or parts[0] in DENYING:
        return PLAIN
    if parts[-1] in READERS or parts[0] in READERS and parts[-1] in ("area", "body", "form", "list", "section", "text", "thread", "wrapper", "container"):
        return COMMENTS
    return NAMED if parts[-1] in AT_END or not ANYWHERE.isdisjoint(parts) else PLAIN


class LineReader(HTMLParser):
    """Reads a page as a stream of events; keeps lines and the elements they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.known: dict[str, int] = {}

    def read(self, html: str) -> None:
        self.reset()
        self.stack: list[tuple[str, int]] = []  # tag, element number
        self.parents: list[int] = [-1]
        self.tags: list[str] = [""]
        self.kinds: list[int] = [PLAIN]
        self.inside: list[bool] = [False]  # within article or main
        self.silent = self.links = 0
        self.head = False
        self.lines: list[tuple[str, int, int, bool]] = []  # text, tags, element, nothing but links
        self.buffer: list[str] = []
        self.n_tags, self.only_links, self.here = 0, True, 0
        self.feed(html)
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""  # an open comment lasts to the end
        self.close()
        self._flush()

    def _flush(self) -> None:
        if self.buffer:
            text = SPACES.sub(" ", "".join(self.buffer)).strip()
            if text:
                self.lines.append((text, self.n_tags, self.here, self.only_links))
                self.n_tags = 0
            self.buffer, self.only_links = [], True
        self.links = 0

    def _close_to(self, depth: int) -> None:
        for tag, _ in self.stack[depth:]:
            self.silent -= tag in SILENT
            self.head = self.head and tag != "head"
        del self.stack[depth:]
        self.here = self.stack[-1][1] if self.stack else 0

    def _end_head(self) -> None:
        self._close_to(next(i for i, (tag, _) in enumerate(self.stack) if tag == "head"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.head and tag not in IN_HEAD and (not self.silent or tag in BLOCKS):
            self._end_head()
        self.n_tags += 1
        if tag in BLOCKS:
            self._flush()
            self._imply_end(tag)
        elif tag == "br":
            self.buffer.append(" ")
        elif tag == "a":
            self.links += 1
        if tag in VOID or tag not in BLOCKS and tag not in SILENT:
            return  # inline: changes no line
        inside = self.inside[self.here]
        kind = ALWAYS if tag in BOILERPLATE else NAMED if tag in ("form", "fieldset") else HEADER if tag == "header" else PLAIN
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true":
                kind = ALWAYS
            elif value and key == "role":
                kind = max(kind, ALWAYS if value.strip().lower() in ROLES else PLAIN)
            elif value and (key == "class" or key == "id") and tag not in ("html", "body", "main"):
                for name in value.lower().split():
                    if (k := self.known.get(name)) is None:
                        k = self.known[name] = kind_of_name(name) if len(self.known) < 50_000 else PLAIN
                        if len(self.known) >= 50_000:
                            self.known.clear()
                    kind = max(kind, k)
        if kind == HEADER:
            kind = PLAIN if inside else NAMED
        self.parents.append(self.here)
        self.tags.append(tag)
        self.kinds.append(kind)
        self.inside.append(inside or tag in REGIONS)
        self.here = len(self.tags) - 1
        self.stack.append((tag, self.here))
        self.silent += tag in SILENT
        self.head = self.head or tag == "head"

    def _imply_end(self, tag: str) -> None:
        """End tags that HTML lets a writer leave out: p before any block, and a list item,
        cell or row before its next."""
        closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        for depth in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[depth][0]
            if open_tag == "p" or open_tag in closes:
                self._close_to(depth)
                return
            if open_tag in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag in BLOCKS:
            self._flush()
        elif tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS or tag in SILENT:
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth][0] == tag:
                    self._close_to(depth)
                    break

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.head:
            if not data.strip():
                return
            self._end_head()
        self.buffer.append(data)
        if not self.links and self.only_links and not data.isspace():
            self.only_links = False


def ratios(lines: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """Logarithms of each line's text-to-tag ratio: lengths of paragraphs differ by orders."""
    return np.log1p(np.array([len(text) / max(1, n) for text, n, _, _ in lines]))


def smoothed(raw: np.ndarray) -> np.ndarray:
    """Gaussian means of each line and those beside it."""
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(x**2) / (2 * SIGMA**2))
    return np.convolve(np.pad(raw, RADIUS, mode="edge"), kernel / kernel.sum(), "valid")


def threshold(smooth: np.ndarray) -> float:
    """The value halfway between the means of what is under and over it: it parts the lines into two clusters."""
    at = float(smooth.mean())
    for _ in range(32):
        over = smooth >= at
        if over.all() or not over.any():
            break
        new = (float(smooth[over].mean()) + float(smooth[~over].mean())) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return min(at, float(smooth.max()))


def content_lines(lines: list[tuple[str, int, int, bool]]) -> tuple[list[bool], list[bool]]:
    """Which lines are content, and which of these are so by their own ratio, not by that of the lines beside them alone."""
    raw = ratios(lines)
    smooth = smoothed(raw)
    least = threshold(smooth)
    content = smooth >= least
    return content.tolist(), (content & (raw >= least)).tolist()


def main_text(reader: LineReader, html: str | None) -> str:
    if not html:
        return ""
    reader.read(html)
    if not reader.lines:
        return ""
    content, own = content_lines(reader.lines)
    gone = trimmed(reader, content)
    live = [(line, ok, sure) for line, ok, sure in zip(reader.lines, content, own) if not gone[line[2]]]
    runs: list[list[tuple]] = [[]]
    for line, ok, sure in live:
        if ok:
            runs[-1].append((line, sure))
        elif runs[-1]:
            runs.append([])
    runs = [r for r in runs if r]
    if not runs:
        return "\n".join([line[0] for line, _, _ in live])
    weights = [sum(len(line[0]) for line, _ in r) for r in runs]
    least = min(max(weights), HEAVY * sum(weights))
    placing = [line[2] for r, w in zip(runs, weights) if w >= least for line, sure in r if sure]
    chosen = region(reader, placing or [line[2] for r, w in zip(runs, weights) if w >= least for line, _ in r], [line for line, _, _ in live])
    held = _flags(reader, {chosen})
    if reader.inside[chosen]:
        return "\n".join([line[0] for line, _, _ in live if held[line[2]]])
    lists = link_lists(reader, live)
    return "\n".join([line[0] for line, _, sure in live if sure or held[line[2]] and not lists[line[2]]])


def trimmed(reader: LineReader, content: list[bool]) -> list[bool]:
    """Elements that structure takes away, by their own kind or an ancestor's."""
    n = len(reader.tags)
    parents, tags, kinds = reader.parents, reader.tags, reader.kinds
    if max(kinds) == PLAIN:
        return [False] * n
    surely = _flags(reader, {e for e in range(n) if kinds[e] >= COMMENTS})
    weight, held, mains, headings = [0] * n, [0] * n, [0] * n, [0] * n
    for (text, _, element, _), ok in zip(reader.lines, content):
        if not surely[element]:
            weight[element] += ok * len(text)
            held[element] += 1
    for e in range(n - 1, -1, -1):  # children have larger numbers than their parents
        mains[e] += tags[e] == "main"
        headings[e] += tags[e] == "h1"
        if e:
            p = parents[e]
            weight[p] += weight[e]
            held[p] += held[e]
            mains[p] += mains[e]
            headings[p] += headings[e]

    def is_layout(e: int) -> bool:
        """Whether a name cannot mean what it says: the page's heading and much of its content stand within."""
        if mains[e] or not headings[0]:
            return mains[e] > 0 or held[e] > 1 and 2 * weight[e] > weight[0]
        return headings[e] > 0 and 4 * weight[e] >= weight[0]

    bad = {e for e in range(n) if kinds[e] == ALWAYS or kinds[e] == COMMENTS and not mains[e] and not headings[e] or kinds[e] == NAMED and not is_layout(e)}
    return _flags(reader, bad)


def region(reader: LineReader, elements: list[int], live: list[tuple]) -> int:
    """The element that the heavy clusters' lines share, as ``article`` or ``main`` if it stands in one; else one with two lines at
    least, and with the headings beside it."""
    common = list(_above(reader, elements[0]))[::-1]
    for e in set(elements[1:]):
        path = list(_above(reader, e))[::-1]
        k = 0
        while k < min(len(common), len(path)) and common[k] == path[k]:
            k += 1
        common = common[:k]
    found = common[-1]
    for e in _above(reader, found):
        if reader.tags[e] in REGIONS:
            found = e
    if reader.inside[found]:
        return found
    while found:
        held = _flags(reader, {found})
        parent = _flags(reader, {reader.parents[found]})
        mine = [line for line in live if held[line[2]]]
        beside = [line for line in live if parent[line[2]] and not held[line[2]]]
        heading = any(reader.tags[line[2]] in HEADINGS for line in beside) and sum(len(x[0]) for x in beside) * 5 <= sum(len(x[0]) for x in mine)
        if len(mine) > 1 and not heading:
            return found
        found = reader.parents[found]
    return found


def link_lists(reader: LineReader, live: list[tuple[tuple, bool, bool]]) -> list[bool]:
    """Elements of which every line is links alone and none is content, with two lines at least."""
    n = len(reader.tags)
    lines, other = [0] * n, [0] * n
    for (_, _, element, only_links), _, sure in live:
        lines[element] += 1
        other[element] += sure or not only_links
    for e in range(n - 1, 0, -1):
        lines[reader.parents[e]] += lines[e]
        other[reader.parents[e]] += other[e]
    return _flags(reader, {e for e in range(n) if lines[e] > 1 and not other[e]})


def _above(reader: LineReader, element: int) -> Iterator[int]:
    """The element and those it stands in, up to the page."""
    while element >= 0:
        yield element
        element = reader.parents[element]


def _flags(reader: LineReader, chosen: set[int]) -> list[bool]:
    """For every element whether it or one that it stands in is chosen."""
    out = [False] * len(reader.tags)
    for e in range(len(out)):
        out[e] = e in chosen or e > 0 and out[reader.parents[e]]
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader()
        for batch in batches:
            found = [main_text(reader, x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
