"""Main text of web pages: parser events, text-to-tag ratios by line, smoothed, and regions clustered by a threshold."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, map_batches, slices

# HTML elements by their role here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What is never text of a page, and elements whose text is rarely the article's.
UNSEEN = frozenset("applet audio canvas datalist embed head iframe map math noframes noscript object script style svg template title video".split())
ASIDE = frozenset("aside button dialog footer form menu nav select textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td th center body".split())
# Words of class and id names that mark what is not the article: those that do so as a name's first word
# whatever follows; those that do so alone, as its last word, or before a word for a part of a page; and words for parts.
PLAIN_HINTS = frozenset("ad ads adsense adslot advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription nav navbar navigation submenu breadcrumb breadcrumbs sidebar footer pagination pager comment comments disqus copyright".split())
OTHER_HINTS = frozenset("banner notice notices notification alert popup modal overlay signup login menu header masthead topbar toolbar share sharing social respond replies reply related recommended recommendations trending widget widgets hidden".split())
PARTS = frozenset("area articles bar block blocks bottom box button buttons col column container content dropdown form grid group headline heading holder icon icons inner item items left link links list media message outer overlay panel post posts region right row section slot stories strip text title tools top unit wrap wrapper zone".split())
COMMENT_HINTS = frozenset("comment comments disqus respond replies reply ad ads advert related sponsored promo".split())
NEGATIONS = frozenset("with has no without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAME = re.compile(r"[A-Za-z][a-z]*")
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_TAG = re.compile(r"<[^<>]*>")
#: Tags without an end that are looked for in all of a page.
RECOVERIES = 30

SIGMA = 1.0
#: Lines that the smoothing reaches to either side.
REACH = int(3 * SIGMA)
#: What a line's ratio counts in an element whose name only hints at something else.
HINTED = 0.25
#: Part of a region's characters that must lie on lines above the threshold for the region to be content.
SHARE = 0.25


class _Line:
    __slots__ = ("block", "container", "landmark", "link", "parts", "tags", "weight")

    def __init__(self, container: int, landmark: int, block: str, weight: float):
        self.parts: list[str] = []
        self.tags, self.link, self.container, self.landmark, self.block, self.weight = 0, 0, container, landmark, block, weight


class LineParser(HTMLParser):
    """Lines (blocks of text) of a page from the events of the standard parser, each with the weight that its elements give it.

    Names and kinds of elements remove nothing but what is never shown: they set weights, 0 where they say plainly that
    an element isn't the article, HINTED where they hint at it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.stack: list[tuple[str, int, float]] = [("", 0, 1.0)]  # open containers: element, number and weight
        self.open: dict[str, int] = {}  # how many of each name the stack has
        self.marks: list[tuple[str, int]] = []  # open article and main elements, and the number of each
        self.count = 0
        self.skip, self.skip_tag, self.heading, self.block = 0, "", "", ""
        self.unseen = False  # whether what is skipped is never shown
        self.link: list[tuple[_Line, int]] | None = None  # characters in the open link; they count once it is closed
        self.line: _Line | None = None

    def parse_html_declaration(self, i: int) -> int:
        """Comments as they are; any other declaration or marked section, whatever it holds, ends at the next ``>``."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        return self.rawdata.find(">", i + 2) + 1 or -1

    def read(self, html: str) -> None:
        """The whole page. A tag or comment that never ends is taken to end at its first ``>``, and without one is dropped.

        The parser looks through all that follows for the end of each such tag; after RECOVERIES of them the text is read
        off between angle brackets, so that time stays in proportion to the page.
        """
        self.feed(html)
        for _ in range(RECOVERIES):
            rest = self.rawdata
            if self.cdata_elem or not _OPEN.match(rest):
                break
            self.rawdata = ""
            self.feed(rest[rest.find(">") + 1 or len(rest) :])
        else:
            rest, self.rawdata = self.rawdata, ""
            self.feed(_TAG.sub(" ", rest).replace("<", " "))
        self.close()

    def _break(self, tag: str = "") -> None:
        self.line, self.block = None, tag

    def _open(self) -> _Line:
        if self.line is None:
            landmark = self.marks[0][1] if self.marks else 0
            _, container, weight = self.stack[-1]
            self.line = _Line(container, 0 if self.skip else landmark, self.block, 0.0 if self.skip else weight)
            self.lines.append(self.line)
        return self.line

    def _weight(self, tag: str, attrs: list[tuple[str, str | None]]) -> float:
        if tag in ("html", "body", "main"):
            return 1.0
        if tag in ASIDE or (tag == "header" and not self.marks):
            return 0.0
        weight = 1.0
        for name, value in attrs:
            value = value or ""
            if name in ("hidden", "aria-hidden") and value in ("", "true", "hidden"):
                return 0.0
            if name == "role" and value.lower() in ROLES:
                return 0.0
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return 0.0
            if name in ("class", "id"):
                for word in value.split():
                    weight = min(weight, self._named([p.lower() for p in _NAME.findall(word)], tag))
        return weight

    def _named(self, parts: list[str], tag: str) -> float:
        if not parts or NEGATIONS.intersection(parts) or (parts[-1] == "header" and self.marks):
            return 1.0
        first, last = parts[0], parts[-1]
        if tag == "article":
            return 0.0 if first in COMMENT_HINTS or last in COMMENT_HINTS else 1.0
        if first in PLAIN_HINTS or last in PLAIN_HINTS or last in OTHER_HINTS or (first in OTHER_HINTS and last in PARTS):
            return 0.0
        return HINTED if first in OTHER_HINTS else 1.0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        weight = 0.0 if tag in UNSEEN else self._weight(tag, attrs)
        if self.skip:
            if tag in ("article", "main") and self.skip_tag not in ("article", "noscript", "template", "form") and weight:
                self.skip = 0  # what was left open ends where the article begins
                self._break()
            else:
                self.skip += tag == self.skip_tag and tag not in VOID
                if tag in BLOCKS:
                    self._break(tag)
                return
        if tag not in VOID and not weight:
            self.skip, self.skip_tag, self.unseen = 1, tag, tag in UNSEEN
            if tag in BLOCKS or not self.unseen:
                self._break(tag)
            return
        if tag in BLOCKS:
            self._break(tag)
        elif self.line is not None:
            self.line.tags += 1
            if tag in ("br", "td", "th", "img"):
                self.line.parts.append(" ")
        if tag in HEADINGS:
            self.heading = tag
        if tag == "a":
            href = dict(attrs).get("href")
            own = href is None or self.heading == "h1" or (self.heading and href.startswith("#"))  # a title's link, or an anchor
            self.link = None if own else []
        if tag in CONTAINERS:
            self.count += 1
            self.stack.append((tag, self.count, min(weight, self.stack[-1][2]) if tag not in ("article", "main") else weight))
            self.open[tag] = self.open.get(tag, 0) + 1
            if tag in ("article", "main"):
                self.marks.append((tag, self.count))

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip_tag:
                self.skip -= 1
            elif tag in ("body", "html"):
                self.skip = 0
            if tag in BLOCKS or (not self.skip and not self.unseen):
                self._break()
            return
        if tag in BLOCKS:
            self._break()
        elif self.line is not None:
            self.line.tags += 1
        if tag in HEADINGS:
            self.heading = ""
        if tag == "a":
            for line, n in self.link or ():
                line.link += n
            self.link = None
        if self.open.get(tag):
            while True:
                name, number, _ = self.stack.pop()
                self.open[name] -= 1
                if self.marks and self.marks[-1][1] == number:
                    self.marks.pop()
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        if (self.skip and self.unseen) or (self.line is None and not data.strip()):
            return
        line = self._open()
        line.parts.append(data)
        if self.link is not None and not self.skip:
            self.link.append((line, len(" ".join(data.split()))))


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(x, REACH, mode="edge"), kernel / kernel.sum(), mode="valid")


def scores(lines: list[tuple]) -> tuple[np.ndarray, np.ndarray, float]:
    """Each line's ratio and score, and the threshold.

    A line's ratio is its weighted characters outside links for each tag. Scores are the ratios smoothed over neighbours,
    weighted again, so that no neighbour lends a menu its text; the threshold is their standard deviation before that.
    """
    weight = np.array([x[5] for x in lines])
    ratio = weight * [max(0, len(t) - link) / max(1, tags) for t, tags, link, *_ in lines]
    smooth = _smooth(ratio)
    return ratio, weight * smooth, float(smooth.std())


def content_lines(lines: list[tuple[str, int, int, int, int, float, str]]) -> list[bool]:
    """Whether each line belongs to the main text.

    lines: text, tags, characters in links, container, landmark, weight, block element. Lines whose score reaches the
    threshold are near content; those whose own ratio does too, not mostly of links, are cores. A region is all of a
    landmark (article, main) or else of a container. It is content if it has a core and lines near content have SHARE of
    its characters, and then stays whole. Elsewhere cores stay, headings near content, and lines that have cores close
    on both sides. Lines without weight never stay.

    Of lines in content that are links and nothing else, a paragraph's or a list's stay where content of their region
    follows and precedes: what stands at its ends, or in a box of its own, leads elsewhere.
    """
    ratio, score, threshold = scores(lines)
    linked = [2 * x[2] > len(x[0]) for x in lines]
    near = [ok and x[5] > 0 and not out for ok, out, x in zip((score >= threshold).tolist(), linked, lines, strict=True)]
    core = [ok and own for ok, own in zip(near, (ratio >= threshold).tolist(), strict=True)]
    core = core if any(core) else near
    region = [(1, x[4]) if x[4] else (0, x[3]) for x in lines]
    if not any(core):  # a page of links: the region with the most text
        total: dict[tuple[int, int], int] = {}
        for x, r in zip(lines, region, strict=True):
            total[r] = total.get(r, 0) + (len(x[0]) if x[5] else 0)
        most = max(total, key=lambda r: total[r])
        return [r == most and x[5] > 0 for x, r in zip(lines, region, strict=True)]
    held: dict[tuple[int, int], list[int]] = {}
    span: dict[tuple[int, int], list[int]] = {}
    for i, (x, r) in enumerate(zip(lines, region, strict=True)):
        if x[5] and not linked[i]:
            own = held.setdefault(r, [0, 0])
            own[0] += len(x[0])
            own[1] += len(x[0]) * near[i]
        if core[i]:
            span.setdefault(r, [i, i])[1] = i
    chosen = {r for r in span if held[r][1] >= SHARE * held[r][0]}
    between = _between(core)
    keep = []
    for i, (x, r) in enumerate(zip(lines, region, strict=True)):
        ok = x[5] > 0 and (core[i] or r in chosen or between[i] or (near[i] and x[6] in HEADINGS))
        if ok and linked[i]:
            alone = x[2] >= len(x[0])
            ok = r in chosen and span[r][0] < i < span[r][1] and (not alone or x[6] in ("p", "li", "dd", "dt", "td", "th"))
        keep.append(ok)
    return keep


def _between(core: list[bool]) -> list[bool]:
    """Whether a line has a core within REACH before it and one within REACH after it."""
    at = np.arange(len(core))
    before = np.maximum.accumulate(np.where(core, at, -len(core) - REACH))
    after = np.minimum.accumulate(np.where(core, at, 2 * len(core) + REACH)[::-1])[::-1]
    return ((at - before <= REACH) & (after - at <= REACH)).tolist()


def extract(html: str | None) -> str:
    """Main text of a page: blocks in page order, one a line."""
    if not html:
        return ""
    parser = LineParser()
    parser.read(html)
    lines = [(" ".join("".join(x.parts).split()), x.tags, x.link, x.container, x.landmark, x.weight, x.block) for x in parser.lines]
    lines = [x for x in lines if x[0]]
    keep = content_lines(lines) if lines else []
    return "\n".join(x[0] for x, ok in zip(lines, keep, strict=True) if ok)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row, one scan without a shuffle.

    Null and empty html, and pages without text, give ''. Repeated rows, null ids and null urls stay as they are.
    Other columns are not read. An empty table gives no rows.
    """

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            outs = []
            for part in slices(batch, 500):
                texts = [extract(h).encode("utf-8", "replace").decode() for h in part.column(2).to_pylist()]
                outs.append(pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]))
            return joined(outs)

        return step

    return map_batches(df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), start, "page_id long, url string, text string, n_chars long")
