"""Main text of web pages by text-to-tag ratio.

The standard library's parser is fed the page in pieces. Its events give lines (the text of
a block between two block tags) with their number of tags, how much of their text is links,
and the region each line lies in: the innermost division, list, table or section around it.
The ratio of text outside links to tags is smoothed over the lines with a Gaussian; two
clusters of the smoothed ratios give the threshold, and regions above it are content. Where
the page marks an article or main part, all of it is candidate content, however short its
paragraphs, but for regions that hold several links and nothing else.

What the markup itself says is something else (navigation, forms, footers, scripts, roles)
is never a candidate. Names of classes and ids are only hints, since anybody may use them:
a part with such a name is left out as long as anything else is left; paragraphs and
headings only where the name has no other meaning. Comments of readers never come back.

Defined cases: a null or empty page has the empty text. Pages are read whole. Unclosed and
stray tags are tolerated. Scripts, styles and buttons inside a block do not end it. Regions
of equal ratio are kept or left out together. Repeated rows give repeated results, an empty
table none. Columns other than those to keep and the page play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
NO_TEXT = frozenset("head script style noscript template iframe svg canvas object audio video math".split())
ASIDE = frozenset("nav footer aside form button select textarea option menu dialog fieldset".split())
ROOTS = frozenset(("article", "main"))
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|alert|popup|modal|"
    r"overlay|sidebar|side|menu|nav|navbar|navigation|breadcrumb\w*|footer|masthead|comments?|commentlist|disqus|replies|"
    r"share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|login|signup|search|skip|pagination|"
    r"pager|toolbar)(?=$|[\s_-])"
)
# Names that say the same on a paragraph or heading too.
PLAIN_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adslot|sponsor\w*|cookie\w*|consent|notice\w*|newsletter|breadcrumb\w*|"
    r"comments?|commentlist|disqus|replies|pagination|pager)(?=$|[\s_-])"
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption td th caption".split())
REGIONS = frozenset("div section ul ol dl table center details figure header address article main body".split())
#: Elements whose text is dropped without ending the block that they stand in.
WITHIN_BLOCKS = frozenset("script style noscript template svg canvas object audio video iframe button select textarea option".split())
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies)(?=$|[\s_-])")
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)

PIECE = 1 << 16
SIGMA = 1.0


@dataclass
class Line:
    text: str
    tags: int
    region: int
    rooted: bool
    hinted: bool = False
    links: int = 0
    linked: int = 0

    @property
    def ratio(self) -> float:
        """Characters outside links per tag, white space aside."""
        return max(len(self.text) - self.text.count(" ") - self.linked, 0) / max(self.tags, 1)


@dataclass
class _Open:
    tag: str
    region: int
    aside: bool
    rooted: bool
    comments: bool
    hinted: bool = False


class LineEvents(HTMLParser):
    """Collects lines from parser events; memory is bounded by the page's text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._open: list[_Open] = [_Open("", 0, False, False, False)]
        self._regions = 0
        self._text: list[str] = []
        self._tags = self._links = self._linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._ends_line(tag):
            self._end_line()
        self._tags += 1
        self._links += tag == "a"
        if tag in CLOSES_PARAGRAPH and self._open[-1].tag in INLINE | {"p"}:
            self._close_paragraph()
        if tag in VOID:
            return
        if tag in ROOTS and (self._open[-1].aside or self._open[-1].hinted) and not self._open[-1].comments:
            self._leave_asides()
        above = self._open[-1]
        named = dict(attrs)
        names = f"{named.get('class') or ''} {named.get('id') or ''}".lower()
        comments = above.comments or bool(COMMENTS.search(names))
        aside = above.aside or comments or self._is_aside(tag, named, above)
        hinted = above.hinted or self._is_hinted(tag, names)
        rooted = above.rooted or tag in ROOTS or named.get("role") == "main"
        region = above.region
        if tag in REGIONS or (aside, hinted, rooted) != (above.aside, above.hinted, above.rooted):
            self._regions += 1
            region = self._regions
        self._open.append(_Open(tag, region, aside, rooted, comments, hinted))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style"):
            self.clear_cdata_mode()
        if tag not in VOID and tag in NO_TEXT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._ends_line(tag):
            self._end_line()
        self._tags += 1
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth].tag == tag:
                del self._open[depth:]
                break

    def handle_data(self, data: str) -> None:
        if not any(above.tag in NO_TEXT or above.tag in WITHIN_BLOCKS for above in self._open[-3:]):
            self._text.append(data)
            if any(above.tag == "a" for above in self._open[-4:]):
                self._linked += sum(map(len, data.split()))

    def close(self) -> None:
        super().close()
        self._end_line()

    def _ends_line(self, tag: str) -> bool:
        within = tag in WITHIN_BLOCKS or any(above.tag in WITHIN_BLOCKS for above in self._open[-3:])
        return tag not in INLINE and not within

    def _end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        at = self._open[-1]
        if text:
            # A line outside the content still counts among the ratios.
            region, rooted = (-1, False) if at.aside else (at.region, at.rooted)
            self.lines.append(Line(text, self._tags, region, rooted, at.hinted, self._links, self._linked))
            self._tags = self._links = self._linked = 0
        self._text.clear()

    def _close_paragraph(self) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth].tag == "p":
                del self._open[depth:]
                return
            if self._open[depth].tag not in INLINE:
                return

    def _leave_asides(self) -> None:
        while self._open[-1].aside or self._open[-1].hinted:
            self._open.pop()

    @staticmethod
    def _is_hinted(tag: str, names: str) -> bool:
        if tag in ("html", "body") or tag in ROOTS:
            return False
        return bool((PLAIN_NAMES if tag in TEXT_BLOCKS else ASIDE_NAMES).search(names))

    @staticmethod
    def _is_aside(tag: str, named: dict, above: _Open) -> bool:
        if tag in ASIDE or tag in NO_TEXT or tag == "title":
            return True
        if tag in ("html", "body") or tag in ROOTS:
            return False
        if tag == "header" and not above.rooted:
            return True
        if "hidden" in named or named.get("aria-hidden") == "true":
            return True
        return (named.get("role") or "").lower() in ASIDE_ROLES


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """The values under a Gaussian of two sigmas each way, ends renormalised."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[d + reach], values[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def cluster_threshold(values: list[float], rounds: int = 20) -> float:
    """The border between two clusters of numbers (two means from the extremes)."""
    low, high = min(values), max(values)
    for _ in range(rounds):
        border = (low + high) / 2
        below, above = [v for v in values if v <= border], [v for v in values if v > border]
        if not below or not above:
            break
        new = (sum(below) / len(below), sum(above) / len(above))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(lines: list[Line]) -> list[str]:
    """The lines of the regions whose smoothed ratio reaches the clusters' border."""
    candidates = [line for line in lines if line.region >= 0]
    rooted = any(line.rooted for line in candidates)
    candidates = [line for line in candidates if line.rooted == rooted]
    # Names are heeded while something is left without them.
    if any(not line.hinted for line in candidates):
        candidates = [line for line in candidates if not line.hinted]
    if not candidates:
        return []
    if rooted:
        menus = _menus(candidates)
        return [line.text for line in candidates if line.region not in menus]
    ratios = dict(zip(map(id, lines), smoothed([line.ratio for line in lines])))
    weight: dict[int, int] = {}
    total: dict[int, float] = {}
    for line in candidates:
        weight[line.region] = weight.get(line.region, 0) + len(line.text)
        total[line.region] = total.get(line.region, 0.0) + ratios[id(line)] * len(line.text)
    means = {region: total[region] / weight[region] for region in weight}
    # The best candidate is content even if all that lies around it has more text per tag.
    border = min(cluster_threshold(list(ratios.values())), max(means.values()))
    menus = _menus(candidates)
    kept = {region for region, mean in means.items() if mean >= border and region not in menus}
    return [line.text for line in candidates if line.region in kept]


def _menus(lines: list[Line]) -> set[int]:
    """Regions of two links and more without any text outside links, unless there are no others."""
    links: dict[int, int] = {}
    texts: set[int] = set()
    for line in lines:
        links[line.region] = links.get(line.region, 0) + line.links
        if line.ratio > 0:
            texts.add(line.region)
    return {region for region, n in links.items() if n >= 2 and region not in texts} if texts else set()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    events = LineEvents()
    for start in range(0, len(html), PIECE):
        events.feed(html[start : start + PIECE])
    events.close()
    return "\n".join(content_lines(events.lines))


def extract_main_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of each page, its main ``text`` and ``n_chars``, in code points."""
    source = pages.select(*keep, F.col(html_column).cast("string").alias("__html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("__html")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in keep], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*keep, "text", "n_chars"],
            )

    types = {field.name: field.dataType.simpleString() for field in source.schema.fields}
    schema = ", ".join(f"`{name}` {types[name]}" for name in keep) + ", text string, n_chars bigint"
    return source.mapInArrow(extract, schema)
