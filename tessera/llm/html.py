"""Main text of web pages from streaming parser events.

A page becomes lines, one for each block-level run of text, that know their containers.
A line's text-to-tag ratio counts its characters outside links for each tag; ratios are
smoothed with a Gaussian and split in two clusters.  The upper cluster says where the
content is: in the articles that hold half of its characters or more, else in the
innermost container that holds ``share`` of them.  All lines of that region are kept,
but for containers in it that have no line of the upper cluster and are mostly links.

Never content: scripts and other silent elements, navigation, asides and the like by
their tags, and elements whose class, id or role names such a part.  A name counts if a
whole word of the attribute is a marker, or a compound of one (``cookie-notice``) that
does not say how it relates to one (``has-sidebar``).  A marked wrapper does not cover
an article inside it, unless it marks adverts, comments or links to other articles;
if everything is marked, the marks are not heeded.

Null or empty html, and html without content: empty text.  Unclosed tags are closed
by the page's end.  A page of any length is parsed whole, in memory linear in it.
Repeated rows are extracted alike; an empty table gives an empty result; only the key,
url and html columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

#: Elements whose text is never shown as text.
SILENT = frozenset("script style noscript template head title svg math canvas iframe object embed audio video map select textarea button input option datalist meter progress".split())
#: Elements beside the article.
BESIDE = frozenset("nav header footer aside menu dialog search".split())
#: Words in class, id or role that mark parts beside the article.
BESIDE_WORDS = frozenset("ad ads advert advertisement adverts adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies disqus discussion footer header masthead share sharing social related recommended newsletter subscribe subscription widget toolbar pagination pager contentinfo complementary search login signup".split())
#: Those of them that cover articles inside, too.
COVERS = frozenset("ad ads advert advertisement adverts adsense banner sponsor sponsored promo promotion comment comments reply replies disqus discussion related recommended".split())
#: Words that make a compound say where a part is, not what the element is.
RELATES = frozenset("has with without no by is and or page layout wrap wrapper container content main article post entry body left-of right-of near beside over under".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary fieldset legend hr center hgroup form".split()) | BESIDE
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("div section ul ol dl table tbody tr td form fieldset details figure blockquote center body".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
#: A new start of one of these ends an open one (its end tag may be left out).
ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())
TOKENS = re.compile(r"[^\s]+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: How far a part is beside the article: marked by name, by a name that covers articles, or by its tag.
MARKED, COVERED, HIDDEN = 1, 2, 3


@lru_cache(maxsize=65_536)
def marked(value: str) -> int:
    """What the words of a class, id or role attribute mark."""
    found = 0
    for token in TOKENS.findall(value):
        if token.lower() in BESIDE_WORDS:
            said = [token.lower()]
        else:
            parts = [x.lower() for x in PARTS.findall(token)]
            said = [] if len(parts) < 2 or not RELATES.isdisjoint(parts) else [x for x in (parts[0], parts[-1]) if x in BESIDE_WORDS]
        if said:
            found = max(found, MARKED if COVERS.isdisjoint(said) else COVERED)
    return found


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    container: int
    main: int
    beside: int
    heading: bool


class Open(NamedTuple):
    tag: str
    beside: int
    container: int
    main: int


class Lines(HTMLParser):
    """Parser events to lines; ``parents`` has the container around each container, the page being 0."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents = [0]
        self.open: list[Open] = []
        self.text: list[str] = []
        self.where: Open | None = None
        self.tags = self.linked = 0
        self.link_at = 0  # how many elements are open around the open link, plus one; 0: none

    @property
    def at(self) -> Open:
        return self.open[-1] if self.open else Open("", 0, 0, 0)

    def flush(self) -> None:
        """End a line.  It belongs to the element its text began in, whatever is open by now."""
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            at = self.where or self.at
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), at.container, at.main, at.beside, at.tag in HEADINGS))
        self.text, self.where, self.tags, self.linked = [], None, 0, 0

    def handle_starttag(self, tag, attrs):
        at = self.at
        if tag in BLOCKS and at.beside < HIDDEN:
            self.flush()
            if tag in ENDS_ITSELF and at.tag == tag or tag not in VOID and at.tag == "p":
                self.open.pop()
                at = self.at
        if at.beside < HIDDEN:
            self.tags += 1
            if tag == "br":
                self.text.append(" ")
        if tag in VOID:
            return
        beside, block = at.beside, tag in BLOCKS
        if beside < HIDDEN and tag not in ("html", "body"):
            beside = max(beside, self.part(tag, attrs, at))
        if tag == "a":
            self.link_at = len(self.open) + 1
        if not (block or tag in SILENT or beside != at.beside or beside == HIDDEN and tag == at.tag):
            return
        container, main = at.container, at.main
        if beside == HIDDEN:
            self.open.append(Open(tag, beside, container, main))
            return
        if tag in MAIN or tag in CONTAINERS:
            container = len(self.parents)
            self.parents.append(at.container)
        if tag in MAIN and not main:
            main = container
            if beside == MARKED:
                beside = 0
        self.open.append(Open(tag, beside, container, main))

    @staticmethod
    def part(tag: str, attrs, at: Open) -> int:
        if tag in SILENT or (tag in BESIDE and not (tag == "header" and at.main)):
            return HIDDEN
        found = MARKED if tag == "form" and not at.main else HIDDEN if tag == "form" else 0
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true"):
                return HIDDEN
            if v and k in ("class", "id", "role"):
                found = max(found, marked(v))
        if found and tag not in BLOCKS:
            return HIDDEN  # an advert inside a line has nothing in it
        if tag in MAIN:
            return found if found == COVERED else 0
        return HIDDEN if found and at.main else found

    def handle_endtag(self, tag):
        if tag in BLOCKS and self.at.beside < HIDDEN:
            self.flush()
        if self.at.beside < HIDDEN:
            self.tags += 1
        if tag == "a":
            self.link_at = 0
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                if self.at.beside == HIDDEN and tag in BLOCKS and self.open[k].beside < HIDDEN:
                    self.flush()
                del self.open[k:]
                if len(self.open) + 1 < self.link_at:
                    self.link_at = 0
                break
            if self.open[k].tag in MAIN and tag not in ("body", "html", "main", "article"):
                break  # a stray end tag inside the article does not close it

    def handle_data(self, data):
        if self.at.beside < HIDDEN:
            if self.where is None and not data.isspace():
                self.where = self.at
            self.text.append(data)
            if self.link_at:
                self.linked += len(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Border of the two clusters (means of each side, until they stay)."""
    border = float(values.mean())
    for _ in range(50):
        low, high = values[values < border], values[values >= border]
        if not len(low) or not len(high):
            break
        if abs((new := (low.mean() + high.mean()) / 2) - border) < 1e-9:
            break
        border = float(new)
    return border


def regions(lines: list[Line], parents: list[int], upper: np.ndarray, share: float) -> np.ndarray:
    """Which lines the content regions keep.

    ``upper`` has the characters outside links of the lines in the upper cluster, else 0.
    The lines of a container and of those in it follow each other, so a container is a
    range of lines, and one pass from the last container to the first adds all up.
    """
    n = len(parents)
    first, last = [len(lines)] * n, [-1] * n
    mass, linked, chars = [0.0] * n, [0] * n, [0] * n
    for i, line in enumerate(lines):
        c = line.container
        first[c], last[c] = min(first[c], i), i
        mass[c] += upper[i]
        linked[c] += line.linked
        chars[c] += len(line.text)
    for c in range(n - 1, 0, -1):
        p = parents[c]
        first[p], last[p] = min(first[p], first[c]), max(last[p], last[c])
        mass[p] += mass[c]
        linked[p] += linked[c]
        chars[p] += chars[c]
    roots = {line.main for line, u in zip(lines, upper) if line.main and u > 0}
    if not roots or 2 * sum(mass[m] for m in roots) < mass[0]:
        # The innermost container with the share; a container comes after those around it.
        root = 0
        for c in range(1, n):
            if parents[c] == root and mass[c] >= share * mass[0]:
                root = c
        roots = {root}
    change = np.zeros((2, len(lines) + 1), np.int64)
    for c in range(n):
        if last[c] >= 0 and (c in roots or not mass[c] and linked[c] > 0.5 * chars[c]):
            change[int(c not in roots), [first[c], last[c] + 1]] += 1, -1
    inside, out = np.cumsum(change[:, :-1], axis=1) > 0
    return inside & ~out


def main_text(html: str | None, sigma: float = 1.5, share: float = 0.8) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    for most in (0, MARKED, COVERED):
        lines = [x for x in parser.lines if x.beside <= most]
        if any(x.text for x in lines):
            break
    else:
        return ""
    prose = np.array([len(x.text) - x.linked for x in lines], float)
    smooth = smoothed(prose / np.array([max(1, x.tags) for x in lines]), sigma)
    upper = np.where(smooth >= threshold(smooth), prose, 0.0)
    if not upper.any():  # nothing but links: each line is as likely
        upper = np.array([len(x.text) for x in lines], float)
    kept = [i for i in np.flatnonzero(regions(lines, parser.parents, upper, share)).tolist() if lines[i].text]
    # A heading just above the region is its title.
    above = next((i for i in range(kept[0] - 1, -1, -1) if lines[i].text), None) if kept else None
    if above is not None and lines[above].heading and not lines[above].main:
        kept.insert(0, above)
    return "\n".join(lines[i].text for i in kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, url, ``text`` and ``n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [key, url, "text", "n_chars"])

    kind = pages.schema
    return pages.select(key, url, html).mapInArrow(run, f"`{key}` {kind[key].dataType.simpleString()}, `{url}` {kind[url].dataType.simpleString()}, text string, n_chars long")
