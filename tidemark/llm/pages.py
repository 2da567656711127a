"""Operator 4: main text of web pages.

The standard library's parser streams start, end and text events; blocks of text
("lines") end where block-level elements begin or end. Every line has a text-to-tag
ratio, its characters over its tags. The ratios are smoothed by a Gaussian over
neighbouring lines and split in two clusters by a threshold between the cluster
means; the upper cluster marks the content, its runs cut to lines that are over the
threshold by themselves at both ends. Lines count by their characters, marked
ones in full, unmarked prose by half. The content region is the innermost article or
main that holds most of this mass, with the articles beside it that have a quarter of
its mass or more; where these hold no more than half, it is the innermost element that
no marked line lies outside of, grown to each ancestor that adds prose beside it,
without runs of unmarked lines of links. All lines of the region are the text, but for
those inside boilerplate elements: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments.
A block that only its class, id or role (or a form tag) makes boilerplate is kept when
it outweighs the rest of the page and either holds the page's h1 or leaves no line of prose
outside: it is then a wrapper of the content. Weight alone brings no sidebar back.

Pages are handled one by one inside tasks, as large batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never content.
DROPPED = frozenset(
    "head title script style noscript template iframe object svg math canvas video audio nav aside footer fieldset button select textarea "
    "label input dialog menu datalist".split()
)
#: Elements that close an open paragraph, and pairs in which a new one closes the old.
CLOSES_P = BLOCK - {"option", "body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
REGIONS = frozenset(("article", "main", "section", "div", "td", "body", "blockquote"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of class, id and role that mark boilerplate.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adbox|adsense|sponsor(?:ed|s)?|promos?|promotions?|banner|sidebars?|side-?bar|rail|widgets?|menus?|nav|navbar|"
    r"navigation|topbar|masthead|breadcrumbs?|pagination|pager|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notices?|alert|popups?|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|recommendations|footer|site-?header|page-?header|copyright|"
    r"skip-?link|tags|toolbar|paywall|complementary|contentinfo|navigation|dialog)(?:$|[\s_-])",
    re.I,
)
#: Of these, the words for readers' texts, which can be longer than the page's own.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])", re.I)
#: Characters of a line of prose and its text-to-tag ratio at least; characters of the only line of a wrapper.
PROSE_CHARS, PROSE_RATIO, WRAPPED_CHARS = 80, 20.0, 200
#: A region grows to an ancestor that has so much of the region's mass beside it.
BESIDE = 0.05
#: Articles count beside the chosen one from so much of its mass.
ALONGSIDE = 0.25
#: A menu on a page that names no content: so many lines in a row, each with so much of its text in links.
MENU_LINES, LINKED = 3, 0.6
_STYLE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Lines(HTMLParser):
    """Collects lines: (text, tags, characters in links, region element, chain of doubtful wrappers).

    Region elements and doubtful wrappers are trees of numbers with a parent each, so
    that a line costs the same at every depth. A wrapper is part of two chains: of all
    wrappers around a line, and of those around readers' texts alone.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple]] = []
        self.open: dict[str, int] = {}
        # dropped, region, in an article, chain of doubts, chain of readers' doubts
        self.state: tuple[bool, int, bool, int, int] = (False, -1, False, -1, -1)
        self.texts: list[str] = []
        self.tags = self.linked = 0
        self.heading = False  # the line has text of an h1
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.kinds: list[str] = []  # of region elements
        self.parents: list[int] = []
        self.readers: list[bool] = []  # of doubtful wrappers
        self.chains: list[tuple[int, int]] = []  # (wrapper, chain before it)
        self.headed: set[int] = set()  # chains around an h1

    def end_line(self) -> None:
        if self.texts:
            text = " ".join("".join(self.texts).split())
            if text:
                self.lines.append((text, max(1, self.tags), self.linked, self.state[1], self.state[3]))
                if self.heading and self.state[3] >= 0:
                    self.headed.add(self.state[3])
            self.texts = []
        self.tags = self.linked = 0
        self.heading = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self.texts.append(" ")
            if tag == "hr":
                self.end_line()
            self.tags += 1
            return
        if tag in BLOCK:
            self.end_line()
            if tag in SIBLINGS or tag in CLOSES_P:
                self._close_implied(tag)
        self.tags += 1
        dropped, region, in_article, doubt, readers = self.state
        marks = _marks(attrs) if attrs and tag not in ("body", "html") else None
        if tag in ("article", "main") and (dropped or doubt >= 0) and not marks and not any(self.open.get(t) for t in ("script", "style", "template", "noscript", "aside", "dialog")):
            dropped, doubt = False, readers  # an element left open before the content
        if not dropped and (tag in DROPPED or marks == "hidden" or (marks and tag not in BLOCK)):
            dropped = tag not in HEADINGS
        elif not dropped and (marks or tag == "form") and tag not in HEADINGS:
            self.chains.append((len(self.readers), doubt))
            doubt = len(self.chains) - 1
            if marks == "readers":
                self.chains.append((len(self.readers), readers))
                readers = len(self.chains) - 1
            self.readers.append(marks == "readers")
        if not dropped and tag == "header" and not in_article:
            dropped = True
        if tag in REGIONS and not dropped:
            self.kinds.append(tag)
            self.parents.append(region)
            region = len(self.kinds) - 1
            in_article = in_article or tag == "article"
        self.stack.append((tag, self.state))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.state = (dropped, region, in_article, doubt, readers)

    def _close_implied(self, tag: str) -> None:
        closed = SIBLINGS.get(tag, frozenset())
        if not self.open.get("p") and not any(self.open.get(t) for t in closed):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in closed or (name == "p" and tag in CLOSES_P):
                self._pop(i)
                return
            if name in REGIONS or name in ("ul", "ol", "dl", "table", "select"):
                return

    def _pop(self, i: int) -> None:
        state = self.stack[i][1]
        if state[3] != self.state[3]:
            self.end_line()
        self.state = state
        for tag, _ in self.stack[i:]:
            self.open[tag] -= 1
        del self.stack[i:]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if self.open.get(tag):
            i = len(self.stack) - 1
            while self.stack[i][0] != tag:
                i -= 1
            self._pop(i)

    def handle_data(self, data: str) -> None:
        if not self.state[0]:
            self.texts.append(data)
            if self.open.get("h1"):
                self.heading = True
            if self.open.get("a"):
                self.linked += len(data)


def _marks(attrs: list) -> str | None:
    """"hidden", "readers" or "named" for attributes of boilerplate."""
    found = None
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (value and name == "style" and _STYLE_HIDDEN.search(value)):
            return "hidden"
        if value and name in ("class", "id", "role") and MARKED.search(value):
            found = "readers" if found == "readers" or READERS.search(value) else "named"
    return found


def content_cluster(chars: np.ndarray, tags: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """True for lines of the upper cluster of smoothed text-to-tag ratios."""
    ratio = chars / tags
    reach = np.arange(-3, 4)
    kernel = np.exp(-0.5 * (reach / sigma) ** 2)
    smooth = np.convolve(np.pad(ratio, 3), kernel, "valid") / np.convolve(np.pad(np.ones(len(ratio)), 3), kernel, "valid")
    threshold = smooth.mean()
    for _ in range(20):  # two means in one dimension
        upper = smooth >= threshold
        if upper.all() or not upper.any():
            break
        new = (smooth[upper].mean() + smooth[~upper].mean()) / 2
        if abs(new - threshold) < 1e-9:
            break
        threshold = new
    threshold = min(threshold, smooth.max())
    return _trimmed(smooth >= threshold, ratio >= threshold)


def _trimmed(marked: np.ndarray, above: np.ndarray) -> np.ndarray:
    """``marked`` without what lies in its runs before the first or after the last line ``above`` by itself.

    Smoothing bridges short lines inside content; it must not carry over its edge.
    """
    if not (marked & above).any():
        return marked
    edges = np.flatnonzero(np.diff(np.concatenate(([False], marked, [False])).astype(np.int8)))
    out = np.zeros(len(marked), bool)
    for a, b in zip(edges[::2], edges[1::2]):
        own = np.flatnonzero(above[a:b])
        if len(own):
            out[a + own[0] : a + own[-1] + 1] = True
    return out


def _is_prose(line: tuple) -> bool:
    return len(line[0]) >= PROSE_CHARS and len(line[0]) >= PROSE_RATIO * line[1]


def _weights(lines: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(marked, mass) of lines: characters of marked lines, half of other prose, next to nothing else."""
    chars = np.array([len(t) for t, *_ in lines], float)
    tags = np.array([n for _, n, *_ in lines], float)
    prose = np.array([_is_prose(x) for x in lines])
    marked = content_cluster(chars, tags)
    return marked, chars * np.where(marked, 1.0, np.where(prose, 0.5, 0.001))


def _without_boilerplate(lines: list[tuple], readers: list[bool], chains: list[tuple[int, int]], headed: set[int]) -> list[tuple]:
    """Lines outside doubtful wrappers, and of those that outweigh the lines outside and hold the h1 or all prose."""
    if all(c < 0 for *_, c in lines):
        return lines
    _, mass = _weights(lines)
    n = len(chains)
    inside, count, longest = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)  # lines below each link of a chain
    for (text, *_, c), m in zip(lines, mass):
        if c >= 0:
            inside[c] += m
            count[c] += 1
            longest[c] = max(longest[c], len(text))
    for c in range(n - 1, -1, -1):
        up = chains[c][1]
        if up >= 0:
            inside[up] += inside[c]
            count[up] += count[c]
            longest[up] = max(longest[up], longest[c])
    wrapper = np.array([w for w, _ in chains])
    top = wrapper.copy()  # wrappers that hold the same lines as the one around them are judged with it
    for c, (w, up) in enumerate(chains):
        if up >= 0 and count[up] == count[c] and readers[w] == readers[wrapper[up]]:
            top[c] = top[up]
    titled: set[int] = set()  # wrappers around an h1
    for c in headed:
        while c >= 0:
            titled.add(int(top[c]))
            c = chains[c][1]
    groups: dict[int, list] = {}
    for c in range(n):
        if top[c] == wrapper[c]:
            one = groups.setdefault(int(top[c]), [0.0, 0, 0])
            one[0] += inside[c]
            one[1] += count[c]
            one[2] = max(one[2], longest[c])
    kept: set[int] = set()
    while True:
        free = np.ones(n + 1, bool)  # links all of whose wrappers are kept; the last one stands for none
        for c, (_, up) in enumerate(chains):
            free[c] = free[up] and int(top[c]) in kept
        rest = sum(m for (*_, c), m in zip(lines, mass) if free[c])
        prose = any(free[x[-1]] and _is_prose(x) for x in lines)
        open_ = [
            (m, -w) for w, (m, k, most) in groups.items()
            if w not in kept and (w in titled or not prose) and m > rest * (2 if readers[w] else 1) and (k > 1 or (most >= WRAPPED_CHARS and not rest))
        ]
        if not open_:
            return [x for x in lines if free[x[-1]]]
        kept.add(-max(open_)[1])


def _regions(lines: list[tuple], kinds: list[str], parents: list[int]) -> tuple[set[int] | None, bool, np.ndarray]:
    """(elements that hold the content or None for the page, named as content, marked lines)."""
    marked, weight = _weights(lines)
    n = len(kinds)
    mass = np.zeros(n + 1)  # of each region element; the last one stands for the page
    some = np.zeros(n + 1, np.int64)  # marked lines in it
    for (*_, region, _), m, x in zip(lines, weight, marked):
        mass[region] += m
        some[region] += x
    for i in range(n - 1, -1, -1):
        mass[parents[i]] += mass[i]
        some[parents[i]] += some[i]
    content = [i for i in range(n) if kinds[i] in ("article", "main")]
    heavy = [i for i in content if mass[i] > mass[-1] / 2]
    if heavy:
        first = min(heavy, key=lambda i: (mass[i], -i))
    else:
        first = max(content, key=lambda i: (mass[i], -i), default=None)
    if first is not None:
        around, i = {first}, parents[first]
        while i >= 0:
            around.add(i)
            i = parents[i]
        within = np.zeros(n + 1, bool)  # elements in a chosen one
        chosen = {first}
        for i in range(n):
            within[i] = within[parents[i]] or i in chosen
            if not within[i] and i not in around and kinds[i] in ("article", "main") and mass[i] >= ALONGSIDE * mass[first]:
                chosen.add(i)
                within[i] = True
        if sum(mass[i] for i in chosen) > mass[-1] / 2:
            return chosen, True, marked
    # the innermost element that holds every marked line, and what lies beside it
    all_marked = int(some[-1])
    region = max((i for i in range(n) if some[i] == all_marked), default=-1)
    above, held = region, mass[region]
    while above >= 0:
        above = parents[above]
        if mass[above] - held >= BESIDE * held:
            region, held = above, mass[above]
    return (None if region < 0 else {region}), False, marked


def _menus(lines: list[tuple], marked: np.ndarray) -> np.ndarray:
    """True for runs of unmarked lines that are mostly links."""
    linked = np.array([k >= LINKED * len(t) for t, _, k, *_ in lines]) & ~marked
    edges = np.flatnonzero(np.diff(np.concatenate(([False], linked, [False])).astype(np.int8)))
    out = np.zeros(len(lines), bool)
    for a, b in zip(edges[::2], edges[1::2]):
        out[a:b] = b - a >= MENU_LINES
    return out


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by blank lines; "" for none or null."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = _without_boilerplate(parser.lines, parser.readers, parser.chains, parser.headed)
    if not lines:
        return ""
    chosen, named, marked = _regions(lines, parser.kinds, parser.parents)
    inside = np.zeros(len(parser.kinds) + 1, bool)
    if chosen is None:
        inside[:] = True
    else:
        for i, up in enumerate(parser.parents):
            inside[i] = inside[up] or i in chosen
    menus = np.zeros(len(lines), bool) if named else _menus(lines, marked)
    return "\n\n".join(x[0] for x, menu in zip(lines, menus) if inside[x[3]] and not menu)


def extract(pages: DataFrame, *, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out``; all columns and rows stay.

    Null and empty pages give an empty text. A column named ``out`` is replaced.
    """
    import pandas as pd

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(h) for h in part], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pages.withColumn(out, F.pandas_udf(run, "string")(F.col(html).cast("string")))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
