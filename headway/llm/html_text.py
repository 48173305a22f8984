"""Main text of pages by tag-path ratios.

Every piece of text hangs on a path of block tags from the root; a step of a path
is a tag with its class and id. Per page:

1. Aggregate: pieces, characters, marks of punctuation and characters in links
   are summed by path, and up the tree of paths, so each beginning of a path has
   the sums of all paths that share it. A piece is text between two block tags.
2. Smooth: characters and marks per piece of a path are drawn to those of its
   beginning, as if it had ``PRIOR`` more pieces like that one.
3. Fuse: (characters per piece) * (1 + marks per piece) * (share of the page's
   characters) * (share of characters outside links).
4. Threshold: a path is worth its own fused ratio or that of its beginning (less
   the share in links), whichever is more. It holds content if that reaches
   ``PART`` of the way, on a log scale, from the ratio of the whole page to that
   of the best path that ends at a container (at no tag of ``TEXT_TAGS``).

Markers only weigh: characters below ``article`` and the like count ``FOR`` times,
below ``nav``, ``footer``, ``form`` and the like, or below a step whose class or
id names a menu, an advert or comments, ``AGAINST`` times, and such a step takes
over only that part of the worth of its beginning. What the ratios make of it
decides; ``markers=False`` leaves the weights out. Scripts, styles, controls and
what a page hides are no text at all.

Pages are taken one by one where they lie, in batches; nothing is shuffled. A
path is a number in a tree, and a step of the walk costs the same at any depth,
so time and memory grow with a page's length, however deep it is or many tags it
leaves open.

Null and empty pages give an empty text. Tags may be unclosed or nested wrongly;
a page without any tag is all content. Very long pages are read whole. Repeated
rows each get their row, an empty table gives none, and columns besides page_id,
url and html are ignored, so names cannot clash. A null page_id or url stays null.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What is never shown as text, and controls.
HIDDEN = set("script style noscript template head title textarea select option svg math iframe object canvas audio video datalist dialog button".split())
RAW = set("script style textarea title noscript iframe".split())
#: Parts of a page that are seldom article.
BESIDE = set("nav header footer aside form menu".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: A new block ends an open paragraph.
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start tag that ends an open one of these, unless one of the others stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: Tags that stand for one block of text, or a list or table of them, in some container.
TEXT_TAGS = set("p li h1 h2 h3 h4 h5 h6 ul ol blockquote pre dl dt dd table thead tbody tfoot tr td th caption figcaption".split())
BESIDE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
MAIN_ROLES = {"main", "article"}
BESIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|sidebar|side-bar|menu|nav\w*|footer|masthead|"
    r"comments?|commentlist|disqus|repl(?:y|ies)|share|sharing|social|related|recommended|breadcrumbs?|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S
)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MARKS = re.compile(r"[.,;:!?…。，、！？؟।]")
PRIOR, PART = 1.0, 0.5
#: Weights of markers; those of a path are multiplied, down to LEAST.
FOR, AGAINST, LEAST = 8.0, 0.02, 1e-9


class Tree:
    """Paths as numbers. A path has a beginning (its parent, a smaller number), the weight of its last step and of all its steps, and is hidden or not, below a main part or not, a container or not."""

    def __init__(self):
        self.parent, self.own, self.weight, self.hidden, self.main, self.holds = [-1], [1.0], [1.0], [False], [False], [True]
        self.step: dict[tuple[int, str], int] = {}

    def below(self, path: int, label: str, bad: bool, good: bool, hidden: bool) -> int:
        at = self.step.get((path, label))
        if at is None:
            at = self.step[path, label] = len(self.parent)
            own = AGAINST if bad else FOR if good and not self.main[path] else 1.0
            self.parent.append(path)
            self.own.append(min(own, 1.0))
            self.weight.append(max(self.weight[path] * own, LEAST))
            self.hidden.append(self.hidden[path] or hidden)
            self.main.append(self.main[path] or good)
            self.holds.append(label.split(" ", 1)[0] not in TEXT_TAGS)
        return at


class Walk:
    """The open tags of a page while it is read, with the places of each name among them."""

    def __init__(self):
        self.open: list[tuple[str, int, bool]] = []  # name, path, in a link
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # places of tags that are not inline

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def push(self, name: str, path: int, link: bool) -> None:
        self.places[name].append(len(self.open))
        if name not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((name, path, link))

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            name = self.open.pop()[0]
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()


def pieces(page: str) -> tuple[Tree, list[tuple[int, str, bool]]]:
    """The tree of paths, and (path, text, in a link) in page order; a piece with path -1 parts blocks."""
    tree, walk, out, at, size = Tree(), Walk(), [], 0, len(page)
    path, link, hidden = 0, False, tree.hidden
    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at and not hidden[path]:
            text = page[at:end]
            out.append((path, html.unescape(text) if "&" in text else text, link))
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            out.append((-1, "", False))
        if m["close"]:
            place = walk.last((name,))
            if place >= 0:
                walk.cut(place)
        elif name not in VOID or name == "hr":
            if name in CLOSES_P and walk.blocks and walk.open[walk.blocks[-1]][0] == "p":
                walk.cut(walk.blocks[-1])
            if name in IMPLIED:
                ends, stops = IMPLIED[name]
                place = walk.last(ends)
                if place > walk.last(stops):
                    walk.cut(place)
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else size
            elif name != "hr":
                above, in_link = (walk.open[-1][1], walk.open[-1][2]) if walk.open else (0, False)
                walk.push(name, _step(tree, above, name, m["attrs"] or ""), in_link or name == "a")
        path, link = (walk.open[-1][1], walk.open[-1][2]) if walk.open else (0, False)
    return tree, out


def _step(tree: Tree, above: int, name: str, attrs: str) -> int:
    """The path of a tag below ``above``. Inline tags add a step only where markers or hiding say something."""
    got = {a.lower(): html.unescape(x or y or z) for a, x, y, z in ATTR.findall(attrs)} if attrs.strip(" /") else {}
    named = f"{got.get('class', '')} {got.get('id', '')}".strip() if got else ""
    role = got.get("role", "").lower()
    hidden = name in HIDDEN or (bool(got) and ("hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()))
    good = name in ("article", "main") or role in MAIN_ROLES or got.get("itemprop", "").lower() == "articlebody"
    bad = (name in BESIDE and not (name == "header" and tree.main[above])) or role in BESIDE_ROLES
    bad = bad or (bool(named) and name not in ("html", "body", "article", "main") and bool(BESIDE_NAMES.search(named)))
    if name in INLINE and not (hidden or bad):
        return above
    return tree.below(above, f"{name} {named} {role}" if named or role else name, bad, good, hidden)


def content_paths(tree: Tree, found: list[tuple[int, str, bool]], markers: bool = True) -> list[bool]:
    """By path: whether its smoothed and fused ratio, or what it takes over from its beginning, reaches the threshold."""
    n, last = len(tree.parent), -1  # last: the path of a piece that goes on
    count, chars, marks, linked = ([0.0] * n for _ in range(4))
    for path, text, link in found:
        if path >= 0 and text.isspace():
            continue
        if path >= 0:
            size = len(text) * (tree.weight[path] if markers else 1.0)
            count[path] += path != last
            chars[path] += size
            marks[path] += len(MARKS.findall(text))
            linked[path] += size * link
        last = path
    for p in range(n - 1, 0, -1):
        for column in (count, chars, marks, linked):
            column[tree.parent[p]] += column[p]
    if not chars[0]:
        return [True] * n
    per_piece, marks_per_piece, worth = [0.0] * n, [0.0] * n, [0.0] * n
    for p in range(n):
        if not count[p]:
            continue
        up, prior = max(tree.parent[p], 0), PRIOR if p else 0.0
        per_piece[p] = (chars[p] + prior * per_piece[up]) / (count[p] + prior)
        marks_per_piece[p] = (marks[p] + prior * marks_per_piece[up]) / (count[p] + prior)
        plain = 1 - linked[p] / chars[p]
        fused = per_piece[p] * (1 + marks_per_piece[p]) * (chars[p] / chars[0]) * plain
        worth[p] = max(fused, worth[up] * plain * (tree.own[p] if markers else 1.0))
    limit = worth[0] ** (1 - PART) * max(w for w, holds in zip(worth, tree.holds, strict=True) if holds) ** PART
    return [w >= limit * (1 - 1e-9) for w in worth]


def main_text(page: str | None, markers: bool = True) -> str:
    if not page:
        return ""
    tree, found = pieces(page)
    keep = content_paths(tree, found, markers)
    return " ".join("".join(" " if p < 0 else text for p, text, _ in found if p < 0 or keep[p]).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [main_text(x) for x in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"].astype("Int64"), "url": f["url"], "text": text, "n_chars": list(map(len, text))})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
