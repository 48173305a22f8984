"""Tag-path ratios: against a plain version, without markers, on pages without an article, and on deep pages."""

import html
import math
import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from headway.llm import html_text
from headway.llm.base import table


class Paths(HTMLParser):
    """(path, text, in a link) of a page whose only slips are unclosed p and b; blocks are parted by None."""

    SKIP = {"script", "style", "title", "head"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self.out.append((None, "", False))
        if tag == "p" and any(t == "p" for t, _ in self.stack):
            while self.stack.pop()[0] != "p":
                pass
        if tag not in ("br", "meta"):
            name = dict(attrs).get("class")
            self.stack.append((tag, f"{tag} {name}" if name else tag))

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.out.append((None, "", False))
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(t in self.SKIP for t, _ in self.stack):
            path = tuple(label for t, label in self.stack if t not in ("a", "b"))
            self.out.append((path, data, any(t == "a" for t, _ in self.stack)))


BAD, GOOD = {"nav", "footer", "div ad"}, {"article"}


def plain_text(page, markers=True):
    parser = Paths()
    parser.feed(page)
    parser.close()
    found, pieces = [], []
    for path, text, link in parser.out:
        if path is None or text.strip():
            pieces.append((path, text, link))
    own = lambda path: (html_text.AGAINST if path[-1] in BAD else html_text.FOR if path[-1] in GOOD else 1.0) if markers else 1.0
    sums = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    last = None
    for path, text, link in pieces:
        if path is not None:
            weight = math.prod(own(path[: i + 1]) for i in range(len(path)))
            for i in range(len(path) + 1):
                s = sums[path[:i]]
                s[0] += path != last
                s[1] += len(text) * weight
                s[2] += sum(text.count(c) for c in ".,;:!?…")
                s[3] += len(text) * weight * link
        last = path
    worth, ratios = {}, {}
    for path in sorted(sums, key=len):
        n, chars, marks, linked = sums[path]
        if not path:
            a, b, above = chars / n, marks / n, 0.0
        else:
            a, b = ((x + html_text.PRIOR * y) / (n + html_text.PRIOR) for x, y in zip((chars, marks), ratios[path[:-1]], strict=True))
            above = worth[path[:-1]] * min(1.0, own(path))
        ratios[path] = a, b
        free = 1 - linked / chars
        worth[path] = max(a * (1 + b) * chars / sums[()][1] * free, above * free)
    best = max(w for path, w in worth.items() if not path or path[-1].split()[0] not in html_text.TEXT_TAGS)
    limit = math.exp((1 - html_text.PART) * math.log(worth[()]) + html_text.PART * math.log(best))
    for path, text, _ in parser.out:
        found.append(" " if path is None else text if not text.strip() or worth[path] >= limit * (1 - 1e-9) else "")
    return " ".join("".join(found).split())


@pytest.fixture(scope="module")
def pages():
    import pyarrow.parquet as pq

    return {sf: pq.read_table(f"/root/testdata/{sf}/pages.parquet", columns=["html"]).column("html").to_pylist() for sf in ("sf0.01", "sf0.1")}


def article(page):
    """What stands between the article tags, inline tags removed and blocks parted."""
    body = re.sub(r"</?b>", "", re.search(r"(?s)<article>(.*?)</article>", page).group(1))
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", body)).split())


def test_equals_the_plain_version(pages):
    for page in pages["sf0.01"]:
        for markers in (True, False):
            assert html_text.main_text(page, markers) == plain_text(page, markers)


def test_the_article_with_and_without_markers(pages):
    wanted = [article(p) for p in pages["sf0.1"]]
    assert [html_text.main_text(p) for p in pages["sf0.1"]] == wanted
    unmarked = sum(html_text.main_text(p, markers=False) == w for p, w in zip(pages["sf0.1"], wanted, strict=True))
    assert unmarked >= 0.96 * len(wanted)


def test_the_article_of_pages_without_any_marker(pages):
    names = [("<article>", '<div class="c1">'), ("</article>", "</div>"), ("<nav>", '<div class="c2">'), ("</nav>", "</div>"), ("<footer>", '<div class="c3">'), ("</footer>", "</div>"), ('class="ad"', 'class="c4"'), ("<body>", '<body><div id="w">')]
    right = 0
    for page in pages["sf0.1"]:
        wanted = article(page)
        for a, b in names:
            page = page.replace(a, b)
        right += html_text.main_text(page) == wanted
    assert right >= 0.96 * len(pages["sf0.1"])


def test_the_ratios_decide(pages, monkeypatch):
    page = pages["sf0.1"][0]
    tree, found = html_text.pieces(page)
    kept = html_text.content_paths(tree, found)
    assert any(kept) and not all(kept)
    monkeypatch.setattr(html_text, "content_paths", lambda tree, found, markers: [True] * len(tree.parent))
    assert all(html_text.main_text(p) != article(p) for p in pages["sf0.1"][:200])


@pytest.mark.parametrize(
    "make", [lambda n: "<div>x" * n, lambda n: "<b>" * n + "<p></p>" * n, lambda n: "<ul>" + "<div>" * n + "<li>y</li>" * n, lambda n: "<div>" * n + "</b>" * n, lambda n: "<p><div>" + "<b>" * n + "<p>q</p>" * n, lambda n: "<a '" * n]
)
def test_deep_and_unclosed_pages_take_time_in_proportion(make):
    def seconds(n):
        page = make(n)
        start = time.process_time()
        html_text.main_text(page)
        return time.process_time() - start

    seconds(1_000)
    assert seconds(80_000) < 16 * seconds(10_000) + 0.5


def test_a_megabyte_of_open_tags():
    page = "<div>x" * 170_000
    start = time.process_time()
    assert html_text.main_text(page).count("x") == 170_000
    assert time.process_time() - start < 8  # about 2 s on an idle machine


def test_lists_links_and_forms():
    text = "A long text, with marks. And one more, too. "
    page = f"<div class=wrap><ul class=x><li><a href=q>one</a><li><a href=q>two</a></ul><div class=post><h2>Title</h2><p>{text * 5}</p><ul><li>first<li>second</ul><p>See <a href=x>this link</a>, please.</p></div><form><label>Name, please.</label></form></div>"
    assert html_text.main_text(page) == f"Title {(text * 5).strip()} first second See this link, please."
    assert html_text.main_text(f"<form id=page><div class=post><p>{text}</p></div></form>") == text.strip()


def test_clashing_columns_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "'x' AS text", "7 AS n_chars")
    got = sorted(map(tuple, html_text.extract(rows).collect()), key=repr)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=repr)


def test_query_takes_every_page(spark, small):
    assert html_text.extract(table(spark, small, "pages")).filter("text = ''").count() == 0
