"""The extracted text against the standard library's parser, and the tree's importances against plain sums."""

import math
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from timberline.llm import html

SF = "/root/testdata/sf0.01"


class Article(HTMLParser):
    """Blocks of what stands in article elements; the given pages have one each, with headings, paragraphs and breaks."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.blocks = 0, [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("article", "p", "h1"):
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1"):
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_second_version(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in html.query(spark, SF).collect()}
    assert got == {i: "\n".join(Article(p or "").blocks) for i, p in pages.items()}


def test_the_tree_decides(spark, monkeypatch):
    """Without any name, advertisements, notices and comments go from every page; without the tree they stay on every page."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    monkeypatch.setattr(html, "TIP", 0.0)
    # the rows are made in workers, where nothing is patched: the plain nodes are told without a tip
    nodes = html.style_nodes
    monkeypatch.setattr(html, "style_nodes", lambda page: [(p, a, b, 0.0, c) for p, a, b, _, c in nodes(page)])
    low = low_nodes(pages)
    for r in pages.collect():
        own = low.get(html_host(r["url"]), frozenset())
        assert html.main_text(r["html"], own) == whole[r["page_id"]]
        alone = html.main_text(r["html"])
        assert len(alone) > len(whole[r["page_id"]]) and all(block in alone.split("\n") for block in whole[r["page_id"]].split("\n"))


def html_host(url):
    return url.split("://", 1)[1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower() if url and "://" in url else ""


def low_nodes(pages):
    """By host the paths that go, from plain entropies; names say what style_nodes lets them."""
    nodes = {(html_host(r["url"]), n[0], n[1], n[2], n[3], r["html"] if n[4] is None else n[4]) for r in pages.collect() for n in html.style_nodes(r["html"] or "")}
    out = defaultdict(set)
    for (h, path), x in importances(nodes).items():
        if x < html.MIN_IMPORTANCE:
            out[h].add(path)
    return {h: frozenset(paths) for h, paths in out.items()}


def importances(nodes):
    """By the definition -sum p log p: the mean of both entropies over log(pages), the lesser for containers beside articles; a host's pages but one
    against SHARED_PAGES for those of all hosts, less the tip."""

    def share(nodes):
        shares = []
        for feature in (2, 3):
            n = Counter(x[feature] for x in nodes)
            shares.append(-sum(c / len(nodes) * math.log(c / len(nodes)) for c in n.values()) / math.log(len(nodes)) if len(nodes) > 1 else 1.0)
        return min(shares) if nodes[0][1].endswith("*") else sum(shares) / 2

    by_host, by_path = defaultdict(list), defaultdict(list)
    for x in nodes:
        by_host[x[0], x[1]].append(x)
        by_path[x[1]].append(x)
    of_all = {path: share(own) for path, own in by_path.items()}
    weight = lambda own: (len(own) - 1) / (len(own) - 1 + html.SHARED_PAGES)
    return {(h, path): weight(own) * share(own) + (1 - weight(own)) * of_all[path] - own[0][4] for (h, path), own in by_host.items() if len(by_path[path]) > 1}


def test_importance(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select(html.host(pages["url"]).alias("host"), "html")
    want = importances({(r["host"], *n[:4], r["html"] if n[4] is None else n[4]) for r in rows.collect() for n in html.style_nodes(r["html"])})
    got = {(r["host"], r["path"]): r["importance"] for r in html.style_tree(rows).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_names_and_references():
    assert html.main_text("<article><p class='lead promo-free'>A</p><div class='share-price'>B</div><section class='legal analysis'>C</section><div class='related-work'>D</div></article>") == "A\nB\nC\nD"
    assert html.main_text("<main></main><div><p>Real story here</p></div>") == "Real story here"
    assert html.main_text("x &<i>amp;</i> y &lt;") == "x &amp; y <"
    assert html.main_text("a < b and c <d") == "a < b and c <d"
    assert html.main_text("<div class='promo'>story</div><article><p class='notice'>The court gave notice</p></article>") == "story\nThe court gave notice"  # a name alone says nothing
    ad = next(c for c in html.parse("<div class='ad'>buy</div>").children)
    assert html.main_text("<div class='ad'>buy</div><p>x</p>", frozenset([ad.path])) == "x"
    assert html.main_text("<div class='ad'>buy</div><article>x</article>", frozenset([ad.path])) == "buy\nx" and html.main_text("<div class='ad'>buy</div><article>x</article>", frozenset([f"{ad.path}*"])) == "x"
    assert html.main_text("<div class='ad'><article>story</article></div>", frozenset([ad.path])) == "story"  # holds an article


def test_names_tip_close_cases(spark):
    """Of two boxes that vary alike, a little less than needed with the tip, the named one goes."""
    pages = []
    for i in range(40):
        box = "<p>same</p>" if i < 33 else f"<p>other {i}</p>" + "<i>x</i>" * (i - 32)
        pages.append((i, "http://h/", f"<body><article><p>story {i}</p></article><div class='box'>{box}</div><div class='promo'>{box}</div></body>"))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["path"]: r for r in html.style_tree(table.select(html.host("url").alias("host"), "html")).collect()}
    box, promo = (next(c for c in html.parse(f"<body><div class='{name}'>x</div></body>").children[0].children).path + "*" for name in ("box", "promo"))
    assert found[box]["importance"] == pytest.approx(found[promo]["importance"] + html.TIP)


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a \"'" * 100_000, "<!" * 300_000, "<div>" * 30_000 + "</x>" * 30_000, "<b>" * 20_000 + "<div></div>" * 20_000, "<" * 500_000 + ">", "<a \"> <b '>" * 30_000, '<a ">" ' * 30_000, "<b><article>" + "<span>" * 30_000 + "</b>" * 30_000, "<p><div>" * 30_000, "<li><td>" * 30_000])
def test_hostile_pages_take_little_time(page):
    """In time proportional to the page: a page of some 200 KB to 1 MB takes under two seconds of this process, whatever else runs."""
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 2


@pytest.mark.parametrize("shape", [lambda n: '<a ">" ' * n, lambda n: "<b><article>" + "<span>" * n + "</b>" * n, lambda n: "<a x='>' y" * n])
def test_time_is_linear(shape):
    def took(n):
        page, began = shape(n), time.process_time()
        html.main_text(page)
        return time.process_time() - began

    took(2000)
    assert took(80_000) < 40 * max(took(8000), 0.01)  # ten times the page; a quadratic parser would take a hundred times as long


def test_few_pages_of_a_host_and_salted_sites(spark, monkeypatch):
    """A box that all hosts have goes from each, even where a host has one page."""
    monkeypatch.setattr(html, "BROADCAST_ROWS", 0)
    rows = [(i, f"http://h{i}/", f"<body><div class='box'>same every time</div><div class='body'><p>text {i}</p>{'<p>more</p>' * (i % 3)}</div>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([f"text {i}", *["more"] * (i % 3)]) for i in range(12)}
