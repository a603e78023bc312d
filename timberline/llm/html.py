"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of presentation: a node is a chain of elements with their names,
ids and classes. For each node the entropy, over the pages that have it, of how its children are laid out
(presentation) and of what its text says (content), each divided by log(pages), tells how much the pages differ in it: 1 where every page
differs, 0 where all are alike. The importance of a node is their mean; that of a container beside an article of its page the
lesser of both, as furniture may be laid out alike and say something else on every page. Branches of low importance are removed from each page.
What few pages of a host say is weighed with what all hosts' pages say of the same node.

What a branch is called only tips a close case: an `ad` or `comments` (a whole id or class) needs a little more importance to stay. A node
on one page alone is judged by nothing and stays. Elements that HTML itself keeps apart from the text (nav, footer, aside, form, script, ...) never count; elements that hold
an article are never removed.

Entropies are sums over counts, so no host's pages meet in one task. Copies of a page count once. Branches inside of articles are
judged over different articles, so that one article on many pages is no furniture; an article itself is never removed by its repetition.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import pieces, written
from timberline.llm.urls import host

#: What all hosts say weighs as much as so many pages of a host; the importance under which a node goes.
SHARED_PAGES, MIN_IMPORTANCE = 8, 0.25
#: By how much a name lessens importance.
TIP = 0.05
#: Rows of low nodes that are broadcast at most; more are joined by host, dealt over SALTS ways.
BROADCAST_ROWS, SALTS = 100_000, 64

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
FURNITURE = frozenset("head nav header footer aside form script style noscript template iframe object svg canvas button select option textarea dialog menu title xmp noembed noframes audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = BLOCKS - frozenset("address blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 hr li p pre td th tr summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

#: A heuristic, no standard: what furniture and readers' comments are often called. Such a name only tips a close case.
NAMES = frozenset("ad ads adbox ad-box advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar site-header masthead site-footer cookie-notice cookie-banner cookies consent gdpr notice popup modal newsletter newsletter-signup subscribe signup login share-buttons social social-links related-posts recommended pagination pager skip-link toolbar comments comment comment-list comments-area comment-section user-comments disqus disqus_thread replies reactions".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")
MARKUP = re.compile("<[a-zA-Z/!?]")
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"']++)))?""")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in RAW}
MAIN = frozenset(("article", "main"))
INLINE = frozenset("p b i em strong span a li".split())
NONE: dict[str, str] = {}
SPACE, DIGITS = re.compile(r"\s+"), re.compile("[0-9]+")


@lru_cache(10_000)
def chain(path: str, tag: str, name: str) -> str:
    """Stands for a chain of elements, at any depth."""
    return xxhash.xxh3_64_hexdigest(f"{path}>{tag}.{name}")


class Node:
    __slots__ = ("tag", "attributes", "children", "path", "shielded", "holds")

    def __init__(self, tag: str, attributes: dict[str, str], path: str, shielded: bool):
        self.tag, self.attributes, self.children, self.holds = tag, attributes, [], False
        name = " ".join(sorted(self.names())) if attributes else ""
        self.path = chain(path, tag, DIGITS.sub("#", name) if name else name)
        self.shielded = shielded or self.main()

    def names(self) -> list[str]:
        return f"{self.attributes.get('id', '')} {self.attributes.get('class', '')}".lower().split()

    def main(self) -> bool:
        return self.tag in MAIN or (bool(self.attributes) and self.attributes.get("role", "").lower() in MAIN)

    def furniture(self) -> bool:
        """Kept apart from the text by HTML itself."""
        if self.tag in FURNITURE and not (self.tag == "header" and self.shielded):
            return True
        a = self.attributes
        return bool(a) and self.tag not in ("html", "body", "article", "main") and (a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true")

    def name(self, root: "Node") -> str:
        """Its path; containers beside an article of the page are told from others of the path."""
        return f"{self.path}*" if root.holds and not self.shielded and self.tag in CONTAINERS else self.path

    def tip(self) -> float:
        """By how much its names lessen its importance."""
        return 0.0 if not self.attributes or NAMES.isdisjoint(self.names()) else TIP


#: Elements that the end of an inline element, or the beginning of a list item or cell, does not reach over.
WALLS, LISTS = frozenset("article main body td th".split()), frozenset("ul ol dl table select body article".split())


@lru_cache(1000)
def kinds(tag: str) -> tuple[str, ...]:
    return (tag, *("#block",) * (tag in BLOCKS), *("#wall",) * (tag in WALLS), *("#list",) * (tag in LISTS))


class Open:
    """The elements that are open, and where in the stack each kind of them stands, so that what an end tag closes is known without a walk."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], defaultdict(list)

    def last(self, kind: str) -> int:
        held = self.places.get(kind)
        return held[-1] if held else 0

    def push(self, node: Node) -> None:
        for kind in kinds(node.tag):
            self.places[kind].append(len(self.stack))
        self.stack.append(node)

    def close(self, upto: int) -> None:
        for node in self.stack[upto:]:
            for kind in kinds(node.tag):
                self.places[kind].pop()
        del self.stack[upto:]

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at and not (tag in INLINE and self.last("#wall") > at):
            self.close(at)

    def begin(self, tag: str) -> None:
        """Closes what the beginning of an element ends."""
        if tag in CLOSES_P and (at := self.last("p")) and self.last("#block") == at:
            self.close(at)
        if tag in SIBLINGS and (at := max(map(self.last, SIBLINGS[tag]))) and self.last("#list") < at:
            self.close(at)

    def holds_article(self) -> None:
        for node in reversed(self.stack):
            if node.holds:
                break
            node.holds = True


def parse(page: str) -> Node:
    """A tree of elements and text, without recursion, in time proportional to the page; unclosed and crossing elements are closed as browsers would, roughly.

    A `<` that no `>` follows is text, as is all after it. Where quotes keep a tag open to the end of the page, it and all later tags end at
    their first `>`, quoted or not.
    """
    root = Node("", {}, "", False)
    open_, at, end, last, tag_at = Open(root), 0, len(page), page.rfind(">"), TAG.match
    while at < end:
        next_, top = MARKUP.search(page, at), open_.stack[-1]
        begin = next_.start() if next_ else -1
        if begin < 0 or begin > last:
            top.children.append(page[at:])
            break
        if begin > at:
            top.children.append(page[at:begin])
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith(("<!", "<?"), begin):
            at = page.find(">", begin) + 1
            continue
        m = tag_at(page, begin)
        if m is None and (m := BROKEN.match(page, begin)):
            tag_at = BROKEN.match
        if m is None:  # no tag
            top.children.append("<")
            at = begin + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            open_.end(tag)
            continue
        open_.begin(tag)
        top = open_.stack[-1]
        said = m[3]
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(said)} if said and not said.isspace() else NONE
        node = Node(tag, attributes, top.path, top.shielded)
        if node.main():
            open_.holds_article()
        top.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if not said or not said.rstrip().endswith("/") or tag in BLOCKS or tag in ("a", "b", "i", "em", "span", "strong"):
            open_.push(node)
    return root


def walk(root: Node, stop):
    """('open' | 'close' | 'text', node or text) in page order, without what is below nodes for which stop holds."""
    todo = [iter(root.children)]
    nodes = [root]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            node = nodes.pop()
            if nodes:
                yield "close", node
        elif isinstance(child, str):
            yield "text", child
        elif not stop(child):
            yield "open", child
            todo.append(iter(child.children))
            nodes.append(child)


def main_text(page: str | None, low: frozenset[str] = frozenset()) -> str:
    """Blocks of the main text joined by a line feed. low: paths that the site style tree found unimportant.

    All that isn't furniture counts, within an article or main element and outside. References are decoded in each text by itself.
    """
    if not page:
        return ""
    root = parse(page)
    blocks, parts = [], []

    def goes(node: Node) -> bool:
        return node.furniture() or (node.name(root) in low and not node.holds and not node.main())

    def flush():
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append(text)
        parts.clear()

    for kind, x in walk(root, goes):
        if kind == "text":
            parts.append(references.unescape(x) if "&" in x else x)
        elif x.tag in BLOCKS:
            flush()
        elif x.tag == "br":
            parts.append(" ")
    flush()
    return "\n".join(blocks)


def style_nodes(page: str) -> list[tuple[str, int, int, float, int | None]]:
    """(name, presentation, content, tip, article) of each element path that can be furniture: hashes of its children's layout, of its whole
    text and, inside of articles, of all text of the page's articles."""
    root = parse(page)
    layout: dict[str, list[str]] = {}
    text: dict[str, list[str]] = {}
    tip: dict[str, float] = {}
    open_: list[tuple[Node, list[str], list[str]]] = []
    inner: set[str] = set()
    article: list[str] = []
    for kind, x in walk(root, Node.furniture):
        if kind == "text":
            if open_ and (said := SPACE.sub(" ", x).strip()):
                open_[-1][2].append(said)
                if open_[-1][0].shielded:
                    article.append(said)
        elif kind == "open":
            if open_:
                open_[-1][1].append(x.tag)
            open_.append((x, [], []))
        else:
            _, tags, said = open_.pop()
            if open_ and said:  # a branch says what its children say
                open_[-1][2].append(xxhash.xxh3_64_hexdigest("\0".join(said)))
            if x.main() or x.holds:
                continue
            layout.setdefault(name := x.name(root), []).extend(tags)
            text.setdefault(name, []).extend(said)
            tip[name] = x.tip()
            if x.shielded:
                inner.add(name)
    digest = lambda parts: xxhash.xxh3_64_intdigest("\0".join(parts).encode()) - (1 << 63)
    whole = digest(article)
    return [(p, digest(layout[p]), digest(text[p]), tip[p], whole if p in inner else None) for p in layout if text[p]]


def style_tree(pages: DataFrame, shared_pages: int = SHARED_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """(host, html) -> (host, path, importance, low): what the tree says of each node that more than one page has. What all hosts' pages say counts as much as
    shared_pages pages of the host, whose first page says nothing."""
    import pyarrow as pa

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                page = page.as_py()
                if page:
                    name = xxhash.xxh3_64_intdigest(page) - (1 << 63)
                    rows += [(h, name if article is None else article, *n) for *n, article in style_nodes(page.decode("utf-8", "replace"))]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["host", "page", "path", "presentation", "content", "tip"])

    nodes = pages.mapInArrow(run, "host string, page long, path string, presentation long, content long, tip double").distinct()
    counts = nodes.select("host", "path", "tip", F.explode(F.array(F.struct(F.lit("p").alias("kind"), F.col("presentation").alias("feature")), F.struct(F.lit("c").alias("kind"), F.col("content").alias("feature")))).alias("f")).groupBy("host", "path", "tip", "f").agg(F.count("*").alias("c"))
    counts = written(counts.select("host", "path", "tip", "f.kind", "f.feature", "c"))

    def judged(counts: DataFrame, *keys: str) -> DataFrame:
        """m, pages that have the node, and its importance: the mean of both shares, beside articles the lesser."""
        entropy = counts.groupBy(*keys, "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
        share = F.when(F.col("m") > 1, (F.log("m") - F.col("clogc") / F.col("m")) / F.log("m")).otherwise(1.0)
        return entropy.withColumn("share", share).groupBy(*keys).agg(F.max("m").alias("m"), F.when(F.endswith("path", F.lit("*")), F.min("share")).otherwise(F.avg("share")).alias("importance"))

    own = judged(counts, "host", "path", "tip")
    all_ = judged(counts.groupBy("path", "kind", "feature").agg(F.sum("c").alias("c")), "path").select("path", F.col("m").alias("all_m"), F.col("importance").alias("all_importance"))
    both = own.join(all_, "path").where("all_m > 1")
    weight = (F.col("m") - 1) / (F.col("m") - 1 + shared_pages)
    importance = weight * F.col("importance") + (1 - weight) * F.col("all_importance") - F.col("tip")
    return both.select("host", "path", importance.alias("importance"), (importance < min_importance).alias("low"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shared_pages: int = SHARED_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages, with whole pages of any size and depth. Other columns are left out, whatever their names.

    Null or empty html: empty text. Null URLs share one site, the empty host. Repeated rows give the same text each. An empty table gives none.
    """
    import pyarrow as pa

    site = F.coalesce(host(F.col(url_col).cast("string")), F.lit(""))
    tree = style_tree(pages.select(site.alias("host"), F.col(html_col).cast("string").alias("html")), shared_pages, min_importance)
    found = written(tree.where("low").select("host", "path").distinct())
    sites = found.groupBy("host").agg(F.collect_set("path").alias("low"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), site.alias("host"))
    if found.count() <= BROADCAST_ROWS:
        told = rows.join(F.broadcast(sites), "host", "left")
    else:  # the pages of a large host are many tasks
        told = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(sites.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")

    def run(batches):
        for batch in pieces(batches):
            texts = []
            for page, low in zip(batch.column(2).cast(pa.binary()), batch.column(3).to_pylist()):
                texts.append(main_text((page.as_py() or b"").decode("utf-8", "replace"), frozenset(low or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return told.select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
