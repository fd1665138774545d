"""HTML extraction by site style trees.

Pages of one host are merged into a style tree: a node is a path of elements (tag and classes) from the root. Over the
host's pages a node has a presentation importance (entropy of the tag sequences of its children) and a content
importance (entropy of its text), both relative to the most that so many pages allow. A node that hardly varies in
either is template noise, and its branch is removed from each page. On each page, branches that markup itself declares to
be no content (menus, forms, adverts, comments, ...) go too, and if the page marks its article, the text is that of
the article. A branch of low importance that holds most of an article's text stays: copies of one article on one host
aren't noise. Neither is text that no other page of the host has at that node, nor what would leave a page empty.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by newlines
in page order; a line break element is white space.

Defined results: null or empty html gives empty text; pages without a host in their url share the host ''; a host's
repeated pages count each; hosts of few pages remove nothing by importance; an empty table gives an empty result;
columns besides the id, url and html aren't read. Pages are read whole, and broken markup never fails.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.text import arrow_rows, keep_columns, ship_package, small_batches
from sieveline.plans.lineage import cut

#: Pages that a host needs before importance is judged, and the importance below which a branch goes.
MIN_PAGES = 3
MIN_IMPORTANCE = 0.2
#: A low branch, all its nodes together, with more than this share of the article's text stays.
MAX_SHARE = 0.5
#: Rows (host, node) of low importance that may be broadcast; beyond that the hosts are joined by a shuffle.
BROADCAST_NODES = 50_000

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "legend", "optgroup", "option", "tbody", "tfoot", "thead", "tr"}
SCOPES = frozenset("html body table td th caption button object".split())
#: A start tag ends open elements of these kinds, up to an element of the second set.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NOISE_TAGS = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg canvas object dialog menu embed audio video map datalist noembed noframes xmp".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu navbar nav navigation "
    "breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social comment comments reply replies disqus respond related recommended recommendations widget toolbar "
    "pagination pager skip".split()
)
COMMENT_WORDS = frozenset("comment comments comments-area comment-list reply replies respond disqus".split())
#: Noise whatever it holds.
HARD_NOISE = RAW | frozenset("head template select svg canvas object datalist embed audio video map nav footer aside dialog menu button".split())
#: Noise outside an article only: inside, it holds the title.
PAGE_HEADER = frozenset("header topbar".split())
PROSE_TAGS = frozenset("p h1 h2 pre blockquote".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dt dd figcaption".split())

#: A quoted value ends at a quote that ends the attribute too; any other quote is an ordinary character.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=(?>\s*+(?:\"[^\"]*\"|'[^']*')(?=[\s/>]))?+)*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Parts of a class name, and first parts that say something of a whole page: "with-sidebar" is no sidebar.
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
PAGE_STATES = frozenset("with without has no not is hide show page layout col cols column grid".split())
#: What markup may call by these tags and still wrap the page's content, if it holds more than this share of its text.
MOST_TEXT = 0.5


@dataclass(eq=False)
class Node:
    tag: str
    classes: str = ""
    noise: bool = False
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    #: Within an article or main element, itself included.
    inside: bool = False
    #: The open paragraph that a block's start ends.
    open_p: Node | None = None
    #: Has a headline, article or main element below.
    holds: bool = False
    #: Filled in by `measure`: characters of text below, without white space, and a digest of the branch's text.
    size: int = 0
    body: int = 0
    #: Of the size, what stands in paragraphs and headlines.
    prose: int = 0

    @property
    def step(self) -> str:
        return f"{self.tag}.{self.classes}" if self.classes else self.tag


def declared_noise(tag: str, attributes: dict[str, str], bare: str) -> bool:
    if tag in NOISE_TAGS or attributes.get("role", "").lower() in NOISE_ROLES:
        return True
    if attributes.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|$)", bare) or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main") and not {"comment", "comments", "reply"} & names_in(attributes):
        return False
    return bool(names_in(attributes) & NOISE_WORDS)


def names_in(attributes: dict[str, str]) -> set[str]:
    """The words of an element's classes and id; a name that begins with a page state says nothing of the element."""
    out: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [w.lower() for w in NAME_PART.findall(name)]
        if parts and parts[0] not in PAGE_STATES:
            out.update(parts)
    return out


def measure(root: Node) -> None:
    """Sizes and digests of all branches, from the leaves up; raw elements have no children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        parts = []
        for c in node.children:
            if isinstance(c, str):
                words = c.split()
                node.size += sum(map(len, words))
                parts += words
            else:
                node.holds |= c.holds or c.tag in ("h1", "article", "main")
                if not c.noise:
                    node.size += c.size
                    node.prose += c.prose
                    parts.append(str(c.body))
        if node.tag in PROSE_TAGS:
            node.prose = node.size
        node.body = digest(" ".join(parts)) if parts else 0


def restore_wrappers(root: Node) -> None:
    """What is called noise but holds most of the page's text wraps the content: it is noise no longer. The share is of all
    text that isn't declared noise within it; only a form, or what has a headline, article or main element, is a wrapper."""
    total = sum(c.size if isinstance(c, Node) else len("".join(c.split())) for c in root.children)
    stack, wrappers = [root], []
    while stack:
        node = stack.pop()
        for c in node.children:
            if isinstance(c, Node):
                wraps = c.tag == "form" or (c.holds and not COMMENT_WORDS & set(c.classes.lower().split()))
                if c.noise and wraps and c.tag not in HARD_NOISE and c.size > MOST_TEXT * total:
                    wrappers.append(c)
                stack.append(c)
    for node in wrappers:
        node.noise = False


def parse(html: str) -> Node:
    """The element tree, with ends implied as browsers do for paragraphs, list items and tables."""
    root = here = Node("#root")
    at, end, last = 0, len(html), html.rfind(">")
    open_tags: dict[str, int] = {}
    while at < end:
        m = TOKEN.search(html, at) if at <= last or "<!--" in html[at:] else None
        if m is None:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        closing, tag, rest = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            continue
        if closing:
            if not open_tags.get(tag):
                continue
            node = here
            while node is not root and node.tag != tag:
                node = node.parent if node.tag not in SCOPES or tag in ("html", "body", "table", "article", "main") else root
            if node is not root:
                here = node.parent
            continue
        if tag in CLOSES_P:
            if here.open_p is not None:
                here = here.open_p.parent
        if tag in IMPLIED_ENDS:
            ends, stops = IMPLIED_ENDS[tag]
            node, target = here, None
            while node is not root and node.tag not in stops:
                if node.tag in ends:
                    target = node
                node = node.parent
            here = target.parent if target else here
        attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)} if "=" in rest else {}
        bare = ATTRIBUTE.sub(" ", rest).rstrip("/").lower()
        node = Node(tag, " ".join(sorted(attributes.get("class", "").split())), declared_noise(tag, attributes, bare), here, inside=here.inside or tag in ("article", "main"))
        node.open_p = node if tag == "p" else None if tag in SCOPES else here.open_p
        names = names_in(attributes) if attributes else set()
        if tag == "header" or names & PAGE_HEADER:
            node.noise |= not here.inside and tag not in ("html", "body", "article", "main")
        here.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not rest.endswith("/"):
            open_tags[tag] = open_tags.get(tag, 0) + 1  # ever opened: what was never open needs no search
            here = node
    measure(root)
    restore_wrappers(root)
    remeasure(root)
    return root


def remeasure(root: Node) -> None:
    """Sizes after wrappers were restored."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.size = node.body = node.prose = 0
        stack += [c for c in node.children if isinstance(c, Node)]
    measure(root)


def content_roots(root: Node) -> list[Node]:
    """The outermost mains that aren't declared noise, else the outermost articles, if the paragraphs and headlines outside
    hold no more text than they do (a teaser isn't the story); else the whole page."""
    for wanted in ("main", "article"):
        found: list[Node] = []
        stack = [root]
        while stack:
            node = stack.pop()
            if node.noise:
                continue
            if node.tag == wanted:
                found.append(node)
            else:
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        outside = root.prose - sum(n.prose for n in found)
        if found and sum(n.size for n in found) >= outside:
            return found
    return [root]


def blocks_of(roots: list[Node], removed: set[int]) -> list[str]:
    """Texts of the blocks in page order; removed holds ids of nodes whose branches are left out."""
    out: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        if text := " ".join(unescape("".join(pieces)).split()):
            out.append(text)
        pieces.clear()

    for top in roots:
        stack: list[tuple[Node | str, bool]] = [(top, False)]
        while stack:
            item, done = stack.pop()
            if isinstance(item, str):
                pieces.append(item)
            elif done:
                flush()
            elif item.tag in ("br", "td", "th", "wbr", "img") and not item.noise and id(item) not in removed:
                pieces.append("" if item.tag == "wbr" else " ")
                stack += [(c, False) for c in reversed(item.children)]
            elif not item.noise and id(item) not in removed:
                if item.tag in BLOCKS or item is top:
                    flush()
                    stack.append((item, True))
                stack += [(c, False) for c in reversed(item.children)]
            elif item.tag in BLOCKS:
                flush()
    flush()
    return out


def style_nodes(root: Node) -> dict[int, list[Node]]:
    """Nodes of the page by the hash of their path, which names a node of the host's style tree."""
    out: dict[int, list[Node]] = {}
    stack = [(c, 0) for c in root.children if isinstance(c, Node)]
    while stack:
        node, above = stack.pop()
        if node.noise:
            continue
        path = digest(f"{above:x}/{node.step}")
        out.setdefault(path, []).append(node)
        stack += [(c, path) for c in node.children if isinstance(c, Node)]
    return out


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def body_of(nodes: list[Node]) -> int:
    return nodes[0].body if len(nodes) == 1 else digest(" ".join(str(n.body) for n in nodes))


def page_styles(html: str) -> list[tuple[int, int, int]]:
    """(node, hash of its children's tags, hash of its text) for each style node of a page."""
    return [(key, digest("|".join(",".join(c.step for c in n.children if isinstance(c, Node)) for n in nodes)), body_of(nodes)) for key, nodes in style_nodes(parse(html)).items()]


def low_branches(root: Node, roots: list[Node], low: frozenset[int]) -> set[int]:
    """Nodes to remove for their low importance: never a root of the content, a text element of an article, text of this
    page only, or a branch whose nodes together have most of the text; none if no text were left. low holds the XOR of a style
    node and a text that several pages have there."""
    if not low:
        return set()
    total = sum(r.size for r in roots)
    tops = {id(r) for r in roots}
    above: set[int] = set()
    for r in roots:
        node = r
        while node is not None:
            above.add(id(node))
            node = node.parent
    removed = set()
    for key, nodes in style_nodes(root).items():
        if key ^ body_of(nodes) in low and sum(n.size for n in nodes) <= MAX_SHARE * total:
            removed |= {id(n) for n in nodes if not (id(n) in tops | above or (n.tag in TEXT_TAGS and n.inside))}
    return removed if removed and blocks_of(roots, removed) else set()


def main_text(html: str | None, low: frozenset[int] = frozenset()) -> str:
    if not html:
        return ""
    root = parse(html)
    roots = content_roots(root)
    return "\n".join(blocks_of(roots, low_branches(root, roots, low)))


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return keep_columns(pages, "page_id", "url", "html").withColumn("host", host)


def seen_styles(hosted: DataFrame) -> DataFrame:
    """host, node, style, body: a row for each style node of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(host, *style) for host, html in zip(batch["host"], batch["html"], strict=True) if html for style in page_styles(html)]
            yield pd.DataFrame(rows, columns=["host", "node", "style", "body"])

    return cut(hosted.select("host", "html").mapInPandas(run, "host string, node bigint, style bigint, body bigint"))


def node_importance(seen: DataFrame) -> DataFrame:
    """host, node, pages, presentation, content: importances from 0 (all pages alike) to 1 (all different)."""

    def entropy(by: str, name: str) -> DataFrame:
        counts = seen.groupBy("host", "node", by).agg(F.count("*").alias("c"))
        total = F.sum("c")
        value = 1 - F.sum(F.col("c") * F.ln("c")) / (total * F.ln(total))
        return counts.groupBy("host", "node").agg(total.alias("pages"), F.when(total > 1, value).otherwise(1.0).alias(name))

    return entropy("style", "presentation").join(entropy("body", "content").drop("pages"), ["host", "node"])


def low_nodes(seen: DataFrame) -> DataFrame:
    """host, low: the nodes of each host whose presentation and content both hardly vary, each with the texts that several
    pages have there."""
    low = node_importance(seen).where((F.col("pages") >= MIN_PAGES) & (F.greatest("presentation", "content") < MIN_IMPORTANCE))
    repeated = seen.groupBy("host", "node", "body").agg(F.count("*").alias("n")).where("n > 1").join(low.select("host", "node"), ["host", "node"])
    return repeated.groupBy("host").agg(F.array_sort(F.collect_set(F.col("node").bitwiseXOR(F.col("body")))).alias("low"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page (page_id, url, html)."""
    ship_package(pages.sparkSession)
    small_batches(pages.sparkSession)
    hosted = with_host(pages)
    low = cut(low_nodes(seen_styles(hosted)))
    size = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0))).first()[0]
    joined = hosted.join(F.broadcast(low) if size <= BROADCAST_NODES else low, "host", "left")

    def describe(html: str | None, nodes: list[int] | None) -> tuple:
        text = main_text(html, frozenset(nodes or ()))
        return text, len(text)

    return arrow_rows(joined.select("page_id", "url", "html", "low"), "html", describe, "text string, n_chars bigint", "low")
