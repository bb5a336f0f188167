"""HTML extraction by tree scoring.

A page becomes a tree (comments, scripts and styles skipped; unclosed and stray tags
borne with). Subtrees that are chrome by tag, role, class or id fall away: menus, headers,
footers, sidebars, notices, adverts, forms, reader comments. Each paragraph then passes
points for its length and its commas to its ancestors, less with distance; a container's
points are discounted by its link density. The best container is kept with those of its
siblings that score alike or read as prose, with all that stands between these but menus, and
with what adjoins them: headings before, and lists, tables, quotes and plain containers of few links
(at the top of a page no containers). Inside an article or main a class or id is chrome only if all
of its words are (or say mere layout). Blocks that are mostly links are menus; a list of links
stays where prose stands before and after it, so one at an article's edge falls.

Text: character references decoded, white space in a block turned into one space, blocks
joined in page order by one space. Null or empty html, or a page without text, gives the
empty string. Every row of the input gives one row, repeated ones too; pages may be of any
length and depth; nothing is capped. Of containers that score alike the first of the page
counts. An empty table gives none.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag of the second set ends an open tag of the first.
ENDS_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CHROME_TAGS = frozenset("head nav footer aside form button select svg canvas audio video object dialog menu fieldset datalist script style noscript template textarea title iframe".split())
#: Chrome tags that a page may wrap around its article, by habit or by a missing end tag.
WRAPPERS = frozenset("nav footer aside form dialog menu fieldset header".split())
HEAD = frozenset("title meta link style script noscript template base head html body".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice "
    "notification popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar aside menu nav navbar "
    "navigation breadcrumb breadcrumbs comment comments commentlist disqus replies reply respond footer header masthead topbar toolbar widget widgets pagination pager "
    "login signin outbrain taboola toc skip alert rail".split()
)
LAYOUT_WORDS = frozenset("list box bar wrap wrapper container block section area links buttons button icons icon item items form top bottom left right inline unit slot posts articles stories group panel inner outer".split())
CONTENT_WORDS = frozenset("article content main post story entry body text page wrapper container hentry".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
POINTS = {"article": 25, "main": 25, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "address": -3, "th": -5}
PARAGRAPH = frozenset("p pre td blockquote dd li figcaption".split())
CONTAINER = frozenset("div section article main body td html".split())
COMMA = re.compile("[,،、，]")


class Node:
    __slots__ = ("tag", "parent", "kids", "attrs", "score", "size", "linked", "commas", "links")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.kids: list[Node | str] = []
        self.score = 0.0


def parse(page: str) -> Node:
    root = at = Node("html", None)
    #: How many of the open tags are of a kind, so that nothing climbs for a tag that is not open.
    opened = Counter(["html"])

    def climb(to: Node) -> Node:
        up = at
        while up is not to:
            opened[up.tag] -= 1
            up = up.parent
        return to

    pos = 0
    lower = None
    for m in iter(lambda: TOKEN.search(page, pos), None):
        if m.start() > pos:
            at.kids.append(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = at if opened[tag] else None
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                at = climb(up.parent)
            elif tag in ("p", "br"):
                at.kids.append(Node("br", at))
            continue
        if tag in ("html", "body"):
            if tag == "body":
                while at.parent is not None and at.tag in ("head", "p", "title"):
                    at = climb(at.parent)
            if tag == "html":
                continue
        if tag not in HEAD and at.tag == "head" and at.parent is not None:
            at = climb(at.parent)
        if tag in ENDS_P:
            up = at if opened["p"] else None
            while up is not None and up.tag != "p" and up.tag not in CONTAINER and up.tag not in ("li", "button"):
                up = up.parent
            if up is not None and up.tag == "p":
                at = climb(up.parent)
        elif tag in ENDS:
            up = at if any(opened[t] for t in ENDS[tag]) else None
            while up is not None and up.tag not in ENDS[tag] and up.tag not in ("ul", "ol", "dl", "table", "div", "section", "article"):
                up = up.parent
            if up is not None and up.tag in ENDS[tag] and up.parent is not None:
                at = climb(up.parent)
                if tag == "tr" and at.tag == "tr":
                    at = climb(at.parent)
        node = Node(tag, at, m[3])
        at.kids.append(node)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find("</" + tag, pos)
            close = page.find(">", end) if end >= 0 else -1
            pos = len(page) if end < 0 or close < 0 else close + 1
        elif tag not in VOID and not m[3].endswith("/"):
            opened[tag] += 1
            at = node
    if pos < len(page):
        at.kids.append(page[pos:])
    return root


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attrs)} if node.attrs and "=" in node.attrs or "hidden" in node.attrs else {}


def is_chrome(node: Node, in_article: bool, holds_article: bool) -> bool:
    """Whether a node falls away by its tag, role, class or id. holds_article: an article or main lies inside it."""
    if node.tag in CHROME_TAGS:
        return True
    if node.tag == "header":
        return not in_article
    a = attributes(node)
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    if a.get("role", "").lower() in CHROME_ROLES:
        return True
    named = [w.lower() for w in WORD.findall(a.get("class", "") + " " + a.get("id", ""))]
    if node.tag in ("html", "body", "article", "main") and "comment" not in named and "comments" not in named:
        return False
    if in_article:
        # There a name has to be chrome as a whole, and the header holds the title.
        parts = [[w.lower() for w in WORD.findall(name)] for name in (a.get("class", "") + " " + a.get("id", "")).split()]
        words = [w for part in parts if all(w in CHROME_WORDS or w in LAYOUT_WORDS for w in part) for w in part if w in CHROME_WORDS and w != "header"]
    else:
        words = [w for w in named if w in CHROME_WORDS]
    if not words:
        return False
    first = words[0]
    if first not in ("comment", "comments") and any(w in CONTENT_WORDS for w in named) and holds_article:
        return False
    return not holds_article or first in ("comment", "comments", "commentlist", "replies", "related", "recommended", "sidebar")


def article_counts(nodes: list[Node]) -> dict[Node, int]:
    """Articles and mains of each node and what lies under it, counted once from the leaves up."""
    out: dict[Node, int] = {}
    for node in reversed(nodes):
        out[node] = (node.tag in ("article", "main")) + sum(out[k] for k in node.kids if isinstance(k, Node))
    return out


def wraps_article(root: Node, nodes: list[Node], articles: dict[Node, int]) -> Callable[[Node, bool], bool]:
    """A test of chrome, by tag or name, for being a wrapper of the article: no article lies outside it, and it holds one or most of the page's paragraph points."""
    measure(nodes)
    points: dict[Node, float] = {}
    for node in reversed(nodes):
        own = (1 + node.commas + min(node.size / 100, 3)) * (1 - link_density(node)) if node.size and is_paragraph(node) else 0.0
        points[node] = max(own, sum(points[k] for k in node.kids if isinstance(k, Node)))

    def test(node: Node, in_article: bool) -> bool:
        if in_article or articles[node] < articles[root]:
            return False
        a = attributes(node)
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "") or a.get("role", "").lower() in CHROME_ROLES:
            return False
        if node.tag in CHROME_TAGS and node.tag not in WRAPPERS:
            return False
        named = [w.lower() for w in WORD.findall(a.get("class", "") + " " + a.get("id", ""))]
        if node.tag not in WRAPPERS and node.tag not in ("article", "main") and any(w.startswith("comment") for w in named) and not any(w in CONTENT_WORDS for w in named):
            return False
        return articles[node] > 0 or points[node] > 0.5 * points[root]

    return test


def prune(root: Node) -> None:
    """Take chrome out of the tree; chrome that wraps the article becomes a plain container."""
    nodes = in_order(root)
    articles = article_counts(nodes)
    wraps = wraps_article(root, nodes, articles)
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        kept: list[Node | str] = []
        for k in node.kids:
            if isinstance(k, Node) and is_chrome(k, inside, articles[k] > (k.tag in ("article", "main"))):
                if not wraps(k, inside):
                    continue
                if k.tag in WRAPPERS:
                    k.tag = "div"
            kept.append(k)
        node.kids = kept
        todo += [(k, inside) for k in node.kids if isinstance(k, Node)]


def in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def measure(nodes: list[Node]) -> None:
    """Letters of text, of them in links, commas and links, from the leaves up."""
    for node in reversed(nodes):
        node.size = node.linked = node.commas = 0
        node.links = int(node.tag == "a")
        for k in node.kids:
            if isinstance(k, str):
                node.size += len(k.strip())
                node.commas += len(COMMA.findall(k))
            else:
                node.size += k.size
                node.commas += k.commas
                node.links += k.links
                node.linked += k.size if k.tag == "a" else k.linked


def link_density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def is_paragraph(node: Node) -> bool:
    if node.tag in PARAGRAPH:
        return not any(isinstance(k, Node) and k.tag in PARAGRAPH for k in node.kids)
    return node.tag in ("div", "section", "article", "main", "body") and any(isinstance(k, str) and not k.isspace() for k in node.kids)


def pass_points(nodes: list[Node]) -> None:
    for node in nodes:
        node.score += POINTS.get(node.tag, 0)
    for node in nodes:
        if not node.size or not is_paragraph(node):
            continue
        own = node.size if node.tag in PARAGRAPH else sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        points = (1 + node.commas + min(own / 100, 3)) * (1 - link_density(node))
        up, share = (node.parent, 1) if node.tag in PARAGRAPH else (node, 1)
        while up is not None and share <= 12:
            up.score += points / share
            up, share = up.parent, share * 2 if share < 4 else share + 4


def is_menu(node: Node) -> bool:
    """A list or block that is mostly several links."""
    return node.tag in ("ul", "ol", "div", "section", "dl", "table", "p") and node.links >= 3 and link_density(node) > 0.6


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ADJOINING = frozenset("ul ol dl table blockquote pre figure".split())


def adjoins(node: Node, at_top: bool) -> bool:
    """Whether a sibling next to the article's parts reads as one."""
    if is_menu(node) or link_density(node) >= 0.3:
        return False
    if node.tag in ADJOINING:
        return True
    return node.tag in (("p",) if at_top else ("p", "div", "section")) and (node.size > 80 or not node.linked and text_of([node])[-1:] in (".", "!", "?"))


def chosen(root: Node, nodes: list[Node]) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    pool = [n for n in nodes if n.size and (n.tag in CONTAINER or n.tag in ("blockquote", "pre"))]
    if not pool:
        return [root]
    value = lambda n: n.score * (1 - link_density(n))
    best = max(pool, key=value)
    top = value(best)
    # An ancestor with several containers of like score is the better one.
    up = best.parent
    while up is not None and up.tag in CONTAINER and up.tag not in ("html", "body"):
        alike = [k for k in up.kids if isinstance(k, Node) and k is not best and k.tag in CONTAINER and value(k) >= 0.5 * top]
        if up.tag in ("article", "main") or len(alike) >= 2:
            best = up
        up = up.parent
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * top)
    kids = [k for k in best.parent.kids if isinstance(k, Node) and k.size]
    core = [i for i, k in enumerate(kids) if k is best or k.tag in CONTAINER and value(k) >= least and link_density(k) < 0.3]
    if best.tag in ("article", "main"):
        return [kids[i] for i in core]
    first, last, at_top = core[0], core[-1], best.parent.tag in ("body", "html")
    while first and (kids[first - 1].tag in HEADINGS or adjoins(kids[first - 1], at_top)):
        first -= 1
    # Below, a heading belongs if what follows it does.
    look = last + 1
    while look < len(kids) and (kids[look].tag in HEADINGS or adjoins(kids[look], at_top)):
        last = last if kids[look].tag in HEADINGS else look
        look += 1
    far = [i for i, k in enumerate(kids) if not first <= i <= last and k.tag == "p" and (k.size > 80 and link_density(k) < 0.25 or not k.linked and text_of([k])[-1:] in (".", "!", "?"))]
    inside = [i for i in range(first, last + 1) if i in core or not is_menu(kids[i])]
    return [kids[i] for i in sorted({*inside, *far})]


def text_of(tops: list[Node]) -> str:
    """Blocks in page order. Lists of links stay between prose only, other blocks of links never."""
    blocks: list[tuple[str, str]] = []
    run: list[str] = []
    kind = ["prose"]

    def close() -> None:
        if run:
            text = "".join(run)
            run.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((kind[-1], text))

    for top in tops:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif x == "":
                kind.pop()
            elif isinstance(x, str):
                run.append(x)
            else:
                menu = x is not top and kind[-1] != "menu" and is_menu(x)
                if menu and x.tag in ("div", "section", "p"):
                    continue
                if x.tag in BLOCK:
                    close()
                    if menu or x.tag in HEADINGS and kind[-1] != "menu":
                        kind.append("menu" if menu else "heading")
                        todo.append("")
                    todo.append(None)
                # An empty text would end a kind.
                todo += [k for k in reversed(x.kids) if k != ""]
        close()
    prose = [i for i, (k, _) in enumerate(blocks) if k == "prose"]
    return " ".join(t for i, (k, t) in enumerate(blocks) if k != "menu" or prose and prose[0] < i < prose[-1])


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    nodes = in_order(root)
    measure(nodes)
    pass_points(nodes)
    return text_of(chosen(root, nodes))


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (code points); columns of those names are replaced."""
    at = pages.columns.index(html_col)
    names = [c for c in pages.columns if c != html_col and c not in ("text", "n_chars")]
    places = [pages.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in places), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"]
            )

    fields = [pages.schema[c] for c in names] + [StructField("text", StringType()), StructField("n_chars", LongType())]
    return pages.mapInArrow(run, StructType(fields))
