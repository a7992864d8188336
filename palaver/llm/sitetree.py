"""Main text of web pages by a style tree of each site.

Pages of a host are merged: a node of the site's tree is a path of element labels (tag and
classes) from the root. Over all occurrences of a node on the host two entropies are taken:
of its presentation (the sequence of its children's labels) and of its content (the text it
holds directly). Both are normalised, so 0 means "the same everywhere" and 1 "different
everywhere". They come from sums of ``c * log(c)`` over counts ``c``, which add up partially,
so a host with a large part of all pages is never in one task.

A page then weighs its branches bottom-up: content nodes by their content's entropy and
length, presentation nodes by their own entropy and, more and more with depth, their
children's. Known roles correct the weight: menus, footers, forms, adverts, comments and the
like weigh nothing unless they hold the page's main content, links count against a branch, and
``article`` or ``main`` weigh in full. A class or id is a role if its whole name is one or is
made of role names only; on headings and sections of main content, if its whole name is one. A
compound name that ends in a role (``user-comments``, ``share-bar``) is evidence and lowers the
weight of its branch to ``EVIDENCE`` of what it is, in the main content too; so does being an
``article`` next to a ``main`` that holds text.

Branches below the threshold go; what stays is the text. Inside the main content a branch goes
if it is the same on the site: the tree has seen it on at least ``MANY`` pages of the host, its
content entropy is below ``CONSTANT``, and the main content itself differs from page to page.

Cases: null html is empty and gives an empty text; a null or odd URL is a host of its own
(the empty one); a node seen once on its host counts as content; repeated pages are kept and
extracted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import columns_of, materialise

THRESHOLD = 0.2
DAMPING = 0.9
EVIDENCE = 0.1
CONSTANT = 0.05
MANY = 8

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|iframe)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# fixed values: parts of HTML and of common class names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mfenced "
    "semantics annotation svg object select".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "p": {"p"},
}
LISTS = frozenset("ul ol dl table div section article main body aside nav form header footer td th".split())
WORTHLESS = frozenset("head title nav footer aside form button dialog menu header annotation".split())
#: Worth nothing once their end tag is found: without one, the text behind them is the page's.
CLOSED = frozenset("noscript template svg object select".split())
FOREIGN = frozenset("svg math".split())
MAIN = frozenset("article main".split())
TITLED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
NEVER_SHOWN = frozenset("head title noscript template svg select".split())
WORTHLESS_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies copyright disqus footer form gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "related replies reply respond search share sharing sidebar sidebars skip social sponsor sponsored subscribe "
    "subscription toc toolbar widget widgets".split()
)
MAIN_NAMES = frozenset("main articlebody".split())
#: Pieces at the end of a compound name that say what holds the role, not what it is.
HOLDERS = frozenset(
    "area articles bar block body box container content entries group inner item items link links list outer panel posts row "
    "section stories thread title wrap wrapper".split()
)
#: A name that begins with one of these says something about the page's layout.
LAYOUT = frozenset("has hide is no not with without".split())
#: Parts of an article that bear its own head and foot.
OWN_PARTS = frozenset("header title copyright search social menu form login".split())


class Node:
    __slots__ = ("label", "tag", "key", "parent", "children", "text", "linked", "prior", "main", "breaks", "hidden")

    def __init__(self, label, tag, key, parent, prior, main):
        self.label, self.tag, self.key, self.parent, self.prior, self.main = label, tag, key, parent, prior, main
        self.children: list = []  # nodes and texts in page order
        self.text = self.linked = 0
        self.breaks = tag not in INLINE
        self.hidden = False  # shown to nobody, whatever lies below


def _names(attributes: str) -> tuple[str, set[str], bool]:
    """Classes as a label, the whole names in the attributes, and whether the element is hidden."""
    label, names, hidden = "", set(), False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden":
            hidden = hidden or not value or value == "hidden"
            continue
        if name == "style":
            hidden = hidden or "display:none" in re.sub(r"\s", "", value)
            continue
        if name == "class":
            label = ".".join(sorted(value.split()))
        names.update(value.split())
    return label, names, hidden


def _is_role(name: str) -> bool:
    """A name made of role names only (``cookie-notice``, but not ``has-sidebar``)."""
    pieces = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    return bool(pieces) and all(p in WORTHLESS_NAMES for p in pieces)


def _ends_in_role(name: str) -> bool:
    """A compound name whose last piece, but for what holds it, is a role (``cookie-banner-wrap``)."""
    pieces = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    if len(pieces) < 2 or pieces[0] in LAYOUT:
        return False
    while len(pieces) > 1 and pieces[-1] in HOLDERS:
        pieces.pop()
    return pieces[-1] in WORTHLESS_NAMES and pieces[-1] not in OWN_PARTS


def _teasers(root: Node) -> None:
    """Articles beside a ``main`` that holds text are no main content."""
    every = list(nodes_of(root))
    if not any(n.tag == "main" and n.prior and any(_own_text(x) for x in nodes_of(n)) for n in every):
        return
    for node in every:
        if node.tag != "article":
            continue
        around = {id(x) for x in nodes_of(node) if x.tag == "main"}
        above = node.parent
        while above is not None and above.tag != "main":
            above = above.parent
        if above is None and not around:
            node.main, node.prior = False, min(node.prior, EVIDENCE)


def _in_foreign(node: Node) -> bool:
    while node is not None and node.tag not in FOREIGN:
        node = node.parent
    return node is not None


def _lift(mains: list[Node]) -> None:
    """Branches that hold the page's main content are no menus or forms, whatever they are called."""
    for main in mains:
        above = []
        node = main.parent
        while node is not None:
            above.append(node)
            node = node.parent
        if not any(n.hidden for n in above):
            for n in above:
                n.prior = 1.0


_KEYS: dict[tuple[int, str], int] = {}


def _key(parent: int, label: str) -> int:
    found = _KEYS.get((parent, label))
    if found is None:
        if len(_KEYS) > 200_000:
            _KEYS.clear()
        found = xxhash.xxh64_intdigest(f"{parent}>{label}".encode("utf-8", "surrogatepass")) - (1 << 63)
        _KEYS[(parent, label)] = found
    return found


def parse(page: str) -> Node:
    """A forgiving DOM: unclosed and stray tags are allowed, scripts and comments left out."""
    root = Node("", "", 0, None, 1.0, False)
    at, here = root, 0
    mains: list[Node] = []

    def add(text: str) -> None:
        if text:
            at.children.append(text)

    for m in TOKEN.finditer(page):
        add(page[here: m.start()])
        here = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            node = at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                if tag in CLOSED:
                    node.prior, node.hidden = 0.0, tag in NEVER_SHOWN
                at = node.parent
            continue
        closing = CLOSES.get(tag) or (CLOSES["p"] if tag not in INLINE and tag not in VOID else None)
        if closing:
            node = at
            while node is not root and node.tag not in closing and node.tag not in LISTS:
                node = node.parent
            if node.tag in closing:
                at = node.parent
        label, names, hidden = _names(m[4]) if "=" in m[4] or "hidden" in m[4] else ("", set(), False)
        label = f"{tag}.{label}" if label else tag
        pieces = {p for n in names for p in re.split(r"[^a-z0-9]+", n)}
        main = tag in MAIN or bool(pieces & MAIN_NAMES and tag not in INLINE)
        inside = at
        while inside is not root and not inside.main:
            inside = inside.parent
        own_head = tag == "header" and inside is not root
        whole = inside is not root and tag in TITLED  # an id here is a slug of the heading's words
        role = any(n in WORTHLESS_NAMES or (not whole and _is_role(n)) for n in names)
        worthless = hidden or (tag in WORTHLESS and not own_head) or (role and tag not in ("html", "body") and not main)
        compound = not whole and tag not in MAIN and tag not in ("html", "body") and any(_ends_in_role(n) for n in names)
        main = main and not compound
        node = Node(label, tag, _key(at.key, label), at, 0.0 if worthless else EVIDENCE if compound else 1.0, main)
        node.hidden = hidden or (tag in NEVER_SHOWN and tag not in CLOSED)
        if (tag in MAIN or main and names & MAIN_NAMES) and inside is root and not role and not node.hidden:
            mains.append(node)
        at.children.append(node)
        if tag not in VOID and not (m[4].endswith("/") and (tag in FOREIGN or _in_foreign(at))):
            at = node
    add(page[here:])
    _lift(mains)
    if mains:
        _teasers(root)
    return root


def nodes_of(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def _own_text(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def _style(node: Node) -> str:
    """Labels of the children in order, runs of one label counted once."""
    labels: list[str] = []
    for c in node.children:
        label = c.label if isinstance(c, Node) else ("#" if c.strip() else None)
        if label and (not labels or labels[-1] != label):
            labels.append(label)
    return ">".join(labels)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


SEEN = "host string, node long, kind int, value long, n long"
STYLE, CONTENT, ON_PAGE = 0, 1, 2


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for url, page, page_key in zip(*[batch.column(c).to_pylist() for c in ("url", "html", "page_key")]):
            host = host_of(url)
            for node in nodes_of(parse(page)):
                seen[host, node.key, STYLE, _hash(_style(node))] += 1
                if text := _own_text(node):
                    seen[host, node.key, CONTENT, _hash(text)] += 1
                seen[host, node.key, ON_PAGE, page_key] = 1
        columns = list(zip(*seen)) if seen else [()] * 4
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array(list(seen.values()), pa.int64())],
            ["host", "node", "kind", "value", "n"],
        )


def importance(seen: DataFrame) -> DataFrame:
    """(host, node, style, content, pages): normalised entropies of the site's nodes, and the pages they are on."""
    counts = seen.where(F.col("kind") != ON_PAGE).groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("c"))
    sums = counts.groupBy("host", "node", "kind").agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s")
    )
    spread = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    pages = seen.where(F.col("kind") == ON_PAGE).groupBy("host", "node", "kind").agg(F.sum("n").alias("m"), F.lit(0.0).alias("s"))
    return sums.unionByName(pages).groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == STYLE, spread)).alias("style"),
        F.max(F.when(F.col("kind") == CONTENT, spread)).alias("content"),
        F.max(F.when(F.col("kind") == ON_PAGE, F.col("m"))).alias("pages"),
    )


#: Entropies of a node's presentation and content on its host (None: it holds no text), and the pages it is on.
Known = dict[int, tuple[float | None, float | None, int]]
UNKNOWN = (1.0, 1.0, 1)


def weigh(root: Node, known: Known) -> tuple[dict[int, float], dict[int, float]]:
    """Weight and content entropy of each branch, by ``id`` of its node, from the leaves up."""
    weight: dict[int, float] = {}
    differs: dict[int, float] = {}
    for node in reversed(list(nodes_of(root))):
        style, content, _ = known.get(node.key, UNKNOWN)
        style, content = (1.0 if style is None else style), (1.0 if content is None else content)
        own = len(_own_text(node))
        children = [c for c in node.children if isinstance(c, Node)]
        node.text = own + sum(c.text for c in children)
        node.linked = node.text if node.tag == "a" else sum(c.linked for c in children)
        mixed = own * content + sum(c.text * weight[id(c)] for c in children)
        below = mixed / node.text if node.text else 0.0
        plain = own * content + sum(c.text * differs[id(c)] for c in children)
        differs[id(node)] = plain / node.text if node.text else 1.0
        labels = len({c.label for c in children})
        damp = DAMPING**labels
        total = below if not children else (1 - damp) * style + damp * below
        if not node.main and node.text:
            total *= 1 - node.linked / node.text
        weight[id(node)] = 1.0 if node.main else node.prior * total
    return weight, differs


def main_text(page: str, known: Known, threshold: float = THRESHOLD) -> str:
    root = parse(page)
    weight, differs = weigh(root, known)
    out: list[str] = []
    # (node or text, inside main content, that differs from page to page)
    stack: list[tuple] = [(root, False, False)]
    while stack:
        item, in_main, varied = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if item.prior == 0.0:
            continue
        if in_main and (
            item.prior < threshold or varied and item.text and differs[id(item)] < CONSTANT and known.get(item.key, UNKNOWN)[2] >= MANY
        ):
            continue  # the same on many pages of the host, or named after a role
        if item.main and not in_main:
            in_main, varied = True, differs[id(item)] >= threshold
        holds = in_main or any(n.main for n in nodes_of(item))
        if not holds and item.text and item.parent is not None and weight[id(item)] < threshold and item.tag not in ("html", "body"):
            if not (item.tag in INLINE and weight[id(item.parent)] >= threshold):
                continue
        content = known.get(item.key, UNKNOWN)[1]
        keep_own = in_main or content is None or content >= threshold
        gap = " " if item.breaks else ""
        stack.append((gap, in_main, varied))
        for c in reversed(item.children):
            if isinstance(c, Node) or keep_own:
                stack.append((c, in_main, varied))
        stack.append((gap, in_main, varied))
    return " ".join(html_.unescape("".join(out)).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, known in zip(batch.column("html").to_pylist(), batch.column("known").to_pylist()):
            texts.append(main_text(page, {k["node"]: (k["style"], k["content"], k["pages"]) for k in known or ()}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    source = columns_of(pages, "page_id", "url", "html").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64("page_id", "url", "html").alias("page_key")
    )
    seen = materialise(source.select("url", "html", "page_key").mapInArrow(_observe, SEEN), "site-seen")
    site = materialise(importance(seen), "site-tree")
    on_page = seen.where(F.col("kind") == ON_PAGE).select("host", "node", F.col("value").alias("page_key"))
    # a set of a page's nodes: copies of a page add nothing, in whatever task they are found
    known = on_page.join(site, ["host", "node"]).groupBy("page_key").agg(
        F.collect_set(F.struct("node", "style", "content", "pages")).alias("known")
    )
    return source.join(known, "page_key", "left").select("page_id", "url", "html", "known").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
