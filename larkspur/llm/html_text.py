"""Main text of web pages, with a style tree for each site.

Pages are parsed to a light DOM.  Three things take branches out:

* what an element is: scripts, styles, forms, menus, headers, footers and
  sidebars by tag or role, and hidden elements;
* the site style tree: pages of one host are merged.  An element node (a path of
  tags and classes from the root) has the entropy of its presentation (sequences
  of child tags) and that of its content over the distinct pages with it; its
  importance is the mean of both, over the logarithm of the number of pages.  A
  content node (a path and one block's text) on c of the host's n pages has the
  importance 1 - log c / log n.  Two imaginary pages that share nothing are
  counted with the real ones, so a few pages alone prove nothing: a branch needs
  about ten equal pages, a block five.  Nodes of an importance below
  `least_importance` are a template's, and go;
* names: an element whose class or id is made only of words for readers'
  comments goes, unless nothing else has any text.  Other names are weak
  evidence: an element named like an advert or a sidebar goes where enough text
  stays without such elements; else the largest of them is taken to be the
  article's frame.

What is left of the outermost main and article elements, in page order, or of
the whole page where there is none, is the text.

The tree is kept as counts: a page sends one row a node, rows are counted before
they meet, and so a host with a third of all pages is spread by content.  Only
nodes of low importance return to the pages: of n pages with b blocks each, at
most b * n^(1/5) content nodes can be that common.

Defined results: null html gives an empty text; pages with a null url, or none
with a host, count as one host; a page that would lose everything to the style
tree keeps what the other rules left; repeated pages count once in the tree;
other columns are not read.  Parsing is linear in the page, whatever its tags.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Elements by what they do in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select option xmp noframes".split())
NOISE_TAGS = frozenset("nav footer aside form button input menu dialog fieldset label head".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html caption td th tr tbody thead tfoot dd dt li".split())
#: A start tag of `by` closes an open element of `tags` that no `walls` encloses.
IMPLIED = (
    (frozenset(CLOSES_P), frozenset({"p"}), frozenset("div article section main body td th li blockquote".split())),
    (frozenset({"li"}), frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"tr"}), frozenset({"tr"}), frozenset({"table"})),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset({"tr", "table"})),
)
#: IMPLIED by start tag: what it closes, and the bits that it sets and that it leaves in what is below.
CLOSES = {tag: [(bit, tags) for bit, (by, tags, _) in enumerate(IMPLIED) if tag in by] for tag in frozenset().union(*(by for by, _, _ in IMPLIED))}
LEAVES = {tag: (sum(1 << bit for bit, (_, tags, _) in enumerate(IMPLIED) if tag in tags), sum(1 << bit for bit, (_, _, walls) in enumerate(IMPLIED) if tag not in walls)) for tag in frozenset().union(*(tags | walls for _, tags, walls in IMPLIED))}
WALLS = ("article", "main", "body")
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer sidebar widget ad ads advert adverts advertisement advertising adsense "
    "sponsor sponsored sponsors promo banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social comment comments reply replies disqus respond alert header masthead toolbar".split()
)
NEUTRAL_WORDS = frozenset("site page main top bottom left right box block bar area section wrapper wrap container list item items button buttons link links post global primary secondary inner outer content unit slot js c form side".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PART = re.compile(r"[a-z]{2,}")
LOW = "page_id long, url string, text string, n_chars long"


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /\n") else {}


def is_noise(tag: str, at: dict[str, str], in_article: bool) -> bool:
    """By tag, role or being hidden; a header inside an article is the article's."""
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return True
    return bool(at) and ("hidden" in at or at.get("aria-hidden", "").lower() == "true" or at.get("role", "").lower() in NOISE_ROLES)


NAMED, COMMENTS = 1, 2


def named_as(tag: str, at: dict[str, str], in_article: bool) -> int:
    """COMMENTS or NAMED if a class or the id is made of such words and neutral ones only, else 0."""
    if not at or tag in ("body", "html", "main"):
        return 0
    words, out = NOISE_WORDS - {"header"} if in_article else NOISE_WORDS, 0
    for name in f"{at.get('class', '')} {at.get('id', '')}".lower().split():
        parts = set(NAME_PART.findall(name))
        if parts & COMMENT_WORDS and parts <= COMMENT_WORDS | NEUTRAL_WORDS:
            return COMMENTS
        if tag != "article" and parts & words and parts <= words | NEUTRAL_WORDS:
            out = NAMED
    return out


class Node:
    __slots__ = ("implied", "inside", "key", "kids", "main", "named", "noise", "size", "tag")

    def __init__(self, tag: str, key: int, noise: bool, named: int, main: bool, inside: bool, implied: int) -> None:
        self.tag, self.key, self.noise, self.named, self.main, self.inside, self.implied = tag, key, noise, named, main, inside, implied
        self.kids: list = []
        self.size = 0


@cache
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def path_key(parent: int, tag: str, name: str) -> int:
    return short_hash(f"{parent}/{tag}.{name}")


def parse(source: str) -> Node:
    """The DOM: Nodes and text; void and raw elements have no content."""
    root = Node("", 0, False, 0, False, False, 0)
    stack, at = [root], 0
    opened: list[tuple[int, dict[str, int]]] = [(0, {})]  # open elements by tag, above each wall: a stray end doesn't close a wall

    whole = {"body": 0, "html": 0}
    keys: dict[tuple[int, str, str], int] = {}

    def close(to: int) -> None:
        end = len(stack)
        while opened[-1][0] >= to:
            end = opened.pop()[0]
        for node in stack[to:end]:
            opened[-1][1][node.tag] -= 1
        for node in stack[to:]:
            if node.tag in whole:
                whole[node.tag] -= 1
        del stack[to:]

    while at < len(source):
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            stack[-1].kids.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        if m[1]:
            tag, (wall, tags) = m[1].lower(), opened[-1]
            if tags.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            elif wall and stack[wall].tag == tag:
                close(wall)
            elif whole.get(tag):
                close(next(i for i, n in enumerate(stack) if n.tag == tag))
        elif m[2]:
            tag = m[2].lower()
            found = attributes(m[3])
            for bit, tags in CLOSES.get(tag, ()):
                if stack[-1].implied >> bit & 1:
                    i = len(stack) - 1
                    while stack[i].tag not in tags:
                        i -= 1
                    close(i)
            top = stack[-1]
            main = tag in ("article", "main") or found.get("role", "").lower() in ("main", "article")
            named = named_as(tag, found, top.inside)
            sets, leaves = LEAVES.get(tag, (0, -1))
            implied = sets | top.implied & leaves
            step = top.key, tag, found.get("class", "")
            key = keys.get(step)
            if key is None:
                key = keys[step] = path_key(*step)
            node = Node(tag, key, is_noise(tag, found, top.inside), named, main and not named, top.inside or tag in ("article", "main"), implied)
            top.kids.append(node)
            if tag in RAW:
                end = raw_end(tag).search(source, at)
                at = source.find(">", end.end()) + 1 if end else 0
                at = at or len(source)  # one that isn't closed takes the rest
            elif tag not in VOID and (not m[3].rstrip().endswith("/") or tag in BLOCKS):
                if tag in WALLS:
                    opened.append((len(stack), {}))
                else:
                    opened[-1][1][tag] = opened[-1][1].get(tag, 0) + 1
                if tag in whole:
                    whole[tag] += 1
                stack.append(node)
    return root


def main_nodes(root: Node) -> list[Node]:
    """The outermost main and article elements outside of noise, in page order, or the whole page."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.main:
            out.append(n)
        else:
            stack += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.noise]
    return out or [root]


def weigh(nodes: list[Node], low: frozenset[int]) -> None:
    """Sets every node's size: the characters of text below it without noise and low branches."""
    stack = [(n, False) for n in nodes]
    while stack:
        n, done = stack.pop()
        if done:
            n.size = sum(k.size if isinstance(k, Node) else len(k.strip()) for k in n.kids if isinstance(k, str) or not _gone(k, low))
        else:
            stack.append((n, True))
            stack += [(k, False) for k in n.kids if isinstance(k, Node) and not _gone(k, low)]


def _gone(node: Node, low: frozenset[int]) -> bool:
    return node.noise or node.key in low


def _outermost_named(nodes: list[Node], low: frozenset[int], least: int = NAMED) -> list[Node]:
    out, stack = [], list(nodes)
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, Node) and not _gone(k, low):
                (out if k.named >= least else stack).append(k)
    return out


#: Text that must stay for the elements with noise names to go: characters, or a share.
ENOUGH, ENOUGH_SHARE = 120, 0.2


def drop_named(nodes: list[Node], low: frozenset[int]) -> None:
    """Makes comments noise unless they are all there is, and named elements but for those without which too little text stays."""
    weigh(nodes, low)
    said = _outermost_named(nodes, low, COMMENTS)
    if said and sum(k.size for k in said) < sum(n.size for n in nodes):
        for k in said:
            k.noise = True
        weigh(nodes, low)
    total = sum(n.size for n in nodes)
    heap = [(-k.size, i, k) for i, k in enumerate(_outermost_named(nodes, low))]
    heapify(heap)
    stays, made = total + sum(h[0] for h in heap), len(heap)
    while heap and stays < ENOUGH and stays < ENOUGH_SHARE * total:
        size, _, frame = heappop(heap)
        stays -= size
        for k in _outermost_named([frame], low):
            made += 1
            stays -= k.size
            heappush(heap, (-k.size, made, k))
    for _, _, k in heap:
        k.noise = True


def blocks(nodes: list[Node], low: frozenset[int]) -> list[str]:
    """Texts of the blocks below nodes, without noise, low branches and low blocks."""
    out: list[str] = []
    line: list[str] = []
    key = 0

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text and not (low and content_key(key, text) in low):
            out.append(text)

    stack: list = []
    for n in reversed(nodes):
        stack += [0, n, 0]
    while stack:
        x = stack.pop()
        if isinstance(x, int):
            end()
            key = x
        elif isinstance(x, str):
            line.append(x)
        elif _gone(x, low):
            if x.tag in BLOCKS:
                end()
        elif x.tag in ("br", "wbr"):
            line.append(" " if x.tag == "br" else "")
        else:
            if x.tag in BLOCKS:
                end()
                stack.append(key)
                key = x.key
            stack.extend(reversed(x.kids))
    end()
    return out


def main_text(source: str | None, low: frozenset[int] = frozenset()) -> str:
    if not source:
        return ""
    for nodes_low in (low, frozenset()) if low else (low,):
        nodes = main_nodes(parse(source))
        drop_named(nodes, nodes_low)
        found = blocks(nodes, nodes_low)
        if found:
            break
    return "\n\n".join(found)


def short_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def content_key(path: int, text: str) -> int:
    return short_hash(f"{path}#{text}")


PAGE_KEY = 0


def tree_rows(source: str) -> list[tuple[int, int, int]]:
    """(node, presentation, content): of every path in the main part of a page, its elements taken together; of every block of
    three words or more (0, 0); and one for the page itself."""
    seen: dict[int, tuple[list, list]] = {}
    nodes = main_nodes(parse(source))
    for top in nodes:
        stack = [(top, iter(top.kids), [])]
        while stack:
            node, kids, texts = stack[-1]
            for k in kids:
                if isinstance(k, str):
                    texts.append(k)
                elif not k.noise:
                    stack.append((k, iter(k.kids), []))
                    break
            else:
                stack.pop()
                text = " ".join("".join(texts).split())
                style, content = seen.setdefault(node.key, ([], []))
                style.append(",".join(k.tag for k in node.kids if isinstance(k, Node)))
                content.append(text if len(text) < 64 else str(short_hash(text)))
                if stack:
                    stack[-1][2].append(content[-1])
    rows = [(k, short_hash("|".join(s)), short_hash("\n".join(c))) for k, (s, c) in seen.items() if k]
    return [(PAGE_KEY, 0, 0), *rows, *((k, 0, 0) for k in content_keys(nodes))]


def content_keys(nodes: list[Node]) -> set[int]:
    """The content nodes of a page."""
    out, line = set(), []
    key, stack = 0, []
    for n in reversed(nodes):
        stack += [0, n, 0]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
            continue
        block = isinstance(x, int) or x.tag in BLOCKS
        if block and line:
            words = "".join(line).split()
            if len(words) >= 3:
                out.add(content_key(key, " ".join(words)))
            line.clear()
        if isinstance(x, int):
            key = x
        elif x.tag == "br":
            line.append(" ")
        elif not x.noise:
            if block:
                stack.append(key)
                key = x.key
            stack.extend(reversed(x.kids))
    return out


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


IMAGINARY = 2


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, importance) over all pages; pages as in with_host()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for host, source in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                source = source.as_py()
                if source:
                    page = short_hash(source)
                    rows += [(host, page, *r) for r in tree_rows(source)]
            if rows:
                host, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(x, pa.int64()) for x in rest)], names=["host", "page", "node", "style", "content"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, page long, node long, style long, content long").distinct()
    both = written(rows.groupBy("host", "node", "style", "content").agg(F.count("*").alias("n")), "tree-rows")
    is_element = (F.col("style") != 0) | (F.col("content") != 0)
    elements, texts = both.where(is_element), both.where(~is_element & (F.col("node") != PAGE_KEY))
    more = F.lit(IMAGINARY)

    def entropy(column: str) -> DataFrame:
        """With m real pages, over the logarithm of all; the imaginary pages' terms are log 1."""
        per = elements.groupBy("host", "node", column).agg(F.sum("n").alias("n"))
        out = per.groupBy("host", "node").agg((F.sum("n") + more).alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
        return out.select("host", "node", (1 - F.col("s") / F.col("m") / F.log("m")).alias(f"h_{column}"))

    tree = entropy("style").join(entropy("content"), ["host", "node"]).select("host", "node", ((F.col("h_style") + F.col("h_content")) / 2).alias("importance"))
    sizes = both.where(F.col("node") == PAGE_KEY).select("host", (F.col("n") + more).alias("pages"))
    common = texts.where(F.col("n") > 1).select("host", "node", "n").join(sizes, "host").select("host", "node", (1 - F.log("n") / F.log("pages")).alias("importance"))
    return tree.unionByName(common)


def extract(pages: DataFrame, least_importance: float = 0.2, broadcast_rows: int = 200_000) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    hosted = with_host(pages)
    low = style_tree(hosted).where(F.col("importance") < least_importance)
    by_host = written(low.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("low")), "style-tree")
    size = by_host.agg(F.coalesce(F.sum(F.size("low") + 4), F.lit(0))).first()[0]
    if size <= broadcast_rows:
        by_host = F.broadcast(by_host)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(s.as_py(), frozenset(p or ())) for s, p in zip(b.column("html"), b.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return hosted.join(by_host, "host", "left").select("page_id", "url", "html", "low").mapInArrow(run, LOW)
