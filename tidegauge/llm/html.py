"""Operator 9, HTML extraction by wrapper induction.

One page of each host and layout is its reference. All pages of that layout are
aligned with it by simple tree matching, and what their matched nodes say is counted:
a node that says the same on all pages that have it is template; what varies is
content. The wrapper is the reference with its
template nodes and the lowest node that holds all that varies (the article or main
around it, if there is one); nodes that take turns among a few texts, as adverts do,
don't widen it. Every page is then aligned with the reference of its host
and layout and read through the wrapper.

What varies and yet is no part of an article can't be told by alignment. Elements that
HTML itself sets apart (nav, footer, aside, form and so on) are left out before, and so
are containers whose class or id is one of a few words (``comments``, ``sidebar``);
parts of such names, and names of headings, paragraphs and items, don't count.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, stored, table

#: A node is template only if so many different pages have it. One whose texts are each on
#: as many pages, on average, takes turns and tells nothing of where the content is.
TEMPLATE_PAGES = 3
#: Characters of reference outlines that are broadcast at once; more hosts are read in blocks.
BLOCK_CHARS = 8_000_000
#: References that a task keeps unpacked.
KEPT = 500
#: An article or main that holds this share of all that varies is the content.
MAIN_SHARE = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
BOILERPLATE = frozenset("nav footer aside form button menu dialog head".split()) | RAW
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol dl table tbody thead select".split())
_CONTAINERS = frozenset("div section ul ol table dl".split())
#: Whole class and id names of containers that aren't part of an article.
_MARKS = re.compile(
    r"(?:ads?|advert(?:isement)?s?|sponsored|promo|banner|cookies?|cookie-(?:banner|bar|consent|notice)|consent|gdpr|notices?|menu|nav|navbar|breadcrumbs?|sidebar|widget|footer|masthead|"
    r"comments?|comment-list|replies|disqus|share|sharing|social|newsletter|subscribe|signup|login|popup|modal|pagination|pager|copyright)(?:[-_]?\d+)?",
    re.I,
)
#: Nodes that hold running text; alone they are no template.
_TEXTUAL = re.compile(r"(p|h[1-6]|li|dt|dd|blockquote|pre|td|th)(\.|$)")
_PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "label", "parts", "dropped", "inside")

    def __init__(self, tag: str, label: str, dropped: bool, inside: bool = False) -> None:
        self.tag, self.label, self.dropped = tag, label, dropped
        self.inside = inside or tag in ("article", "main")
        self.parts: list[Node | str] = []


def _node(tag: str, attributes: str, inside: bool) -> Node:
    names, dropped = "", tag in BOILERPLATE or tag == "header" and not inside
    if attributes and ("=" in attributes or "hidden" in attributes):
        for key, a, b, c in _NAMES.findall(attributes):
            value, key = a or b or c, key.lower()
            if key == "class":
                names = " ".join(sorted(re.sub(r"\d+", "0", value).lower().replace("/", "|").split()))
            if key in ("class", "id") and tag in _CONTAINERS:
                dropped |= any(_MARKS.fullmatch(x) for x in value.split())
            dropped |= key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower() or key == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search")
    return Node(tag, f"{tag}.{names}" if names else tag, dropped, inside)


def parse(text: str) -> Node:
    """A tree of any markup: unclosed paragraphs and items end where HTML says so,
    stray end tags are ignored, and everything open ends with the text."""
    root = Node("", "", False)
    stack, at, size = [root], 0, len(text)
    while at < size:
        m = _PIECE.search(text, at)
        if not m:
            stack[-1].parts.append(text[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(text[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # an inline end tag doesn't close a block
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in _ITEMS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _ITEMS[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in _LISTS:
                    break
        elif tag == "body" and any(x.tag == "head" for x in stack):
            del stack[next(i for i, x in enumerate(stack) if x.tag == "head") :]
        node = _node(tag, m[3], stack[-1].inside)
        stack[-1].parts.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(text, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def text_of(nodes: list[Node], left_out: frozenset[int] | set[int] = frozenset()) -> str:
    """Their text: references decoded, blocks in page order joined by one space.
    Nodes whose id() is in ``left_out`` are passed over."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        gap = () if x.tag in INLINE else (" ",)
        out += gap
        if not x.dropped and id(x) not in left_out:
            stack += gap
            stack += reversed(x.parts)
        else:
            out.append(" ")
    return " ".join(entities.unescape("".join(out)).split())


# --- outlines and their alignment ------------------------------------------


class Block:
    """A block of a page: its own text (that of inline nodes included), the blocks in
    it, and the page's nodes that it stands for. Neighbours of one label and structure
    are one block, so a run of paragraphs or records is."""

    __slots__ = ("label", "own", "size", "inner", "whole", "total", "form", "count", "nodes")

    def __init__(self, label: str, own: int = 0, size: int = 0, inner: list[Block] | None = None, nodes: list[Node] | None = None) -> None:
        self.label, self.own, self.size, self.inner, self.nodes = label, own, size, inner or [], nodes or []
        parts = [own, size, *(x for b in self.inner for x in (zlib.crc32(b.label.encode("utf-8", "surrogatepass")), b.whole))]
        self.whole = zlib.crc32(b"%d," * len(parts) % tuple(parts))
        self.total = size + sum(b.total for b in self.inner)
        self.form = hash((label, tuple(b.form for b in self.inner)))
        self.count = 1 + sum(b.count for b in self.inner)


def _own(node: Node) -> tuple[str, list[Node]]:
    """A node's own text, and the blocks that stand in it."""
    text: list[str] = []
    blocks: list[Node] = []
    stack: list[Node | str] = list(reversed(node.parts))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            text.append(x)
        elif x.tag in INLINE:
            if not x.dropped:
                stack += reversed(x.parts)
        elif not x.dropped and x.tag not in VOID:
            blocks.append(x)
    return " ".join("".join(text).split()), blocks


def outline(root: Node) -> Block:
    """The page's blocks without dropped ones."""
    order, found = [root], {}
    for node in order:  # grows; what stands in a node comes after it
        found[id(node)] = text, blocks = _own(node)
        order += blocks
    made: dict[int, Block] = {}
    for node in reversed(order):
        text, blocks = found[id(node)]
        inner: list[Block] = []
        for b in (made.pop(id(x)) for x in blocks):
            last = inner[-1] if inner else None
            if last and last.label == b.label and (last.form == b.form or not last.inner and len(last.nodes) > 1 and not b.inner):
                inner[-1] = Block(b.label, zlib.crc32(b"%d %d" % (last.whole, b.whole)), last.total + b.total, None, last.nodes + b.nodes)
            else:
                inner.append(b)
        made[id(node)] = Block(node.label, zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text), inner, [node])
    return made[id(root)]


def in_order(root: Block) -> list[Block]:
    """A block and all in it, each before what stands in it, in page order."""
    out, stack = [], [root]
    while stack:
        b = stack.pop()
        out.append(b)
        stack += reversed(b.inner)
    return out


def packed(root: Block) -> str:
    """Labels and numbers of inner blocks, in order."""
    return json.dumps([[b.label, len(b.inner)] for b in in_order(root)])


def unpacked(text: str) -> Block:
    rows = json.loads(text)
    done: list[Block] = []
    for label, n in reversed(rows):
        inner = [done.pop() for _ in range(n)]
        done.append(Block(label, inner=inner))
    return done[0]


def match(a: Block, b: Block) -> tuple[int, list[tuple[Block, Block]]]:
    """Simple tree matching: the largest number of pairs of equal labels that keep
    ancestry and order, and those pairs. Equal structures match as a whole, also at the
    ends of two rows of blocks, where matching them is always among the best."""
    if a.label != b.label:
        return 0, []

    def core(x: Block, y: Block) -> tuple[int, int, int]:
        """How many blocks at both ends have equal structure: at the front, and the ends of the rest."""
        n, m, at = len(x.inner), len(y.inner), 0
        while at < min(n, m) and x.inner[at].form == y.inner[at].form:
            at += 1
        while n > at and m > at and x.inner[n - 1].form == y.inner[m - 1].form:
            n, m = n - 1, m - 1
        return at, n, m

    order = [(a, b)]
    for x, y in order:  # grows: pairs that can match if those above do
        if x.form != y.form:
            at, n, m = core(x, y)
            order += [(p, q) for p in x.inner[at:n] for q in y.inner[at:m] if p.label == q.label]
    weight: dict[tuple[int, int], int] = {}

    def table_of(x: Block, y: Block) -> tuple[int, int, int, list[list[int]]]:
        at, n, m = core(x, y)
        best = [[0] * (m - at + 1) for _ in range(n - at + 1)]
        for i in range(n - at):
            for j in range(m - at):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight.get((id(x.inner[at + i]), id(y.inner[at + j])), 0))
        return at, n, m, best

    for x, y in reversed(order):
        if x.form == y.form:
            weight[id(x), id(y)] = x.count
        elif (id(x), id(y)) not in weight:
            at, n, m, best = table_of(x, y)
            weight[id(x), id(y)] = 1 + best[-1][-1] + sum(p.count for p in x.inner[:at]) + sum(p.count for p in x.inner[n:])
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        if x.form == y.form:
            pairs += zip(in_order(x), in_order(y), strict=True)
            continue
        pairs.append((x, y))
        at, n, m, best = table_of(x, y)
        stack += zip(x.inner[:at], y.inner[:at], strict=True)
        stack += zip(x.inner[n:], y.inner[m:], strict=True)
        i, j = n - at, m - at
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                stack.append((x.inner[at + i], y.inner[at + j]))
    return weight[id(a), id(b)], pairs


def _is_article(label: str) -> bool:
    return label.split(".")[0] in ("article", "main")


def layout(page: Block) -> str:
    """A name of the page's layout: the labels of the blocks side by side at the first
    level that has several, and the path to it."""
    at: list[str] = []
    while True:
        blocks = {c.label: c for c in page.inner if not _TEXTUAL.match(c.label) and c.label not in _LISTS}
        at.append("\n".join(sorted(blocks)))
        if len(blocks) != 1 or _is_article(at[-1]):
            return "%08x" % zlib.crc32("/".join(at).encode("utf-8", "surrogatepass"))
        page = blocks.popitem()[1]


# --- wrappers --------------------------------------------------------------


class Wrapper:
    """A reference, the numbers of its template blocks and of the one that holds the
    content. It travels packed."""

    def __init__(self, packed: str, template: frozenset[int] = frozenset(), content: int = 0) -> None:
        self.packed, self.template, self.content = packed, template, content
        self.reference = unpacked(packed)
        self.numbers = {id(b): i for i, b in enumerate(in_order(self.reference))}

    def __reduce__(self) -> tuple:
        return Wrapper, (self.packed, self.template, self.content)

    def aligned(self, page: Block) -> Iterator[tuple[int, Block]]:
        """(number in the reference, block of the page) of all that match."""
        for a, b in match(self.reference, page)[1]:
            yield self.numbers[id(a)], b


def induced(reference: str, slots: list[tuple[int, int, int, int, int]]) -> Wrapper | None:
    """The wrapper from (number, pages, texts, own texts, characters) of the reference's
    blocks; None where nothing varies."""
    w = Wrapper(reference)
    blocks, up = in_order(w.reference), {}
    for i, b in enumerate(blocks):
        for c in b.inner:
            up[w.numbers[id(c)]] = i

    def above(i: int) -> list[int]:
        """From the root to the block."""
        out = [i]
        while out[-1] in up:
            out.append(up[out[-1]])
        return out[::-1]

    seen = {i: (n, texts, own, size) for i, n, texts, own, size in slots}
    fixed = {
        i for i, (n, texts, _, _) in seen.items()
        if i and texts == 1 and n >= TEMPLATE_PAGES and not _TEXTUAL.match(blocks[i].label) and not _is_article(blocks[i].label) and blocks[i].label.split(".")[0] not in ("html", "body")
    }
    varies = [i for i, (n, _, own, _) in seen.items() if own and n < TEMPLATE_PAGES * own and not fixed & set(above(i))]
    if not varies:
        return None
    paths = [above(i) for i in varies]
    shared = [x[0] for x in zip(*paths, strict=False) if len(set(x)) == 1]
    while len(shared) > 1 and _TEXTUAL.match(blocks[shared[-1]].label):
        shared.pop()
    content = next((i for i in shared if _is_article(blocks[i].label)), None)
    if content is None:
        content = shared[-1]
        mass = {i: 0 for i in range(len(blocks))}
        for i, path in zip(varies, paths, strict=True):
            for j in path:
                mass[j] += seen[i][3]
        main = [j for j in range(len(blocks)) if _is_article(blocks[j].label) and mass[j] >= MAIN_SHARE * mass[content]]
        content = main[0] if main else content
    return Wrapper(reference, frozenset(fixed), content)


def articles(root: Node) -> list[Node]:
    """The outermost article and main nodes."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.tag in ("article", "main"):
            out.append(x)
        else:
            stack += [y for y in reversed(x.parts) if not isinstance(y, str) and not y.dropped]
    return out


def extract(html: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page: through the wrapper, else of all its articles, else of
    the whole page without boilerplate."""
    if not html:
        return ""
    root = parse(html)
    return read_through(root, outline(root) if wrapper else None, wrapper)


def read_through(root: Node, page: Block | None, wrapper: Wrapper | None) -> str:
    if wrapper:
        left_out, content = set(), []
        for i, b in wrapper.aligned(page):
            if i in wrapper.template:
                left_out |= {id(x) for x in b.nodes}
            if i == wrapper.content:
                content = b.nodes
        if text := text_of(content, left_out):
            return text
    return text_of(articles(root)) or text_of([root])


def _host(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def references(pages: DataFrame) -> DataFrame:
    """(host, layout, outline): the page of smallest hash of each host and layout, and
    of each host as layout ''. Of ``pages`` (page, host, html)."""

    def kernel(batch: pa.RecordBatch) -> dict[str, object]:
        best: dict[tuple[str, str], tuple[int, str]] = {}
        for page, host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block = outline(parse(text))
            for key in ((host, layout(block)), (host, "")):
                if key not in best or page < best[key][0]:
                    best[key] = page, packed(block)
        return {"host": [k[0] for k in best], "layout": [k[1] for k in best], "page": [x[0] for x in best.values()], "outline": [x[1] for x in best.values()]}

    each = map_batches(pages.select("page", "host", "html"), kernel, "host string, layout string, page long, outline string", 2)
    return each.groupBy("host", "layout").agg(F.min(F.struct("page", "outline")).alias("x")).select("host", "layout", "x.outline")


def slots(pages: DataFrame, sent: dict[tuple[str, str], str]) -> DataFrame:
    """(host, layout, slot, pages, texts, own, size) of all blocks of the references
    ``sent`` by (host, layout): on how many different pages a block is, how many texts
    and own texts it has there, and its own characters on all of them."""
    shared = pages.sparkSession.sparkContext.broadcast(sent)
    known: dict[tuple[str, str], Wrapper] = {}

    def kernel(batch: pa.RecordBatch) -> dict[str, object]:
        rows = set()
        for page, host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block = outline(parse(text))
            for key in ((host, layout(block)), (host, "")):
                if len(known) > KEPT:
                    known.clear()
                w = known.get(key) or known.setdefault(key, Wrapper(shared.value[key]))
                rows |= {(*key, i, b.own if b.size else None, b.whole, b.size, page) for i, b in w.aligned(block) if b.total}
        return dict(zip(("host", "layout", "slot", "own", "whole", "size", "page"), map(list, zip(*rows, strict=True)) if rows else [[]] * 7, strict=True))

    each = map_batches(pages.select("page", "host", "html"), kernel, "host string, layout string, slot int, own long, whole long, size long, page long", 2)
    texts = each.distinct().groupBy("host", "layout", "slot", "own", "whole").agg(F.count("*").alias("pages"), F.sum("size").alias("size"))
    return texts.groupBy("host", "layout", "slot").agg(F.sum("pages").alias("pages"), F.count("*").alias("texts"), F.count_distinct("own").alias("own"), F.sum("size").alias("size"))


def wrappers(pages: DataFrame, sent: dict[tuple[str, str], str]) -> dict[tuple[str, str], tuple]:
    """The wrappers, packed, of layouts that at least TEMPLATE_PAGES different pages have."""
    by: dict[tuple[str, str], list] = {}
    for r in slots(pages, sent).collect():  # as many rows as the references have blocks
        by.setdefault((r.host, r.layout), []).append((r.slot, r.pages, r.texts, r.own, r["size"]))
    made = {k: induced(sent[k], rows) for k, rows in by.items() if max(x[1] for x in rows) >= TEMPLATE_PAGES}
    return {k: (w.packed, w.template, w.content) for k, w in made.items() if w}


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    The whole html is read through the wrapper of its url's host and its layout; of
    all pages of the host if its layout has fewer than TEMPLATE_PAGES different ones.
    Hosts with fewer, pages without a host and pages on which the wrapper finds nothing
    are read by their own structure (the articles, or all that is no boilerplate). Null or empty html gives an empty
    text; null ids, repeated rows (one page when counting) and extra columns change
    nothing; of pages with equal hashes either may be the reference, they are equal;
    an empty table gives none.

    Scale: a page is parsed once to find references, once to count and once to read,
    where it lies; html is never shuffled. Executors sum up a batch before rows are
    exchanged, and a slot's texts are counted by text first, so a hot host is spread. What is
    sent out at once is bounded by BLOCK_CHARS; more hosts than that are read in blocks.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    slim = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), _host("url").alias("host"))
    known = slim.where("host <> '' and html <> ''").select(F.xxhash64("html").alias("page"), "host", "html")
    refs = stored(references(known), "references")
    chars = refs.agg(F.sum(F.length("outline") + F.length("host") + 50)).first()[0] or 0
    n = 1 + chars // BLOCK_CHARS
    out = None
    for b in range(n):
        def own(df: DataFrame, b: int = b) -> DataFrame:
            return df if n == 1 else df.where(F.pmod(F.xxhash64("host"), F.lit(n)) == b)  # a null host has a hash too

        sent = {(r.host, r.layout): r.outline for r in own(refs).collect()}
        found = pages.sparkSession.sparkContext.broadcast(wrappers(own(known), sent))
        kept: dict[tuple[str, str], Wrapper] = {}

        def read(batch: pa.RecordBatch, found=found, kept=kept) -> dict[str, object]:
            texts = []
            for html, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                root = parse(html or "")
                page = wrapper = None
                if (host, "") in found.value:
                    page = outline(root)
                    key = (host, layout(page))
                    key = key if key in found.value else (host, "")
                    if len(kept) > KEPT:
                        kept.clear()
                    wrapper = kept.get(key) or kept.setdefault(key, Wrapper(*found.value[key]))
                texts.append(read_through(root, page, wrapper))
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

        part = map_batches(own(slim), read, f"page_id {kind}, url string, text string, n_chars long", 2)
        out = part if out is None else out.union(part)
    discard(refs)
    return out


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
